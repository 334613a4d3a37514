from .table_io import CODECS, ParquetTableIO, TableIO

__all__ = ["CODECS", "ParquetTableIO", "TableIO"]
