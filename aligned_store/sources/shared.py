"""The folder that driver and executors share."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, in local mode only, a temporary folder of this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or "cluster" in master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="aligned-store-")
    return shared_dir.own


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few rows as a local relation: no Python worker makes them, as it would rows given as a list.

    A timestamp without a time zone is in this process's, as in ``createDataFrame``.
    """
    zoned = {i for i, f in enumerate(schema.fields) if isinstance(f.dataType, T.TimestampType)}

    def value(i: int, x):
        return x.astimezone() if i in zoned and isinstance(x, dt.datetime) and x.tzinfo is None else x

    shape = to_arrow_schema(schema)
    columns = [pa.array([value(i, r[i]) for r in rows], f.type) for i, f in enumerate(shape)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=shape), schema)


DAY_US = 86_400 * 10**6
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def whole(column: Column, kind: T.DataType) -> Column:
    """A date or time as a whole number that no time zone enters into: days, or microseconds since 1970.

    A time without a zone counts as if it were in UTC. Other types are left as they are.
    """
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(column.cast("date")).cast("long") * F.lit(DAY_US)
        clock = F.hour(column) * F.lit(3600) + F.minute(column) * F.lit(60)
        return day + clock.cast("long") * F.lit(10**6) + (F.extract(F.lit("SECOND"), column) * F.lit(10**6)).cast("long")
    return column


def micros(x: dt.datetime) -> int:
    """Microseconds since 1970; a time without a zone is in this process's."""
    return (x.astimezone(dt.UTC) - _EPOCH) // dt.timedelta(microseconds=1)


def literal(value, kind: T.DataType) -> Column:
    """A bound as a column of the key's type.

    A naive ``datetime`` is a wall clock for keys without a zone; for keys with one it is in this process's zone, as
    everywhere in PySpark. One with a zone is a moment; for keys without a zone it is read in the session's.
    """
    if isinstance(value, dt.datetime):
        if isinstance(kind, T.TimestampNTZType) and value.tzinfo is None:
            return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
        value = value if value.tzinfo else value.astimezone()
        return F.lit(value).cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else F.lit(value)
    if isinstance(value, str) and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(value).cast(kind)
    return F.lit(value)


def spark_schema(schema) -> T.StructType:
    """A Spark schema, of an Arrow schema too."""
    return from_arrow_schema(schema) if isinstance(schema, pa.Schema) else schema


def spark_frame(spark: SparkSession, df) -> DataFrame:
    """A DataFrame, of an Arrow table or record batch or a pandas frame too; these are held by the driver."""
    if isinstance(df, DataFrame):
        return df
    if isinstance(df, pa.RecordBatch):
        df = pa.Table.from_batches([df])
    if isinstance(df, pa.Table) or type(df).__module__.partition(".")[0] == "pandas":
        return spark.createDataFrame(df)
    raise TypeError(f"a DataFrame, an Arrow table or a pandas frame is wanted, not {type(df).__name__}")


def arrow_frame(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.Table | pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """A DataFrame of the Arrow tables or record batches that tasks make of a frame's; none passes through the driver.

    They have the columns of ``schema``, in any order and in types that Arrow casts to these without loss.
    """
    kind = to_arrow_schema(schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in make(batches):
            table = pa.Table.from_batches([x]) if isinstance(x, pa.RecordBatch) else x
            yield from table.select(kind.names).cast(kind).to_batches()

    return df.mapInArrow(made, schema)


def wider(spark: SparkSession, name: str, a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both, as a union of them has it; text and other kinds don't mix."""
    if isinstance(a, T.StringType) != isinstance(b, T.StringType):
        raise TypeError(f"{name} is {a.simpleString()} in the lake and {b.simpleString()} here")
    frame = lambda kind: local_frame(spark, [], T.StructType([T.StructField("x", kind)]))
    try:
        return frame(a).union(frame(b)).schema["x"].dataType
    except AnalysisException as e:
        raise TypeError(f"{name} is {a.simpleString()} in the lake and {b.simpleString()} here") from e
