"""System-table schemas, signal types, statuses and exceptions."""

from __future__ import annotations

from pyspark.sql import types as T

FEATURE, TARGET, AS_OF, SPARSE, RUNTIME = "feature", "target", "as_of_feature", "sparse_feature", "runtime_computed"
PENDING, SUCCESS, FAILED, ROLLED_BACK = "pending", "success", "failed", "rolled_back"
NO_TABLE = "n/a"
ERROR_CHARS = 2000


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()
DEFAULT_INDEX = _schema(timestamp=_TS, symbol=_S)
FEATURE_METADATA = _schema(feature_name=_S, version=_L, table_addr=_S, owner=_S, signal_type=_S, feature_params=_S)
TRANSACTION_LOG = _schema(transaction_id=_S, status=_S, owner=_S, signal_type=_S, started_at=_TS, updated_at=_TS, error=_S)
ANNOTATIONS = T.StructType([*FEATURE_METADATA.fields, T.StructField("comment", _S), T.StructField("tags", T.ArrayType(_S))])


def table_metadata(primary: T.DataType) -> T.StructType:
    return _schema(table_addr=_S, last_updated=primary, update_timestamp=_TS)


class MissingFeaturesException(KeyError):
    """None of the requested features is known."""


class UninitializedLakeException(ValueError):
    """The lake has no system tables yet."""


class MissingOrMisregisteredSignalsException(ValueError):
    """A requested target isn't registered as one."""


class ConcurrentWriteError(RuntimeError):
    """Another writer has published the version that was to be published."""
