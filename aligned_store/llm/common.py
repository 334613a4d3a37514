"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import scratch, shared_dir

__all__ = ["scratch", "shared_dir"]

#: A side of a join is broadcast only when a count has shown it to be at most this many narrow rows.
BROADCAST_ROWS = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table behind a frame made by :func:`cut`, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, _UPPER, _UPPER.lower())


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores put before it until no column is called so (Spark ignores case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a materialised narrow side, broadcast when its counted size allows, else by a shuffle."""
    if right.count() <= limit:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("shuffle_hash"), on, how)


#: A side of :func:`lookup` is sent to all tasks up to so many rows, which are about a megabyte.
FEW_ROWS = 20_000
#: Keys that hold more than this share of the rows of a join are met one by one; there are no more of them than its inverse.
HOT_SHARE = 1 / 2048


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int = FEW_ROWS) -> DataFrame:
    """Join rows to a side with one row for each key, so that no hot key's rows meet in one task.

    A right side of ``limit`` narrow rows at most is sent to all tasks. Beyond that, the keys that hold more than
    ``HOT_SHARE`` of the left rows are counted; there are fewer than 2,048, whatever the input, so their right rows
    are sent, and only rows of other keys are shuffled. Both sides should be written tables. Null keys match nothing.
    """
    if right.count() <= limit:
        return left.join(F.broadcast(right), on, how)
    least = int(left.count() * HOT_SHARE)
    hot = cut(left.dropna(subset=on).groupBy(*on).count().where(F.col("count") > least).drop("count"), "hot")
    if hot.isEmpty():
        return left.join(right.hint("shuffle_hash"), on, how)
    few = right.join(F.broadcast(hot), on, "left_semi")
    warm = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how)
    return warm.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right.hint("shuffle_hash"), on, how))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with a function made once per task.

    Batches are kept small, so that a worker's memory doesn't follow the default of 10,000 rows, however long.
    Workers go from task to task, so at its end each gives back what its task has freed.
    """
    lean_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = begin_task(make)
        try:
            for batch in batches:
                for part in bounded(batch):
                    out = step(part)
                    if out is not None and out.num_rows:
                        yield out
        finally:
            del step
            give_back()

    return df.mapInArrow(run, schema)


#: What this worker holds for its next task, and which of it the present task has asked for.
_HELD: dict[str, object] = {}
_ASKED: set[str] = set()


def held(key: str, make: Callable[[], object]):
    """The object of that key, made once in a worker and let go when a task begins that doesn't ask for it."""
    _ASKED.add(key)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def begin_task(make: Callable[[], Callable]) -> Callable:
    _ASKED.clear()
    step = make()
    for key in set(_HELD) - _ASKED:
        del _HELD[key]
    return step


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lower the session's Arrow batch size to ``rows``, if it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def bounded(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes each, one row at least, so that work arrays stay small."""
    n = batch.num_rows
    step = max(1, int(n * most / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array], replace: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    """The batch with columns appended, and some replaced in place (by position of their first name)."""
    own = list(batch.schema.names)
    cols = [(replace or {}).get(n, batch.column(i)) for i, n in enumerate(own)]
    return pa.RecordBatch.from_arrays(cols + arrays, names=own + names)


def held_out(id_col, modulus: int, remainder: int):
    """Whether crc32 of the id as text (a null id: of the empty text) leaves ``remainder``."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
