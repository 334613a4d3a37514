"""Bounded, deterministic training samples, with features made from whole texts on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, utf8
from .hashing import sparse


def balanced(rows: DataFrame, label: str, key: str, per_label: int, labels: int = 200) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each label, chosen by a hash of ``key``, and the count of each label in all rows.

    Of more than ``labels`` labels the most frequent are learned. One narrow aggregation and a filter: no row is
    shuffled. ``rows`` should be narrow up to here.
    """
    often = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(labels)
    counts = {r[0]: r[1] for r in often.collect()}
    if not counts:
        return rows.limit(0), {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    spread = (F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)).cast("double")
    return rows.where(spread < F.element_at(share, F.col(label))), counts


def collect_features(rows: DataFrame, label: str, text: str, key: str, bits: int, most: int, pairs: bool = False) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """(label, buckets, shares) of ``most`` rows at most, in a fixed order; the texts stay on the executors."""
    kind = rows.schema[label].dataType
    schema = T.StructType([T.StructField("o", T.LongType()), T.StructField("y", kind), T.StructField("b", T.BinaryType()), T.StructField("v", T.BinaryType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sparse(t, bits, pairs) for t in utf8(batch.column(2))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.astype("<u4").tobytes() for b, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["o", "y", "b", "v"])

        return step

    picked = rows.select(F.xxhash64(F.col(key), F.lit("order")).alias("o"), F.col(label).alias("y"), F.col(text).alias("t"))
    out = map_batches(picked, make, schema).orderBy("o", "y", "b", "v").limit(most).collect()
    return [(r.y, np.frombuffer(r.b, "<u4").astype(np.intp), np.frombuffer(r.v, "<f4").astype(np.float64)) for r in out]
