"""Best-fit packing of token sequences by exact-complement hashing.

Documents are encoded, ended by a separator id, and cut only if longer than a sequence. The plan is
made from the number of pieces of each length alone, which is a table of ``capacity`` rows whatever the
input: for each length, longest first, single, pair and triple sums of shorter lengths that fill its
gap exactly are looked up in hash indexes and consumed as long as all counts last; what is left over
goes best-fit. A plan is a list of patterns (lengths) with how often each is used. Pieces are then
numbered within their length, without bringing one length to one task, and look their place up.

Defined results: null or empty text is a piece of the separator alone. Repeated rows are packed each.
Ids may be of any type and null; they are only carried along. Pieces of equal length are interchangeable, so
ties go to any of them. Extra columns are ignored. An empty table gives no pieces. Texts of any length are
encoded whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches
from .tokens import encoder

CAPACITY, SEPARATOR = 1024, 2


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces of a sequence, number of such sequences) that use up ``counts``.

    Small pieces spent on exact triples may be missed later where pieces are few, so the plans with
    complements of up to one, two and three pieces are compared; the fewest sequences win.
    """
    plans = [_plan(counts, capacity, depth) for depth in (3, 2, 1)]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _plan(counts: dict[int, int], capacity: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    left = {n: c for n, c in counts.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if c := left.pop(capacity, 0):
        out.append(((capacity,), c))

    def take(parts: tuple[int, ...]) -> bool:
        need = {n: parts.count(n) for n in parts}
        times = min(left.get(n, 0) // k for n, k in need.items())
        if times:
            out.append((parts, times))
            for n, k in need.items():
                left[n] -= k * times
                if not left[n]:
                    del left[n]
        return bool(times)

    pairs: dict[int, list[tuple[int, int]]] = {}  # sum -> pairs, the more even first
    lengths = sorted(left)
    for i, a in enumerate(lengths if depth > 1 else ()):
        for b in lengths[i:]:
            if a + b < capacity:
                pairs.setdefault(a + b, []).append((b, a))
    for n in sorted(left, reverse=True):
        gap = capacity - n
        if n in left and gap in left:
            take((n, gap))
        for b, a in sorted(pairs.get(gap, ())) if n in left else ():
            if a in left and b in left:
                take((n, b, a))
                if n not in left:
                    break
        if n in left and depth > 2:  # triples: a single and the pair that completes it
            for c in sorted((x for x in left if x < gap), reverse=True):
                for b, a in pairs.get(gap - c, ()) if n in left and c in left else ():
                    if b <= c and a in left and b in left:
                        take((n, c, b, a))
                        if n not in left or c not in left:
                            break
                if n not in left:
                    break
    return out + best_fit(left, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal bins are one entry, filled together."""
    bins: dict[tuple[int, ...], int] = {}
    gaps: dict[int, list[tuple[int, ...]]] = {}
    order: list[int] = []

    def put(parts: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(parts)
        if parts not in bins:
            if gap not in gaps:
                insort(order, gap)
            gaps.setdefault(gap, []).append(parts)
        bins[parts] = bins.get(parts, 0) + times

    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                if c >= each:
                    put((n,) * each, c // each)
                if c % each:
                    put((n,) * (c % each), 1)
                break
            gap = order[at]
            parts = gaps[gap][-1]
            times, fit = bins[parts], min(gap // n, c)
            used = min(times, c // fit)
            if used == times:
                gaps[gap].pop()
                del bins[parts]
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                bins[parts] -= used
            put((*parts, *(n,) * fit), used)
            c -= used * fit
    return list(bins.items())


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> for its pieces by number: first number, sequence less that number, and offset of each stretch."""
    found: dict[int, list[list[int]]] = {}
    base = 0
    for parts, times in patterns:
        at = 0
        for n in parts:
            rows = found.setdefault(n, [[0], [], []])
            first = rows[0][-1]
            rows[0].append(first + times)
            rows[1].append(base - first)
            rows[2].append(at)
            at += n
        base += times
    return {n: (np.array(r[0][:-1]), np.array(r[1]), np.array(r[2])) for n, r in found.items()}


PIECES = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, buckets: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, bucket): documents cut to ``capacity`` ids; the first piece may be shorter.

    A task deals its pieces to the buckets in turn, so pieces that are equal in everything are spread too.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *PIECES, T.StructField("bucket", T.IntegerType())])

    def make():
        own, end = encoder(path), np.array([separator], "<u4").tobytes()
        turn = None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal turn
            who, rows = [], []
            for i, ids in enumerate(own.batch([t or "" for t in batch.column(1).to_pylist()])):
                raw = ids.tobytes() + end
                n = len(raw) // 4
                begin, stop, k = 0, (n - 1) % capacity + 1, 0
                while begin < n:
                    who.append(i)
                    rows.append((k, begin, stop - begin, zlib.crc32(raw[4 * begin : 4 * stop])))
                    begin, stop, k = stop, stop + capacity, k + 1
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            if turn is None:  # tasks begin at different buckets
                turn = int(cols[3][0]) if len(rows) else 0
            dealt = ((np.arange(len(rows)) + turn) % buckets).astype(np.int32)
            turn += len(rows)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:]), pa.array(dealt)], names=schema.names)

        return step

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, schema)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Pieces with sequence_id and offset in it."""
    spark = docs.sparkSession
    # numbers within a length, in two levels: buckets of rows have their own counts, so no length meets in one task
    buckets = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucketed = cut(pieces(docs, path, id_col, text_col, capacity, separator, buckets), "pieces")
    counted = cut(bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    totals = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(places(plan(totals, capacity)))
    before = counted.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    numbered = bucketed.withColumn("own", own).join(before, ["bucket", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("number"))
    schema = T.StructType([*bucketed.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                mask = length == n
                first, base, at = shared.value[int(n)]
                k = np.searchsorted(first, number[mask], "right") - 1
                sequence[mask], offset[mask] = number[mask] + base[k], at[k]
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=schema.names)

        return step

    return map_batches(numbered, make, schema)
