"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into a hierarchy of phrases. On each level runs of one symbol become one
symbol; deterministic coin tossing (the lowest bit in which a symbol differs from the one before it,
and its value there, three times over) gives labels below eight, unequal between neighbours; a phrase
begins where a label is a local maximum, and is named by a hash of its symbols, the symbols of the next
level. Where phrases begin depends on a few symbols around only, so equal substrings share all names but
those near their ends, wherever they stand. The fingerprint keeps, for the names of three levels, a byte
of the least hash of each of 64 classes of names; likeness is the share of equal classes among those
filled in either.

Defined results: null and empty text have no names, a fingerprint of empty classes, and likeness 1 to
each other. A document's next is the one after it by (doc_id, hash of the text), nulls first, and the
first follows the last; so repeated rows follow each other, and a lone row follows itself. Ids may be of any type
that has an order. Extra columns are ignored. An empty table gives no rows. A text of any length is parsed
whole, which takes some 60 bytes of a worker's memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.layout import at_most
from ..sources.shared import local_frame
from .common import lean_batches

CLASSES, EMPTY, LEVELS = 64, 0xFF, (2, 3, 4)
#: Rows for each range by which the ranges are cut, and the bytes of text that make a range, if there are more than of shuffles.
SAMPLE, RANGE_BYTES = 40, 64 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
#: label of a symbol below 64 after one below 64
_TOSS = np.array([[2 * (b := ((x ^ y) & -(x ^ y)).bit_length() - 1 if x != y else 0) + (x >> b & 1) for x in range(64)] for y in range(64)], np.uint8).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _level(names: np.ndarray, begin: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One level up: phrase names, and where each text's phrases begin. ``begin`` ascends and ends with the total."""
    n = len(names)
    head = np.zeros(n, bool)
    head[begin[:-1][begin[:-1] < n]] = True
    new = head.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    if len(at) < n:  # runs
        run = np.diff(np.append(at, n))
        names = np.where(run > 1, _mixed(names[at] + run.astype(np.uint64) * _MIX2), names[at])
        head = head[at]
        begin = np.searchsorted(at, begin)
        n = len(at)
    before = np.empty_like(names)
    before[1:], before[:1] = names[:-1], 0
    differ = names ^ before
    bit = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) & np.uint8(63)
    label = ((bit & np.uint8(31)) << np.uint8(1)) | ((names >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    label[head] = 0  # what stands before a text has no part in it
    for _ in range(2):
        pair = label.astype(np.uint16)
        pair[1:] |= label[:-1].astype(np.uint16) << np.uint16(6)
        label = _TOSS[pair]
        label[head] = 0
    cut = head.copy()
    if n > 2:
        # a local maximum; the last symbol of a text can't be one, as its right neighbour is not known
        cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~head[2:] & ~head[:-2]
    at = np.flatnonzero(cut)
    if not len(at):
        return names[:0], np.zeros_like(begin)
    place = np.arange(n, dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, n))).astype(np.uint64)
    part = _mixed(names + (place + np.uint64(1)) * _MIX2 + np.uint64(level))
    return _mixed(np.add.reduceat(part, at)), np.searchsorted(at, begin)


def fingerprints(texts: list[bytes], levels: tuple[int, ...] = LEVELS) -> np.ndarray:
    """(texts x levels * CLASSES) bytes: of the least hash of each class on each level; EMPTY where a class has none."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        names = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
        least = np.full((len(texts), len(levels) * CLASSES), 1 << 32, np.int64)
        for level in range(1, max(levels) + 1):
            if len(names):
                names, begin = _level(names, begin, level)
            if level in levels and len(names):
                who = np.repeat(np.arange(len(texts)), np.diff(begin))
                slot = (names >> np.uint64(58)).astype(np.int64) + CLASSES * levels.index(level) + who * least.shape[1]
                np.minimum.at(least.reshape(-1), slot, ((names >> np.uint64(20)) & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return np.where(least >> 32, EMPTY, least % EMPTY).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, on the coarsest level that fills half of its classes in either text, else on all levels together."""
    either, same = (a != EMPTY) | (b != EMPTY), (a == b) & (a != EMPTY)
    n, k = either.sum(1), same.sum(1)
    for at in range(0, a.shape[1], CLASSES):  # coarser levels come later and win
        level_n = either[:, at : at + CLASSES].sum(1)
        full = level_n >= CLASSES // 2
        n, k = np.where(full, level_n, n), np.where(full, same[:, at : at + CLASSES].sum(1), k)
    return np.where(n > 0, k / np.maximum(n, 1), 1.0)


def text_of(fp: np.ndarray) -> str:
    return fp.tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many, or all, of the next text's first."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_OUT = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def _rows(chunk: list[tuple[object, str, str]]) -> dict[str, list]:
    """chunk: id, text, next text of consecutive documents."""
    edits = [edited(t, f) for _, t, f in chunk]
    own = [t.encode() for _, t, _ in chunk]
    new = [e.encode() for e in edits]
    fps = fingerprints([*own, chunk[-1][2].encode(), *new])
    n = len(chunk)
    mine, after, changed = fps[:n], fps[1 : n + 1], fps[n + 1 :]
    return {"n_chars": [len(t) for _, t, _ in chunk], "edited_sha256": [hashlib.sha256(e).hexdigest() for e in new], "fingerprint": list(map(text_of, mine)), "edited_fingerprint": list(map(text_of, changed)), "near_edited": likeness(mine, changed).tolist(), "near_next": likeness(mine, after).tolist()}


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1 << 18) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Texts are shuffled once, to ranges of (doc_id, hash, a random number), of about ``RANGE_BYTES`` or as many as the
    session has shuffle partitions; the first document of each range
    also goes to the range before it, as what follows its last. The ranges are cut by a bounded sample of ids and
    hashes, so neither one id nor one row repeated without end is left to one task. A task holds a chunk of texts
    at a time.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # the number only tells equal rows apart, for which it doesn't matter which is which
    keyed = base.select("doc_id", "text", F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("r")).alias("k"))
    marks = keyed.select("k").orderBy(F.xxhash64("k")).limit(SAMPLE * ranges).orderBy("k").collect()
    kind = keyed.schema["k"].dataType
    step = max(1, -(-len(marks) // ranges))
    # one array that is folded to a literal, and a search over it that is the same code for any number of cuts
    cuts = [F.struct(F.lit(m.k.i).cast(kind["i"].dataType).alias("i"), F.lit(m.k.h).alias("h"), F.lit(m.k.r).alias("r")).cast(kind) for m in marks[step::step]]
    part = at_most(F.array(*cuts), F.col("k"), len(cuts).bit_length()) if cuts else F.lit(0)
    placed = keyed.withColumn("p", part)
    firsts = {r.p: r.k for r in placed.select("p", "k").groupBy("p").agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    # range -> the range before it, which needs its first document
    heads = local_frame(spark, [(firsts[p].i, firsts[p].h, p, order[k - 1]) for k, p in enumerate(order)], T.StructType([kind["i"], kind["h"], T.StructField("own", T.IntegerType()), T.StructField("to", T.IntegerType())]))
    # one row for each range at most, and of rows as its first any one
    met = F.col("k.i").eqNullSafe(F.col("i")) & (F.col("k.h") == F.col("h"))
    tails = keyed.join(F.broadcast(heads), met).select("doc_id", "text", "k", F.col("to").alias("p"), F.lit(True).alias("tail"))
    tails = tails.groupBy("p", "tail").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("k").alias("k")).select("doc_id", "text", "k", "p", "tail")
    dealt = placed.withColumn("tail", F.lit(False)).unionByName(tails).repartitionById(ranges, "p").sortWithinPartitions("p", "tail", "k")
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), *[T.StructField(n, t) for n, t in _OUT]])
    arrow = pa.schema([("doc_id", pa.null()), *[(n, {"n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}.get(n, pa.string())) for n, _ in _OUT]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, chunk, size = None, [], 0

        def done() -> pa.RecordBatch:
            rows = _rows(chunk)
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in chunk], kind), *[pa.array(rows[n], arrow.field(n).type) for n, _ in _OUT]], names=schema.names)

        last = None  # id, text, range
        ended = None  # the range whose following document has been seen
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for i, text, p, tail in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    if tail and ended == p:
                        continue
                    if last is not None and last[2] == p:
                        if chunk and size > chunk_bytes:
                            yield done()
                            chunk, size = [], 0
                        chunk.append((last[0], last[1], text))
                        size += len(last[1]) + len(text)
                    if tail:  # nothing of this range comes after it
                        ended, last = p, None
                        if chunk:
                            yield done()
                            chunk, size = [], 0
                    else:
                        last = (i, text, p)
        if chunk:
            yield done()

    lean_batches(spark)
    return dealt.mapInArrow(run, schema)
