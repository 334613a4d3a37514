"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact check.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. Each count is kept in
thermometer code (0, 1, 2 as 00, 01, 11), so the Manhattan distance of two embeddings is the bit count
of their XOR. It never exceeds the Hamming distance, so pairs further apart than ``radius`` in it are
no links. The join is a range join on a grid: the segments are dealt to ``radius + k`` groups, and of two
embeddings within ``radius`` of each other all but ``radius`` groups have a range of zero; so every link
shares one of the grid cells "the counts of these k groups". A pair is reported in the first such cell alone,
after the range condition on the whole embedding and the exact check. ``k`` grows with the number of
fingerprints (:func:`agreeing`), and full cells go another way (:func:`connecting_links`); neither changes
which rows are connected.

Defined results: text without words has fingerprint zero and links like any other. Repeated rows give
repeated result rows. A null id is no candidate for component_id (null if the component has no other).
Ids may be of any type that has an order; of equal ones any row may stand for them. Extra columns are
ignored, or carried along by :func:`drop_near_duplicates`, whatever their names. An empty table gives no rows.
Texts of any length are read whole, piece by piece. Fingerprints are made distinct before the join, so a group
of exact copies is one row in it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FEW_ROWS, cut, lookup, map_batches, small_join, utf8, with_columns
from .graph import ball, components
from .places import as_one, in_place, marks, place, placed

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints in a grid cell up to which they are compared in pairs.
DENSE = 2000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    digest = xxhash.xxh64_intdigest
    if n <= 0xFFFF:
        begins = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=begins[1:])
        begins = begins.tolist()
        hashes = np.fromiter([digest(joined[a : b - 1], seed) for a, b in zip(begins, begins[shingle:], strict=False)], np.uint64, n)
        counts = _count(hashes)
    else:  # a very long text goes piece by piece
        counts, step = 0, 50_000
        for at in range(0, n, step):
            some = words[at : at + step + shingle - 1]
            counts = counts + _count(np.array([digest(b" ".join(some[i : i + shingle]), seed) for i in range(len(some) - shingle + 1)], np.uint64))
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _count(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    if len(hashes) < 128:
        return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    columns = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return np.concatenate([np.bincount(c, minlength=256) @ _BITS for c in columns])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

        return step

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, schema)


def _with_fingerprint(docs: DataFrame, name: str, text_col: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column(batch.schema.get_field_index(text_col)))
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, batch.num_rows)
            return with_columns(batch, [name], [pa.array(fps.view(np.int64))])

        return step

    return map_batches(docs, make, schema)


def _embedding(fp):
    """Counts of set bits in each two-bit segment, in thermometer code."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    low = fp.bitwiseAND(odd)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _group_masks(groups: int) -> list[int]:
    """64-bit masks: the 32 segments dealt to groups of nearly equal size."""
    edges = [32 * g // groups for g in range(groups + 1)]
    return [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def agreeing(n: int, radius: int = RADIUS) -> int:
    """How many groups of counts to ask agreement of, so that a grid cell holds about one of ``n`` scattered embeddings.

    Any number finds all links; more of them make smaller cells, and more cells. An embedding holds about 1.5 bits
    a segment. Beyond 8 groups (495 cells at radius 4) cells would cost more than the candidates they save.
    """
    return next((k for k in range(3, 8) if n <= 2 ** (48 * k / (k + radius))), 8)


def _side(fps: DataFrame, radius: int, agree: int) -> tuple[DataFrame, list, list]:
    """(fp, cell, at) of all grid cells of the fingerprints; the cells, and the masks of the groups."""
    groups = radius + agree
    masks = _group_masks(groups)
    cells = [(sum(1 << g for g in c), _signed(sum(masks[g] for g in c))) for c in combinations(range(groups), agree)]
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col("e").bitwiseAND(F.lit(m)).alias("at")) for c, m in cells]))
    side = fps.select("fp", _embedding(F.col("fp")).alias("e")).select("fp", keys.alias("k")).select("fp", "k.cell", "k.at")
    return side, cells, masks


def linked_pairs(fps: DataFrame, radius: int = RADIUS, agree: int = 3) -> DataFrame:
    """Distinct fingerprints (fp) -> pairs (a < b) at Hamming distance ``radius`` or less."""
    return _pairs(*_side(fps, radius, agree), radius)


def _pairs(side: DataFrame, cells: list, masks: list, radius: int) -> DataFrame:
    # merged, as the planner takes a side for no larger than the fingerprints it is exploded from, and would send it to all tasks
    left, right = side.alias("l"), side.alias("r").hint("merge")
    apart = _embedding(F.col("l.fp")).bitwiseXOR(_embedding(F.col("r.fp")))
    same = sum((F.when(apart.bitwiseAND(F.lit(_signed(m))) == 0, 1 << g).otherwise(0) for g, m in enumerate(masks)), F.lit(0))
    # the bits of a cell up to its highest: only in the first cell that two share are these all their agreements
    upto = F.element_at(F.create_map(*[F.lit(x) for c, _ in cells for x in (c, (1 << c.bit_length()) - 1)]), F.col("l.cell"))
    match = (F.col("l.cell") == F.col("r.cell")) & (F.col("l.at") == F.col("r.at")) & (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(apart) <= radius) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= radius) & (same.bitwiseAND(upto) == F.col("l.cell"))
    return left.join(right, match).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def connecting_links(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """Distinct fingerprints (fp, a written table) -> links (a, b) within ``radius`` that connect whatever is linked.

    Fingerprints that share no cell with more than ``dense`` others are compared in pairs. Where cells are fuller,
    comparing all pairs would take the square of what is in them. Two fingerprints are within ``radius`` if and
    only if some word is within half of it of both; so there each fingerprint is dealt to all words of its ball
    (2,081 at radius 4), and linked to one representative in each, of which none holds more than 2,081. Such
    links are few for each fingerprint however many share a cell, all are within ``radius``, and all that a pair
    would have connected is connected.
    """
    side, cells, masks = _side(fps, radius, agreeing(fps.count(), radius))
    full = cut(side.groupBy("cell", "at").count().where(F.col("count") > dense).drop("count"), "full")
    if full.isEmpty():
        return cut(_pairs(side, cells, masks, radius), "links")
    light = _pairs(lookup(side, full.withColumn("full", F.lit(True)), ["cell", "at"]).where("full is null").select("fp", "cell", "at"), cells, masks, radius)
    crowd = cut(lookup(side, full, ["cell", "at"], "inner").select("fp").distinct(), "crowd")
    near, far = radius // 2, radius - radius // 2
    words = crowd.select("fp", F.explode(ball(F.col("fp"), far)).alias("word"))
    core = F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("word"))) <= near, F.col("fp"))
    met = words.groupBy("word").agg(F.min(core).alias("a"), F.collect_list("fp").alias("all")).where("a is not null and size(all) > 1")
    star = met.select("a", F.explode("all").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # a pair's first common cell may be a full one of which the other way knows; those in light cells stand as they are
    return cut(light.unionByName(star), "links")


def _rooted(prints: DataFrame, first: str, radius: int) -> DataFrame:
    """Distinct fingerprints (fp, ``first``) -> (fp, best): the least ``first`` of the component, nulls aside."""
    links = connecting_links(prints.select("fp"), radius)
    roots = components(links).select(F.col("node").alias("fp"), "root")
    rooted = cut(small_join(prints, roots, ["fp"], "left", FEW_ROWS).select("fp", first, F.coalesce("root", "fp").alias("root")), "rooted")
    best = cut(rooted.groupBy("root").agg(F.min(first).alias("best")), "best")
    return cut(lookup(rooted, best, ["root"], "inner").select("fp", "best"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, **kw) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest id reachable over links)."""
    members = cut(fingerprints(docs, id_col, text_col, **kw), "fingerprints")
    prints = cut(members.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    named = lookup(members, _rooted(prints, "first", radius), ["fp"], "inner")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, **kw) -> DataFrame:
    """``docs`` with one row of each component, of those with its smallest id any one; columns unchanged.

    Rows of null ids stay where a component has no other. Ids may be of any type that has an order. Rows are told
    apart by where they are stored, so those that are equal in everything are too; what goes is marked there,
    and the rest is read where it is (:mod:`.places`): no text is shuffled.
    """
    rows = placed(docs, "rows")
    file, row = place(rows)
    narrow = rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), file.alias("file"), row.alias("row"))
    members = cut(_with_fingerprint(narrow, "fp", "text", **kw).drop("text"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "file", "row")
    prints = cut(members.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    stay = _rooted(prints, "first", radius).select("best.file", "best.row").distinct()
    gone = cut(members.select("file", "row").join(stay.hint("merge"), ["file", "row"], "left_anti"), "gone")
    return as_one(in_place(rows, marks(gone), keep=False), "kept")
