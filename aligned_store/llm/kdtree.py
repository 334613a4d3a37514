"""Sharding by a k-d tree over metadata: shards of near equal bytes, of documents that are alike in metadata.

Each dimension of a document's metadata has a place between 0 and ``TOP``, numbers by their value, texts by the bytes
that follow what all have in common. A node of the tree that has to give several shards is split along the dimension in
which its documents lie widest, at the weighted median (the quantile of bytes that its two sides need), and so on
until every leaf is one shard of about the target bytes. Behind a place stand ``TIE`` bits of a hash, so that documents
that are equal in all dimensions, however many, still have an order to be split in.

Medians are found by histograms: a pass sums bytes by node and bin, of which there are ``BINS`` to a node; the next
pass cuts up the bin in which the median lies. A pass reads a narrow table that has no texts, and only a row for each
node comes to the driver, which holds the tree; it has twice as many nodes as there are shards, ``MOST`` at most. Texts
are shuffled once, to the files of their shards.

Defined results: null text has no bytes. Null metadata, NaN and infinite numbers stand before all others. Rows that
are equal in every column are rows each. Ids may be of any type, null or repeated; they are only carried along. Empty
texts weigh their overhead. An empty table gives no rows; fewer rows than shards leave shards empty. No document is
cut, so one longer than the target makes its shard larger. Further columns are written with the shards; their names may
be any.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import local_frame
from .common import cut, forget, fresh, scratch, small_join

#: The highest place; bits of a hash behind it; bins of a histogram; shards that a tree may have.
TOP, TIE, BINS, MOST = (1 << 22) - 1, 40, 1024, 1 << 18
#: Bytes of a shard that one task writes.
TASK_BYTES = 64 << 20
_LONG = T.LongType()


@dataclass
class Node:
    """``leaves`` shards from ``first`` on; once split, the dimension and the key from which on rows go to the right."""

    id: int
    first: int
    leaves: int
    dim: int | None = None
    key: int = 0

    def sides(self) -> tuple[Node, Node]:
        left = self.leaves // 2
        return Node(2 * self.id, self.first, left), Node(2 * self.id + 1, self.first + left, self.leaves - left)


@dataclass
class Tree:
    """The splits of each level, the leaves, how many there are to be, and the bytes of all rows."""

    levels: list[list[Node]]
    leaves: list[Node]
    shards: int
    bytes: int


def _key(place: Column, tie: Column) -> Column:
    return F.call_function("shiftleft", place, F.lit(TIE)).bitwiseOR(tie)


def places(rows: DataFrame, dims: list[str]) -> list[Column]:
    """The place of each dimension, as an expression of columns ``dims``. One pass finds their ranges."""
    ends, value = [], {}
    for i, d in enumerate(dims):
        kind = rows.schema[d].dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            value[d] = F.col(f"`{d}`").cast("binary")
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            wide = F.col(f"`{d}`").cast("double")
            value[d] = F.when(F.abs(wide) < F.lit(float("inf")), wide)  # NaN is above infinity
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value[d] = F.unix_micros(F.col(f"`{d}`").cast("timestamp")).cast("double")
        elif isinstance(kind, T.DateType):
            value[d] = F.unix_date(f"`{d}`").cast("double")
        else:
            raise TypeError(f"{d} is {kind.simpleString()}, which has no place along a line")
        ends += [F.min(value[d]).alias(f"lo{i}"), F.max(value[d]).alias(f"hi{i}")]
    r = rows.agg(*ends).first()
    out = []
    for i, d in enumerate(dims):
        low, high, own = r[f"lo{i}"], r[f"hi{i}"], value[d]
        if isinstance(low, (bytes, bytearray)):
            same = next((k for k, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
            number = lambda x, same=same: int.from_bytes(bytes(x[same : same + 6]).ljust(6, b"\0"), "big")
            low, high = float(number(low)), float(number(high))
            own = F.conv(F.hex(F.rpad(F.substring(own, same + 1, 6), 6, F.lit(b"\0"))), 16, 10).cast("double")
        if low is None or low == high:
            out.append(F.when(own.isNull(), 0).otherwise(1).cast("long"))
        else:  # halves, as the range may be beyond a double
            share = (own / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
            out.append(F.coalesce(F.round(share * F.lit(float(TOP - 1))).cast("long") + 1, F.lit(0)).cast("long"))
    return out


def build(rows: DataFrame, dims: int, shards: int | None, target_bytes: int | None) -> Tree:
    """The tree of ``rows`` (node, keys, w), which are moved from level to level as written tables."""
    total = rows.agg(F.sum("w")).first()[0] or 0
    shards = shards or max(1, round(total / target_bytes))
    if shards > MOST:
        raise ValueError(f"{shards} shards are more than {MOST}: raise the target")
    levels, leaves, live = [], [], [Node(1, 0, shards)]
    while live:
        leaves += [n for n in live if n.leaves == 1]
        live = [n for n in live if n.leaves > 1]
        split_level(rows, live, dims)
        level = [n for n in live if n.dim is not None]  # nodes without rows need no split
        if level:
            levels.append(level)
            moved = cut(walk(rows, [level], "node", "keys"), "keys")
            forget(rows)
            rows = moved
        live = [s for n in level for s in n.sides()]
    forget(rows)
    return Tree(levels, leaves, shards, total)


def split_level(rows: DataFrame, live: list[Node], dims: int) -> None:
    """Set the dimension and key of each node's split; nodes that have no rows are left as they are."""
    if not live:
        return
    spark = rows.sparkSession
    of = {n.id: n for n in live}
    ids = local_frame(spark, [(n.id,) for n in live], T.StructType([T.StructField("node", _LONG)]))
    ends = [f(F.col("keys")[i]).alias(f"{a}{i}") for i in range(dims) for f, a in ((F.min, "lo"), (F.max, "hi"))]
    todo = {}
    for r in rows.join(F.broadcast(ids), "node").groupBy("node").agg(F.sum("w").alias("w"), *ends).collect():
        node = of[r.node]
        width = [(r[f"hi{i}"] >> TIE) - (r[f"lo{i}"] >> TIE) for i in range(dims)]
        node.dim = max(range(dims), key=lambda i: (width[i], -i))
        goal = r.w * (node.leaves // 2) / node.leaves
        todo[r.node] = (r[f"lo{node.dim}"], r[f"hi{node.dim}"] + 1, goal)
    kind = T.StructType([T.StructField(n, t) for n, t in (("node", _LONG), ("dim", T.IntegerType()), ("low", _LONG), ("step", _LONG), ("high", _LONG), ("goal", T.DoubleType()))])
    while todo:
        # goal: the bytes that are to be below the key, of those from low on
        state = local_frame(spark, [(i, of[i].dim, low, -(-(high - low) // BINS), high, goal) for i, (low, high, goal) in todo.items()], kind)
        key = F.element_at("keys", F.col("dim") + 1)
        inside = rows.join(F.broadcast(state), "node").where((key >= F.col("low")) & (key < F.col("high")))
        bins = inside.groupBy("node", "low", "step", "high", "goal", F.expr("(keys[dim] - low) div step").alias("bin")).agg(F.sum("w").alias("w"), F.count("*").alias("n"))
        along = Window.partitionBy("node").orderBy("bin")
        known = bins.withColumn("done", F.sum("w").over(along)).withColumn("all", F.sum("w").over(Window.partitionBy("node")))
        first = known.where((F.col("done") >= F.col("goal")) | (F.col("done") == F.col("all"))).groupBy("node").agg(F.min_by(F.struct("low", "step", "high", "goal", "bin", "w", "n", "done"), "bin").alias("b"))
        for node, b in first.collect():
            low, high, goal = b.low + b.bin * b.step, min(b.low + (b.bin + 1) * b.step, b.high), b.goal - (b.done - b.w)
            if b.n == 1 or high - low == 1:
                of[node].key = low if 2 * goal < b.w else high  # whichever leaves less on the wrong side
                del todo[node]
            else:
                todo[node] = (low, high, goal)


def walk(rows: DataFrame, levels: list[list[Node]], node: str, keys: str) -> DataFrame:
    """``rows`` with each one's ``node`` after the splits of these levels."""
    kind = T.StructType([T.StructField("_split", _LONG), T.StructField("_dim", T.IntegerType()), T.StructField("_key", _LONG)])
    names = rows.columns
    for level in levels:
        splits = F.broadcast(local_frame(rows.sparkSession, [(n.id, n.dim, n.key) for n in level], kind))
        right = (F.element_at(keys, F.col("_dim") + 1) >= F.col("_key")).cast("long")
        to = F.when(F.col("_split").isNull(), F.col(node)).otherwise(2 * F.col(node) + right)
        met = rows.join(splits, F.col(node) == F.col("_split"), "left")
        rows = met.select(*[to.alias(c) if c == node else F.col(f"`{c}`") for c in names])
    return rows


@dataclass
class Sharded:
    """Shards written under ``path``, a folder for each, with the columns that documents came with.

    ``tree`` is what they were dealt by. :meth:`read` gives their rows with ``shard`` and ``slot``.
    """

    path: str
    tree: Tree
    schema: T.StructType
    column: str

    def read(self, spark: SparkSession) -> DataFrame:
        """The shards' rows, with their shard and their slot: the place that they have in its files, from 0 without gaps."""
        whole = T.StructType([*self.schema.fields, T.StructField(self.column, T.IntegerType())])
        rows = spark.read.schema(whole).parquet(self.path)
        shard, file, at = (fresh(rows.columns, n) for n in ("_shard", "_file", "_row"))
        placed = rows.select("*", F.col(self.column).alias(shard), F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
        files = placed.groupBy(shard, file).agg(F.count("*").alias("n"))
        before = Window.partitionBy(shard).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
        offsets = cut(files.select(F.col(file), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), "offsets")
        slot = (F.col("_before") + F.col(at)).alias("slot")
        return small_join(placed, offsets, [file], "inner").select(*[F.col(f"`{c}`") for c in self.schema.names], F.col(shard).alias("shard"), slot)


def kd_shards(docs: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, path: str | None = None) -> Sharded:
    """Write ``docs`` in shards of near equal bytes (UTF-8 bytes of the text and ``overhead``), split along ``dims``.

    Either the number of shards or the bytes that each is to have must be given.
    """
    if not shards and not target_bytes:
        raise ValueError("give shards or target_bytes")
    path = path or scratch(docs.sparkSession, "shards")
    names = list(docs.columns)
    new = {}
    for n in ("node", "keys", "w", "tie", "part", "shard", *[f"d{i}" for i in range(len(dims))]):
        new[n] = fresh([*names, *new.values()], f"_{n}")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    weight = F.octet_length(text).cast("long") + overhead
    # rows that are equal in all else are told apart by where they stand
    tie = F.xxhash64(F.col(f"`{id_col}`"), text, F.monotonically_increasing_id()).bitwiseAND((1 << TIE) - 1)
    own = [new[f"d{i}"] for i in range(len(dims))]
    full = docs.select("*", *[F.col(f"`{d}`").alias(o) for d, o in zip(dims, own, strict=True)], tie.alias(new["tie"]), weight.alias(new["w"]))
    narrow = cut(full.select(*own, F.col(new["tie"]).alias("tie"), F.col(new["w"]).alias("w")), "metadata")
    keys = lambda tie: F.array(*[_key(p, F.col(tie)) for p in at])
    at = places(narrow, own)
    rows = cut(narrow.select(F.lit(1).cast("long").alias("node"), keys("tie").alias("keys"), "w"), "keys")
    forget(narrow)
    tree = build(rows, len(dims), shards, target_bytes)
    # the texts go the same way, and are shuffled once, to so many tasks for each shard as its bytes need
    parts = max(1, -(-tree.bytes // (tree.shards * TASK_BYTES)))
    sent = walk(full.select(*[F.col(f"`{c}`") for c in names], F.lit(1).cast("long").alias(new["node"]), keys(new["tie"]).alias(new["keys"]), F.pmod(new["tie"], F.lit(parts)).cast("int").alias(new["part"])), tree.levels, new["node"], new["keys"])
    leaves = local_frame(docs.sparkSession, [(n.id, n.first) for n in tree.leaves], T.StructType([T.StructField("_leaf", _LONG), T.StructField(new["shard"], T.IntegerType())]))
    sent = sent.join(F.broadcast(leaves), F.col(new["node"]) == F.col("_leaf")).select(*[F.col(f"`{c}`") for c in names], new["shard"], (F.col(new["shard"]) * parts + F.col(new["part"])).alias(new["part"]))
    sent.repartitionById(tree.shards * parts, new["part"]).drop(new["part"]).write.partitionBy(new["shard"]).parquet(path)
    return Sharded(path, tree, docs.schema, new["shard"])


def sharding(docs: DataFrame, shards: int, dims: list[str], id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, read from the written shards."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(d).alias(f"m{i}") for i, d in enumerate(dims)])
    done = kd_shards(own, [f"m{i}" for i in range(len(dims))], shards, overhead=overhead).read(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
