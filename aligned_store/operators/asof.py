"""As-of join: for each left row the nearest right row of its group, as one union and windows over it.

No range join: both sides are shuffled once by ``by`` and sorted by ``p``, and each window is a running one,
so a group takes time n log n. Groups of more than ``hot_rows`` rows are split into blocks of ``p``, as
many tasks; what a block needs of the blocks before and after it comes from one row for each block.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import DAY_US, whole

STRATEGIES = ("backward", "forward", "nearest")
#: Groups of more rows than this, of both sides together, are split.
HOT_ROWS = 2_000_000
#: Into so many blocks (a power of two).
BLOCKS = 256
#: Rows of a sample for each block, where cuts come from one.
PICKED = 32
_UNITS = {"ns": 1e-3, "us": 1, "ms": 10**3, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6}


def tolerance_of(value, kind: T.DataType):
    """A tolerance such as "1d12h" in microseconds for times; a number as it is."""
    if value is None or isinstance(value, (int, float)):
        return value
    parts = re.findall(r"(\d+)(ns|us|ms|s|m|h|d|w)", str(value))
    if not parts or "".join(n + u for n, u in parts) != str(value) or isinstance(kind, T.NumericType):
        raise ValueError(f"bad tolerance {value!r}")
    return int(sum(int(n) * _UNITS[u] for n, u in parts))


def distance(a: Column, b: Column, kind: T.DataType) -> Column:
    """``a - b``: in microseconds for times."""
    if isinstance(kind, T.DateType):
        return F.datediff(a, b).cast("long") * F.lit(DAY_US)
    return whole(a, kind) - whole(b, kind)


def as_of_join(left: DataFrame, right: DataFrame, p: str, by: list[str], values: list[str], strategy: str = "backward", tolerance=None, allow_exact_matches: bool = True, rows: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` with ``values`` of the matched right row: the row is picked, so a null in it stays null.

    Of rows equally near, nearest takes the later one. A tolerance is inclusive. Null group keys are a
    group. ``rows``, if known, is a bound on the rows of both sides; where it rules out groups to split,
    none are looked for.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {', '.join(STRATEGIES)}")
    kind = left.schema[p].dataType
    within = tolerance_of(tolerance, kind)
    own = [c for c in left.columns if c not in (p, *by)]
    shape = T.StructType([T.StructField("_p", kind), *[T.StructField(v, right.schema[v].dataType) for v in values]])
    kept = T.StructType([left.schema[c] for c in own])
    whole = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.lit(None).cast(kept)
    a = left.select(*by, p, whole.alias("_own"), F.lit(None).cast(shape).alias("_right"), F.lit(True).alias("_left"))
    b = right.select(*by, p, F.lit(None).cast(kept).alias("_own"), F.struct(F.col(p).alias("_p"), *[F.col(f"`{v}`") for v in values]).cast(shape).alias("_right"), F.lit(False).alias("_left"))
    both = a.unionByName(b)
    split = (rows is None or rows > hot_rows) and isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType))
    if split:
        both = blocks(both, p, by, kind, hot_rows)

    def near(ahead: bool) -> Column:
        # forward is backward in descending order: a frame to the end of a group would be read anew for each row
        along = F.col(p).desc() if ahead else F.col(p).asc()
        ties = F.col("_left").asc() if allow_exact_matches else F.col("_left").desc()
        w = Window.partitionBy(*by, *(["_block"] if split else [])).orderBy(along, ties).rowsBetween(Window.unboundedPreceding, 0)
        hit = F.last("_right", ignorenulls=True).over(w)
        return F.coalesce(hit, F.col("_after" if ahead else "_before")) if split else hit

    if strategy == "nearest":
        both = both.withColumn("_a", near(False)).withColumn("_b", near(True))
        back, ahead = distance(F.col(p), F.col("_a._p"), kind), distance(F.col("_b._p"), F.col(p), kind)
        hit = F.when(F.col("_a").isNull() | (ahead <= back), F.col("_b")).otherwise(F.col("_a"))
    else:
        hit = near(strategy == "forward")
    found = both.withColumn("_hit", hit).where("_left")
    if within is not None:
        apart = F.abs(distance(F.col(p), F.col("_hit._p"), kind))
        found = found.withColumn("_hit", F.when(apart <= F.lit(within), F.col("_hit")))
    return found.select(*[F.col(f"_own.`{c}`").alias(c) if c in own else F.col(f"`{c}`") for c in left.columns], *[F.col(f"_hit.`{v}`").alias(v) for v in values])


def blocks(both: DataFrame, p: str, by: list[str], kind: T.DataType, hot_rows: int) -> DataFrame:
    """With _block, and for the blocks of hot groups the nearest right rows _before and _after the block.

    A hot group's blocks are cut at ``BLOCKS`` quantiles of its ``p`` (of texts: of a sample), so they hold about as many rows each, however
    crowded; rows of equal ``p`` are in one. No side is hinted as small: the tables of hot groups and blocks
    have ``BLOCKS`` rows for ``hot_rows`` rows at most, and adaptive execution sees their size.
    """
    hot = both.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    value = whole(F.col(p), kind)
    near = _left_join(both, hot, by).where("_n is not null")
    if isinstance(kind, T.StringType):  # texts have no quantiles: cuts are evenly spaced in a sorted sample of about as many rows of each group
        share = F.lit(PICKED * BLOCKS << 20) / F.col("_n")
        picked = near.where(F.pmod(F.xxhash64(*by, p, F.monotonically_increasing_id()), F.lit(1 << 20)) < share)
        seen = picked.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_seen"))
        at = lambda k: F.element_at("_seen", (F.floor(k * F.size("_seen") / BLOCKS) + 1).cast("int"))
        sizes = seen.where(F.size("_seen") > 0).withColumn("_cuts", F.transform(F.sequence(F.lit(1), F.lit(BLOCKS - 1)), at)).drop("_seen")
    else:
        cuts = F.percentile_approx(value, [k / BLOCKS for k in range(1, BLOCKS)], 10 * BLOCKS)
        sizes = near.groupBy(*by).agg(cuts.alias("_cuts"))
    steps = [BLOCKS >> k for k in range(1, BLOCKS.bit_length())]
    # binary search: how many cuts are at most the value
    at = lambda n, step: n + F.when(F.element_at("_cuts", n + step) <= value, step).otherwise(0)
    block = F.when(F.col("_cuts").isNotNull(), F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), at)).otherwise(0).cast("long")
    tagged = _left_join(both, sizes, by).withColumn("_block", block).withColumn("_hot", F.col("_cuts").isNotNull()).drop("_cuts")
    when = F.when(~F.col("_left"), F.col(p))
    ends = tagged.where("_hot").groupBy(*by, "_block").agg(F.max_by("_right", when).alias("_newest"), F.min_by("_right", when).alias("_oldest"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_block", F.last("_newest", ignorenulls=True).over(earlier).alias("_before"), F.last("_oldest", ignorenulls=True).over(later).alias("_after"))
    return _left_join(tagged, carried, [*by, "_block"])


def _left_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join on keys of which null equals null; without keys ``right`` is the one row of a whole aggregate."""
    renamed = right.select(*[F.col(f"`{k}`").alias(f"_on_{i}") for i, k in enumerate(on)], *[F.col(c) for c in right.columns if c not in on])
    condition = F.lit(True)
    for i, k in enumerate(on):
        condition = condition & F.col(f"`{k}`").eqNullSafe(F.col(f"_on_{i}"))
    return left.join(renamed, condition, "left").drop(*[f"_on_{i}" for i in range(len(on))])
