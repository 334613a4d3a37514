"""Orders of rows in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that quantiles are taken from, and bits of a column's place among them.
SAMPLE, BITS = 20_000, 8


def z_order(df: DataFrame, columns: list[str]) -> Column:
    """A number whose order keeps rows close that are close in all of ``columns``.

    The bits of each column's place among quantiles, of a bounded sample of the rows, in turn. Places only decide
    where rows lie, so that the sample is one changes no result.
    """
    sample = df.select(*columns).orderBy(F.xxhash64(*columns, F.monotonically_increasing_id())).limit(SAMPLE).collect()
    parts = []
    for i, c in enumerate(columns):
        seen = sorted(r[c] for r in sample if r[c] is not None)
        # cuts that are equal stay: places of few values are as far apart as those of many
        cuts = [seen[len(seen) * k >> BITS] for k in range(1, 1 << BITS)] if seen else []
        kind = df.schema[c].dataType
        place = at_most(F.array(*[F.lit(x).cast(kind) for x in cuts]), F.col(f"`{c}`")) if cuts else F.lit(0)
        parts += [F.shiftleft(F.shiftright(place, b).bitwiseAND(1).cast("long"), b * len(columns) + len(columns) - 1 - i) for b in range(BITS)]
    total = parts[0]
    for p in parts[1:]:
        total = total.bitwiseOR(p)
    return total


def at_most(cuts: Column, value: Column, bits: int = BITS) -> Column:
    """How many of the sorted ``cuts``, fewer than two to the power of ``bits``, are at most ``value``; 0 for null."""
    step = lambda n, s: n + F.when(F.coalesce(F.get(cuts, n + s - 1) <= value, F.lit(False)), s).otherwise(0)
    return F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), F.lit(0), step)
