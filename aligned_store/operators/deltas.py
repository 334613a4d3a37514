"""Cleaning of input frames and their comparison with the master index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def preprocess(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows without a null key, the first of each key: that with the lowest position in the input.

    They are laid out by range of the keys, in ``order``, and sorted by them; keys that are equal are in one range, so
    this one exchange serves the choice of the first as well.
    """
    at = df.withColumn("_at", F.monotonically_increasing_id()).dropna(subset=order).repartitionByRange(*order)
    first = at.withColumn("_rank", F.row_number().over(Window.partitionBy(*order).orderBy("_at")))
    return first.where("_rank = 1").drop("_rank", "_at").sortWithinPartitions(*order)


@dataclass
class Deltas:
    """How an input lies to the index: rows, rows with new keys, and ranges of the primary key."""

    rows: int
    new_rows: int
    low: object
    high: object
    new: DataFrame


def index_deltas(df: DataFrame, index: DataFrame, keys: list[str], primary: str) -> Deltas:
    """``df`` is clean and stored. One action; the new rows stay a lazy anti join."""
    known = index.select(*keys, F.lit(True).alias("_known"))
    marked = df.select(*keys).join(known, keys, "left")
    new = F.col("_known").isNull()
    r = marked.agg(F.count("*").alias("n"), F.count_if(new).alias("m"), F.min(primary).alias("lo"), F.max(primary).alias("hi")).first()
    return Deltas(r.n, r.m, r.lo, r.hi, df.select(*keys).join(index.select(*keys), keys, "left_anti"))


def replaced(old: DataFrame, df: DataFrame, keys: list[str], primary: str, columns: list[str], low, high) -> DataFrame:
    """A table after a whole replacement of ``columns`` in [low, high]: keys absent from ``df`` become null there.

    Sibling columns stay; new keys come in.
    """
    names = [c for c in old.columns if c not in keys] + [c for c in columns if c not in old.columns]
    t = old.select(*keys, *[F.col(f"`{c}`").alias(f"_old_{c}") for c in old.columns if c not in keys], F.lit(True).alias("_t"))
    s = df.select(*keys, *[F.col(f"`{c}`").alias(f"_new_{c}") for c in columns], F.lit(True).alias("_s"))
    joined = t.join(s, keys, "full")
    inside = F.col(primary).between(low, high)

    def value(c: str):
        before = F.col(f"`_old_{c}`") if c in old.columns else F.lit(None)
        if c not in columns:
            return before.alias(c)
        return F.when(F.col("_s"), F.col(f"`_new_{c}`")).when(~inside, before).alias(c)

    return joined.select(*keys, *map(value, names))


def upserted(old: DataFrame, df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A table of observations with those of ``df`` in place of its own of the same keys; all others stay."""
    names = [c for c in old.columns if c not in keys] + [c for c in columns if c not in old.columns]
    t = old.select(*keys, *[F.col(f"`{c}`").alias(f"_old_{c}") for c in old.columns if c not in keys])
    s = df.select(*keys, *[F.col(f"`{c}`").alias(f"_new_{c}") for c in columns], F.lit(True).alias("_s"))

    def value(c: str):
        before = F.col(f"`_old_{c}`") if c in old.columns else F.lit(None)
        return (F.when(F.col("_s"), F.col(f"`_new_{c}`")).otherwise(before) if c in columns else before).alias(c)

    return t.join(s, keys, "full").select(*keys, *map(value, names))


def without_empty(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have a value; sparse tables store no others."""
    return df.dropna(how="all", subset=[c for c in df.columns if c not in keys])
