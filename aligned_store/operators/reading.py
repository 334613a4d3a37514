"""Alignment of feature groups to the master index."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import AS_OF
from ..sources.shared import literal
from .asof import STRATEGIES, as_of_join


def between(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive range filter; each bound is optional."""
    if start is not None:
        df = df.where(F.col(f"`{column}`") >= literal(start, df.schema[column].dataType))
    if end is not None:
        df = df.where(F.col(f"`{column}`") <= literal(end, df.schema[column].dataType))
    return df


def as_of_params(text: str | None) -> dict:
    params = json.loads(text) if text else None
    if params is None:
        raise ValueError("an as-of feature has no parameters")
    if params.get("strategy", "backward") not in STRATEGIES:
        raise ValueError(f"strategy {params['strategy']!r} is none of {', '.join(STRATEGIES)}")
    return params


def context(strategy: str, start, end) -> tuple:
    """The range of observations that may be matched from an index range: backward looks before it, forward after it."""
    return (None if strategy in ("backward", "nearest") else start, None if strategy in ("forward", "nearest") else end)


def gather(parts: list[tuple[DataFrame, int | None, bool]], keys: list[str], ranged: bool = False) -> DataFrame:
    """A left join of an index with any number of groups by one exchange.

    ``parts``: frames of the keys and a group's columns, the number of the group (None: no columns), and whether their
    rows are index rows. All rows are dealt by key together, each with its values in its group's struct, and a key's
    rows become one: no two rows of a key have the same group. With ``ranged`` they are dealt by range, so that a sort
    by the keys needs no further exchange.
    """
    kinds: dict[int, T.StructType] = {}
    for df, k, _ in parts:
        if k is not None and k not in kinds:
            kinds[k] = T.StructType([f for f in df.schema if f.name not in keys])
    quoted = [quote(k) for k in keys]

    def row(df: DataFrame, k: int | None, index: bool) -> DataFrame:
        own = lambda g: f"struct({', '.join(map(quote, kinds[g].names))})" if g == k else f"CAST(NULL AS struct<{', '.join(f'{quote(f.name)}: {f.dataType.simpleString()}' for f in kinds[g])}>)"
        return df.selectExpr(*quoted, f"CAST({'TRUE' if index else 'NULL'} AS BOOLEAN) AS _index", *[f"{own(g)} AS _group_{g}" for g in kinds])

    rows = reduce(DataFrame.unionAll, [row(*p) for p in parts])
    dealt = rows.repartitionByRange(*keys) if ranged else rows.repartition(*keys)
    met = dealt.groupBy(*keys).agg(F.first("_index", ignorenulls=True).alias("_index"), *[F.first(f"_group_{g}", ignorenulls=True).alias(f"_group_{g}") for g in kinds])
    return met.where("_index").selectExpr(*quoted, *[f"_group_{g}.{quote(n)}" for g in kinds for n in kinds[g].names])


def quote(name: str) -> str:
    """A name as SQL has it."""
    return "`" + name.replace("`", "``") + "`"


def align(index: DataFrame, scan, signal_type: str, params: str | None, features: list[str], keys: list[str], primary: str, start=None, end=None, count=None) -> DataFrame:
    """``index`` (already bounded) with ``features`` of one group; ``scan(low, high)`` gives the group's rows of a range.

    ``count(low, high)``, if given, bounds the rows of that range and of the index.
    """
    if signal_type == AS_OF:
        p = as_of_params(params)
        strategy = p.get("strategy", "backward")
        reach = context(strategy, start, end)
        rows = scan(*reach).select(*keys, *[F.col(f"`{f}`") for f in features])
        return as_of_join(index, rows, primary, [k for k in keys if k != primary], features, strategy, p.get("tolerance"), p.get("allow_exact_matches", True), rows=count(*reach) if count else None)
    return index.join(scan(start, end).select(*keys, *[F.col(f"`{f}`") for f in features]), keys, "left")
