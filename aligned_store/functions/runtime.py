"""Features computed at read time from SQL expressions."""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def roots(spark: SparkSession, expr: str) -> list[str]:
    """The columns that an expression refers to, by Catalyst's parser."""
    found, stack = [], [spark._jsparkSession.sessionState().sqlParser().parseExpression(expr)]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "UnresolvedAttribute":
            parts = node.nameParts()
            found.append(parts.apply(0))
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return sorted(set(found))


def levels(exprs: dict[str, str], of: dict[str, list[str]]) -> list[list[str]]:
    """Outputs in batches whose roots are all computed before; a cycle raises ``graphlib.CycleError``."""
    sorter = TopologicalSorter({n: [r for r in of[n] if r in exprs] for n in exprs})
    sorter.prepare()
    out = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out.append(ready)
        sorter.done(*ready)
    return out


def with_columns_topo(df: DataFrame, exprs: dict[str, str], of: dict[str, list[str]] | None = None) -> DataFrame:
    of = of or {n: roots(df.sparkSession, e) for n, e in exprs.items()}
    for batch in levels(exprs, of):
        df = df.withColumns({n: F.expr(exprs[n]) for n in batch})
    return df
