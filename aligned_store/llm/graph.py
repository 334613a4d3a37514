"""Connected components of an undirected graph, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, lookup


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, root): the smallest node reachable, for nodes that have an edge.

    Each round ranks the nodes anew by a hash; every node moves to the neighbour of least rank of its neighbour
    of least rank, and the edges are contracted to where their ends have moved. The ranks don't depend on how
    nodes are numbered, so whatever the graph, a node stays with a chance of about a half at most, and the rounds
    grow with the logarithm of the nodes: a path takes as many in ascending as in any other order. Where nodes
    went is kept for each round, in tables that shrink with the graph; afterwards they are followed back, from the
    last to the first, and each node gets the smallest one of its component.

    Every step is a written table in the shared folder, so lineage stays short and a lost executor costs its
    tasks. Hubs are met by partial aggregation, and by :func:`lookup` where many nodes move to one. Null ends and
    edges from a node to itself are ignored.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return cut(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    live, moves = tidy(edges), []
    while not live.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
        near = cut(ends.groupBy("node").agg(F.min(rank("to")).alias("least")).select("node", F.least(rank("node"), "least")["to"].alias("up")), "near")
        step = cut(lookup(near, near.select(F.col("node").alias("up"), F.col("up").alias("to")), ["up"], "inner").select("node", "to"), "moves")
        at = lambda name: step.select(F.col("node").alias(name), F.col("to").alias(f"{name}_to"))  # noqa: E731, B023
        moved = tidy(lookup(lookup(live, at("a"), ["a"], "inner"), at("b"), ["b"], "inner").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")))
        forget(live)
        forget(near)
        live, moves = moved, [*moves, step]
    components.rounds = len(moves)
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    last = moves.pop()
    while moves:
        before = moves.pop()
        onward = lookup(before, last.select(F.col("node").alias("to"), F.col("to").alias("end")), ["to"], "left")
        # those that no edge was left to had arrived
        new = cut(onward.select("node", F.coalesce("end", "to").alias("to")), "moves")
        forget(before)
        forget(last)
        last = new
    least = cut(last.groupBy("to").agg(F.min("node").alias("root")), "roots")
    return cut(lookup(last, least, ["to"], "inner").select("node", "root"), "labels")


def ball(word: Column, radius: int) -> Column:
    """All 64-bit words that differ from ``word`` in ``radius`` bits at most."""
    out = F.array(word)
    for _ in range(radius):
        step = lambda w: F.concat(F.array(w), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: w.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
        out = F.array_distinct(F.flatten(F.transform(out, step)))
    return out
