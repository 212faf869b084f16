"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the smallest node reachable. Loops and repeats are harmless.

    Every round each node moves to the neighbour (or itself) of least hash, and links are replaced by those between the
    nodes moved to. Hashed order shrinks any graph, long chains too, by a constant share a round, so rounds are logarithmic. Rounds
    are written tables. Hubs only meet partial aggregation and sort-merge joins, which adaptive execution splits.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    edges = scratch.table(f"{name}-e0", edges)
    n = edges.count()  # a round has no more edges than the one before it, and twice as many nodes at most
    label = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("to", F.col("node"))
    moves = []
    number = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        move = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("least"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v"))
        move = scratch.table(f"{name}-m{number}", move.select("node", F.least("least", own)["v"].alias("to")), 2 * n)
        moves.append(move)
        number += 1
        moved = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = scratch.table(f"{name}-e{number}", moved.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), n)
    for k, move in enumerate(moves):
        label = label.join(move.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        if k % 4 == 3:
            label = scratch.table(f"{name}-l{k}", label, 2 * n)
    label = scratch.table(f"{name}-l", label, 2 * n)
    least = label.groupBy("to").agg(F.min("node").alias("component"))
    out = scratch.table(f"{name}-out", label.join(least, "to").select("node", "component"), 2 * n)
    scratch.drop(*[f"{name}-e{k}" for k in range(number + 1)], *[f"{name}-m{k}" for k in range(number)], f"{name}-l", *[f"{name}-l{k}" for k in range(3, number, 4)])
    return out
