"""Connected components by contraction: no adjacency list, no driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Those links (a, b) that join what earlier ones haven't."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    kept = []
    for x, y in zip(a, b, strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[p] = q
            kept.append((x, y))
    return kept


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    In each round a node's parent is its smallest neighbour or itself, parents are followed
    to the top by doubling, and edges move there; nodes that have no edge left are done. Minima
    are pre-aggregated and joins can be split, so a node with very many edges is no hot spot;
    joins are merges, so that no side is ever gathered at the driver. Loops and repeated edges
    do no harm; an empty table gives no rows."""
    edges = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
        parents = settled(both.groupBy("node").agg(F.min("other").alias("parent")).select("node", F.least("node", "parent").alias("parent")))
        moving = True
        while moving:  # each time twice as far
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand")).hint("merge")
            jumped = settled(parents.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
            moving = not jumped.where("moved").isEmpty()
            parents = jumped.select("node", "parent")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            moved = parents.select(F.col("node").alias("component"), "parent").hint("merge")
            labels = settled(labels.join(moved, "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")).hint("merge")
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")).hint("merge")
        moved = edges.join(a, "a").join(b, "b").where("pa <> pb")
        edges = settled(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
