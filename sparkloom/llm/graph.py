"""Connected components by alternating large-star and small-star rounds, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One round over edges (u, v) with u > v; also the staged minima, to be dropped once it is written.

    The minima are a table of their own, so both join inputs are plain exchanges and a hub's rows can be split.
    """
    near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stage(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    seen = near.join(least, "u")
    if large:
        out = seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = seen.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct(), least


def _edges(edges: DataFrame) -> DataFrame:
    """Staged (u, v) with u > v, from the first two columns."""
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    return stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct())


def _round(now: DataFrame) -> DataFrame:
    for large in (True, False):
        made, least = _star(now, large)
        made = stage(made)
        unstage(least)
        unstage(now)
        now = made
    return now


def drawn_together(edges: DataFrame) -> DataFrame:
    """Staged edges (u, v), u > v, of the same components after a single round: most nodes are next to their smallest."""
    return _round(_edges(edges))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (its first two columns); component is the smallest node.

    Nulls and self-loops are dropped: a node without another end isn't in the result.
    """
    now = _edges(edges)
    for _ in range(max_rounds):
        # in a star around its smallest node, every other node has one edge up and none down
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").head(1):
            break
        now = _round(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # now every component is a star around its smallest node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
