"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import Cuts
from ..plans.skew import join_hot


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``u, v``: 64-bit ids); component is the smallest node of its part.

    Nulls and loops are ignored, though a node of a loop alone is its own component. In each round every node hands its
    larger neighbours to its smallest one (large star), then its smaller ones (small star); edges never grow in number,
    and the rounds needed grow with the logarithm of the longest path. A node with a large part of all edges is split
    over tasks by join_hot. Each round is a table in the shared folder. Rounds end when every edge leads to the smallest
    node of its part; that ``max_rounds`` rounds don't get there is an error.
    """
    edges = edges.where("u is not null and v is not null").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    cuts = Cuts(edges.sparkSession)
    edges = cuts.cut(edges.distinct())
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = cuts.cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = e.count()
    for _ in range(max_rounds):
        if not n:
            break
        large = cuts.cut(_star(e, n, large=True))
        e = cuts.cut(_star(large, n, large=False))
        # done when no node is both somebody's smaller end and has a smaller one itself, and none has two
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, open_ = per.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
        # each round reads only the one before
        cuts.drop(1, keep=1)
        if not open_:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _star(e: DataFrame, n: int, large: bool) -> DataFrame:
    """One step over e (u > v, n edges)."""
    both = e if not large else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("u", "m"))
    joined = join_hot(both, least, "u", "degree", n)
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
