"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation to one row per node (combined before its shuffle, so a node with
a third of all edges is no single task's load) and a join back that may be split where it is
skewed. Nothing is collected; each round is cut into a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("m", "u").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    linked = down.join(least, F.col("u") == F.col("n")).select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
    return linked.filter("u != v").distinct()


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge (u, v); component is its smallest node.
    Self loops and repeated edges don't matter; null ends take no part; no edge gives no row."""
    now = scratch.cut(edges.filter("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        nxt = scratch.cut(_small_star(_large_star(now)), "stars")
        mark = nxt.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.count_if(F.col("v") > F.col("u"))).first()
        scratch.drop(now)
        now = nxt
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("v"))
    return roots.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v"), F.col("v")).distinct())
