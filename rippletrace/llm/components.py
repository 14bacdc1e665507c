"""Connected components of an edge table by alternating large and small stars.

Each round re-hangs every neighbour on the smallest known node, first upwards,
then downwards; rounds end when the edges no longer change. Labels are minima
(combined before they are shuffled), so a node with very many neighbours costs
one row per task, and the joins back are plain equi-joins that adaptive
execution can split. Nothing but two figures a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of one type -> (node, component) for every node but the smallest of each component.

    Null ends and self-loops are dropped; repeated edges count once; no edges give no rows.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = cut(ordered), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        now = cut(_small(_large(now).distinct()).distinct())
