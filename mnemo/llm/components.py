"""Connected components of an edge table, by alternating star steps.

Every step is a minimum per node (partially aggregated, so a hub costs one
row per map task) and a join back, both of which Spark splits when a node
is hot. Each round is written to the shared checkpoint folder: the lineage
stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.sources.snapshot import materialize


def _large(e: DataFrame) -> DataFrame:
    """Larger neighbours of every node point to its smallest neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # repeated pairs go with the next step, which ends in a distinct
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(e: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, point to the smallest."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node that has an edge to a smaller one.

    ``edges`` has LONG columns u and v, of which self-loops and nulls are
    left out. root is the smallest node of u's component; the roots
    themselves have no row.
    """
    spark = edges.sparkSession
    e = materialize(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return e.select("u", F.col("v").alias("root"))
        before = mark
        e = materialize(spark, _small(_large(e)), "links")
