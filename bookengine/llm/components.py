"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookengine.llm.store import discard, materialize, spill


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written, so that both sides of the join are plain exchanges: Spark splits a hot node's rows
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", 2 * count)
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the least of them. Edges come with a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (least node reachable) for every node of ``edges`` (a, b: longs), roots included.

    Nulls and loops are ignored. Each round is a written table; sums of the edges tell when a round
    changed nothing. Minima are taken map-side first, and a hot node's rows are in sort-merge joins that
    Spark may split.
    """
    spark = edges.sparkSession
    clean = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    state, path = spill(clean, "edges")
    mark = None
    while True:
        seen = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        if seen[0] == 0:
            break
        # a round never adds edges: each moves to another end or goes
        step = _small_star(_large_star(state, seen[0])).distinct()
        state, new_path = spill(step, "edges", 2 * seen[0])
        discard(spark, path)
        path = new_path
    roots = state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
