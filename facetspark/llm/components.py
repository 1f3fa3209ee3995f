"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from facetspark.llm.shared import cut

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of edges (a, b); the component is the smallest id that can be reached.

    Each round hangs the larger neighbours of every id on its smallest neighbour (large star), then the
    smaller ones (small star); the edges end as one star for each component. Neighbours are only ever
    aggregated to their minimum, so that a hub's neighbours never meet in one row, and a hub is joined back
    with a plain join, whose hot keys Spark can split. Loops and repeated edges are harmless; null ids are dropped.
    """
    now = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u > v").distinct()
    )
    before = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.where("u <> v").distinct())
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
