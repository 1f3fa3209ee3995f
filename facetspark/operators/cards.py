"""Purpose-specific views of documents: aspect scores of spans, cards, assignment to aspects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

FLOOR = 0.15
FALLBACK_CHARS = 1500


def aspect_scores(scored: DataFrame, k: int = 2) -> DataFrame:
    """(uid, aspect, score): the mean of a span's k best anchors of each aspect; scored: (uid, aspect, anchor, score)."""
    best = F.row_number().over(W.partitionBy("uid", "aspect").orderBy(F.desc("score"), "anchor"))
    return scored.withColumn("r", best).where(F.col("r") <= k).groupBy("uid", "aspect").agg(F.avg("score").alias("score"))


def best_aspect(scores: DataFrame, floor: float | None = None, other: int = -1) -> DataFrame:
    """(uid, aspect, score): the best aspect of each span, ties to the lower; `other` below the floor."""
    first = F.row_number().over(W.partitionBy("uid").orderBy(F.desc(F.round("score", 12)), "aspect"))
    best = scores.withColumn("r", first).where("r = 1").drop("r")
    return best if floor is None else best.withColumn("aspect", F.when(F.col("score") >= floor, F.col("aspect")).otherwise(F.lit(other)))


def partition_cards(spans: DataFrame, best: DataFrame) -> DataFrame:
    """(doc, aspect, text): each span goes to its aspect's card, in order; spans: (uid, doc, pos, text). No span is lost."""
    both = spans.join(best.select("uid", "aspect"), "uid")
    return both.groupBy("doc", "aspect").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def lossy_cards(spans: DataFrame, scores: DataFrame, n: int, floor: float = FLOOR) -> DataFrame:
    """(doc, aspect, text): the n best spans of each aspect at or above the floor, best first."""
    first = F.row_number().over(W.partitionBy("doc", "aspect").orderBy(F.desc(F.round("score", 12)), "pos"))
    top = spans.join(scores.where(F.col("score") >= floor), "uid").withColumn("r", first).where(F.col("r") <= n)
    return top.groupBy("doc", "aspect").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " ").alias("text"))


def framed(cards: DataFrame, labels: DataFrame) -> DataFrame:
    """Cards with their aspect's label in front."""
    return cards.join(F.broadcast(labels), "aspect").withColumn("text", F.concat("label", F.lit(": "), "text")).drop("label")


def with_fallback(cards: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents (doc, text) without any card get their beginning as one card without aspect."""
    bare = docs.join(cards.select("doc").distinct(), "doc", "left_anti")
    return cards.unionByName(bare.select("doc", F.lit(None).cast("int").alias("aspect"), F.substring("text", 1, FALLBACK_CHARS).alias("text")))
