"""Retrieval arms: channel weights by the shape of a question, and all arms fused from channels that are scored once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

CHANNELS = ("dense", "bm25", "topic", "community", "relation", "entity")
# A shape's weights of the channels, in their order, and its depth of expansion.
SHAPE_WEIGHTS = {
    "local": (2, 2, 1, 1, 1, 1, 1),
    "entity": (1, 1, 1, 1, 2, 3, 2),
    "thematic": (1, 1, 3, 2, 1, 1, 2),
    "cross-topic": (1, 1, 2, 3, 1, 1, 3),
    "multi-hop": (1, 1, 1, 1, 3, 2, 3),
    "temporal": (2, 1, 1, 1, 2, 1, 2),
    "lexical": (1, 3, 0, 0, 0, 0, 1),
    "unanswerable": (1, 1, 0, 0, 0, 0, 0),
}
#: The depth of arms without a planner, which weigh every channel 1.
STATIC_DEPTH = 3
#: Channels that read the links between topics and communities, and those that read the graph of relations.
LINKED, GRAPH = ("topic", "community"), ("relation", "entity")


class Arm(NamedTuple):
    """kind: fused (all channels), cheap_turn and cheap_sentence (two channels of weight 1), or lazy (accepted units first)."""

    name: str
    kind: str
    planner: str
    overlay: str
    speaker_rule: bool
    graph: bool


# The arms.
ARMS = (
    Arm("ours_cheap", "cheap_turn", "static", "R0", True, False),
    Arm("ours_cheap_norule", "cheap_turn", "static", "R0", False, False),
    Arm("ours_sentence_norule", "cheap_sentence", "static", "R0", False, False),
    Arm("S4_static", "fused", "static", "R0", True, True),
    Arm("S5_primary", "fused", "llm", "R3", True, True),
    Arm("S5_primary_norule", "fused", "llm", "R3", False, True),
    Arm("S5_noPGR", "fused", "llm", "R3", True, False),
    Arm("S5_planner_rules", "fused", "rules", "R3", True, True),
    Arm("S5_planner_oracle", "fused", "oracle", "R3", True, True),
    Arm("S5_overlay_R0", "fused", "llm", "R0", True, True),
    Arm("S5_overlay_R2", "fused", "llm", "R2", True, True),
    Arm("S5_overlay_P0", "fused", "llm", "P0", True, True),
    Arm("S2_lazy", "lazy", "static", "R0", True, True),
)


def shape_weights(spark: SparkSession) -> DataFrame:
    """(shape, channel, weight, depth): a row for each channel of each shape; static is the shape of arms without a planner."""
    every = {**SHAPE_WEIGHTS, "static": (*[1] * len(CHANNELS), STATIC_DEPTH)}
    return spark.createDataFrame([(s, c, float(row[i]), row[-1]) for s, row in every.items() for i, c in enumerate(CHANNELS)], "shape string, channel string, weight double, depth int")


def _arm_channels(arms: tuple[Arm, ...], spark: SparkSession) -> DataFrame:
    """(arm, planner, speaker_rule, lazy, cheap, channel, overlay): the channels that an arm may read; overlay is '' where links don't matter."""
    rows = []
    for a in arms:
        cheap = {"cheap_turn": ("dense", "bm25"), "cheap_sentence": ("sentence", "bm25")}.get(a.kind)
        for c in cheap or [c for c in CHANNELS if a.graph or c not in GRAPH]:
            rows.append((a.name, a.planner, a.speaker_rule, a.kind == "lazy", cheap is not None, c, a.overlay if c in LINKED else ""))
    return spark.createDataFrame(rows, "arm string, planner string, speaker_rule boolean, lazy boolean, cheap boolean, channel string, overlay string")


def arm_weights(shapes: DataFrame, arms: tuple[Arm, ...] = ARMS) -> DataFrame:
    """(arm, qid, shape, depth, speaker_rule, lazy, channel, overlay, weight) of shapes (qid, planner, shape), without channels of weight 0.

    Arms without a planner weigh every question alike; cheap ones don't expand. The tables of arms and shapes are fixed and small, and are broadcast.
    """
    spark = shapes.sparkSession
    questions = shapes.select("qid", "planner", "shape").unionByName(shapes.select("qid").distinct().select("qid", F.lit("static").alias("planner"), F.lit("static").alias("shape")))
    rows = questions.join(F.broadcast(_arm_channels(arms, spark)), "planner").join(F.broadcast(shape_weights(spark)), ["shape", "channel"], "left")
    weight = F.when(F.col("cheap"), 1.0).otherwise(F.col("weight"))
    depth = F.when(F.col("cheap"), 0).otherwise(F.max("depth").over(W.partitionBy("arm", "qid")))
    return rows.select("arm", "qid", "shape", depth.alias("depth"), "speaker_rule", "lazy", "channel", "overlay", weight.alias("weight")).where("weight > 0")


def needed(weights: DataFrame) -> DataFrame:
    """(qid, channel, overlay): what any arm reads. A channel is scored for these questions alone, once for all arms."""
    return weights.select("qid", "channel", "overlay").distinct()


def run_arms(weights: DataFrame, hits: DataFrame, quarantined: DataFrame, accepted: DataFrame, depth: int = 100, k: int = 60) -> DataFrame:
    """(arm, qid, uid, rank, score): the ranking of every arm.

    hits (qid, channel, overlay, uid, rank) of all channels are fused by reciprocal rank with the arm's weights, the best `depth`
    stay, ties to the smaller uid. Lazy arms put accepted units (qid, uid, rank) before them. Arms under the speaker rule lose
    quarantined units (qid, uid), and the rest move up. Each hit meets the arms that read its channel, so a hit makes at
    most as many rows as there are arms, and they are summed by one exchange.
    """
    read = weights.select("arm", "qid", "channel", "overlay", "weight", "speaker_rule", "lazy")
    score = F.sum(F.col("weight") / (k + F.col("rank")))
    fused = hits.join(read, ["qid", "channel", "overlay"]).groupBy("arm", "qid", "uid", "speaker_rule", "lazy").agg(score.alias("score"))
    best = fused.withColumn("at", F.row_number().over(W.partitionBy("arm", "qid").orderBy(F.desc(F.round("score", 12)), "uid"))).where(F.col("at") <= depth)
    arms = weights.where("lazy").select("arm", "qid", "speaker_rule").distinct()
    first = accepted.join(arms, "qid").select("arm", "qid", "uid", "speaker_rule", F.lit(0).alias("stage"), F.col("rank").cast("long").alias("at"), F.lit(None).cast("double").alias("score"))
    every = best.select("arm", "qid", "uid", "speaker_rule", F.lit(1).alias("stage"), F.col("at").cast("long").alias("at"), "score").unionByName(first)
    once = every.groupBy("arm", "qid", "uid", "speaker_rule").agg(F.min(F.struct("stage", "at")).alias("at"), F.max("score").alias("score"))
    held = once.join(quarantined.select("qid", "uid", F.lit(True).alias("out")).distinct(), ["qid", "uid"], "left").where(~(F.col("speaker_rule") & F.coalesce("out", F.lit(False))))
    return held.withColumn("rank", F.row_number().over(W.partitionBy("arm", "qid").orderBy("at", "uid"))).select("arm", "qid", "uid", "rank", "score")
