"""Answers scored by shared stems, with the rules of each category of question."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from facetspark.functions.stems import stems

# Categories of questions, and what says that there is no answer.
LISTS, ALTERNATIVES, ABSTAINS = 1, 3, 5
SINGLE = (2, 3, 4)
ABSTENTIONS = ("no information available", "not mentioned")


def _parts(answers: DataFrame, col: str) -> DataFrame:
    """(qid, part, stem, n, size): how often each stem stands in each part of an answer. Lists are split at commas, others are one part."""
    pieces = F.when(F.col("category") == LISTS, F.split(col, ",")).otherwise(F.array(col))
    every = answers.select("qid", F.posexplode(pieces).alias("part", "text")).select("qid", "part", stems("text").alias("s"))
    return every.select("qid", "part", F.size("s").alias("size"), F.explode("s").alias("stem")).groupBy("qid", "part", "stem", "size").agg(F.count("*").alias("n"))


def category_scores(answers: DataFrame) -> DataFrame:
    """(qid, category, score) of answers (qid, category, prediction, reference).

    2, 3 and 4: F1 of the two texts' stems, counted with repeats; of 3 the reference is what stands before its first
    semicolon. 1: the reference is a list, each part takes its best F1 among the parts of the prediction, and they are averaged. 5: 1 where the
    prediction abstains. Other categories have a null score. Null texts are empty; texts without words score 0.

    Parts meet by the stems they share, so parts without one are never paired; a common stem pairs parts of one question
    only. Repeated qids must be told apart by the caller.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    reference = F.when(F.col("category") == ALTERNATIVES, F.trim(F.substring_index(text("reference"), ";", 1))).otherwise(text("reference"))
    rows = answers.select("qid", "category", text("prediction").alias("prediction"), reference.alias("reference"))
    scored = rows.where(F.col("category").isin(LISTS, *SINGLE))
    mine = _parts(scored, "prediction").withColumnRenamed("part", "other").withColumnRenamed("n", "m").withColumnRenamed("size", "width")
    both = _parts(scored, "reference").join(mine, ["qid", "stem"]).groupBy("qid", "part", "other", "size", "width").agg(F.sum(F.least("n", "m")).alias("common"))
    best = both.groupBy("qid", "part").agg(F.max(2 * F.col("common") / (F.col("size") + F.col("width"))).alias("f1"))
    total = best.groupBy("qid").agg(F.sum("f1").alias("f1"))
    parts = F.when(F.col("category") == LISTS, F.size(F.split("reference", ","))).otherwise(1)
    low = F.lower("prediction")
    abstains = F.contains(low, F.lit(ABSTENTIONS[0])) | F.contains(low, F.lit(ABSTENTIONS[1]))
    score = F.when(F.col("category") == ABSTAINS, abstains.cast("double")).when(F.col("category").isin(LISTS, *SINGLE), F.coalesce("f1", F.lit(0.0)) / parts)
    return rows.join(total, "qid", "left").select("qid", "category", score.alias("score"))
