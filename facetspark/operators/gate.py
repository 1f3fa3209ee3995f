"""Relevance gates: component scores, a fitted logistic gate, quantile gates and their evaluation."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window as W, functions as F

from facetspark.operators.stats import exact_percentile, order_statistics


def component_scores(scored: DataFrame, k: int = 3) -> DataFrame:
    """(uid, key, score): the mean of a unit's k best anchors in each anchor set; scored: (uid, key, anchor, score)."""
    best = F.row_number().over(W.partitionBy("uid", "key").orderBy(F.desc("score"), "anchor"))
    return scored.withColumn("r", best).where(F.col("r") <= k).groupBy("uid", "key").agg(F.avg("score").alias("score"))


def fit_gate(features: DataFrame, columns: list[str], recall: float = 0.95):
    """(weights, bias, threshold) from rows with 0/1 label: L2 logistic regression with C = 1, threshold at the recall's quantile of the positives."""
    data = VectorAssembler(inputCols=columns, outputCol="x").transform(features)
    n = data.count()
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1 / n, elasticNetParam=0.0, standardization=False).fit(data)
    weights, bias = model.coefficients.toArray().tolist(), float(model.intercept)
    positives = apply_gate(features.where("label = 1"), columns, weights, bias)
    threshold = exact_percentile(positives, "gate", 1 - recall)
    return weights, bias, threshold


def apply_gate(features: DataFrame, columns: list[str], weights: list[float], bias: float) -> DataFrame:
    total = F.lit(bias)
    for c, w in zip(columns, weights):
        total = total + F.col(c) * w
    return features.withColumn("gate", total)


def quantile_gate(df: DataFrame, score: str, q: float) -> DataFrame:
    """Rows at or above the score's exact quantile."""
    return df.where(F.col(score) >= F.lit(exact_percentile(df, score, q)))


def top_fraction(df: DataFrame, score: str, key: str, fraction: float, least: int) -> DataFrame:
    """The best fraction by score (rounded half to even), `least` rows at least; ties at the edge go to the smaller key.

    The edge is found from counts, so only rows that tie at it are ordered.
    """
    kept = []
    found = order_statistics(df, score, lambda n: (kept.append(min(n, max(least, round(fraction * n)))), n - kept[0], n - kept[0])[1:])
    if not found:
        return df.limit(0)
    edge = next(iter(found.values()))
    above = df.where(F.col(score) > edge)
    tied = df.where(F.col(score) == edge).orderBy(key).limit(kept[0] - above.count())
    return above.unionByName(tied)


def evaluate(df: DataFrame, passed: str = "passed", label: str = "label") -> DataFrame:
    """One row: confusion cells, precision, recall and share that survives."""
    yes = F.col(label) == 1
    cells = df.agg(
        F.count_if(F.col(passed) & yes).alias("tp"), F.count_if(F.col(passed) & ~yes).alias("fp"), F.count_if(~F.col(passed) & yes).alias("fn"), F.count_if(~F.col(passed) & ~yes).alias("tn")
    )
    ratio = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))
    c = F.col
    return cells.select(
        "tp", "fp", "fn", "tn", ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        ratio(c("tp") + c("fp"), c("tp") + c("fp") + c("fn") + c("tn")).alias("survival"),
    )


