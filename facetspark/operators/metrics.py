"""Ranking, novelty and answer metrics over long-form rankings and gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def ranking_metrics(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """For each query of qrels: ndcg, recall, mrr, judged, success and ap at k.

    ranking: (qid, uid, rank from 1); qrels: (qid, uid, gain). Gains are linear, the ideal is over all qrels;
    a query without positive gains scores 0; unjudged units gain 0. judged is over min(k, length).
    """
    gains = qrels.where("gain IS NOT NULL")
    ideal_rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("gain"), "uid"))
    ideal = (
        gains.withColumn("i", ideal_rank).groupBy("qid")
        .agg(F.sum(F.when(F.col("i") <= k, F.col("gain") / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("idcg"), F.count_if(F.col("gain") > 0).alias("relevant"))
    )
    hits = ranking.where(F.col("rank") <= k).join(gains, ["qid", "uid"], "left").withColumn("rel", F.coalesce(F.col("gain") > 0, F.lit(False)))
    before = F.sum(F.col("rel").cast("int")).over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    found = hits.withColumn("precision", F.when(F.col("rel"), before / F.col("rank"))).groupBy("qid").agg(
        F.sum(F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.count_if("rel").alias("hits"),
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"),
        F.count_if(F.col("gain").isNotNull()).alias("known"),
        F.count("*").alias("shown"),
        F.sum("precision").alias("precisions"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(found, "qid", "left").select(
        "qid",
        F.when(F.col("idcg") > 0, zero(F.col("dcg") / F.col("idcg"))).otherwise(0.0).alias("ndcg"),
        zero(F.col("hits") / F.nullif("relevant", F.lit(0))).alias("recall"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("known") / F.least(F.lit(k), "shown")).alias("judged"),
        F.coalesce((F.col("hits") > 0).cast("int"), F.lit(0)).alias("success"),
        zero(F.col("precisions") / F.nullif("relevant", F.lit(0))).alias("ap"),
    )


def alpha_dcg(ranking: DataFrame, subtopics: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """(qid, alpha_dcg): each further unit of a subtopic counts (1 - alpha) times the one before."""
    seen = ranking.where(F.col("rank") <= k).join(subtopics, ["qid", "uid"])
    nth = F.row_number().over(W.partitionBy("qid", "subtopic").orderBy("rank")) - 1
    return seen.withColumn("g", F.pow(F.lit(1 - alpha), nth) / F.log2(F.col("rank") + 1)).groupBy("qid").agg(F.sum("g").alias("alpha_dcg"))


def subtopic_recall(ranking: DataFrame, subtopics: DataFrame, k: int) -> DataFrame:
    all_ = subtopics.groupBy("qid").agg(F.countDistinct("subtopic").alias("n"))
    hit = ranking.where(F.col("rank") <= k).join(subtopics, ["qid", "uid"]).groupBy("qid").agg(F.countDistinct("subtopic").alias("hit"))
    return all_.join(hit, "qid", "left").select("qid", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("subtopic_recall"))


def token_f1(pairs: DataFrame, id_col: str, predicted: Column, gold: Column) -> DataFrame:
    """(id, f1): F1 over the multisets of normalised tokens (arrays); 0 where they share none."""
    base = pairs.select(id_col, predicted.alias("p"), gold.alias("g"))
    count = lambda c: base.select(id_col, F.explode(c).alias("t")).groupBy(id_col, "t").agg(F.count("*").alias(f"n_{c}"))
    same = count("p").join(count("g"), [id_col, "t"]).groupBy(id_col).agg(F.sum(F.least("n_p", "n_g")).alias("same"))
    n = F.size("p") + F.size("g")
    return base.join(same, id_col, "left").select(id_col, F.when(n > 0, 2 * F.coalesce("same", F.lit(0)) / n).otherwise(0.0).alias("f1"))


def kendall_tau_b(items: DataFrame, key: str, x: str, y: str, tie: str) -> DataFrame:
    """(key, tau): tau-b between x and y within each key, null where undefined; pairs are of one key's items, a bounded list."""
    a, b = items.alias("a"), items.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{tie}") < F.col(f"b.{tie}")))
    sx, sy = F.signum(F.col(f"a.{x}") - F.col(f"b.{x}")), F.signum(F.col(f"a.{y}") - F.col(f"b.{y}"))
    sums = pairs.groupBy(F.col(f"a.{key}").alias(key)).agg(F.sum(sx * sy).alias("s"), F.sum(F.abs(sx)).alias("nx"), F.sum(F.abs(sy)).alias("ny"))
    return sums.select(key, F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("s") / F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def binary_scores(scored: DataFrame) -> DataFrame:
    """One row: roc_auc by average ranks of (score, positive boolean), null where a class is missing.

    Counted over distinct scores, so that ties share their average rank. Sums below a score run over a thousand
    stretches of the scores first, then inside them, so that no task holds all scores.
    """
    by = scored.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    ends = by.agg(F.min("score").cast("double").alias("low"), F.max("score").cast("double").alias("high"))
    stretch = F.coalesce(F.floor((F.col("score") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * 1000), F.lit(0))
    by = by.crossJoin(F.broadcast(ends)).withColumn("stretch", stretch)
    sums = by.groupBy("stretch").agg(F.sum("n").alias("in_stretch"))
    below = F.coalesce(F.sum("in_stretch").over(W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each stretch
    by = by.join(F.broadcast(sums.select("stretch", below.alias("below"))), "stretch")
    lower = F.col("below") + F.coalesce(F.sum("n").over(W.partitionBy("stretch").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return by.withColumn("wins", F.col("p") * (lower + F.col("n") / 2)).agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"), (F.sum("wins") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("roc_auc")
    )


def first_unused(verdicts: DataFrame) -> DataFrame:
    """(qid, cand, ref) of matches made one candidate after the other, each with the first reference that equals it and is still free.

    verdicts (qid, cand, ref) are the pairs judged equal, by position. In the order of candidate, then reference, a pair is a
    match if neither has been matched before; one pass over a question's pairs, which are a bounded list.
    """
    taken = F.struct(F.array().cast("array<long>").alias("cand"), F.array().cast("array<long>").alias("ref"))
    free = lambda s, x: ~F.array_contains(s["ref"], x["ref"]) & ~F.array_contains(s["cand"], x["cand"])
    more = lambda s, x: F.struct(F.concat(s["cand"], F.array(x["cand"])).alias("cand"), F.concat(s["ref"], F.array(x["ref"])).alias("ref"))
    listed = verdicts.groupBy("qid").agg(F.sort_array(F.collect_set(F.struct(F.col("cand").cast("long").alias("cand"), F.col("ref").cast("long").alias("ref")))).alias("p"))
    made = listed.select("qid", F.aggregate("p", taken, lambda s, x: F.when(free(s, x), more(s, x)).otherwise(s)).alias("m"))
    return made.select("qid", F.explode(F.arrays_zip("m.cand", "m.ref")).alias("m")).select("qid", "m.cand", "m.ref")


def event_order(references: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """(qid, precision, recall, f1, tau_norm, final_score) of ordered events: references (qid, ref, text), candidates (qid, cand, text), matches (qid, cand, ref).

    A matched candidate reads as its reference, the others as they stand. Precision counts candidates that read as no reference,
    recall references that no candidate reads as. The order is compared by Kendall's tau-b over all different
    texts: a text's rank in a list is its last position there, one more than their number where it is missing. tau_norm
    (from 0 to 1) and the final score, its product with f1, are null where tau is undefined. Questions are those with references.
    """
    named = matches.join(references.select("qid", "ref", F.col("text").alias("as")), ["qid", "ref"]).select("qid", "cand", "as")
    read = candidates.join(named, ["qid", "cand"], "left").select("qid", "cand", F.coalesce("as", "text").alias("text"))
    in_order = lambda df, at, out: df.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct(at, "text"))), lambda x: x["text"]).alias(out))
    both = in_order(references, "ref", "r").join(in_order(read, "cand", "c"), "qid", "left").withColumn("c", F.coalesce("c", F.array().cast("array<string>")))
    hits = F.size(F.array_intersect("r", "c"))
    wrong, missed = F.size(F.filter("c", lambda x: ~F.array_contains("r", x))), F.size(F.filter("r", lambda x: ~F.array_contains("c", x)))
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    scored = both.withColumn("precision", ratio(hits, wrong)).withColumn("recall", ratio(hits, missed))
    scored = scored.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    items = scored.select("qid", "r", "c", F.posexplode(F.array_distinct(F.concat("r", "c"))).alias("i", "text"), F.size(F.array_distinct(F.concat("r", "c"))).alias("n"))
    last = lambda xs: F.size(xs) + 1 - F.array_position(F.reverse(xs), F.col("text"))
    rank = lambda xs: F.when(F.array_contains(xs, F.col("text")), last(xs)).otherwise(F.col("n") + 1)
    tau = kendall_tau_b(items.select("qid", "i", rank("r").alias("x"), rank("c").alias("y")), "qid", "x", "y", "i")
    out = scored.join(tau, "qid", "left").withColumn("tau_norm", (F.col("tau") + 1) / 2)
    return out.select("qid", "precision", "recall", "f1", "tau_norm", (F.col("tau_norm") * F.col("f1")).alias("final_score"))
