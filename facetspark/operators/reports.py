"""Scores of questions and answers, failure buckets, accuracy cells, paired test records and their readings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetspark.functions import text as T


def share(condition: Column) -> Column:
    """The share of rows for which the condition holds; null where there are none."""
    return F.avg(condition.cast("int"))


def answers_over_aliases(pairs: DataFrame, key: str) -> DataFrame:
    """(key, exact, substring, n_aliases) of pairs (key, prediction, alias): whether any alias equals, or stands in, the prediction after normalising."""
    norm = pairs.select(key, T.normalise_answer(F.col("prediction")).alias("p"), T.normalise_answer(F.col("alias")).alias("a"))
    return norm.groupBy(key).agg(F.bool_or(F.col("p") == F.col("a")).alias("exact"), F.bool_or(F.contains("p", "a")).alias("substring"), F.count("*").alias("n_aliases"))


def mcq_letter(reply: Column) -> Column:
    """The option that a reply names and nothing else: B, (B), Answer: B. Null for any other reply."""
    return F.upper(F.nullif(F.regexp_extract(reply, r"^(?i)\s*(?:answer\s*:\s*)?\(?([a-d])\)?[.\s]*$", 1), F.lit("")))


def rubric_score(reply: Column) -> Column:
    """The score 0, 0.5 or 1 of a JSON reply, inside a fence or not; null for any other reply."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    score = F.try_to_number(F.get_json_object(bare, "$.score"), F.lit("9.9")).cast("double")
    return F.when(score.isin(0.0, 0.5, 1.0), score)


def recovered_rubric(reply: Column) -> Column:
    """(score, recovered): the rubric score of a reply, or where it has none that of the reply with its illegal escapes made literal."""
    repaired = T.repair_json_escapes(reply)
    direct, again = rubric_score(reply), F.when(repaired != reply, rubric_score(repaired))
    return F.struct(F.coalesce(direct, again).alias("score"), (direct.isNull() & again.isNotNull()).alias("recovered"))


def rubric_mean(judgements: DataFrame, key: str, expected: str) -> DataFrame:
    """(key, rubric): the mean of the scores where all expected items have a valid one; else null."""
    agg = judgements.groupBy(key).agg(F.count("score").alias("n"), F.count("*").alias("rows"), F.max(expected).alias("want"), F.sum("score").alias("total"))
    complete = (F.col("n") == F.col("want")) & (F.col("rows") == F.col("want"))
    return agg.select(key, F.when(complete, F.col("total") / F.col("want")).alias("rubric"))


def capped_precision(ranking: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """(qid, ap, hit_fraction, hit): average precision over min(evidence, k), the share of evidence in the first k, and whether any is."""
    total = evidence.select("qid", "uid").distinct().groupBy("qid").agg(F.count("*").alias("relevant"))
    hits = ranking.where(F.col("rank") <= k).join(evidence.select("qid", "uid").distinct(), ["qid", "uid"])
    nth = F.row_number().over(W.partitionBy("qid").orderBy("rank"))
    summed = hits.withColumn("nth", nth).groupBy("qid").agg(F.sum(F.col("nth") / F.col("rank")).alias("s"), F.count("*").alias("n"))
    both = total.join(summed, "qid", "left")
    return both.select("qid", (F.coalesce("s", F.lit(0.0)) / F.least("relevant", F.lit(k))).alias("ap"), (F.coalesce("n", F.lit(0)) / F.col("relevant")).alias("hit_fraction"), F.col("n").isNotNull().alias("hit"))


def budget_retrieval(ranking: DataFrame, rendered: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, recall_at_5, recall_at_10, recall_at_100, evidence_recall_at_budget, all_evidence_at_budget): evidence in the ranking and wholly rendered."""
    e = evidence.select("qid", "uid").distinct().join(ranking.select("qid", "uid", "rank"), ["qid", "uid"], "left").join(rendered.select("qid", "uid", F.lit(True).alias("shown")).distinct(), ["qid", "uid"], "left")
    at = [share(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"recall_at_{k}") for k in (5, 10, 100)]
    shown = F.coalesce("shown", F.lit(False))
    return e.groupBy("qid").agg(*at, share(shown).alias("evidence_recall_at_budget"), F.bool_and(shown).cast("int").alias("all_evidence_at_budget"))


def alpha_ndcg(ranking: DataFrame, subtopics: DataFrame, candidates: DataFrame, alpha: float = 0.5, k: int = 20) -> DataFrame:
    """(qid, alpha_dcg, ideal, alpha_ndcg): gain with repeats of a subtopic discounted, over that of the greedy ideal ranking.

    ranking and candidates (qid, uid, rank), the latter a bounded pool in a fixed order; subtopics (qid, uid, subtopic). The greedy
    ideal takes one candidate after the other, so a query's pool is worked on by one task.
    """
    pool = candidates.select("qid", "uid", F.col("rank").alias("place"))
    rows = pool.join(ranking.select("qid", "uid", "rank"), ["qid", "uid"], "full").join(subtopics, ["qid", "uid"], "left").groupBy("qid", "uid", "place", "rank").agg(F.sort_array(F.collect_set("subtopic")).alias("topics"))
    kind = dict(rows.dtypes)["qid"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import math

        def gain(topics, seen) -> float:
            return sum((1 - alpha) ** seen.get(t, 0) for t in topics)

        def score(order: Iterator) -> float:
            seen, total = {}, 0.0
            for at, topics in enumerate(order):
                total += gain(topics, seen) / math.log2(at + 2)
                for t in topics:
                    seen[t] = seen.get(t, 0) + 1
            return total

        got = score(pdf[pdf["rank"] <= k].sort_values("rank")["topics"])
        left = pdf[pdf["place"].notna()].sort_values("place")["topics"].tolist()
        best, seen = [], {}
        while left and len(best) < k:
            i = max(range(len(left)), key=lambda j: (gain(left[j], seen), -j))
            best.append(left.pop(i))
            for t in best[-1]:
                seen[t] = seen.get(t, 0) + 1
        ideal = score(best)
        return pd.DataFrame([(pdf["qid"].iloc[0], got, ideal, got / ideal if ideal > 0 else 0.0)], columns=["qid", "alpha_dcg", "ideal", "alpha_ndcg"])

    return rows.groupBy("qid").applyInPandas(run, f"qid {kind}, alpha_dcg double, ideal double, alpha_ndcg double")


def failure_bucket(cases: DataFrame) -> DataFrame:
    """bucket and decidable: 0 where the answer isn't wrong, 5 where the judges disagree, then the first stage that lost evidence, else 4.

    cases: primary, second (verdicts, null where there is none), indexed, found and rendered (all evidence is in the
    index, among the candidates, in the context).
    """
    wrong = F.coalesce(~F.col("primary"), F.lit(False))
    b = (
        F.when(~wrong, 0).when(F.col("second").isNotNull() & (F.col("second") != F.col("primary")), 5)
        .when(~F.col("indexed"), 1).when(~F.col("found"), 2).when(~F.col("rendered"), 3).otherwise(4)
    )
    return cases.withColumn("bucket", b).withColumn("decidable", F.col("second").isNotNull())


def bucket_counts(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Wrong answers by bucket, and those of which the judges' agreement isn't known, for each key and each subset of the last key."""
    n = [F.count_if(F.col("bucket") == b).alias(f"bucket_{b}") for b in (5, 1, 2, 3, 4)]
    return judged.where("bucket <> 0").groupBy(*keys).agg(*n, F.count("*").alias("n_wrong"), F.count_if(~F.col("decidable")).alias("n_undecidable"))


def accuracy_cell(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row a cell: accuracy of all, of answerable and of abstention questions, and the second judge's beside it.

    records: correct, second (booleans, null where not judged), abstention, missing.
    """
    judged, both = F.col("second").isNotNull(), F.col("second").isNotNull() & F.col("correct").isNotNull()
    return records.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("missing").alias("n_missing"), share(F.coalesce("correct", F.lit(False))).alias("acc_all"),
        share(F.when(~F.col("abstention"), F.coalesce("correct", F.lit(False)))).alias("acc_answerable"), share(F.when(F.col("abstention"), F.coalesce("correct", F.lit(False)))).alias("acc_abstention"),
        F.count_if(judged).alias("second_n"), share(F.col("second")).alias("second_acc"), F.count_if(both & (F.col("second") != F.col("correct"))).alias("n_disagree"),
    )


def summarise(scores: DataFrame, keys: list[str], fields: list[str], missing: str = "missing") -> DataFrame:
    """Means of the fields over all questions of a key, nulls left out, with their number and that of missing ones."""
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(missing).alias("n_missing"), *[F.avg(f).alias(f) for f in fields])


def consecutive_arms(values: DataFrame, arms: list[str]) -> DataFrame:
    """(step, qid, a, b): each arm paired with the one before it; what an arm lacks counts as zero."""
    wide = values.groupBy("qid").pivot("arm", arms).agg(F.first("value")).na.fill(0.0, arms)
    steps = [F.struct(F.lit(f"{y}-{x}").alias("step"), F.col(x).alias("a"), F.col(y).alias("b")) for x, y in zip(arms, arms[1:])]
    return wide.select("qid", F.explode(F.array(*steps)).alias("s")).select("s.step", "qid", "s.a", "s.b")


def interaction(values: DataFrame, arms: tuple[str, str], groups: tuple[str, str]) -> DataFrame:
    """One row: the gain of the second arm over the first in each of two groups, and their difference."""
    gain = lambda g: F.avg(F.when((F.col("grp") == g) & (F.col("arm") == arms[1]), F.col("value"))) - F.avg(F.when((F.col("grp") == g) & (F.col("arm") == arms[0]), F.col("value")))
    one = values.agg(gain(groups[0]).alias("first_gain"), gain(groups[1]).alias("second_gain"))
    return one.withColumn("difference", F.col("first_gain") - F.col("second_gain"))


def reading(tests: DataFrame, most_losses: int = 3) -> DataFrame:
    """label, holds and net_losses of test records (ran, partial, delta, holm_significant, wins, losses).

    shown: positive and significant; not shown: positive alone; failed: not positive. holds is non-inferiority: at most
    most_losses more losses than wins, on a complete run.
    """
    label = (
        F.when(~F.col("ran"), "not run").when(F.col("partial"), "partial").when(F.coalesce(F.col("delta") <= 0, F.lit(True)), "failed")
        .when(F.coalesce("holm_significant", F.lit(False)), "shown").otherwise("not shown")
    )
    net = F.col("losses") - F.col("wins")
    return tests.withColumn("label", label).withColumn("net_losses", net).withColumn("holds", F.col("ran") & ~F.col("partial") & (net <= most_losses))


def ledger(rows: DataFrame, stage: str, corpus: str, invocation: str, usd: str) -> DataFrame:
    """(stage, corpus, usd, invocations): sums of each corpus, and of the stage (corpus null), where an invocation of several corpora counts once."""
    by_corpus = rows.groupBy(stage, corpus).agg(F.round(F.sum(usd), 6).alias("usd"), F.count("*").alias("invocations"))
    once = rows.groupBy(stage, invocation).agg(F.min_by(usd, corpus).alias("usd"))
    total = once.groupBy(stage).agg(F.round(F.sum("usd"), 6).alias("usd"), F.count("*").alias("invocations"))
    return by_corpus.unionByName(total.withColumn(corpus, F.lit(None).cast(dict(rows.dtypes)[corpus])))


def chosen_variant(means: DataFrame, key: str, variant: str, value: str, shipped: str) -> DataFrame:
    """(key, chosen): the variant with the highest value; the shipped one keeps a tie, then the first name."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc(value), F.col(variant) != shipped, variant))
    return means.withColumn("_nth", nth).where("_nth = 1").select(key, F.col(variant).alias("chosen"))


def completeness(have: Column, want: Column, least: float) -> Column:
    """none, partial (under the least share) or run."""
    return F.when(have == 0, "none").when(have < want * least, "partial").otherwise("run")


def group_payloads(members: DataFrame, words: DataFrame, key: str, id_col: str, text_col: str, keywords: int, excerpts: int, chars: int) -> DataFrame:
    """(key, size, keywords, excerpts) of groups: from counts of their words (key, word, n) and the beginnings of their first members."""
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "word"))
    top = words.withColumn("r", best).where(F.col("r") <= keywords).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), ",").alias("keywords"))
    nth = F.row_number().over(W.partitionBy(key).orderBy(id_col))
    few = members.withColumn("r", nth).where(F.col("r") <= excerpts).groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.substring(text_col, 1, chars).alias("t")))), lambda x: x["t"]), "|").alias("excerpts"))
    size = members.groupBy(key).agg(F.count("*").alias("size"))
    top, few = top.withColumnRenamed(key, "_top"), few.withColumnRenamed(key, "_few")
    both = size.join(top, F.col(key).eqNullSafe(F.col("_top")), "left").join(few, F.col(key).eqNullSafe(F.col("_few")), "left")
    return both.select(key, "size", "keywords", "excerpts")
