"""Coverage of evidence by rendered units, joint recall, failure buckets and answer scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A turn is covered when so much of it is shown: half of its length, 2,000 characters at most.
HALF, MOST_CHARS = 2, 2000


def cover_threshold(length: Column) -> Column:
    return F.least(length / HALF, F.lit(float(MOST_CHARS)))


def turn_coverage(shown: DataFrame, lengths: DataFrame) -> DataFrame:
    """(qid, turn, chars, covered): shown (qid, turn, chars) summed against the turns' lengths (turn, length)."""
    total = shown.groupBy("qid", "turn").agg(F.sum("chars").alias("chars"))
    return total.join(lengths, "turn").withColumn("covered", F.col("chars") >= cover_threshold(F.col("length"))).drop("length")


def joint_recall(evidence: DataFrame, covered: DataFrame) -> DataFrame:
    """(qid, recall, joint): the share of evidence (qid, turn) that is covered, and whether all is."""
    hit = covered.where("covered").select("qid", "turn", F.lit(1).alias("hit")).distinct()
    both = evidence.join(hit, ["qid", "turn"], "left")
    return both.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.bool_and(F.col("hit").isNotNull()).alias("joint"))


def joint_hit(evidence: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    """(qid, joint): all evidence (qid, uid) is among the first k."""
    both = evidence.join(ranking.select("qid", "uid", "rank"), ["qid", "uid"], "left")
    return both.groupBy("qid").agg(F.bool_and(F.coalesce(F.col("rank") <= k, F.lit(False))).alias("joint"))


def p_mrr(before: DataFrame, after: DataFrame, changed: DataFrame, floor: int) -> DataFrame:
    """(qid, p_mrr): how far the changed documents (qid, uid) fall, in -1..1; a missing document stands at the floor rank."""
    r = changed.join(before.select("qid", "uid", F.col("rank").alias("r0")), ["qid", "uid"], "left").join(after.select("qid", "uid", F.col("rank").alias("r1")), ["qid", "uid"], "left")
    a, b = F.coalesce("r0", F.lit(floor)), F.coalesce("r1", F.lit(floor))
    return r.withColumn("v", F.when(a > b, b / a - 1).otherwise(1 - a / b)).groupBy("qid").agg(F.avg("v").alias("p_mrr"))


def buckets(cases: DataFrame) -> DataFrame:
    """bucket 5, 1, 2, 3, 4 by the first rule that holds; cases: refused, located, retrieved, rendered (booleans)."""
    rule = (
        F.when(F.col("refused"), 5).when(~F.col("located"), 1).when(~F.col("retrieved"), 2).when(~F.col("rendered"), 3).otherwise(4)
    )
    return cases.withColumn("bucket", rule)


def replacements_first(ranking: DataFrame, successor: DataFrame) -> DataFrame:
    """A ranking (qid, uid, rank) with each unit's successor (uid, new) put before it, without repeats."""
    moved = ranking.join(successor, "uid").select("qid", F.col("new").alias("uid"), "rank", F.lit(0).alias("at"))
    both = moved.unionByName(ranking.select("qid", "uid", "rank", F.lit(1).alias("at")))
    first = both.groupBy("qid", "uid").agg(F.min(F.struct("rank", "at")).alias("f"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("f", "uid"))).drop("f")


def group_channel(groups: DataFrame, members: DataFrame, scores: DataFrame, best: int = 3) -> DataFrame:
    """(qid, uid, rank): members of each query's best groups that have members, by their own score.

    groups (qid, grp, score), members (grp, uid), scores (qid, uid, score). Scored units look up their groups, as all members of a query's groups are
    queries times units.
    """
    filled = groups.join(members.select("grp").distinct(), "grp", "left_semi")
    top = filled.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "grp"))).where(F.col("r") <= best).select("qid", "grp")
    inside = scores.select("qid", "uid").join(members, "uid").join(top, ["qid", "grp"], "left_semi").select("qid", "uid").distinct()
    pool = inside.join(scores, ["qid", "uid"])
    return pool.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "uid")))


def clipped(start: Column, end: Column, length: int) -> Column:
    """How much of a span lies in the first `length` characters."""
    return F.greatest(F.lit(0), F.least(end, F.lit(length)) - start)
