"""Retrieval channels: folding units to owners, group, relation and entity channels, and the lazy walk over communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Phrases of an entity table that are broadcast.
PHRASE_BYTES = 16_000_000


def fold_first(ranking: DataFrame, owner: str, depth: int) -> DataFrame:
    """(qid, owner, score, via, rank): owners by first appearance in a ranking (qid, uid, score, rank), with the unit that brought them."""
    best = ranking.groupBy("qid", owner).agg(F.min("rank").alias("first"), F.min_by("score", "rank").alias("score"), F.min_by("uid", "rank").alias("via"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("first", owner))).where(F.col("rank") <= depth).drop("first")


def union_in_order(lists: list[DataFrame], key: str) -> DataFrame:
    """(qid, key, rank): the lists one after the other, without repeats."""
    every = None
    for i, one in enumerate(lists):
        part = one.select("qid", key, F.struct(F.lit(i).alias("list"), F.col("rank").cast("long").alias("rank")).alias("at"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("qid", key).agg(F.min("at").alias("at"))
    return first.select("qid", key, F.row_number().over(W.partitionBy("qid").orderBy("at", key)).alias("rank"))


def seeded_pool(base: DataFrame, groups: DataFrame, scored: DataFrame, seeds: int, depth: int) -> DataFrame:
    """(qid, uid, rank): members of the groups (uid, grp) of a query's first `seeds` units, by positive score.

    scored (qid, uid, score) must hold the best `depth` of each group.
    """
    asked = base.where(F.col("rank") <= seeds).join(groups, "uid").select("qid", "grp").distinct()
    pool = scored.join(groups, "uid").join(asked, ["qid", "grp"], "left_semi").groupBy("qid", "uid").agg(F.max("score").alias("score")).where("score > 0")
    return pool.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "uid"))).where(F.col("rank") <= depth)


def relation_channel(scored: list[DataFrame], sources: DataFrame, depth: int) -> DataFrame:
    """(qid, uid, via, rank): units of the relations (sources: rel, pos, uid) by the better of a relation's renderings.

    Each of scored (qid, rel, score) holds the best relations of one rendering, deep enough for `depth` units.
    """
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    best = every.groupBy("qid", "rel").agg(F.max("score").alias("score"))
    placed = best.join(sources, "rel").select("qid", "uid", F.struct((-F.round("score", 12)).alias("s"), "rel", "pos").alias("at"))
    first = placed.groupBy("qid", "uid").agg(F.min("at").alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("at", "uid")))
    return ranked.where(F.col("rank") <= depth).select("qid", "uid", F.col("at.rel").alias("via"), "rank")


def phrase_matches(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """(qid, key, phrase): for each entity key the longest of its phrases that stands in the question between word boundaries.

    questions (qid, words), phrases (key, words); arrays of normalised words, without blanks. Phrases of PHRASE_BYTES at most
    are broadcast and meet each place of a question, which carries as many words as the longest phrase has, by its first word. More phrases
    meet runs of as many words as any phrase has (one number for each length comes to the driver) as whole texts, so that a
    frequent word is no key of a shuffle. Either way no row carries the question, and work is linear in its length.
    """
    listed = phrases.where(F.size("words") > 0).select("key", F.col("words").alias("phrase"), F.size("words").alias("n"))
    lengths = listed.groupBy("n").agg(F.sum(F.octet_length(F.array_join("phrase", " ")) + 64 + 16 * F.col("n")).alias("bytes")).collect()
    none = F.array().cast("array<array<string>>")

    def runs(count: Column, n: int) -> Column:
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("words", i + 1, F.lit(n)))).otherwise(none)

    # explode_outer, as Spark puts a filter on the array's size below explode, which would build the runs twice
    if sum(r["bytes"] for r in lengths) <= PHRASE_BYTES:
        placed = questions.select("qid", F.explode_outer(runs(F.size("words"), max([r["n"] for r in lengths], default=1))).alias("run"))
        known = F.broadcast(listed.withColumn("first", F.get("phrase", F.lit(0))))
        found = placed.withColumn("first", F.get("run", F.lit(0))).join(known, "first").where(F.slice("run", F.lit(1), F.col("n")) == F.col("phrase"))
        found = found.select("qid", "key", F.array_join("phrase", " ").alias("phrase"))
    else:
        every = F.concat(*[F.transform(runs(F.size("words") - r["n"] + 1, r["n"]), lambda run: F.array_join(run, " ")) for r in sorted(lengths)])
        placed = questions.select("qid", F.explode_outer(F.array_distinct(every)).alias("phrase"))
        found = placed.join(listed.withColumn("phrase", F.array_join("phrase", " ")), "phrase")
    best = found.groupBy("qid", "key").agg(F.min(F.struct((-F.length("phrase")).alias("n"), "phrase")).alias("b"))
    return best.select("qid", "key", F.col("b.phrase").alias("phrase"))


def entity_order(matches: DataFrame) -> Column:
    """Entities by length of the matched phrase, then phrase, then key."""
    return F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.length("phrase")), "phrase", "key"))


def lazy_walk(hits: DataFrame, members: DataFrame, verdicts: DataFrame, tests: int = 20, each: int = 5, stop: int = 3) -> DataFrame:
    """(qid, grp, place, hits, tested, accepted): communities visited for each query, and how many of their units were accepted.

    Communities come by the number of dense hits (qid, grp, rank) in them, then best rank, then id. Of each the best
    `each` members (qid, grp, uid, score) are tested, `tests` at most in all; verdicts (uid) are the accepted units. The walk ends
    after `stop` communities in a row without an accepted unit.
    """
    per = W.partitionBy("qid")
    visits = hits.groupBy("qid", "grp").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    visits = visits.withColumn("place", F.row_number().over(per.orderBy(F.desc("hits"), "first", "grp"))).where(F.col("place") <= tests)
    picked = members.withColumn("nth", F.row_number().over(W.partitionBy("qid", "grp").orderBy(F.desc("score"), "uid"))).where(F.col("nth") <= each)
    tried = visits.join(picked, ["qid", "grp"]).withColumn("test", F.row_number().over(per.orderBy("place", "nth"))).where(F.col("test") <= tests)
    judged = tried.join(verdicts.select("uid", F.lit(1).alias("yes")), "uid", "left")
    done = judged.groupBy("qid", "grp", "place", "hits").agg(F.count("*").alias("tested"), F.count("yes").alias("accepted"))
    upto = per.orderBy("place")
    barren = F.sum((F.col("accepted") == 0).cast("int")).over(upto.rowsBetween(1 - stop, 0)) == stop
    ended = F.max(F.col("barren").cast("int")).over(upto.rowsBetween(W.unboundedPreceding, -1))
    return done.withColumn("barren", barren).withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0").drop("barren", "ended")


def display_order(units: DataFrame, key: str, date: str, container: Column, index: Column) -> DataFrame:
    """Taken units in the order they are shown: undated ones first in rank order, then by date, container, index and rank."""
    w = W.partitionBy(key).orderBy(F.col(date).isNotNull(), F.col(date), F.when(F.col(date).isNotNull(), container), F.when(F.col(date).isNotNull(), index), "rank")
    return units.withColumn("shown", F.row_number().over(w))
