"""Packing ranked units into budgets, expansion, and temporal facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def budget_take(units: DataFrame, budget: int, keys: list[str], order: list[str], least: int = 1) -> DataFrame:
    """Units in order until the budget is full: taken (tokens that fit) and truncated.

    The first unit that doesn't fit is cut to what is left, if that is at least `least` tokens; then it stops.
    """
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = units.withColumn("upto", F.sum("tokens").over(w)).withColumn("before", F.col("upto") - F.col("tokens"))
    kept = run.where((F.col("before") < budget) & ((F.col("upto") <= budget) | (F.lit(budget) - F.col("before") >= least)))
    return kept.withColumn("taken", F.least("tokens", F.lit(budget) - F.col("before"))).withColumn("truncated", F.col("upto") > budget).drop("upto", "before")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """The last value that isn't null, up to this row."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.last(col, ignorenulls=True).over(w))


def duplicate_share(units: DataFrame) -> DataFrame:
    """units (qid, take_order, tokens, turns array): the share of tokens in units whose turns all came before."""
    flat = units.select("qid", "take_order", F.explode("turns").alias("turn"))
    first = flat.groupBy("qid", "turn").agg(F.min("take_order").alias("first"))
    seen = flat.join(first, ["qid", "turn"]).groupBy("qid", "take_order").agg(F.bool_and(F.col("first") < F.col("take_order")).alias("again"))
    both = units.join(seen, ["qid", "take_order"], "left")
    return both.groupBy("qid").agg((F.sum(F.when(F.col("again"), F.col("tokens")).otherwise(0)) / F.nullif(F.sum("tokens"), F.lit(0))).alias("duplicate_share"))


def supersede(facts: DataFrame) -> DataFrame:
    """facts (id, slot, clock, object): superseded_at, the earliest later clock at which the slot has another object.

    Facts without a clock neither supersede nor are superseded. A slot's clocks are summed up to their
    smallest and largest object; runs of clocks with one and the same object end where the next run begins,
    so no fact is compared with all later ones.
    """
    dated = facts.where("clock IS NOT NULL")
    at = dated.groupBy("slot", "clock").agg(F.min("object").alias("lo"), F.max("object").alias("hi"))
    w = W.partitionBy("slot").orderBy("clock")
    single = F.col("lo") == F.col("hi")
    same = single & (F.lag("lo").over(w) == F.col("lo")) & (F.lag("hi").over(w) == F.col("hi"))
    runs = at.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    starts = runs.groupBy("slot", "run").agg(F.min("clock").alias("start"))
    after = starts.withColumn("next_run", F.lead("start").over(W.partitionBy("slot").orderBy("run"))).select("slot", "run", "next_run")
    ahead = runs.join(after, ["slot", "run"])
    lead = [F.lead(c).over(w).alias(f"n_{c}") for c in ("clock", "lo", "hi", "next_run")]
    table = ahead.select("slot", "clock", *lead)
    nxt = F.when((F.col("n_lo") == F.col("object")) & (F.col("n_hi") == F.col("object")), F.col("n_next_run")).otherwise(F.col("n_clock"))
    return facts.join(table, ["slot", "clock"], "left").withColumn("superseded_at", nxt).drop("n_clock", "n_lo", "n_hi", "n_next_run")


def visible(facts: DataFrame, as_of, start: str = "clock", end: str = "superseded_at") -> DataFrame:
    """Facts that hold as of a time; without one, those that never ended."""
    if as_of is None:
        return facts.where(F.col(end).isNull())
    return facts.where((F.col(start) <= as_of) & (F.col(end).isNull() | (F.col(end) > as_of)))


def overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of spans of one key (a: key, a_id, a_start, a_end; b alike) that overlap by a byte at least."""
    return a.join(b, key).where((F.col("a_end") > F.col("b_start")) & (F.col("a_start") < F.col("b_end")))


def lazy_expand(kept: DataFrame, tail: DataFrame, owners: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """The kept ranking, then the remaining owners of its first `depth` containers by similarity, then the deeper list: stage and position.

    kept and tail (qid, uid, container, rank); owners (uid, container, vec); queries (qid, qvec). Only owners of those
    containers are scored, which an equi-join on the container finds.
    """
    w = W.partitionBy("qid").orderBy("first", "container")
    top = kept.groupBy("qid", "container").agg(F.min("rank").alias("first")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= depth)
    score = F.aggregate(F.zip_with("vec", "qvec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    inside = owners.join(top.select("qid", "container"), "container").join(queries, "qid").select("qid", "uid", F.lit(1).alias("stage"), (-score).alias("at"))
    ahead = kept.select("qid", "uid", F.lit(0).alias("stage"), F.col("rank").cast("double").alias("at"))
    every = ahead.unionByName(inside).unionByName(tail.select("qid", "uid", F.lit(2).alias("stage"), F.col("rank").cast("double").alias("at")))
    once = every.groupBy("qid", "uid").agg(F.min(F.struct("stage", "at")).alias("x")).select("qid", "uid", "x.stage", "x.at")
    return once.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("stage", "at", "uid")))
