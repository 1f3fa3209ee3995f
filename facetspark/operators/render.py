"""Contexts in which compressed units show their facts in the place of their text, cut to a budget of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def word_pieces(text: Column) -> Column:
    """A text in pieces that end with a token each: a run of `\\w` and what stands before it. What follows the last token is in no piece."""
    return F.regexp_extract_all(text, F.lit(r"\W*\w+"), F.lit(0))


def fact_bodies(facts: DataFrame, budget: int, pieces: Callable[[Column], Column] = word_pieces) -> DataFrame:
    """(uid, body): the facts (uid, place, line) of a unit, a line each in order of place.

    Facts that begin beyond the budget are left out, as they could never be shown; so a unit with any number of
    facts makes a text of bounded tokens.
    """
    w = W.partitionBy("uid").orderBy("place", "line").rowsBetween(W.unboundedPreceding, -1)
    early = facts.where("line IS NOT NULL").withColumn("before", F.coalesce(F.sum(F.size(pieces(F.col("line")))).over(w), F.lit(0))).where(F.col("before") < budget)
    lines = F.sort_array(F.collect_list(F.struct("place", "line")))
    return early.groupBy("uid").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))


def lines(
    ranking: DataFrame, units: DataFrame, compressed: DataFrame, facts: DataFrame, budget: int, least: int = 20, pieces: Callable[[Column], Column] = word_pieces
) -> DataFrame:
    """(qid, uid, rank, line, tokens, truncated, compressed): what each unit shows, until fewer than `least` tokens are left.

    ranking (qid, uid, rank), units (uid, text, date, speaker, place), compressed (uid), facts (uid, place, line). A line
    is a heading and the unit's body: its text, or, for a compressed unit, its facts. Compressed units
    without facts and units that aren't known are passed over. The budget runs over what is shown, headings included; the line that
    exceeds it is cut after the last token that fits. `pieces` splits a text after each token.

    Nulls in a heading are empty; a null text is empty. A unit that a question ranks twice is shown twice.
    """
    wanted = compressed.select("uid").distinct().withColumn("compressed", F.lit(True))
    bodies = fact_bodies(facts.join(wanted.join(ranking.select("uid").distinct(), "uid", "left_semi"), "uid", "left_semi"), budget, pieces)
    known = ranking.select("qid", "uid", "rank").join(units.select("uid", "text", "date", "speaker", F.col("place").alias("at")), "uid")
    known = known.join(wanted, "uid", "left").join(bodies, "uid", "left").withColumn("compressed", F.coalesce("compressed", F.lit(False)))
    w = W.partitionBy("qid").orderBy("rank", "uid")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    heading = F.concat(F.lit("["), text("uid"), F.lit("; "), text("date"), F.lit("; "), text("speaker"), F.lit("; order="), text("at"), F.lit("]\n"))
    visible = known.where("NOT compressed OR body IS NOT NULL").withColumn("nth", F.row_number().over(w))
    line = F.concat(F.when(F.col("nth") > 1, "\n\n").otherwise(""), heading, F.when(F.col("compressed"), F.col("body")).otherwise(text("text")))
    counted = visible.select("qid", "uid", "rank", "compressed", line.alias("line")).withColumn("n", F.size(pieces(F.col("line"))))
    left = F.lit(budget) - (F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    kept = counted.withColumn("left", left).where(F.col("left") >= least)
    cut = F.array_join(F.slice(pieces(F.col("line")), F.lit(1), F.col("left").cast("int")), "")
    over = F.col("n") > F.col("left")
    return kept.select("qid", "uid", "rank", F.when(over, cut).otherwise(F.col("line")).alias("line"), F.least("n", "left").alias("tokens"), over.alias("truncated"), "compressed")


def contexts(shown: DataFrame) -> DataFrame:
    """(qid, context, tokens, selected, compressed, truncated): the lines of a question as one text, and the units in it."""
    every = F.sort_array(F.collect_list(F.struct("rank", "uid", "line")))
    rows = shown.groupBy("qid").agg(every.alias("l"), F.sum("tokens").alias("tokens"), F.count_if("compressed").alias("compressed"), F.count_if("truncated").alias("truncated"))
    return rows.select("qid", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("context"), "tokens", F.transform("l", lambda x: x["uid"]).alias("selected"), "compressed", "truncated")
