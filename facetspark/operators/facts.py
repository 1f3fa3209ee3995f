"""Facts that must stand in their sources, and topic rows that are read for units directly or through their owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from facetspark.functions import text as T

# What a fact may say of its kind and cardinality, and how many facts of a reply are read.
KINDS, CARDINALITIES, MOST = ("state", "event"), ("one", "many"), 16


def validated(facts: DataFrame) -> DataFrame:
    """facts (source, nth, subject, predicate, object, quote, kind, cardinality, valid_from, valid_to) with a verdict, and what is kept of a fact.

    The verdict is accepted, or the first rule broken: beyond (after the first MOST), missing (a blank field), quote (not in the source),
    object (not in the quote), enum. Predicates become canonical, dates that aren't YYYY-MM-DD null; serial is the
    number of the only numbered line of the source that holds the quote. Each fact is judged in its own row, without a shuffle.
    """
    norm = lambda c: T.normalise(F.col(c))
    blank = F.lit(False)
    for c in ("subject", "predicate", "object", "quote"):
        blank = blank | (T.trim_space(F.coalesce(c, F.lit(""))) == "")
    f = facts.withColumn("_source", norm("source")).withColumn("_quote", norm("quote"))
    inside = lambda whole, part: F.coalesce(F.contains(whole, part), F.lit(False))
    allowed = F.coalesce(F.col("kind").isin(*KINDS) & F.col("cardinality").isin(*CARDINALITIES), F.lit(False))
    verdict = (
        F.when(F.col("nth") > MOST, "beyond").when(blank, "missing").when(~inside(F.col("_source"), F.col("_quote")), "quote")
        .when(~inside(F.col("_quote"), norm("object")), "object").when(~allowed, "enum").otherwise("accepted")
    )
    number = r"^\s*(\d+)\.\s"
    lines = F.filter(F.split("source", r"\r\n|\n|\r"), lambda x: x.rlike(number) & F.contains(T.normalise(x), F.col("_quote")))
    f = f.withColumn("verdict", verdict).withColumn("_lines", lines)
    serial = F.when(F.size("_lines") == 1, F.regexp_extract(F.get("_lines", F.lit(0)), number, 1).cast("long"))
    for c in ("valid_from", "valid_to"):
        f = f.withColumn(c, F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.col(c)))
    for c in ("subject", "object", "quote"):
        f = f.withColumn(c, T.trim_space(F.col(c)))
    return f.withColumn("predicate", T.predicate(F.col("predicate"))).withColumn("serial", serial).drop("_source", "_quote", "_lines")


def placed_topics(rows: DataFrame, units: DataFrame, topics: DataFrame) -> DataFrame:
    """rows (unit_id, topic_id, prob) with found: topic (no such topic), direct (the id of a unit), owner (of units) or unit (neither).

    units (uid, owner), topics (topic_id). Both sides are reduced to different ids before they meet the rows.
    """
    t = topics.select("topic_id", F.lit(True).alias("_topic")).distinct()
    u = units.select(F.col("uid").alias("unit_id"), F.lit(True).alias("_unit")).distinct()
    o = units.select(F.col("owner").alias("unit_id"), F.lit(True).alias("_owner")).distinct()
    found = rows.join(t, "topic_id", "left").join(u, "unit_id", "left").join(o, "unit_id", "left")
    where = F.when(F.col("_topic").isNull(), "topic").when(F.col("_unit"), "direct").when(F.col("_owner"), "owner").otherwise("unit")
    return found.withColumn("found", where).drop("_topic", "_unit", "_owner")


def unit_topics(placed: DataFrame, units: DataFrame) -> DataFrame:
    """(uid, topic_id, prob): what rows say of a unit itself and of its owner, summed. Rows are summed by id before they meet an owner's units."""
    summed = placed.where(F.col("found").isin("direct", "owner")).groupBy("found", "unit_id", "topic_id").agg(F.sum("prob").alias("prob"))
    direct = summed.where("found = 'direct'").select(F.col("unit_id").alias("uid"), "topic_id", "prob")
    through = summed.where("found = 'owner'").join(units.select("uid", F.col("owner").alias("unit_id")).distinct(), "unit_id").select("uid", "topic_id", "prob")
    return direct.unionByName(through).groupBy("uid", "topic_id").agg(F.sum("prob").alias("prob"))
