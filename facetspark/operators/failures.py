"""Why an answer is wrong: the first stage that lost evidence, by the rules of chats, of sessions and of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from facetspark.functions.text import normalise
from facetspark.operators.coverage import cover_threshold

#: The stages through which evidence passes, and the bucket of an answer whose evidence a stage lost.
STAGES = {"index": 1, "candidates": 2, "context": 3}


def holds(text: Column, gold: Column) -> Column:
    """The normalised text contains the normalised answer, which isn't empty."""
    wanted = normalise(F.coalesce(gold, F.lit("")))
    return (wanted != "") & F.contains(normalise(F.coalesce(text, F.lit(""))), wanted)


def chat_items(evidence: DataFrame, shown: DataFrame, cases: DataFrame) -> DataFrame:
    """Evidence turns (case, item, text, day, clock) against the units of every stage, as `assign` reads them.

    shown (case, stage, place, item, chars, via): a row for each turn in a unit, with its characters in it; via: the unit only
    cites the turn, and its chars are characters of the cited passage. A turn is covered by all its characters
    in a stage together, or by one citing unit alone. In the context a turn that is cut is kept unless the answer stands in the rest of it, which is read as
    a suffix of the turn.
    """
    own, cited = ~F.col("via"), F.col("via")
    per = shown.groupBy("case", "item", "stage").agg(
        F.coalesce(F.sum(F.when(own, F.col("chars"))), F.lit(0)).alias("chars"), F.max(F.when(cited, F.col("chars"))).alias("cited"), F.min("place").alias("place")
    )
    wide = per.groupBy("case", "item").agg(*[F.max(F.when(F.col("stage") == s, F.struct("chars", "cited", "place"))).alias(f"_{s}") for s in STAGES])
    rows = evidence.join(wide, ["case", "item"], "left").join(cases.select("case", "gold"), "case")
    n = F.length(F.coalesce("text", F.lit("")))
    need = cover_threshold(n)
    covered = lambda s: F.coalesce((F.col(f"_{s}.chars") >= need) | (F.col(f"_{s}.cited") >= need), F.lit(False))
    seen = F.coalesce(F.col("_context.chars"), F.lit(0))
    partial = (seen > 0) & (seen < n)
    tail = F.substring(F.col("text"), (seen + 1).cast("int"), n)
    return rows.select(
        "case", "item", *[covered(s).alias(s) for s in STAGES], partial.alias("partial"), (partial & covered("context") & holds(tail, F.col("gold"))).alias("tail"),
        holds(F.col("text"), F.col("gold")).alias("holder"), "day", "clock", F.col("_context.place").alias("place"),
    )


def session_items(evidence: DataFrame, cited: DataFrame) -> DataFrame:
    """Evidence sessions (case, item) against those that the units of every stage cite (case, stage, item)."""
    wide = cited.groupBy("case", "item").agg(*[F.max((F.col("stage") == s).cast("int")).alias(s) for s in STAGES])
    rows = evidence.join(wide, ["case", "item"], "left")
    return _plain(rows.select("case", "item", *[(F.coalesce(s, F.lit(0)) == 1).alias(s) for s in STAGES]))


def fact_items(facts: DataFrame, chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Located facts (case, item, doc, chunk, fact, fallback) against the chunks of every stage (case, stage, doc, chunk, place, body, truncated).

    A stage holds a fact when its chunks of the fact's document, one after the other and normalised, contain it; a fact that was
    only matched to a document is held by any chunk with words. A fact without a document is held nowhere. texts (chunk, text) are whole chunks: where a
    cut chunk has lost a fact, the rest of it says whether the cut was the reason.
    """
    whole = F.sort_array(F.collect_list(F.struct("place", "chunk", "body")))
    said = normalise(F.array_join(F.transform(whole, lambda x: F.coalesce(x["body"], F.lit(""))), " "))
    docs = chunks.join(facts.select("case", "doc").distinct(), ["case", "doc"], "left_semi").groupBy("case", "doc").pivot("stage", list(STAGES)).agg(said.alias("said"))
    cut = chunks.where("stage = 'context' AND truncated").groupBy("case", "chunk").agg(F.max(F.length(F.coalesce("body", F.lit("")))).alias("kept"))
    ends = cut.join(texts.select("chunk", "text"), "chunk").select("case", "chunk", F.substring(F.col("text"), (F.col("kept") + 1).cast("int"), F.length("text")).alias("rest"))
    wanted = normalise(F.coalesce("fact", F.lit("")))
    held = lambda s: F.coalesce(F.col("doc").isNotNull() & (F.col(s) != "") & (F.coalesce("fallback", F.lit(False)) | F.contains(F.col(s), wanted)), F.lit(False))
    # what the stages hold is decided before the next join, which would move their texts with each fact
    rows = facts.join(docs, ["case", "doc"], "left").select("case", "item", "chunk", "fact", *[held(s).alias(s) for s in STAGES])
    rows = rows.join(ends, ["case", "chunk"], "left")
    lost = ~F.col("context") & F.coalesce(F.contains(normalise(F.col("rest")), wanted), F.lit(False))
    return _plain(rows.select("case", "item", *STAGES, (F.col("context") & F.col("rest").isNotNull()).alias("partial"), lost.alias("tail")))


def _plain(items: DataFrame) -> DataFrame:
    """Items without what only the rule of chats asks for."""
    given = {"partial": F.lit(False), "tail": F.lit(False), "holder": F.lit(False), "day": F.lit(None).cast("string"), "clock": F.lit(None).cast("long"), "place": F.lit(None).cast("long")}
    return items.withColumns({c: x for c, x in given.items() if c not in items.columns})


def assign(cases: DataFrame, items: DataFrame) -> DataFrame:
    """(case, bucket, decidable, rule, lost, half, skipped, fired, gold_earlier) for every case, wrong or not.

    cases (case, primary, second, listed, update): verdicts of two judges, whether the index is known, and whether the
    question asks for an updated fact. items come from the functions above. Bucket 0: not wrong; 5: the judges disagree; then the first stage that lost an
    item (`lost` names the items); 3 also where the answer is in the part of a turn that was cut off, or where, of two turns of one day, the only one that
    holds the answer to an update stands before the other; else 4. half counts items that are shown in part; skipped: the rule of updates had not
    one holder; fired, gold_earlier: that rule decided, and the holder is the earlier turn by its clock.

    Evidence of a case is small; it is summed up by one exchange, and the rule of updates joins it once more with its holder.
    A case without evidence lost nothing: bucket 4.
    """
    lost = lambda s: F.sort_array(F.collect_list(F.when(~F.col(s), F.col("item"))))
    turn = F.struct("item", "day", "clock", "place")
    sums = items.groupBy("case").agg(
        *[lost(s).alias(f"_{s}") for s in STAGES], F.count_if("partial").alias("half"), F.sort_array(F.collect_list(F.when(F.col("tail"), F.col("item")))).alias("_tail"),
        F.count_if("holder").alias("holders"), F.max(F.when(F.col("holder"), turn)).alias("h"),
    )
    one = sums.where("holders = 1").select("case", "h")
    late = items.join(one, "case").where((F.col("item") != F.col("h.item")) & F.col("day").eqNullSafe(F.col("h.day")) & (F.col("h.place") < F.col("place")))
    late = late.groupBy("case").agg(F.min_by(F.struct((F.col("h.clock") < F.col("clock")).alias("earlier")), "item").alias("late"))
    every = cases.select("case", "primary", "second", "listed", "update").join(sums, "case", "left").join(late, "case", "left")
    wrong, both = F.coalesce(~F.col("primary"), F.lit(False)), F.col("second").isNotNull()
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    rule = (
        F.when(~wrong, "not wrong").when(both & (F.col("second") != F.col("primary")), "judges disagree")
        .when(F.coalesce("listed", F.lit(False)) & some(F.col("_index")), "index").when(some(F.col("_candidates")), "candidates")
        .when(some(F.col("_tail")) & ~some(F.expr("array_except(_context, _tail)")), "tail").when(some(F.col("_context")), "context")
        .when(F.coalesce("update", F.lit(False)) & F.col("late").isNotNull(), "update").otherwise("inside")
    )
    number = {"not wrong": 0, "judges disagree": 5, "index": 1, "candidates": 2, "context": 3, "tail": 3, "update": 3, "inside": 4}
    judged = every.withColumn("rule", rule)
    bucket = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[F.col("rule")]
    named = F.when(F.col("rule") == "index", F.col("_index")).when(F.col("rule") == "candidates", F.col("_candidates")).when(F.col("rule") == "context", F.col("_context")).when(F.col("rule") == "tail", F.col("_tail"))
    late_rules = F.col("rule").isin("update", "inside")
    fired = F.col("rule") == "update"
    return judged.select(
        "case", bucket.alias("bucket"), both.alias("decidable"), "rule", F.coalesce(named, F.array().cast(f"array<{items.schema['item'].dataType.simpleString()}>")).alias("lost"),
        F.when(late_rules, F.coalesce("half", F.lit(0))).otherwise(0).alias("half"), (late_rules & F.coalesce("update", F.lit(False)) & (F.coalesce("holders", F.lit(0)) != 1)).alias("skipped"),
        fired.alias("fired"), F.when(fired, F.col("late.earlier")).alias("gold_earlier"),
    )
