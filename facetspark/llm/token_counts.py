"""Exact histogram of encoded lengths, with suffix sums for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from facetspark.llm import bpe
from facetspark.llm.shared import cut

#: Lengths in one block of the two-level suffix sums.
BLOCK = 1024


def histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """n_tokens and n_docs for each length that occurs; null lengths are left out."""
    return lengths.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with what lies at or above each length, which answers every limit.

    For each length L: docs_from and tokens_from (documents of at least L tokens and their tokens),
    docs_to (documents of at most L), kept_total (tokens left when all are cut to L) and lost_total.
    Between two lengths that occur the suffix sums are those of the next one, see `at_limits`.

    Sums run over blocks of BLOCK lengths first (max length / BLOCK rows), then inside the blocks.
    An empty histogram gives no rows.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("all", F.lit(0))
    blocks = h.groupBy("all", "block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = W.partitionBy("all").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("all")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(whole).alias("d_all"),
        F.sum("t").over(whole).alias("t_all"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    return (
        h.join(blocks, "block")
        .withColumn("docs_from", F.col("d_above") + F.sum("n_docs").over(inside))
        .withColumn("tokens_from", F.col("t_above") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside))
        .withColumn("docs_to", F.col("d_all") - F.col("docs_from") + F.col("n_docs"))
        .withColumn("kept_total", F.col("t_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens"))
        .withColumn("lost_total", F.col("t_all") - F.col("kept_total"))
        .select("n_tokens", "n_docs", "docs_from", "tokens_from", "docs_to", "kept_total", "lost_total")
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents, tokens, documents cut, tokens kept and lost. One row a limit."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long")
    total = sums.agg(F.coalesce(F.max("docs_from"), F.lit(0)).alias("docs"), F.coalesce(F.max("tokens_from"), F.lit(0)).alias("tokens"))
    over = (
        F.broadcast(wanted).join(sums, sums["n_tokens"] > wanted["context_limit"])
        .groupBy("context_limit").agg(F.max("docs_from").alias("cut"), F.max("tokens_from").alias("their"))
    )  # suffix sums fall with the length, so the largest are those of the next length
    cut, their = F.coalesce("cut", F.lit(0)), F.coalesce("their", F.lit(0))
    return (
        wanted.join(over, "context_limit", "left").crossJoin(F.broadcast(total))
        .select("context_limit", "docs", "tokens", cut.alias("docs_cut"), (F.col("tokens") - their + cut * F.col("context_limit")).alias("kept_total"))
        .withColumn("lost_total", F.col("tokens") - F.col("kept_total"))
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share p: the smallest length that at least p of the documents don't exceed."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(float(p),) for p in sorted(set(shares))], "share double")
    total = sums.agg(F.max("docs_to").alias("docs"))
    return (
        F.broadcast(wanted).crossJoin(F.broadcast(total)).join(sums, F.col("docs_to") >= F.col("share") * F.col("docs"))
        .groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
    )


def token_counts(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Suffix sums over the exact histogram of encoded lengths of all whole texts.

    Defined results: null and empty texts have length 0. Repeated rows count each. An empty table gives no
    rows. Only the two named columns are read. Documents are encoded where they lie; one row for each
    length and task is shuffled.
    """
    lengths = bpe.lengths(docs, vocab, id_col, text_col)
    return suffix_sums(cut(histogram(lengths)))  # read twice: texts are encoded once
