"""The queries of the training-data operators, each over whole tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from facetspark.llm import (
    bpe, decontam, exact_dedup, langid, license_scan, near_dedup, periodic_runs, quality, sharding, substring_dedup, token_alignment, token_counts, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, a row for each benchmark item they hold."""
    hits = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.withColumn("score", F.round("score", 6)).withColumn("contaminated", F.lit(True))


def op2_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write, index, then read every record back through the index. url_hits: captures that a lookup by URL finds for ids divisible by 50."""
    pages = _table(spark, sf_dir, "pages")
    directory = warc.write_index(warc.write_archives(pages))
    records = warc.read_records(warc.scan_index(directory), payloads=False).drop("payload", "url")
    asked = pages.where("page_id % 50 = 0").select(F.col("page_id").alias("asked"), "url")
    hits = warc.lookup(asked, directory).groupBy(F.col("asked").alias("page_id")).agg(F.count("*").alias("url_hits"))
    return records.join(hits, "page_id", "left")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of 400-byte strings that stand elsewhere too. A null text counts as empty."""
    found = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents that aren't held out. A null id is neither held out nor learned from."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = langid.identify(_table(spark, sf_dir, "documents"), learn=~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document. Blank and null texts are linked with nothing."""
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and verdict of every document under the model of trusted documents."""
    judged = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.withColumn("perplexity", F.round("perplexity", 6)).withColumn("threshold", F.round("threshold", 6))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document. A null text counts as empty."""
    both = bpe.round_trip(_table(spark, sf_dir, "documents"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op8_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document under the law `rows`. A null text has size 16."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document, null texts counting as empty."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals of token counts for every context limit."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32 of the decimal id ends in 0, words from place a on repeat with period p, as the contract fixes."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size("words").cast("long")
    split = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    a = F.col("g") % n
    placed = split.where("size(words) > 0").select("doc_id", "words", n.alias("n"), a.alias("a"), (1 + F.floor((n - a) / (3 + F.col("g") % 8))).alias("p"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = placed.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i))), " ").alias("text"))
    return split.where("coalesce(size(words), 0) <= 0").select("doc_id", "text").unionByName(planted)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs and collapsed text of every document, as digests, with the run of the greatest exponent. A null id plants no period."""
    found = periodic_runs.periodic_runs(_with_planted_periods(_table(spark, sf_dir, "documents")))
    # exact: the greater of two fractions by cross-multiplication; runs come by start, then period, so that the first of equals stays
    higher = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    top = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda s, x: F.when(higher(x, s), x).otherwise(s))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and notices of licences in every document. score: the largest share among its notices; 0.5 with phrases alone, else 0."""
    found = license_scan.license_scan(_table(spark, sf_dir, "documents"))
    said, starts = F.col("places.label"), F.col("places.start")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(said).alias("base_labels"),
        joined(F.concat(said, F.col("notices.label"))).alias("labels"),
        F.round(F.coalesce(F.array_max(F.col("notices.share")), F.when(F.size("places") > 0, 0.5).otherwise(0.0)), 6).alias("score"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two vocabularies in every document."""
    found = token_alignment.token_alignment(_table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_warc_capture_index": op2_warc_capture_index,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_language_id": op4_language_id,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_kneser_ney_quality": op6_kneser_ney_quality,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_label_propagation_shards": op8_label_propagation_shards,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_license_scan": op12_license_scan,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {"op9_exact_dedup": OP9_SQL}
