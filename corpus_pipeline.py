"""A corpus through quality filter, exact and near deduplication, decontamination and encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; `run` writes each
stage's result as Parquet to the shared folder and reads it again for the next. All stages but the last
return the columns of documents.

Defined results: decisions are taken by doc_id, and a null id is an id like any other: rows that share an id
stay or go together. Of rows that agree in id and text exact deduplication leaves one. Empty tables pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from facetspark.llm import bpe, decontam, exact_dedup, near_dedup, quality
from facetspark.llm.shared import new_path


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose id is (not) among ids."""
    ids = ids.select(F.col("doc_id").alias("_wanted")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_wanted"]), how)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the Kneser-Ney model, trained on trusted documents, finds too perplexing for its language."""
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _only(docs, judged.where("kept"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of those with equal texts."""
    kept = _only(docs, exact_dedup.exact_dedup(docs).where("kept"))
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return _only(docs, near_dedup.near_dedup(docs).where("kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return _only(docs, decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the text decoded from them."""
    both = bpe.round_trip(docs)
    return both.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the classifier nor the encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
