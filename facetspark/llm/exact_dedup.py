"""Exact deduplication: group by 128-bit content hash, compare bytes inside the groups, keep one row of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from facetspark.llm.shared import stash

#: What `[\x20\x09-\x0D]` matches.
BLANKS = " \t\n\x0b\x0c\r"


def without_blanks(text: Column) -> Column:
    """text (null: empty) without its ASCII white space."""
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=hash128) -> DataFrame:
    """One row per input row: its group's kept id, the group's size, and whether the row is the one that stays.

    Texts are equal when identical without ASCII white space. Of equal texts the row with the most code
    points stays, then the smallest id. Columns: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by `key` of the normalised text. The group's smallest and largest text travel with the
    partial aggregates, so that bytes are compared without bringing copies together; a hot group costs each
    map task two texts. Where the two differ, the hash has collided, and the rows of that hash alone are
    grouped again by their texts.

    Defined results: null and blank-only texts equal the empty text. A null id loses to any other id and is
    matched with null-safe equality. Rows that repeat an id are members of their own; all rows of the kept
    id are marked as kept. An empty table gives no rows. Only the two named columns are read.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    norm = without_blanks(F.col("_text"))
    rows = src.select(
        "_id", norm.alias("_norm"), F.char_length(F.coalesce("_text", F.lit(""))).cast("long").alias("_chars")
    ).withColumn("_key", key(F.col("_norm")))
    best = F.min(F.struct((-F.col("_chars")).alias("fewer"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))).alias("_best")
    groups = stash(
        rows.groupBy("_key")
        .agg(best, F.count("*").alias("_size"), F.min("_norm").alias("_low"), F.max("_norm").alias("_high"))
        .select("_key", F.col("_best.id").alias("_keep"), "_size", (F.col("_low") != F.col("_high")).alias("_collided")),
        "exact-groups",
    )
    marked = rows.select("_id", "_key", F.sha2("_norm", 256).alias("_sha"))
    out = marked.join(groups.where(~F.col("_collided")), "_key").select("_id", "_keep", "_size", "_sha")
    if not groups.where("_collided").isEmpty():
        bad = groups.where("_collided").select("_key")
        mixed = rows.join(bad, "_key")
        split = mixed.groupBy("_key", "_norm").agg(best, F.count("*").alias("_size")).select(
            "_key", F.col("_norm").alias("_same"), F.col("_best.id").alias("_keep"), "_size"
        )
        pairs = mixed.alias("m").join(split.alias("s"), (F.col("m._key") == F.col("s._key")) & (F.col("_norm") == F.col("_same")))
        out = out.unionByName(pairs.select("_id", "_keep", "_size", F.sha2("_norm", 256).alias("_sha")))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
