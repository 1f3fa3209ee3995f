"""Readers and writers: tables, JSON lines, CSV with rounding, datasets with integrity rules, mail archives, nested chats."""

from __future__ import annotations

import email
import email.policy
import io
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F, types as T


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema, so that nothing is scanned twice."""
    return spark.read.schema(schema).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_latest_jsonl(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Rows of an append-only file, the last of each key."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return read_jsonl(spark, path, schema).withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null."""
    fix = lambda c: F.when(~F.isnan(c), F.round(c, places))
    return df.withColumns({f.name: fix(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def write_csv(df: DataFrame, path: str, places: int = 6) -> None:
    """Rounded doubles; nested columns as JSON."""
    flat = rounded(df, places)
    nested = {f.name: F.to_json(f.name) for f in flat.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    flat.withColumns(nested).write.option("header", True).csv(path)


def integrity(corpus: DataFrame, questions: DataFrame) -> DataFrame:
    """(rule, key): repeated ids, questions of unknown groups and evidence that no document has; empty when all is well.

    corpus (id, group), questions (id, group, evidence_ids array).
    """
    twice = lambda df, rule: df.groupBy("id").count().where("count > 1").select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("key"))
    lost = questions.join(corpus.select("group").distinct(), "group", "left_anti").select(F.lit("unknown group"), F.col("id").cast("string"))
    cited = questions.select("group", F.explode("evidence_ids").alias("id"))
    dangling = cited.join(corpus.select("group", "id"), ["group", "id"], "left_anti").select(F.lit("dangling evidence"), F.col("id").cast("string"))
    return twice(corpus, "repeated document").union(twice(questions, "repeated question")).union(lost).union(dangling)


def write_dataset(corpus: DataFrame, questions: DataFrame, path: str) -> DataFrame:
    """Write both tables after the integrity rules; returns the manifest (name, rows, digest), which is written too."""
    bad = integrity(corpus, questions).limit(5).collect()
    if bad:
        raise ValueError(f"the dataset breaks its rules: {[tuple(r) for r in bad]}")
    parts = []
    for name, df in (("corpus", corpus), ("questions", questions)):
        df.write.parquet(f"{path}/{name}.parquet")
        done = df.sparkSession.read.parquet(f"{path}/{name}.parquet")
        digest = F.sum(F.xxhash64(*done.columns).cast("decimal(38,0)")).cast("string")  # the same in any order of rows
        parts.append(done.agg(F.count("*").alias("rows"), digest.alias("digest")).select(F.lit(name).alias("name"), "rows", "digest"))
    manifest = parts[0].unionByName(parts[1])
    manifest.write.json(f"{path}/manifest.json")
    return corpus.sparkSession.read.schema("name string, rows long, digest string").json(f"{path}/manifest.json")


def write_committed(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Write named tables as Parquet, by the given key columns, and a manifest (name, rows, digest) of all of them last; returns the manifest.

    Rows and an order-free digest are observed while a table is written, so it is computed and read once. What reads the folder
    goes by the manifest (`read_committed`): an attempt that fails leaves none, and its files are overwritten by the next.
    """
    spark, told = next(iter(tables.values())).sparkSession, []
    manifest = f"{path}/manifest.json"
    spark.createDataFrame([], "name string, rows long, digest string").write.mode("overwrite").json(manifest)
    for name, df in tables.items():
        seen = Observation(name)
        digest = F.sum(F.xxhash64(F.struct(*df.columns)).cast("decimal(38,0)")).cast("string").alias("digest")
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), digest).write.mode("overwrite")
        writer.partitionBy(*(keys or {}).get(name, [])).parquet(f"{path}/{name}.parquet")
        told.append((name, seen.get["rows"], seen.get["digest"]))
    spark.createDataFrame(told, "name string, rows long, digest string").coalesce(1).write.mode("overwrite").json(manifest)
    return spark.read.schema("name string, rows long, digest string").json(manifest)


def read_committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a folder whose manifest names it; a folder without one raises."""
    listed = spark.read.schema("name string, rows long, digest string").json(f"{path}/manifest.json")
    if listed.where(F.col("name") == name).isEmpty():
        raise ValueError(f"{path} holds no committed table {name}")
    return spark.read.parquet(f"{path}/{name}.parquet")


MAIL = "archive string, path string, custodian string, folder string, date string, sender string, recipients string, subject string, body string"


def read_mail_archives(spark: SparkSession, path: str, folders: tuple[str, ...] = ("sent", "sent_items", "_sent_mail", "inbox")) -> DataFrame:
    """Messages of tar.gz mail archives: one row for each message in the wanted folders.

    Archives are dealt over tasks; members are read one at a time, and skipped by folder before they are parsed.
    Members are named .../custodian/folder/file.
    """
    wanted = {x.lower() for x in folders}

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                out = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
                    for member in tar:
                        where = member.name.split("/")
                        if not member.isfile() or len(where) < 3 or where[-2].lower() not in wanted:
                            continue
                        message = email.message_from_bytes(tar.extractfile(member).read(), policy=email.policy.default)
                        part = message.get_body(preferencelist=("plain",))
                        try:
                            body = part.get_content() if part else ""
                        except (LookupError, UnicodeDecodeError):
                            body = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
                        head = [str(message.get(h) or "") for h in ("Date", "From", "To", "Subject")]
                        out.append((name, member.name, where[-3], where[-2], *head, body))
                        if len(out) == 1000:
                            yield pd.DataFrame(out, columns=[x.split()[0] for x in MAIL.split(", ")])
                            out = []
                yield pd.DataFrame(out, columns=[x.split()[0] for x in MAIL.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, MAIL)


def plans_in_order(plans: Column) -> Column:
    """Values of a map plan-N -> messages in the order of N, null values left out."""
    keys = F.array_sort(F.transform(F.map_keys(plans), lambda k: F.struct(F.regexp_extract(k, r"(\d+)$", 1).cast("int").alias("n"), k.alias("k"))))
    return F.flatten(F.filter(F.transform(keys, lambda s: F.element_at(plans, s["k"])), lambda v: v.isNotNull()))


def chat_messages(chats: DataFrame, messages: Column, id_col: str = "conversation_id") -> DataFrame:
    """(id, ordinal, message_id, role, content, time_anchor): messages in order, each with the last time anchor up to it."""
    flat = chats.select(id_col, F.posexplode(messages).alias("ordinal", "m"))
    w = W.partitionBy(id_col).orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    anchor = F.last(F.nullif(F.trim("m.time_anchor"), F.lit("")), ignorenulls=True).over(w)
    return flat.select(id_col, "ordinal", F.col("m.id").alias("message_id"), "m.role", "m.content", anchor.alias("time_anchor")).where(F.trim("content") != "")


def occurrence_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """Ids with @occN from the second occurrence on."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(order))
    return df.withColumn("occurrence_id", F.when(nth > 1, F.concat(F.col(key), F.lit("@occ"), nth)).otherwise(F.col(key)))


def deconflicted(df: DataFrame, key: str, question: str, content: Column) -> DataFrame:
    """unique_id: the key, or key@question where its content differs from that of the first question that uses the key."""
    seen = df.withColumn("_content", content)
    first = F.first("_content").over(W.partitionBy(key).orderBy(question).rowsBetween(W.unboundedPreceding, 0))
    same = F.col("_content").eqNullSafe(first)
    return seen.withColumn("unique_id", F.when(same, F.col(key)).otherwise(F.concat(F.col(key), F.lit("@"), F.col(question)))).drop("_content")


def evidence_ids(df: DataFrame, text: str, pattern: str, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, resolved, unresolved, complete): the different ids that the pattern finds in the text, by whether `known` (id) has them."""
    found = df.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("id"))
    both = found.join(known.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    out = both.groupBy(*keys).agg(F.count("_known").alias("resolved"), (F.count("*") - F.count("_known")).alias("unresolved"))
    return out.withColumn("complete", F.col("unresolved") == 0)


def shuffled_options(options: DataFrame, key: str, option: str, seed: int) -> DataFrame:
    """Options (key, option, ...) with the letters A, B, ... in the order of a seeded hash of key and option."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col(option)), 256)
    nth = F.row_number().over(W.partitionBy(key).orderBy(order, option))
    return options.withColumn("letter", F.chr(F.lit(64) + nth))


def group_members(lists: DataFrame, aliases: dict[str, list[str]], variant: str | None = None) -> DataFrame:
    """(variant, topic_id, unit, ...) of groups with lists of members, read under any of the named columns; outlier groups (below 0) are left out."""
    have = set(lists.columns)
    out = lists
    for name, names in aliases.items():
        out = out.withColumn(name, F.coalesce(*[F.col(n) for n in names if n in have]))
    if variant is not None:
        out = out.where(F.col("variant") == variant)
    return out.where("topic_id >= 0").withColumn("unit", F.explode("members"))


def numeric_first(id_col: Column) -> list[Column]:
    """Two sort keys that put numeric ids first, by their number."""
    return [(~id_col.rlike("^[0-9]+$")).alias("word"), F.when(id_col.rlike("^[0-9]+$"), id_col).cast("long").alias("number")]
