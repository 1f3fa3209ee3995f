"""BM25 over an inverted index built with joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetspark.sources.scratch import written

#: Lucene's variant with the usual parameters; terms are runs of two or more word characters in lower case.
K1, B = 1.5, 0.75
TERM = r"\w\w+"
#: Bytes of query terms that are broadcast at a time, and what a row of them takes beside the term.
BLOCK_BYTES, ROW_BYTES = 16_000_000, 64
#: Pairs of a posting and a query's term that a task sums up.
TASK_PAIRS = 2_000_000
#: Stands in every document's postings once; no term begins like this.
EVERY = "\0"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(qid, uid, score) for every document (uid, text) with a term of the query (qid, text); all scores are positive.

    Document lengths and frequencies cover the whole corpus; repeated query terms count as often as they occur. Texts
    are split once, and only the queries' terms leave the scan (with a row for each document, from which lengths are
    averaged): the vocabulary is broadcast where it takes block_bytes at most, else terms are counted by document before they
    meet it. Postings are dealt by document, so a query's scores are summed without another shuffle; queries meet them in blocks of about block_bytes.
    A block takes as many tasks as its pairs of postings and query terms call for, as the size of the postings doesn't show them.
    """
    split = queries.where("text IS NOT NULL").select("qid", F.explode(terms(F.col("text"))).alias("term"))
    asked = written(split.groupBy("qid", "term").agg(F.count("*").alias("qtf")))
    blocks = max(1, -(-asked.agg(F.coalesce(F.sum(F.octet_length("term") + ROW_BYTES), F.lit(0))).first()[0] // block_bytes))
    wanted = asked.select("term").unionByName(asked.sparkSession.createDataFrame([(EVERY,)], "term string")).distinct()
    tokens = docs.where("text IS NOT NULL").select("uid", F.concat(terms(F.col("text")), F.array(F.lit(EVERY))).alias("t"))
    # The length is a column before the terms are exploded, or each term's row would carry all of them. No array is empty; the outer
    # form keeps Spark from a filter on the array's size below, which would split every text again.
    rows = tokens.withColumn("dl", F.size("t") - 1).select("uid", "dl", F.explode_outer("t").alias("term"))
    if blocks == 1:
        rows, wanted = rows.join(F.broadcast(wanted), "term", "left_semi"), None
    counted = rows.groupBy("uid", "dl", "term").agg(F.count("*").alias("tf"))
    if wanted is not None:
        counted = counted.join(wanted, "term", "left_semi")
    counted = written(counted)
    stats = counted.where(F.col("term") == EVERY).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    postings = counted.where(F.col("term") != EVERY)
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("qid", "term", "avgdl", (F.col("qtf") * idf).alias("weight"))  # stats is one row
    part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    block_of = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    pairs = {r["block"]: r["pairs"] for r in asked.join(df, "term").groupBy(block_of.alias("block")).agg(F.sum("df").alias("pairs")).collect()}
    scored = []
    for block in range(blocks):
        some = weighted.where(block_of == block)
        tasks = max(1, -(-pairs.get(block, 0) // TASK_PAIRS))
        scored.append(postings.repartition(tasks, "uid").join(F.broadcast(some), "term").groupBy("qid", "uid").agg(F.sum(F.col("weight") * part).alias("score")))
    return reduce(DataFrame.unionByName, scored)


def bm25_top(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k documents of each query; ties (to nine places) by uid."""
    w = W.partitionBy("qid").orderBy(F.desc("_nine"), "uid")  # a column of its own: an expression is computed for each comparison
    scored = bm25(docs, queries).withColumn("_nine", F.round("score", 9))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_nine")


def tfidf(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, term, w): tf * (ln((1 + n) / (1 + df)) + 1) of each term of a document, scaled so that its squares sum up to 1.

    Texts are dealt by document, so that terms are counted where they are split. Frequencies of the most common terms, as many as block_bytes
    hold, are broadcast; only rows of the others are shuffled to meet theirs. n counts all rows, those without text too.
    """
    n = docs.agg(F.count("*").alias("n"))  # one row
    dealt = docs.where("text IS NOT NULL").select("doc_id", "text").repartition("doc_id").select("doc_id", terms(F.col("text")).alias("t"))
    tf = written(dealt.select("doc_id", F.explode_outer("t").alias("term")).where("term IS NOT NULL").groupBy("doc_id", "term").agg(F.count("*").alias("tf")))
    df = written(tf.groupBy("term").agg(F.count("*").alias("df")))
    level, least, held = F.floor(F.log2("df")), None, 0
    for r in df.groupBy(level.alias("level")).agg(F.sum(F.octet_length("term") + ROW_BYTES).alias("bytes")).orderBy(F.desc("level")).collect():  # a row for each power of two
        held += r["bytes"]
        if held > block_bytes:
            break
        least = r["level"]
    common = df.where(F.lit(False) if least is None else level >= least)
    met = tf.join(F.broadcast(common), "term", "left")
    rare = met.where("df IS NULL").drop("df").join(df.hint("merge"), "term")
    w = met.where("df IS NOT NULL").unionByName(rare).crossJoin(F.broadcast(n))
    w = w.select("doc_id", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id"))))
