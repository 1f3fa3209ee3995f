"""Queries over spans, weights, completion, summaries and small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from facetspark.functions import text as T
from facetspark.operators import context, lexical, select, stats
from facetspark.plans.retrieval import PAIRS_SQL, _bench, _pairs, _search, _vectors, contained, sim_sql, weight_sql
from facetspark.plans.texts import TOKENS, _tokens
from facetspark.sources.scratch import cut

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM conversations WHERE text IS NOT NULL),
t AS (SELECT conv_id, max(lo + n) AS total FROM s GROUP BY 1), c AS (SELECT conv_id, unnest(range(0, total::BIGINT, 500)) AS lo FROM t)
SELECT c.conv_id, (c.lo // 500)::BIGINT AS chunk, min(s.turn) AS first_turn, max(s.turn) AS last_turn, sum(least(c.lo + 500, s.lo + n) - greatest(c.lo, s.lo))::BIGINT AS chars
FROM c JOIN s ON c.conv_id = s.conv_id AND s.lo + n > c.lo AND s.lo < c.lo + 500 GROUP BY ALL""")
def t23_chunk_turn_spans(spark, sf_dir):
    """Conversations as one text with two characters between turns, cut into 500 characters: the turns that each chunk shows."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    n = F.length("text")
    s = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", n.alias("n"), F.coalesce(F.sum(n + 2).over(before), F.lit(0)).alias("a_start"))
    s = s.select(F.col("conv_id").alias("k"), F.col("turn").alias("a_id"), "a_start", (F.col("a_start") + F.col("n")).alias("a_end"))
    total = s.groupBy("k").agg(F.max("a_end").alias("total")).where("total > 0")
    c = total.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(500).cast("long"))).alias("b_start"))
    both = context.overlaps(s, c.withColumn("b_end", F.col("b_start") + 500), "k")
    chars = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return both.groupBy(F.col("k").alias("conv_id"), F.floor(F.col("b_start") / 500).alias("chunk")).agg(F.min("a_id").alias("first_turn"), F.max("a_id").alias("last_turn"), F.sum(chars).alias("chars"))


@query(r"SELECT conv_id, turn, md5(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 2000)) AS body_md5 FROM conversations")
def t27_owner_bodies(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.substring(T.collapse(F.col("text")), 1, 2000)).alias("body_md5"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\w\w+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN d USING (term), n),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS rank FROM u)
SELECT doc_id, term, round(w, 6) AS weight, rank FROM r WHERE rank <= 5""")
def r15_tfidf_terms(spark, sf_dir):
    u = lexical.tfidf(table(spark, sf_dir, "documents"))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.round("w", 9)), "term"))
    return u.withColumn("rank", nth.cast("long")).where("rank <= 5").select("doc_id", "term", F.round("w", 6).alias("weight"), "rank")


@query("SELECT b.item_id AS qid, d.doc_id AS uid, instr(d.text, b.text) AS position, (instr(d.text, b.text) - 1) // 1000 AS chunk FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def j15_located_facts(spark, sf_dir):
    """Where an item's text first stands in the documents that contain it."""
    docs, items = _bench(spark, sf_dir)
    found = contained(docs, items).join(docs, "uid").join(items.withColumnRenamed("text", "item"), "qid")
    position = F.expr("instr(text, item)").cast("long")
    return found.select("qid", "uid", position.alias("position"), F.floor((position - 1) / 1000).alias("chunk"))


@query(f"""WITH t AS (SELECT conv_id, turn, {TOKENS} AS tokens FROM conversations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM t)
SELECT conv_id, coalesce(min(turn + 1) FILTER (upto >= 100), max(turn + 1)) AS k, coalesce(bool_or(upto >= 100), false) AS reached FROM r GROUP BY 1""")
def k25_first_depth_that_reaches_budget(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    r = _tokens(spark, sf_dir).withColumn("upto", F.sum("tokens").over(w)).withColumn("k", F.col("turn") + 1)
    return r.groupBy("conv_id").agg(F.coalesce(F.min(F.when(F.col("upto") >= 100, F.col("k"))), F.max("k")).alias("k"), F.bool_or(F.col("upto") >= 100).alias("reached"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {TOKENS} AS tokens FROM conversations), f AS (SELECT conv_id, role, min(turn) AS first FROM t GROUP BY ALL)
SELECT conv_id, round(sum(CASE WHEN first < turn THEN tokens ELSE 0 END) / nullif(sum(tokens), 0), 6) AS duplicate_share FROM t JOIN f USING (conv_id, role) GROUP BY 1""")
def k18_duplicate_share(spark, sf_dir):
    """The share of tokens in turns of a role that has spoken before."""
    u = _tokens(spark, sf_dir).select(F.col("conv_id").alias("qid"), F.col("turn").alias("take_order"), "tokens", F.array("role").alias("turns"))
    return context.duplicate_share(u).select(F.col("qid").alias("conv_id"), F.round("duplicate_share", 6).alias("duplicate_share"))


@query("SELECT event_id, greatest(0.0, least(1.0, CAST(json_extract(props, '$.k') AS DOUBLE) / 80)) AS confidence, least(9, floor(greatest(0.0, least(1.0, CAST(json_extract(props, '$.k') AS DOUBLE) / 80)) * 10))::BIGINT AS bin FROM events")
def f22_clamped_replies(spark, sf_dir):
    k = F.from_json("props", "k double")["k"]
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), k / 80))
    return table(spark, sf_dir, "events").select("event_id", c.alias("confidence"), F.least(F.lit(9), F.floor(c * 10)).cast("long").alias("bin"))


@query("SELECT text_md5, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def e36_mirrors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5("text").alias("text_md5"))
    return d.groupBy("text_md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@query("""SELECT source, count(*) AS n, sum(coalesce(quality, 0))::BIGINT AS good, round(avg(coalesce(quality, 0)), 6) AS complete_mean, round(avg(quality), 6) AS judged_mean, count(quality) AS judged
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def p20_completed_scores(spark, sf_dir):
    """A population's mean with missing scores as zero, beside the mean of those that are there."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.coalesce("quality", F.lit(0))
    return j.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(q).cast("long").alias("good"), F.round(F.avg(q), 6).alias("complete_mean"), F.round(F.avg("quality"), 6).alias("judged_mean"), F.count("quality").alias("judged")
    )


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j19_pending(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j18_required(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("""SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts, count(*) FILTER (n_chars > 2000) AS over_2000, count(*) FILTER (n_chars > 4000) AS over_4000, max(n_chars) AS longest FROM documents GROUP BY 1""")
def a29_corpus_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("text").alias("texts"),
        F.count_if(F.col("n_chars") > 2000).alias("over_2000"), F.count_if(F.col("n_chars") > 4000).alias("over_4000"), F.max("n_chars").alias("longest"),
    )


@query(f"WITH {sim_sql('s')} SELECT rank, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd FROM s GROUP BY 1")
def x14_similarity_by_depth(spark, sf_dir):
    return _search(spark, sf_dir).groupBy(F.col("rank").cast("long").alias("rank")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("sd"))


@query("SELECT label, vec_id AS uid, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('5|' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 8")
def l18_shown_units(spark, sf_dir):
    """Eight units of each group in seeded order, shown by id."""
    drawn = select.top_by(_vectors(spark, sf_dir).select("uid", "label"), ["label"], [select.seeded(5, F.col("uid")), F.col("uid")], 8)
    return drawn.select("label", "uid", F.row_number().over(W.partitionBy("label").orderBy("uid")).cast("long").alias("pos"))


@query("SELECT l_returnflag, l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS ship_day FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') = (SELECT max(strftime(l_shipdate, '%Y-%m-%d')) FROM lineitem)")
def h32_latest_day(spark, sf_dir):
    """Rows of the latest day, days as text."""
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"))
    last = t.agg(F.max("ship_day").alias("last"))
    return t.join(F.broadcast(last), F.col("ship_day") == F.col("last")).drop("last")


@query(f"""WITH {PAIRS_SQL}, rows AS (SELECT label, sum(b - a) AS d, count(*) AS n FROM pairs JOIN embeddings e ON e.vec_id = pairs.qid GROUP BY 1), {weight_sql('boot', 'label')},
rt AS (SELECT draw, sum(w * d) / nullif(sum(w * n), 0) AS r FROM wt GROUP BY 1) SELECT 'fused' AS test, round((SELECT sum(d) / sum(n) FROM rows), 6) AS delta, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM rt""")
def x7_cluster_bootstrap(spark, sf_dir):
    """A 95 % interval of the mean difference with whole groups drawn, from a row for each group."""
    p = _pairs(spark, sf_dir).join(_vectors(spark, sf_dir).select(F.col("uid").alias("qid"), "label"), "qid")
    g = cut(p.groupBy("one", "label").agg(F.sum(F.col("b") - F.col("a")).alias("d"), F.count("*").alias("n")))  # used twice
    delta = g.groupBy("one").agg((F.sum("d") / F.sum("n")).alias("delta"))
    out = delta.join(stats.bootstrap_interval(g, "one", "label", "d", "n"), "one")
    return out.select(F.col("one").alias("test"), *[F.round(c, 6).alias(c) for c in ("delta", "low", "high")])
