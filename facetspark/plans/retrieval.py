"""Queries over documents, benchmark items and embeddings: retrieval, fusion, selection, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from facetspark.functions import vectors
from facetspark.operators import gate, lexical, metrics, select, similarity, stats
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


def _bench(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text")
    return docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


BM25_SQL = r"""
d AS (SELECT doc_id, regexp_extract_all(lower(text), '\w\w+') AS t FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tok AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d),
asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\w\w+')) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT term, doc_id, dl, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (
  SELECT item_id AS qid, doc_id AS uid,
         sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM post JOIN dfs USING (term) JOIN asked USING (term) CROSS JOIN st GROUP BY ALL),
bm AS (SELECT qid, uid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, uid) AS rank FROM sc)
"""


@query(f"WITH {BM25_SQL} SELECT qid, uid, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def k6_bm25_top10(spark, sf_dir):
    docs, items = _bench(spark, sf_dir)
    return lexical.bm25_top(docs, items, 10).select("qid", "uid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {BM25_SQL}, rel AS (SELECT item_id AS qid, doc_id AS uid FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
n AS (SELECT qid, count(*) AS relevant FROM rel GROUP BY 1),
h AS (SELECT qid, count(*) AS hits, min(rank) AS first FROM bm JOIN rel USING (qid, uid) WHERE rank <= 10 GROUP BY 1)
SELECT qid, round(coalesce(hits, 0) / relevant, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr FROM n LEFT JOIN h USING (qid)""")
def e3_bm25_recall_of_contained_items(spark, sf_dir):
    """Recall and MRR at 10 with documents that contain an item as relevant; candidates share the item's first eight words."""
    docs, items = _bench(spark, sf_dir)
    ranking = lexical.bm25_top(docs, items, 10)
    return metrics.ranking_metrics(ranking, contained(docs, items).withColumn("gain", F.lit(1.0)), 10).select("qid", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, uid) where the document's text contains the item's: an equi-join on what must stand in both, then the exact test.

    An item's inner words stand whole in any text that contains it, so a hash of the first one to four of them
    finds all candidates among the runs of as many words. Items of one or two words meet texts by their
    first three characters; what is shorter than that is tested against all, each different text once.
    """
    key = lambda w, i, n: F.xxhash64(F.slice(w, i + 1, n))
    words = F.split("text", r"[ \n]+")
    asked = items.where("text IS NOT NULL").select("qid", F.col("text").alias("item"), words.alias("w")).withColumn("n", F.least(F.size("w") - 2, F.lit(4)))
    d = docs.select("uid", words.alias("w"))

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: key(F.col("w"), i, F.lit(n)))

    def among(keys: DataFrame, some: DataFrame) -> DataFrame:
        near = keys.join(some, "k").select("uid", "qid", "item").distinct().join(docs, "uid").where(F.contains("text", "item"))
        return near.select("qid", "uid").distinct()

    out = []
    for n in [r[0] for r in asked.select("n").distinct().collect()]:  # -1 to 4
        some = asked.where(F.col("n") == n)
        if n > 0:
            places = d.where(F.size("w") >= n).select("uid", F.explode_outer(F.array_distinct(runs(n))).alias("k"))
            out.append(among(places, some.select("qid", "item", key(F.col("w"), F.lit(1), F.lit(n)).alias("k"))))
            continue
        start = F.substring("item", 1, 3)
        long = docs.where(F.length("text") > 2).select("uid", F.explode_outer(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring("text", i, 3)))).alias("k"))
        out.append(among(long, some.where(F.length("item") > 2).select("qid", "item", start.alias("k"))))
        short = some.where(F.length("item") < 3)
        every = short.select("item").distinct().join(docs, F.contains("text", "item")).select("item", "uid")
        out.append(every.join(short, "item").select("qid", "uid").distinct())
    return reduce(DataFrame.unionByName, out) if out else docs.crossJoin(items.select("qid").limit(0)).select("qid", "uid")


def _vectors(spark, sf_dir, name="uid"):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vec"), "label")


def _search(spark, sf_dir, depth=20, dims=None):
    all_ = _vectors(spark, sf_dir)
    if dims:
        all_ = all_.withColumn("vec", F.slice("vec", 1, dims))
    asked = all_.where("uid % 50 = 0").select(F.col("uid").alias("qid"), "vec")
    return similarity.top_k(asked, all_, depth)


def sim_sql(name: str, dims: int | None = None, depth: int = 20) -> str:
    v = f"embedding[1:{dims}]" if dims else "embedding"
    return f"""{name} AS (SELECT * FROM (SELECT q.vec_id AS qid, u.vec_id AS uid, u.label, list_dot_product(q.{v}::DOUBLE[], u.{v}::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.{v}::DOUBLE[], u.{v}::DOUBLE[]) DESC, u.vec_id) AS rank
  FROM embeddings q JOIN embeddings u ON q.vec_id % 50 = 0) WHERE rank <= {depth})"""


@query(f"WITH {sim_sql('s')} SELECT qid, uid, round(score, 6) AS score, rank FROM s")
def k1_vector_top20(spark, sf_dir):
    return _search(spark, sf_dir).select("qid", "uid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


FUSE_SQL = f"""{sim_sql('s')}, {sim_sql('h', 32)},
u AS (SELECT qid, uid, rank, 1.0 AS w FROM s UNION ALL SELECT qid, uid, rank, 0.4 FROM h),
f AS (SELECT qid, uid, sum(w / (60 + rank)) AS score FROM u GROUP BY ALL),
fused AS (SELECT qid, uid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, uid) AS rank FROM f)"""


def _fused(spark, sf_dir):
    channel = lambda df, name, w: df.select("qid", "uid", "rank", F.lit(name).alias("channel"), F.lit(w).alias("weight"))
    return similarity.rrf(channel(_search(spark, sf_dir), "whole", 1.0).unionByName(channel(_search(spark, sf_dir, dims=32), "half", 0.4)))


@query(f"WITH {FUSE_SQL} SELECT qid, uid, round(score, 9) AS score, rank FROM fused")
def k3_weighted_rrf(spark, sf_dir):
    return _fused(spark, sf_dir).select("qid", "uid", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT q.vec_id AS qid, u.label, max(list_dot_product(q.embedding::DOUBLE[], u.embedding::DOUBLE[])) AS score
FROM embeddings q JOIN embeddings u ON q.vec_id % 50 = 0 GROUP BY ALL)
SELECT qid, label, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label) AS rank FROM s""")
def a1_max_fold_to_parent(spark, sf_dir):
    all_ = _vectors(spark, sf_dir)
    # a task gives the best of each label, not every pair
    scored = similarity.score_all(all_.where("uid % 50 = 0").select(F.col("uid").alias("qid"), "vec"), all_, 1, "label")
    folded = similarity.max_fold(scored.join(all_.select("uid", "label"), "uid"), "label")
    return similarity.ranked(folded, ["qid"], uid="label").select("qid", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


METRIC_SQL = """
g AS (SELECT q.vec_id AS qid, u.vec_id AS uid, 1.0 AS gain FROM embeddings q JOIN embeddings u ON q.label = u.label WHERE q.vec_id % 50 = 0),
i AS (SELECT qid, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) ELSE 0 END) AS idcg, count(*) AS relevant FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY uid) AS i FROM g) GROUP BY 1),
t AS (SELECT s.qid, s.rank, gain IS NOT NULL AS rel, sum((gain IS NOT NULL)::INT) OVER (PARTITION BY s.qid ORDER BY rank) AS cum FROM {r} s LEFT JOIN g USING (qid, uid) WHERE rank <= 10),
m AS (SELECT qid, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(rel::INT) AS hits, min(CASE WHEN rel THEN rank END) AS first, sum(CASE WHEN rel THEN cum / rank ELSE 0 END) AS ap, count(*) AS shown FROM t GROUP BY 1)
"""


def _qrels(spark, sf_dir):
    all_ = _vectors(spark, sf_dir)
    asked = all_.where("uid % 50 = 0").select(F.col("uid").alias("qid"), "label")
    return asked.join(all_.select("uid", "label"), "label").select("qid", "uid", F.lit(1.0).alias("gain"))


@query(f"WITH {sim_sql('s')}, {METRIC_SQL.format(r='s')} SELECT qid, round(dcg / idcg, 6) AS ndcg, round(hits / relevant, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr, "
       "round(hits / shown, 6) AS judged, (hits > 0)::INT AS success, round(ap / relevant, 6) AS ap FROM i JOIN m USING (qid)")
def e1_ranking_metrics(spark, sf_dir):
    m = metrics.ranking_metrics(_search(spark, sf_dir), _qrels(spark, sf_dir), 10)
    return m.select("qid", "success", *[F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr", "judged", "ap")])


@query(f"""WITH {FUSE_SQL}, {METRIC_SQL.format(r='s')}, fm AS (SELECT f.qid, sum(1 / log2(f.rank + 1)) AS dcg FROM fused f JOIN g USING (qid, uid) WHERE f.rank <= 10 GROUP BY 1),
p AS (SELECT i.qid, coalesce(m.dcg, 0) / idcg AS a, coalesce(fm.dcg, 0) / idcg AS b FROM i LEFT JOIN m USING (qid) LEFT JOIN fm USING (qid)), d AS (SELECT *, b - a AS d FROM p)
SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(d), 6) AS delta, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties,
count(*) FILTER (d < -1e-12) AS losses, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) END, 4) AS effect FROM d""")
def x3_paired_comparison(spark, sf_dir):
    """Fused against single ranking by nDCG@10, question by question."""
    out = stats.compare(_pairs(spark, sf_dir), ["one"])
    return out.select("n", "wins", "ties", "losses", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "delta")], F.round("effect", 4).alias("effect"))


def _pairs(spark, sf_dir):
    rel = _qrels(spark, sf_dir)
    value = lambda r: metrics.ranking_metrics(r, rel, 10).select("qid", F.col("ndcg").alias("value"))
    return stats.paired(rel.select("qid").distinct(), value(_search(spark, sf_dir)), value(_fused(spark, sf_dir))).withColumn("one", F.lit("fused"))


#: (qid, a, b): nDCG@10 of the single and of the fused ranking.
PAIRS_SQL = f"""{FUSE_SQL}, {METRIC_SQL.format(r='s')}, fm AS (SELECT f.qid, sum(1 / log2(f.rank + 1)) AS dcg FROM fused f JOIN g USING (qid, uid) WHERE f.rank <= 10 GROUP BY 1),
pairs AS (SELECT i.qid, coalesce(m.dcg, 0) / idcg AS a, coalesce(fm.dcg, 0) / idcg AS b FROM i LEFT JOIN m USING (qid) LEFT JOIN fm USING (qid))"""


def weight_sql(name: str, unit: str) -> str:
    """Draws 0 to 9,999 of every row of `rows`, with Poisson weights from a hash of draw and unit."""
    edges = " + ".join(f"(number >= {x})::INT" for x in stats.POISSON)
    return f"""bb AS (SELECT *, md5('{name}|' || blk || '|' || {unit}) AS h FROM rows, range(0, 1250) gg(blk)), dr AS (SELECT bb.*, blk * 8 + j AS draw, ('0x' || substr(h, (j * 4 + 1)::INT, 4))::INT AS number FROM bb, range(0, 8) x(j)), wt AS (SELECT *, {edges} AS w FROM dr)"""


@query(f"""WITH {PAIRS_SQL}, rows AS (SELECT qid, b - a AS d FROM pairs), fl AS (SELECT *, md5('flip|' || blk || '|' || qid) AS h FROM rows, range(0, 313) gg(blk)), sg AS (SELECT qid, d, blk * 32 + j AS draw, substr(h, (j + 1)::INT, 1) >= '8' AS up FROM fl, range(0, 32) x(j)),
mm AS (SELECT draw, avg(CASE WHEN up THEN d ELSE -d END) AS m FROM sg WHERE draw < 10000 GROUP BY 1), pv AS (SELECT (count(*) FILTER (abs(m) >= abs((SELECT avg(d) FROM rows)) - 1e-12) + 1) / 10001 AS p FROM mm),
{weight_sql('boot', 'qid')}, rt AS (SELECT draw, sum(w * d) / nullif(sum(w), 0) AS r FROM wt GROUP BY 1) SELECT 'fused' AS test, round(p, 6) AS p, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM rt, pv GROUP BY p""")
def x1_permutation_and_bootstrap(spark, sf_dir):
    """The sign-flip p-value and a bootstrap interval of the fused ranking's gain."""
    pairs = cut(_pairs(spark, sf_dir))  # used twice
    diff = pairs.select("one", "qid", (F.col("b") - F.col("a")).alias("d"), F.lit(1).alias("n"))
    out = stats.sign_flips(pairs, "one").join(stats.bootstrap_interval(diff, "one", "qid", "d", "n"), "one")
    return out.select(F.col("one").alias("test"), *[F.round(c, 6).alias(c) for c in ("p", "low", "high")])


@query(f"""WITH {sim_sql('s')}, t AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) - 1 AS nth FROM s WHERE rank <= 10),
a AS (SELECT qid, sum(pow(0.5, nth) / log2(rank + 1)) AS alpha_dcg, count(DISTINCT label) AS hit FROM t GROUP BY 1)
SELECT qid, round(alpha_dcg, 6) AS alpha_dcg, round(hit / (SELECT count(DISTINCT label) FROM embeddings), 6) AS subtopic_recall FROM a""")
def e12_alpha_dcg_and_subtopic_recall(spark, sf_dir):
    ranking, labels = _search(spark, sf_dir), _vectors(spark, sf_dir).select("uid", F.col("label").alias("subtopic"))
    hits = ranking.join(labels, "uid").where("rank <= 10")
    total = labels.agg(F.countDistinct("subtopic").alias("all"))
    found = hits.groupBy("qid").agg(F.countDistinct("subtopic").alias("hit")).crossJoin(F.broadcast(total))
    a = metrics.alpha_dcg(ranking, hits.select("qid", "uid", "subtopic"), 10)
    return a.join(found, "qid").select("qid", F.round("alpha_dcg", 6).alias("alpha_dcg"), F.round(F.col("hit") / F.col("all"), 6).alias("subtopic_recall"))


@query(f"""WITH {sim_sql('s')}, t AS (SELECT * FROM s WHERE rank <= 10)
SELECT a.qid, round(avg(1 - list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[])), 6) AS distance
FROM t a JOIN t b ON a.qid = b.qid AND a.rank < b.rank JOIN embeddings x ON x.vec_id = a.uid JOIN embeddings y ON y.vec_id = b.uid GROUP BY 1""")
def e16_intra_list_distance(spark, sf_dir):
    top = _search(spark, sf_dir, depth=10).join(_vectors(spark, sf_dir), "uid")
    a, b = top.alias("a"), top.alias("b")
    pairs = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.rank") < F.col("b.rank")))
    return pairs.groupBy(F.col("a.qid").alias("qid")).agg(F.round(F.avg(1 - vectors.dot(F.col("a.vec"), F.col("b.vec"))), 6).alias("distance"))


CENTROID_SQL = """
p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) WHERE embedding[i] IS NOT NULL GROUP BY ALL),
c AS (SELECT label, list(x / n ORDER BY i) AS centroid FROM p JOIN (SELECT label, sqrt(sum(x * x)) AS n FROM p GROUP BY 1) USING (label) GROUP BY label)
"""


@query(f"WITH {CENTROID_SQL} SELECT label, i AS dim, round(centroid[i], 6) AS x FROM c, range(1, 65) r(i)")
def r10_centroids(spark, sf_dir):
    c = similarity.centroids(_vectors(spark, sf_dir), "label")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("dim"), F.round("x", 6).alias("x"))


def _to_centroids(spark, sf_dir):
    c = similarity.centroids(_vectors(spark, sf_dir), "label").select(F.col("label").alias("qid"), F.col("centroid").alias("vec"))
    return similarity.score_all(c, _vectors(spark, sf_dir))


@query(f"""WITH {CENTROID_SQL}, s AS (SELECT vec_id, c.label, list_dot_product(embedding::DOUBLE[], centroid) AS score FROM embeddings, c)
SELECT vec_id AS uid, CASE WHEN max(score) >= 0.4 THEN arg_max(label, score) ELSE -1 END AS label, round(max(score), 6) AS score FROM s GROUP BY 1""")
def g4_assign_to_centroids(spark, sf_dir):
    return similarity.assign(_to_centroids(spark, sf_dir), 0.4).select("uid", "label", F.round("score", 6).alias("score"))


@query(f"""WITH {CENTROID_SQL}, s AS (SELECT vec_id, c.label, list_dot_product(embedding::DOUBLE[], centroid) AS score FROM embeddings, c),
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM s),
r AS (SELECT vec_id AS uid, label, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM e)
SELECT uid, label, round(p, 6) AS p, rank FROM r WHERE rank <= 5""")
def l20_topic_distribution(spark, sf_dir):
    top = similarity.softmax_top(_to_centroids(spark, sf_dir), 5)
    return top.select("uid", F.col("qid").alias("label"), F.round("p", 6).alias("p"), F.col("rank").cast("long").alias("rank"))


def _pool(spark, sf_dir, depth=60):
    all_ = _vectors(spark, sf_dir).withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return _search(spark, sf_dir, depth).join(all_, "uid").select("qid", "uid", F.col("score").alias("rel"), "vec", "label")


POOL_SQL = f"{sim_sql('s', depth=60)}, pool AS (SELECT qid, uid, score AS rel, CASE WHEN label = 0 THEN -1 ELSE label END AS label FROM s)"


@query(f"""WITH {POOL_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rel DESC, uid) AS round, max(rel) OVER (PARTITION BY qid, label) AS best FROM pool),
r AS (SELECT qid, uid, row_number() OVER (PARTITION BY qid ORDER BY round, label = -1, best DESC, label) AS pos FROM t) SELECT * FROM r WHERE pos <= 10""")
def l4_cluster_round_robin(spark, sf_dir):
    return select.cluster_round_robin(_pool(spark, sf_dir), 10).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {POOL_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, uid) AS r, least(10, count(*) OVER (PARTITION BY qid)) AS n FROM pool),
u AS (SELECT *, (n - round_even(0.3 * n, 0))::BIGINT AS head FROM t), k AS (SELECT * FROM u WHERE r <= head OR rel >= 0.05),
b AS (SELECT *, row_number() OVER (PARTITION BY qid, r <= head ORDER BY r DESC) AS back FROM k), p AS (SELECT qid, uid, CASE WHEN r <= head THEN r ELSE head + back END AS pos, n FROM b)
SELECT qid, uid, pos FROM p WHERE pos <= n""")
def l5_outlier_harvest(spark, sf_dir):
    """Seven of the most and three of the least relevant of the pool that are above a floor."""
    return select.outlier_harvest(_pool(spark, sf_dir), 10, floor=0.05).withColumn("pos", F.col("pos").cast("long"))


@query()
def l2_mmr(spark, sf_dir):
    return select.mmr(_pool(spark, sf_dir), 10)


@query()
def l3_dpp_greedy(spark, sf_dir):
    return select.dpp(_pool(spark, sf_dir), 10)


@query(f"""WITH {POOL_SQL}, t AS (SELECT *, least(20, count(*) OVER (PARTITION BY qid)) AS n, row_number() OVER (PARTITION BY qid, label ORDER BY rel DESC, uid) AS r FROM pool),
h AS (SELECT *, r = 1 AND label IN (3, -1) AS head FROM t), z AS (SELECT *, r - 1 - max(head::INT) OVER (PARTITION BY qid, label) AS i, count(*) FILTER (NOT head) OVER (PARTITION BY qid, label) AS size, count(*) FILTER (head) OVER (PARTITION BY qid) AS heads FROM h),
c AS (SELECT qid, count(DISTINCT label) AS strata FROM z WHERE size > 0 GROUP BY 1), e AS (SELECT z.*, greatest(1, (n - heads) // greatest(1, strata)) AS share FROM z JOIN c USING (qid)),
k AS (SELECT *, CASE WHEN head THEN 0 WHEN i % greatest(1, size // share) = 0 THEN 1 ELSE 2 END AS kind FROM e),
o AS (SELECT qid, uid, n, row_number() OVER (PARTITION BY qid ORDER BY kind, CASE WHEN kind = 0 THEN list_position([3, -1], label) END, CASE WHEN kind = 1 THEN -size END, CASE WHEN kind = 1 THEN label::VARCHAR END, CASE WHEN kind = 1 THEN i END, rel DESC, uid) AS pos FROM k)
SELECT qid, uid, pos FROM o WHERE pos <= n""")
def l6_coverage_stratified(spark, sf_dir):
    return select.coverage_stratified(_pool(spark, sf_dir), 20, must_cover=(3, -1)).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH s AS (SELECT l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
b AS (SELECT n_chars AS score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM s GROUP BY 1),
w AS (SELECT *, p * (coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS wins FROM b)
SELECT sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(sum(wins) / (sum(p) * sum(n)), 6) AS roc_auc FROM w""")
def a20_gate_roc_auc(spark, sf_dir):
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = metrics.binary_scores(s.select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("positive")))
    return out.withColumn("roc_auc", F.round("roc_auc", 6))


@query("""WITH c AS (SELECT quantile_cont(n_chars, 0.6) AS cut FROM documents),
s AS (SELECT quality, n_chars >= cut AS passed FROM labels JOIN documents USING (doc_id), c),
t AS (SELECT count(*) FILTER (passed AND quality = 1) AS tp, count(*) FILTER (passed AND quality <> 1) AS fp, count(*) FILTER (NOT passed AND quality = 1) AS fn, count(*) FILTER (NOT passed AND quality <> 1) AS tn FROM s)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp + fp) / (tp + fp + fn + tn), 6) AS survival FROM t""")
def p5_quantile_gate_evaluation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    passed = gate.quantile_gate(docs, "n_chars", 0.6).select("doc_id", F.lit(True).alias("ok"))
    judged = table(spark, sf_dir, "labels").join(docs, "doc_id").join(passed, "doc_id", "left")
    e = gate.evaluate(judged.select(F.coalesce("ok", F.lit(False)).alias("passed"), F.col("quality").alias("label")))
    return e.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "survival")])


@query()
def p3_fitted_gate(spark, sf_dir):
    """Similarity to a label's centroid and to the others' as features of a logistic gate for one label."""
    s = _to_centroids(spark, sf_dir).join(_vectors(spark, sf_dir).select("uid", "label"), "uid")
    x = s.groupBy("uid", (F.col("label") == 1).cast("int").alias("label")).agg(
        F.max(F.when(F.col("qid") == 1, F.col("score"))).alias("own"), F.max(F.when(F.col("qid") != 1, F.col("score"))).alias("other")
    )
    weights, bias, threshold = gate.fit_gate(x, ["own", "other"])
    return gate.apply_gate(x, ["own", "other"], weights, bias).select("uid", "label", F.round("gate", 4).alias("gate"), (F.col("gate") >= threshold).alias("passed"))
