"""Queries over cards, group channels, coverage, facts and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from facetspark.operators import cards, context, coverage, gate, graph, lexical, select, similarity
from facetspark.plans.retrieval import _search, _vectors, sim_sql
from facetspark.plans.texts import PHRASES_SQL, TOKENS, _occurrences, _tokens

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


#: Each label is an aspect with its first three vectors as anchors; ten vectors in a row are a document's spans.
ASPECT_SQL = """an AS (SELECT label AS aspect, vec_id AS anchor, embedding AS e FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 3),
sc AS (SELECT vec_id AS uid, aspect, anchor, list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) AS score FROM embeddings, an),
asp AS (SELECT uid, aspect, avg(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY uid, aspect ORDER BY score DESC, anchor) AS r FROM sc) WHERE r <= 2 GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(score, 12) DESC, aspect) AS r FROM asp) WHERE r = 1)"""


def _aspects(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    anchors = select.top_by(v, ["label"], [F.col("uid")], 3)
    scored = similarity.score_all(anchors.select(F.col("uid").alias("qid"), "vec"), v)
    names = anchors.select(F.col("uid").alias("qid"), F.col("label").alias("aspect"))
    return cards.aspect_scores(scored.join(names, "qid").select("uid", "aspect", F.col("qid").alias("anchor"), "score"))


def _spans(spark, sf_dir):
    return _vectors(spark, sf_dir).select("uid", F.floor(F.col("uid") / 10).alias("doc"), (F.col("uid") % 10).alias("pos"), F.col("uid").cast("string").alias("text"))


@query(f"WITH {ASPECT_SQL} SELECT uid // 10 AS doc, aspect, string_agg(uid::VARCHAR, ' ' ORDER BY uid) AS text FROM best GROUP BY ALL")
def r4_partition_cards(spark, sf_dir):
    return cards.partition_cards(_spans(spark, sf_dir), cards.best_aspect(_aspects(spark, sf_dir)))


@query(f"""WITH {ASPECT_SQL}, t AS (SELECT uid // 10 AS doc, aspect, uid, row_number() OVER (PARTITION BY uid // 10, aspect ORDER BY round(score, 12) DESC, uid) AS r FROM asp WHERE score >= 0.15)
SELECT doc, aspect, string_agg(uid::VARCHAR, ' ' ORDER BY r) AS text FROM t WHERE r <= 2 GROUP BY ALL""")
def r5_lossy_cards(spark, sf_dir):
    return cards.lossy_cards(_spans(spark, sf_dir), _aspects(spark, sf_dir), 2)


@query(f"WITH {ASPECT_SQL} SELECT uid, CASE WHEN score >= 0.3 THEN aspect ELSE -1 END AS aspect, round(score, 6) AS score FROM best")
def r8_floor_assignment(spark, sf_dir):
    return cards.best_aspect(_aspects(spark, sf_dir), floor=0.3).select("uid", "aspect", F.round("score", 6).alias("score"))


@query(f"""WITH {ASPECT_SQL}, t AS (SELECT uid, max(score) AS score FROM asp GROUP BY 1), n AS (SELECT greatest(50, round_even(0.3 * count(*), 0)) AS keep FROM t),
r AS (SELECT uid, row_number() OVER (ORDER BY round(score, 12) DESC, uid) AS r FROM t) SELECT uid FROM r, n WHERE r <= keep""")
def p6_top_fraction_gate(spark, sf_dir):
    """The top fraction by score, at least fifty."""
    t = _aspects(spark, sf_dir).groupBy("uid").agg(F.round(F.max("score"), 12).alias("score"))
    return gate.top_fraction(t, "score", "uid", 0.3, 50).select("uid")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 25")
def p9_source_cap(spark, sf_dir):
    return select.top_by(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], 25).select("doc_id", "source")


@query(f"WITH {PHRASES_SQL} SELECT phrase, f, pronoun, hub FROM hub WHERE pronoun OR hub")
def p16_hub_phrases(spark, sf_dir):
    """Phrases that go before graphs are built: pronouns by majority, and the most frequent half per cent."""
    return graph.hub_rule(_occurrences(spark, sf_dir)).where("pronoun OR hub")


LINKS_SQL = """tp AS (SELECT lang AS topic, round(avg(n_chars), 3) AS score FROM documents GROUP BY 1), cm AS (SELECT source AS community, round(avg(n_chars), 3) AS score FROM documents GROUP BY 1),
lk AS (SELECT lang AS topic, source AS community, count(*) / 100 AS w FROM documents GROUP BY ALL)"""


@query(f"""WITH {LINKS_SQL} SELECT topic AS grp, round(any_value(tp.score) + coalesce(sum(w * cm.score), 0), 4) AS score FROM tp LEFT JOIN lk USING (topic) LEFT JOIN cm USING (community) GROUP BY 1
UNION ALL SELECT community, round(any_value(cm.score) + coalesce(sum(w * tp.score), 0), 4) FROM cm LEFT JOIN lk USING (community) LEFT JOIN tp USING (topic) GROUP BY 1""")
def j10_apply_links(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    mean = lambda c, name: d.groupBy(F.col(c).alias(name)).agg(F.round(F.avg("n_chars"), 3).alias("score"))
    links = d.groupBy(F.col("lang").alias("topic"), F.col("source").alias("community")).agg((F.count("*") / 100).alias("w"))
    t, c = graph.apply_links(mean("lang", "topic"), mean("source", "community"), links)
    return t.union(c).toDF("grp", "score").withColumn("score", F.round("score", 4))


@query(f"""WITH {sim_sql('s', depth=60)}, g AS (SELECT qid, label AS grp, max(score) AS score FROM s GROUP BY ALL), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, grp) AS r FROM g) WHERE r <= 3)
SELECT s.qid, s.uid, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, s.uid) AS rank FROM s JOIN top ON s.qid = top.qid AND s.label = top.grp""")
def k11_group_channel(spark, sf_dir):
    s, v = _search(spark, sf_dir, 60), _vectors(spark, sf_dir).select("uid", F.col("label").alias("grp"))
    groups = similarity.max_fold(s.join(v, "uid"), "grp")
    return coverage.group_channel(groups, v.select("grp", "uid"), s).select("qid", "uid", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {sim_sql('s', depth=40)}, r AS (SELECT qid, uid, uid // 10 AS container, rank FROM s), kept AS (SELECT * FROM r WHERE rank <= 12),
c AS (SELECT qid, container, row_number() OVER (PARTITION BY qid ORDER BY min(rank), container) AS place FROM kept GROUP BY qid, container),
o AS (SELECT q.vec_id AS qid, u.vec_id AS uid, list_dot_product(q.embedding::DOUBLE[], u.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings u ON q.vec_id % 50 = 0 JOIN c ON c.qid = q.vec_id AND c.container = u.vec_id // 10 AND place <= 3),
a AS (SELECT qid, uid, 0 AS stage, rank::DOUBLE AS ord FROM kept UNION ALL SELECT qid, uid, 1, -score FROM o WHERE (qid, uid) NOT IN (SELECT (qid, uid) FROM kept)),
b AS (FROM a UNION ALL SELECT qid, uid, 2, rank::DOUBLE FROM r WHERE rank > 12 AND (qid, uid) NOT IN (SELECT (qid, uid) FROM a))
SELECT qid, uid, stage, row_number() OVER (PARTITION BY qid ORDER BY stage, ord, uid) AS pos FROM b""")
def k15_lazy_expansion(spark, sf_dir):
    """The kept ranking, then the other members of its first three containers by similarity, then the deeper list."""
    v = _vectors(spark, sf_dir).withColumn("container", F.floor(F.col("uid") / 10))
    ranking = _search(spark, sf_dir, 40).withColumn("container", F.floor(F.col("uid") / 10))
    return context.lazy_expand(ranking.where("rank <= 12"), ranking.where("rank > 12"), v, v.where("uid % 50 = 0").select(F.col("uid").alias("qid"), F.col("vec").alias("qvec")), 3).select(
        "qid", "uid", "stage", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {sim_sql('s', depth=50)}, {sim_sql('h', 32, 50)}, e AS (SELECT q.vec_id AS qid, u.vec_id AS uid FROM embeddings q JOIN embeddings u ON q.vec_id % 50 = 0 AND u.vec_id BETWEEN q.vec_id AND q.vec_id + 2),
j AS (SELECT e.qid, bool_and(coalesce(s.rank <= 20, false)) AS joint FROM e LEFT JOIN s USING (qid, uid) GROUP BY 1),
p AS (SELECT e.qid, avg(CASE WHEN coalesce(s.rank, 51) > coalesce(h.rank, 51) THEN coalesce(h.rank, 51) / coalesce(s.rank, 51) - 1 ELSE 1 - coalesce(s.rank, 51) / coalesce(h.rank, 51) END) AS p FROM e LEFT JOIN s USING (qid, uid) LEFT JOIN h USING (qid, uid) GROUP BY 1)
SELECT qid, joint, round(p, 6) AS p_mrr FROM j JOIN p USING (qid)""")
def e10_joint_hit_and_p_mrr(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("uid")
    asked = v.where("uid % 50 = 0").select(F.col("uid").alias("qid"))
    evidence = asked.select("qid", F.explode(F.sequence(F.col("qid"), F.col("qid") + 2)).alias("uid")).join(v, "uid")
    one, two = _search(spark, sf_dir, 50), _search(spark, sf_dir, 50, 32)
    return coverage.joint_hit(evidence, one, 20).join(coverage.p_mrr(one, two, evidence, 51), "qid").select("qid", "joint", F.round("p_mrr", 6).alias("p_mrr"))


@query(f"""WITH t AS (SELECT conv_id AS qid, turn, role, {TOKENS} AS tokens FROM conversations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM t),
s AS (SELECT qid, turn, least(tokens, 200 - (upto - tokens)) AS chars, tokens AS length FROM r WHERE upto - tokens < 200), c AS (SELECT qid, turn FROM s WHERE chars >= least(length / 2, 2000)),
e AS (SELECT t.qid, t.turn, c.turn IS NOT NULL AS hit FROM t LEFT JOIN c USING (qid, turn) WHERE role = 'user')
SELECT qid, round(avg(hit::INT), 6) AS recall, bool_and(hit) AS joint, CASE WHEN bool_and(hit) THEN 4 WHEN bool_or(hit) THEN 3 ELSE 2 END AS bucket FROM e GROUP BY 1""")
def e18_coverage_and_buckets(spark, sf_dir):
    """User turns as evidence for a conversation packed into 200 tokens: coverage, joint recall and failure bucket."""
    t = _tokens(spark, sf_dir)
    shown = context.budget_take(t, 200, ["conv_id"], ["turn"])
    key = F.concat_ws("#", "conv_id", "turn").alias("turn")
    covered = coverage.turn_coverage(shown.select(F.col("conv_id").alias("qid"), key, F.col("taken").alias("chars")), t.select(key, F.col("tokens").alias("length")))
    joint = coverage.joint_recall(t.where("role = 'user'").select(F.col("conv_id").alias("qid"), key), covered)
    cases = joint.select("*", F.lit(False).alias("refused"), F.lit(True).alias("located"), (F.col("recall") > 0).alias("retrieved"), F.col("joint").alias("rendered"))
    return coverage.buckets(cases).select("qid", F.round("recall", 6).alias("recall"), "joint", "bucket")


@query(f"""WITH {sim_sql('s', depth=10)}, m AS (SELECT qid, uid + 1 AS uid, rank, 0 AS ord FROM s WHERE uid % 3 = 0), b AS (FROM m UNION ALL SELECT qid, uid, rank, 1 FROM s),
f AS (SELECT qid, uid, min(rank * 2 + ord) AS f FROM b GROUP BY ALL) SELECT qid, uid, row_number() OVER (PARTITION BY qid ORDER BY f, uid) AS rank FROM f""")
def k24_replacements_first(spark, sf_dir):
    r = _search(spark, sf_dir, 10)
    new = _vectors(spark, sf_dir).where("uid % 3 = 0").select("uid", (F.col("uid") + 1).alias("new"))
    return coverage.replacements_first(r, new).select("qid", "uid", F.col("rank").cast("long").alias("rank"))


@query(r"""WITH tok AS (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '\w\w+')) AS dl, unnest(regexp_extract_all(lower(text), '\w\w+')) AS term FROM conversations),
q AS (SELECT conv_id, term, count(*) AS qtf FROM tok WHERE turn = 0 GROUP BY ALL), hits AS (SELECT t.conv_id, t.turn, dl, t.term, count(*) AS tf, any_value(qtf) AS qtf FROM tok t JOIN q USING (conv_id, term) WHERE t.turn > 0 GROUP BY ALL)
SELECT conv_id, turn, sum(least(tf, qtf))::BIGINT AS shared, row_number() OVER (PARTITION BY conv_id ORDER BY sum(least(tf, qtf)) DESC, turn) AS rank FROM hits GROUP BY conv_id, turn""")
def j2_group_scoped_search(spark, sf_dir):
    """Turns of the same conversation that share terms with its first turn: an equi-join on group and term, never across groups."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(lexical.terms(F.col("text"))).alias("term")).groupBy("conv_id", "turn", "term").agg(F.count("*").alias("tf"))
    q = t.where("turn = 0").select("conv_id", "term", F.col("tf").alias("qtf"))
    s = t.where("turn > 0").join(q, ["conv_id", "term"]).groupBy("conv_id", "turn").agg(F.sum(F.least("tf", "qtf")).alias("shared"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("shared"), "turn")).cast("long"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 90 THEN 'accepted' ELSE 'rejected' END AS verdict FROM events""")
def p21_validated_facts(spark, sf_dir):
    f = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    return f.withColumn("verdict", F.when(F.col("k").between(10, 90), "accepted").otherwise("rejected"))


@query("""WITH h AS (SELECT doc_id, substr(sha256(concat(coalesce(lang, ''), chr(31), coalesce(source, ''))), 1, 12) AS h FROM documents)
SELECT doc_id, 'id_' || h || CASE WHEN row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 THEN '_' || (row_number() OVER (PARTITION BY h ORDER BY doc_id) - 1) ELSE '' END AS content_id FROM h""")
def s8_content_ids(spark, sf_dir):
    """Ids from content, with a running suffix where the content repeats."""
    h = F.substring(F.sha2(F.concat(F.coalesce("lang", F.lit("")), F.lit("\x1f"), F.coalesce("source", F.lit(""))), 256), 1, 12)
    nth = F.row_number().over(W.partitionBy("h").orderBy("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", h.alias("h")).withColumn("n", nth)
    return d.select("doc_id", F.concat(F.lit("id_"), "h", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n") - 1)).otherwise("")).alias("content_id"))


@query("""WITH c AS (SELECT event_type AS tier, count(*) AS calls, sum(value) AS tokens FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1)
SELECT tier, calls, round(tokens, 4) AS tokens, round(tokens * CASE tier WHEN 'click' THEN 0.1 WHEN 'view' THEN 0.2 ELSE 0.3 END, 4) AS cost, round(sum(tokens) OVER (), 4) AS all_tokens FROM c""")
def a36_cost_by_tier(spark, sf_dir):
    e = table(spark, sf_dir, "events").dropDuplicates(["event_id"])
    price = F.when(F.col("tier") == "click", 0.1).when(F.col("tier") == "view", 0.2).otherwise(0.3)
    c = e.groupBy(F.col("event_type").alias("tier")).agg(F.count("*").alias("calls"), F.sum("value").alias("tokens"))
    total = c.agg(F.sum("tokens").alias("all"))
    return c.crossJoin(F.broadcast(total)).select("tier", "calls", F.round("tokens", 4).alias("tokens"), F.round(F.col("tokens") * price, 4).alias("cost"), F.round("all", 4).alias("all_tokens"))
