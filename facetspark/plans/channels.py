"""Queries over retrieval channels, their fusion and rendering."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from facetspark.functions import text as T, vectors
from facetspark.operators import channels, context, coverage, similarity
from facetspark.plans.common import Register, table
from facetspark.plans.retrieval import _search, _vectors, sim_sql

query = Register()
long = lambda c: F.col(c).cast("long").alias(c)

#: Vectors are sub-units: four make an owner, twenty a container.
OWNER, CONTAINER = 4, 20


def _ranking(spark, sf_dir, depth=100):
    r = _search(spark, sf_dir, depth)
    return r.withColumn("owner", F.floor(F.col("uid") / OWNER)).withColumn("container", F.floor(F.col("uid") / CONTAINER))


def _asked(spark, sf_dir):
    return _vectors(spark, sf_dir).where("uid % 50 = 0").select(F.col("uid").alias("qid"), "vec")


FOLD_SQL = f"""{sim_sql('s', depth=100)}, fo AS (SELECT qid, uid // 4 AS owner, min(rank) AS first, arg_min(score, rank) AS score, arg_min(uid, rank) AS via FROM s GROUP BY ALL),
fold AS (SELECT qid, owner, score, via, row_number() OVER (PARTITION BY qid ORDER BY first, owner) AS rank FROM fo)"""


@query(f"WITH {FOLD_SQL} SELECT qid, owner, round(score, 6) AS score, via, rank FROM fold WHERE rank <= 20")
def k8_subunit_channel(spark, sf_dir):
    """Sub-units by similarity, folded to owners by first appearance, with score and the unit that brought them."""
    f = channels.fold_first(_ranking(spark, sf_dir), "owner", 20)
    return f.select("qid", "owner", F.round("score", 6).alias("score"), "via", long("rank"))


def mean_sql(name: str, group: str) -> str:
    return f"""{name}p AS (SELECT {group} AS grp, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) WHERE embedding[i] IS NOT NULL GROUP BY ALL),
{name} AS (SELECT grp, list(x / n ORDER BY i) AS vec FROM {name}p JOIN (SELECT grp, sqrt(sum(x * x)) AS n FROM {name}p GROUP BY 1) USING (grp) GROUP BY grp)"""


@query(f"""WITH {mean_sql('ov', 'vec_id // 4')}, r AS (SELECT q.vec_id AS qid, grp AS owner, list_dot_product(q.embedding::DOUBLE[], vec) AS score FROM embeddings q, ov WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT qid, owner, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, owner) AS rank FROM r) WHERE rank <= 20""")
def k9_owner_channel(spark, sf_dir):
    """Owners by the mean of their units' vectors."""
    means = similarity.centroids(_vectors(spark, sf_dir).withColumn("owner", F.floor(F.col("uid") / OWNER)), "owner")
    top = similarity.top_k(_asked(spark, sf_dir), means.select(F.col("owner").alias("uid"), F.col("centroid").alias("vec")), 20)
    return top.select("qid", F.col("uid").alias("owner"), F.round("score", 6).alias("score"), long("rank"))


@query(f"""WITH {FOLD_SQL}, {sim_sql('h', 32, 100)}, ho AS (SELECT qid, uid // 4 AS owner, min(rank) AS rank FROM h GROUP BY ALL), hr AS (SELECT qid, owner, row_number() OVER (PARTITION BY qid ORDER BY rank, owner) AS rank FROM ho),
u AS (SELECT qid, owner, min(l * 100000 + rank) AS spot FROM (SELECT qid, owner, 0 AS l, rank FROM fold WHERE rank <= 10 UNION ALL SELECT qid, owner, 1, rank FROM hr WHERE rank <= 10) GROUP BY ALL),
o AS (SELECT qid, owner, row_number() OVER (PARTITION BY qid ORDER BY spot, owner) AS rank FROM u), c AS (SELECT qid, owner // 5 AS session, min(rank) AS first FROM o GROUP BY ALL)
SELECT qid, session, row_number() OVER (PARTITION BY qid ORDER BY first, session) AS rank FROM c""")
def a7_session_ranking(spark, sf_dir):
    """Owners of two channels one after the other without repeats, then their sessions by first appearance."""
    whole = channels.fold_first(_ranking(spark, sf_dir), "owner", 10)
    half = channels.fold_first(_search(spark, sf_dir, 100, 32).withColumn("owner", F.floor(F.col("uid") / OWNER)), "owner", 10)
    both = channels.union_in_order([whole, half], "owner").withColumn("session", F.floor(F.col("owner") / 5))
    first = both.groupBy("qid", "session").agg(F.min("rank").alias("first"))
    return first.select("qid", "session", F.row_number().over(W.partitionBy("qid").orderBy("first", "session")).cast("long").alias("rank"))


# The weights of the four channels.
CHANNEL_WEIGHTS = {"base": 1.0, "topics": 0.2, "communities": 0.2, "relations": 0.4}


@query(f"""WITH {sim_sql('s', depth=100)}, al AS (SELECT q.vec_id AS qid, u.vec_id AS uid, u.label, u.vec_id // 20 AS container, list_dot_product(q.embedding::DOUBLE[], u.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings u ON q.vec_id % 50 = 0),
t AS (SELECT DISTINCT qid, label FROM s WHERE rank <= 5), c AS (SELECT DISTINCT qid, uid // 20 AS container FROM s WHERE rank <= 5), n AS (SELECT DISTINCT qid, unnest([uid - 1, uid + 1]) AS uid FROM s WHERE rank <= 5),
p AS (SELECT 'topics' AS channel, 0.2 AS w, qid, uid, score FROM al SEMI JOIN t USING (qid, label) UNION ALL SELECT 'communities', 0.2, qid, uid, score FROM al SEMI JOIN c USING (qid, container) UNION ALL SELECT 'relations', 0.4, qid, uid, score FROM al SEMI JOIN n USING (qid, uid)),
r AS (SELECT channel, w, qid, uid, row_number() OVER (PARTITION BY channel, qid ORDER BY score DESC, uid) AS rank FROM p WHERE score > 0),
e AS (SELECT w, qid, uid, rank FROM r WHERE rank <= 100 UNION ALL SELECT 1.0, qid, uid, rank FROM s), f AS (SELECT qid, uid, sum(w / (60 + rank)) AS score, count(*) AS channels FROM e GROUP BY ALL)
SELECT * FROM (SELECT qid, uid, round(score, 9) AS score, channels, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, uid) AS rank FROM f) WHERE rank <= 30""")
def k5_four_channel_fusion(spark, sf_dir):
    """K5: the ranking, and members of its first five units' topics, containers and neighbourhoods, fused with weights."""
    v = _vectors(spark, sf_dir)
    base = _search(spark, sf_dir, 100)
    by_topic = similarity.score_all(_asked(spark, sf_dir), v, 100, "label")
    topics = channels.seeded_pool(base, v.select("uid", F.col("label").alias("grp")), by_topic, 5, 100)
    seeds = base.where("rank <= 5").select("qid", "uid")
    container = F.floor(F.col("uid") / CONTAINER)
    asked = _asked(spark, sf_dir).withColumnRenamed("vec", "qvec")

    def near(pairs):  # the few members are scored where an equi-join brings them together
        s = pairs.join(v.select("uid", "vec"), "uid").join(asked, "qid").select("qid", "uid", vectors.dot(F.col("vec"), F.col("qvec")).alias("score")).where("score > 0")
        return s.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "uid"))).where("rank <= 100")

    members = v.select("uid", container.alias("grp"))
    communities = near(seeds.select("qid", container.alias("grp")).distinct().join(members, "grp").select("qid", "uid"))
    relations = near(seeds.select("qid", F.explode(F.array(F.col("uid") - 1, F.col("uid") + 1)).alias("uid")).distinct())
    lists = {"base": base, "topics": topics, "communities": communities, "relations": relations}
    every = None
    for name, one in lists.items():
        part = one.select("qid", "uid", "rank", F.lit(name).alias("channel"), F.lit(CHANNEL_WEIGHTS[name]).alias("weight"))
        every = part if every is None else every.unionByName(part)
    fused = similarity.rrf(every).where("rank <= 30")
    return fused.select("qid", "uid", F.round("score", 9).alias("score"), F.size("via").cast("long").alias("channels"), long("rank"))


PLAIN_MEAN = "SELECT grp, list(x ORDER BY i) AS vec FROM (SELECT {0} AS grp, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) WHERE embedding[i] IS NOT NULL GROUP BY ALL) GROUP BY 1"


@query(f"""WITH {sim_sql('s', depth=100)}, tv AS ({PLAIN_MEAN.format('label')}), cv AS ({PLAIN_MEAN.format('vec_id % 7')}), q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
ts AS (SELECT qid, grp, list_cosine_similarity(v, vec) AS score FROM q, tv), cs AS (SELECT qid, grp, list_cosine_similarity(v, vec) AS score FROM q, cv),
lk AS (SELECT label AS topic, vec_id % 7 AS community, count(*) / (SELECT count(*) FROM embeddings) AS w FROM embeddings GROUP BY ALL),
t2 AS (SELECT ts.qid, ts.grp, ts.score + coalesce(sum(w * cs.score), 0) AS score FROM ts LEFT JOIN lk ON topic = ts.grp LEFT JOIN cs ON cs.qid = ts.qid AND cs.grp = community GROUP BY ts.qid, ts.grp, ts.score),
b AS (SELECT qid, grp FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, grp) AS r FROM t2) WHERE r <= 3),
p AS (SELECT s.qid, uid, uid // 4 AS owner, score, row_number() OVER (PARTITION BY s.qid ORDER BY s.rank) AS rank FROM s JOIN b ON b.qid = s.qid AND b.grp = s.label),
f AS (SELECT qid, owner, min(rank) AS first FROM p GROUP BY ALL) SELECT * FROM (SELECT qid, owner, row_number() OVER (PARTITION BY qid ORDER BY first, owner) AS rank FROM f) WHERE rank <= 20""")
def k12_topic_channel_with_overlay(spark, sf_dir):
    """Cosines to plain mean prototypes, raised by links from communities; members of the best three topics, folded to owners."""
    v = _vectors(spark, sf_dir).withColumn("community", F.col("uid") % 7)
    asked = _asked(spark, sf_dir)

    def cosines(key, name):
        means = v.select(key, F.posexplode("vec").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        proto = means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("proto"))
        few = F.broadcast(proto)  # a row for each of the few topics or communities
        return asked.crossJoin(few).select("qid", F.col(key).alias(name), vectors.cosine(F.col("vec"), F.col("proto")).alias("score"))

    topics, communities = cosines("label", "topic"), cosines("community", "community").withColumnRenamed("score", "more")
    total = v.agg(F.count("*").alias("all"))
    links = v.groupBy(F.col("label").alias("topic"), "community").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("topic", "community", (F.col("n") / F.col("all")).alias("w"))
    raised = topics.join(F.broadcast(links), "topic", "left").join(communities, ["qid", "community"], "left").groupBy("qid", "topic").agg((F.max("score") + F.coalesce(F.sum(F.col("w") * F.col("more")), F.lit(0.0))).alias("score"))
    groups = raised.select("qid", F.col("topic").alias("grp"), F.round("score", 12).alias("score"))
    pool = coverage.group_channel(groups, v.select(F.col("label").alias("grp"), "uid"), _search(spark, sf_dir, 100).select("qid", "uid", "score"))
    return channels.fold_first(pool.withColumn("owner", F.floor(F.col("uid") / OWNER)), "owner", 20).select("qid", "owner", long("rank"))


@query(f"""WITH {mean_sql('tc', 'label')}, a AS (SELECT q.vec_id AS qid, u.vec_id AS rel, list_dot_product(q.embedding::DOUBLE[], u.embedding::DOUBLE[]) AS one, list_dot_product(q.embedding::DOUBLE[], tc.vec) AS topic FROM embeddings q JOIN embeddings u ON q.vec_id % 50 = 0 AND u.vec_id % 2 = 0 JOIN tc ON tc.grp = u.label),
b AS (SELECT qid, rel, greatest(one, (one + topic) / 2) AS score FROM a), e AS (SELECT qid, uid, -round(score, 12) AS s, rel, pos FROM b, LATERAL (SELECT unnest([rel + 1, rel]) AS uid, unnest([0, 1]) AS pos)),
f AS (SELECT qid, uid, min(struct_pack(s := s, rel := rel, pos := pos)) AS spot FROM e WHERE uid IN (SELECT vec_id FROM embeddings) GROUP BY ALL) SELECT * FROM (SELECT qid, uid, spot.rel AS via, row_number() OVER (PARTITION BY qid ORDER BY spot, uid) AS rank FROM f) WHERE rank <= 20""")
def k13_relation_channel(spark, sf_dir):
    """Relations between neighbouring units by the better of two renderings (plain, and half of its topic), then their units in order."""
    v = _vectors(spark, sf_dir)
    rels = v.where("uid % 2 = 0").join(F.broadcast(similarity.centroids(v, "label")), "label")  # a centroid for each label
    half = F.zip_with("vec", "centroid", lambda a, b: (a.cast("double") + b) / 2)
    scored = [similarity.score_all(_asked(spark, sf_dir), rels.select("uid", one.alias("vec")), 40).withColumnRenamed("uid", "rel") for one in (F.col("vec"), half)]
    sources = rels.select(F.col("uid").alias("rel"), F.posexplode(F.array(F.col("uid") + 1, F.col("uid"))).alias("pos", "uid")).join(v.select("uid"), "uid", "left_semi")
    return channels.relation_channel(scored, sources, 20).select("qid", "uid", "via", long("rank"))


PHRASE_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"""WITH q AS (SELECT doc_id AS qid, ' ' || array_to_string({PHRASE_WORDS.format('text')}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id AS key, array_to_string(list_slice({PHRASE_WORDS.format('text')}, a, b), ' ') AS phrase FROM benchmark, (VALUES (1, 3), (2, 5), (4, 6)) r(a, b)),
m AS (SELECT qid, key, phrase, row_number() OVER (PARTITION BY qid, key ORDER BY length(phrase) DESC, phrase) AS r FROM q JOIN p ON phrase <> '' AND contains(t, ' ' || phrase || ' '))
SELECT qid, key, phrase, row_number() OVER (PARTITION BY qid ORDER BY length(phrase) DESC, phrase, key) AS rank FROM m WHERE r = 1""")
def j7_entity_channel(spark, sf_dir):
    """Entities (benchmark items, known by three of their phrases) that a document names, the longest phrase of each, in order of length."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    q = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("qid"), words("text").alias("words"))
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), words("text").alias("w"))
    p = item.select("key", F.explode(F.array(F.slice("w", 1, 3), F.slice("w", 2, 4), F.slice("w", 4, 3))).alias("words")).distinct()
    m = channels.phrase_matches(q, p)
    return m.withColumn("rank", channels.entity_order(m).cast("long"))


@query(f"""WITH {sim_sql('s', depth=100)}, v AS (SELECT qid, uid // 20 AS grp, count(*) AS hits, min(rank) AS first FROM s GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, first, grp) AS place FROM v),
m AS (SELECT w.qid, w.grp, w.place, w.hits, u.vec_id AS uid, row_number() OVER (PARTITION BY w.qid, w.grp ORDER BY list_dot_product(q.embedding::DOUBLE[], u.embedding::DOUBLE[]) DESC, u.vec_id) AS nth FROM w JOIN embeddings u ON u.vec_id // 20 = w.grp JOIN embeddings q ON q.vec_id = w.qid WHERE place <= 20),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, nth) AS test FROM m WHERE nth <= 5), y AS (SELECT DISTINCT doc_id AS uid FROM labels WHERE quality = 0),
d AS (SELECT qid, grp, place, hits, count(*) AS tested, count(y.uid) AS accepted FROM t LEFT JOIN y USING (uid) WHERE test <= 20 GROUP BY ALL),
b AS (SELECT *, sum((accepted = 0)::INT) OVER (PARTITION BY qid ORDER BY place ROWS 2 PRECEDING) = 3 AS barren FROM d), e AS (SELECT *, coalesce(max(barren::INT) OVER (PARTITION BY qid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM b)
SELECT qid, grp, place, hits, tested, accepted FROM e WHERE ended = 0""")
def k16_lazy_community_walk(spark, sf_dir):
    """Containers by where the hits land; five units of each are tested against a table of verdicts, until three in a row yield none."""
    v = _vectors(spark, sf_dir).select("uid", "vec", F.floor(F.col("uid") / CONTAINER).alias("grp"))
    hits = _ranking(spark, sf_dir).select("qid", F.col("container").alias("grp"), "rank")
    asked = _asked(spark, sf_dir).withColumnRenamed("vec", "qvec")
    members = hits.select("qid", "grp").distinct().join(v, "grp").join(asked, "qid").select("qid", "grp", "uid", vectors.dot(F.col("vec"), F.col("qvec")).alias("score"))
    yes = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("uid")).distinct()
    return channels.lazy_walk(hits, members, yes).select("qid", "grp", long("place"), "hits", "tested", "accepted")


@query(r"""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM t), k AS (SELECT *, least(n, 2500 - (upto - n)) AS taken FROM r WHERE upto - n < 2500),
o AS (SELECT k.*, row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'system', CASE WHEN role <> 'system' THEN turn END, rank) AS shown FROM k)
SELECT conv_id, count(*) AS units, sum(taken)::BIGINT AS chars, count(*) FILTER (upto > 2500) AS truncated, md5(string_agg('[' || role || '] ' || substr(c.text, 1, taken::INT), chr(10) || chr(10) ORDER BY shown)) AS context_md5 FROM o JOIN conversations c USING (conv_id, turn, role) GROUP BY 1""")
def k19_rendered_context(spark, sf_dir):
    """Longest turns first into 2,500 characters, shown with system turns first and the others in order of time, as one text."""
    t = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("tokens", F.length("text"))
    t = t.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("tokens"), "turn")))
    kept = context.budget_take(t, 2500, ["conv_id"], ["rank"]).withColumn("date", F.when(F.col("role") != "system", F.col("turn")))
    shown = channels.display_order(kept, "conv_id", "date", F.col("conv_id"), F.col("turn"))
    line = F.concat(F.lit("["), "role", F.lit("] "), F.substring("text", F.lit(1), F.col("taken").cast("int")))
    parts = shown.groupBy("conv_id").agg(
        F.count("*").alias("units"), F.sum("taken").cast("long").alias("chars"), F.count_if("truncated").alias("truncated"), F.sort_array(F.collect_list(F.struct("shown", line.alias("line")))).alias("lines")
    )
    return parts.select("conv_id", "units", "chars", "truncated", F.md5(F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")).alias("context_md5"))


@query(r"""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, md5(string_agg(role || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY turn)) AS context_md5, count(*) AS turns FROM t WHERE rank <= 5 GROUP BY 1""")
def h3_chronological_context(spark, sf_dir):
    """The best five turns of a conversation as single lines, in order of time."""
    t = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    top = t.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn"))).where("rank <= 5")
    line = F.concat("role", F.lit(": "), T.collapse(F.col("text")))
    lines = top.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"), F.count("*").alias("turns"))
    return lines.select("conv_id", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("context_md5"), "turns")


QUERIES, ORACLES = query.queries, query.oracles
