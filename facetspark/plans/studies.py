"""Queries over link sets, communities, shard plans, event orders and arms."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from facetspark.functions import dates, text as T
from facetspark.operators import arms, chains, metrics, order, placebo
from facetspark.plans.common import Register, table
from facetspark.plans.retrieval import _search, _vectors, sim_sql
from facetspark.sources.scratch import cut

query = Register()
long = lambda c: F.col(c).cast("long").alias(c)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS topic, l_partkey AS community FROM lineitem)
SELECT 'topic' AS side, topic AS id, count(*) AS degree, 0::BIGINT AS coincident, 0::BIGINT AS repeated FROM l GROUP BY 2 UNION ALL SELECT 'community', community, count(*), 0, 0 FROM l GROUP BY 2""")
def l19_placebo_links(spark, sf_dir):
    """Links of orders and parts with the parts shuffled: every end keeps its degree, and no link is a given one or stands twice."""
    given = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("topic"), F.col("l_partkey").alias("community")).distinct()
    made = placebo.placebo_links(given.withColumn("w", F.lit(1.0)), distinct=True)
    degrees = lambda c: made.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("degree"), *[F.sum(F.col(x).cast("int")).alias(x) for x in ("coincident", "repeated")])
    side = lambda c: degrees(c).select(F.lit(c).alias("side"), "id", "degree", "coincident", "repeated")
    return side("topic").unionByName(side("community"))


@query("""WITH RECURSIVE c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY o_custkey) AS i, sum(n) OVER (ORDER BY o_custkey) AS upto FROM c),
b AS (SELECT 0::BIGINT AS shard, 0::HUGEINT AS u, 0::BIGINT AS last UNION ALL SELECT shard + 1, e.upto, e.i FROM b, LATERAL (SELECT min(i) AS i, min(upto) AS upto FROM o WHERE o.upto >= b.u + 500) e WHERE e.i IS NOT NULL)
SELECT o_custkey, n, (SELECT max(shard) FROM b WHERE b.last < o.i) AS shard FROM o""")
def k27_shard_plan(spark, sf_dir):
    """Customers in order, put together until a shard holds 500 orders."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return order.shard_plan(counts, ["o_custkey"], "n", 500).select("o_custkey", "n", long("shard"))


EVENTS_SQL = r"""refs AS (SELECT conv_id AS qid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ref, text FROM conversations WHERE role = 'user' AND text IS NOT NULL),
cands AS (SELECT conv_id AS qid, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS cand, text FROM conversations WHERE role <> 'user' AND text IS NOT NULL),
rw AS (SELECT DISTINCT qid, ref, unnest(regexp_extract_all(lower(text), '\p{L}{6,}')) AS w FROM refs), cw AS (SELECT DISTINCT qid, cand, unnest(regexp_extract_all(lower(text), '\p{L}{6,}')) AS w FROM cands),
yes AS (SELECT DISTINCT qid, cand, ref FROM rw JOIN cw USING (qid, w)),
g AS (SELECT qid, -1::BIGINT AS cand, []::BIGINT[] AS used, NULL::BIGINT AS ref FROM (SELECT DISTINCT qid FROM yes)
UNION ALL SELECT g.qid, g.cand + 1, CASE WHEN m.ref IS NULL THEN used ELSE list_append(used, m.ref) END, m.ref FROM g JOIN (SELECT qid, max(cand) AS most FROM cands GROUP BY 1) z ON z.qid = g.qid AND g.cand < z.most, LATERAL (SELECT min(y.ref) AS ref FROM yes y WHERE y.qid = g.qid AND y.cand = g.cand + 1 AND NOT list_contains(g.used, y.ref)) m),
matched AS (SELECT qid, cand, ref FROM g WHERE ref IS NOT NULL)"""


def _events(spark, sf_dir):
    """Questions and answers of a conversation as reference and candidate events (candidates latest first), and those that share a word of six letters."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("qid"), "turn", "role", "text")

    def listed(rows, out, sign):
        nth = F.expr(f"row_number() OVER (PARTITION BY qid ORDER BY {sign} turn) - 1")
        return rows.select("qid", nth.cast("long").alias(out), "text")

    refs, cands = listed(c.where("role = 'user'"), "ref", ""), listed(c.where("role <> 'user'"), "cand", "-")
    words = lambda df, at: df.select("qid", at, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{6,})"), 1))).alias("w"))
    yes = words(refs, "ref").join(words(cands, "cand"), ["qid", "w"]).select("qid", "cand", "ref").distinct()
    return refs, cands, yes


@query(f"WITH RECURSIVE {EVENTS_SQL} SELECT qid, cand, ref FROM matched")
def e31_first_unused_alignment(spark, sf_dir):
    """Answers matched one after the other with the first question not yet taken that shares a long word."""
    return metrics.first_unused(_events(spark, sf_dir)[2])


@query(f"""WITH RECURSIVE {EVENTS_SQL}, al AS (SELECT c.qid, list(coalesce(r.text, c.text) ORDER BY c.cand) AS c FROM cands c LEFT JOIN matched m USING (qid, cand) LEFT JOIN refs r ON r.qid = m.qid AND r.ref = m.ref GROUP BY 1),
rl AS (SELECT qid, list(text ORDER BY ref) AS r FROM refs GROUP BY 1), b AS (SELECT qid, r, coalesce(c, []) AS c FROM rl LEFT JOIN al USING (qid)),
n AS (SELECT qid, r, c, len(list_distinct(list_intersect(r, c))) AS tp, len(list_filter(c, lambda x: NOT list_contains(r, x))) AS fp, len(list_filter(r, lambda x: NOT list_contains(c, x))) AS fn FROM b),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM n),
u AS (SELECT qid, r, c, len(list_distinct(list_concat(r, c))) + 1 AS tie, unnest(list_distinct(list_concat(r, c))) AS t FROM p),
k AS (SELECT qid, t, CASE WHEN list_contains(r, t) THEN len(r) + 1 - list_position(list_reverse(r), t) ELSE tie END AS x, CASE WHEN list_contains(c, t) THEN len(c) + 1 - list_position(list_reverse(c), t) ELSE tie END AS y FROM u),
s AS (SELECT a.qid, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(abs(sign(a.x - b.x))) AS nx, sum(abs(sign(a.y - b.y))) AS ny FROM k a JOIN k b ON a.qid = b.qid AND a.t < b.t GROUP BY 1),
f AS (SELECT p.*, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, CASE WHEN nx > 0 AND ny > 0 THEN (s / sqrt(nx * ny) + 1) / 2 END AS tau_norm FROM p LEFT JOIN s USING (qid))
SELECT qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(tau_norm, 6) AS tau_norm, round(tau_norm * f1, 6) AS final_score FROM f""")
def e30_event_order(spark, sf_dir):
    """Precision, recall, f1 and the order of aligned answers against the questions."""
    refs, cands, yes = _events(spark, sf_dir)
    out = metrics.event_order(refs, cands, metrics.first_unused(yes))
    return out.select("qid", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "tau_norm", "final_score")])


#: How many of the first hits open their topics and communities, by link set.
OVERLAY_SEEDS = {"R0": 3, "R2": 5, "R3": 4, "P0": 2}
PLANNERS = ("llm", "rules", "oracle")
ARM_CHANNELS = {a: {"cheap_turn": ("dense", "bm25"), "cheap_sentence": ("sentence", "bm25")}.get(a.kind) or [c for c in arms.CHANNELS if a.graph or c not in arms.GRAPH] for a in arms.ARMS}
ARM_VALUES = ", ".join(f"('{a.name}', '{a.planner}', {a.speaker_rule}, {a.kind == 'lazy'}, {a.kind.startswith('cheap')}, '{c}', '{a.overlay if c in arms.LINKED else ''}')" for a, cs in ARM_CHANNELS.items() for c in cs)
WEIGHT_VALUES = ", ".join(f"('{s}', '{c}', {row[i]}, {row[-1]})" for s, row in {**arms.SHAPE_WEIGHTS, "static": (1, 1, 1, 1, 1, 1, 3)}.items() for i, c in enumerate(arms.CHANNELS))
ARMS_SQL = f"""{sim_sql('s', depth=100)}, {sim_sql('h', 32)}, x AS (SELECT s.*, e.label, s.uid // 20 AS grp FROM s JOIN embeddings e ON e.vec_id = s.uid), ov(overlay, n) AS (VALUES {', '.join(f"('{o}', {n})" for o, n in OVERLAY_SEEDS.items())}),
raw AS (SELECT 'dense' AS channel, '' AS overlay, qid, uid, rank AS o FROM s UNION ALL SELECT 'bm25', '', qid, uid, rank FROM h UNION ALL SELECT 'sentence', '', qid, uid, rank FROM s WHERE uid % 2 = 0
UNION ALL SELECT 'topic', overlay, qid, uid, rank FROM x, ov WHERE EXISTS (SELECT 1 FROM x y WHERE y.qid = x.qid AND y.label = x.label AND y.rank <= ov.n) UNION ALL SELECT 'community', overlay, qid, uid, rank FROM x, ov WHERE EXISTS (SELECT 1 FROM x y WHERE y.qid = x.qid AND y.grp = x.grp AND y.rank <= ov.n)
UNION ALL SELECT 'relation', '', qid, uid, rank FROM x WHERE EXISTS (SELECT 1 FROM x y WHERE y.qid = x.qid AND abs(y.uid - x.uid) = 1 AND y.rank <= 5) UNION ALL SELECT 'entity', '', qid, uid, rank FROM x WHERE uid % 4 = qid % 4),
hits AS (SELECT channel, overlay, qid, uid, row_number() OVER (PARTITION BY channel, overlay, qid ORDER BY o) AS rank FROM raw), q AS (SELECT DISTINCT qid FROM s),
sh AS (SELECT qid, planner, shape FROM q, (VALUES {', '.join(f"('{p}', {i})" for i, p in enumerate(PLANNERS))}) p(planner, k) JOIN (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(arms.SHAPE_WEIGHTS))}) z(i, shape) ON z.i = (qid // 50 + k) % 8 UNION ALL SELECT qid, 'static', 'static' FROM q),
w AS (SELECT arm, qid, shape, CASE WHEN cheap THEN 0 ELSE max(depth) OVER (PARTITION BY arm, qid) END AS depth, rule, lazy, channel, overlay, CASE WHEN cheap THEN 1 ELSE weight END AS weight FROM (VALUES {ARM_VALUES}) a(arm, planner, rule, lazy, cheap, channel, overlay) JOIN sh USING (planner) LEFT JOIN (VALUES {WEIGHT_VALUES}) v(shape, channel, weight, depth) USING (shape, channel)),
f AS (SELECT arm, qid, uid, rule, lazy, sum(weight / (60 + rank)) AS score FROM hits JOIN w USING (qid, channel, overlay) WHERE weight > 0 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY arm, qid ORDER BY round(score, 12) DESC, uid) AS o FROM f),
acc AS (SELECT qid, uid, rank AS o FROM s JOIN (SELECT DISTINCT doc_id AS uid FROM labels WHERE quality = 1) USING (uid) WHERE rank <= 20),
e AS (SELECT arm, qid, uid, rule, 1 AS stage, o FROM b WHERE o <= 100 UNION ALL SELECT arm, qid, uid, rule, 0, o FROM acc JOIN (SELECT DISTINCT arm, qid, rule FROM w WHERE lazy) USING (qid)),
g AS (SELECT arm, qid, uid, min(stage * 1000 + o) AS o FROM e WHERE NOT (rule AND uid IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)) GROUP BY ALL), d AS (SELECT DISTINCT arm, qid, shape, depth FROM w WHERE weight > 0)
SELECT arm, qid, any_value(shape) AS shape, any_value(depth) AS depth, count(*) AS n, md5(string_agg(uid::VARCHAR, ',' ORDER BY o)) AS ranking_md5 FROM g JOIN d USING (arm, qid) GROUP BY 1, 2"""


@query(f"WITH {ARMS_SQL}")
def q17_arms(spark, sf_dir):
    """Thirteen arms over seven channels that are scored once, with weights by each planner's shape of a question.

    Planners' shapes, accepted and quarantined units are tables (shapes by question number, labels). The ranking of half vectors takes the
    place of the lexical channel, even units that of sentences; the others are drawn from the dense ranking's topics, containers and neighbours.
    """
    dense, half = _search(spark, sf_dir, 100).select("qid", "uid", "rank"), _search(spark, sf_dir, dims=32).select("qid", "uid", "rank")
    x = dense.join(_vectors(spark, sf_dir).select("uid", "label"), "uid").withColumn("grp", F.floor(F.col("uid") / 20))
    questions = dense.select("qid").distinct()
    shape = F.get(F.array(*[F.lit(s) for s in arms.SHAPE_WEIGHTS]), ((F.floor(F.col("qid") / 50) + F.col("k")) % 8).cast("int"))
    shapes = questions.select("qid", F.posexplode(F.array(*[F.lit(p) for p in PLANNERS])).alias("k", "planner")).select("qid", "planner", shape.alias("shape"))
    weights = cut(arms.arm_weights(shapes))
    wanted = arms.needed(weights)
    seeds = spark.createDataFrame(list(OVERLAY_SEEDS.items()), "overlay string, n int")

    def opened(key):  # what the first hits of each link set open
        first = x.groupBy("qid", key).agg(F.min("rank").alias("first"))
        return x.join(first, ["qid", key]).join(F.broadcast(seeds), F.col("first") <= F.col("n")).select("qid", "overlay", "uid", "rank")

    near = x.where("rank <= 5").select("qid", F.explode(F.array(F.col("uid") - 1, F.col("uid") + 1)).alias("uid")).distinct()
    found = {
        "dense": dense, "bm25": half, "sentence": dense.where("uid % 2 = 0"), "topic": opened("label"), "community": opened("grp"),
        "relation": x.join(near, ["qid", "uid"], "left_semi"), "entity": x.where("uid % 4 = qid % 4"),
    }
    raw = None
    for channel, rows in found.items():
        overlay = F.col("overlay") if "overlay" in rows.columns else F.lit("")
        part = rows.select("qid", F.lit(channel).alias("channel"), overlay.alias("overlay"), "uid", "rank").join(wanted, ["qid", "channel", "overlay"], "left_semi")
        raw = part if raw is None else raw.unionByName(part)
    hits = raw.withColumn("rank", F.row_number().over(W.partitionBy("channel", "overlay", "qid").orderBy("rank")))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "uid")
    accepted = dense.where("rank <= 20").join(labels.where("quality = 1"), "uid", "left_semi").select("qid", "uid", "rank")
    out = dense.unionByName(half).join(labels.where("toxic = 1"), "uid", "left_semi").select("qid", "uid")
    ranked = arms.run_arms(weights, hits, out, accepted)
    listed = ranked.groupBy("arm", "qid").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", F.col("uid").cast("string").alias("uid")))).alias("l"))
    told = weights.select("arm", "qid", "shape", "depth").distinct()
    return listed.join(told, ["arm", "qid"]).select("arm", "qid", "shape", "depth", "n", F.md5(F.array_join(F.transform("l", lambda r: r["uid"]), ",")).alias("ranking_md5"))


@query("""WITH RECURSIVE f AS (SELECT l_orderkey, l_linenumber AS variant, min(CASE WHEN l_quantity > 40 THEN l_partkey END) AS data, min(CASE WHEN l_linenumber > 1 AND l_quantity <= 40 THEN l_linenumber - 1 WHEN l_quantity > 30 AND l_quantity <= 40 THEN 2 END) AS reused_from FROM lineitem GROUP BY ALL),
c AS (SELECT l_orderkey, variant, variant AS place, data, reused_from AS nxt, 0 AS steps FROM f UNION ALL SELECT c.l_orderkey, c.variant, c.nxt, f.data, f.reused_from, steps + 1 FROM c LEFT JOIN f ON f.l_orderkey = c.l_orderkey AND f.variant = c.nxt WHERE c.data IS NULL AND c.nxt IS NOT NULL AND steps < 20),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, variant ORDER BY steps DESC) AS r FROM c)
SELECT l_orderkey, variant, CASE WHEN data IS NOT NULL THEN place END::VARCHAR AS source, data::VARCHAR AS data, CASE WHEN data IS NOT NULL THEN CASE WHEN steps = 0 THEN 'own' ELSE 'reused' END WHEN steps >= 20 THEN 'cycle' ELSE 'missing' END AS status FROM l WHERE r = 1""")
def h28_reuse_chains(spark, sf_dir):
    """Lines of an order that stand for the one before, through chains of any length, with those that end nowhere and those that run in a circle."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    to = F.when((n > 1) & (q <= 40), n - 1).when((q > 30) & (q <= 40), 2)
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", n.alias("variant")).agg(F.min(F.when(q > 40, F.col("l_partkey"))).alias("data"), F.min(to).alias("reused_from"))
    return chains.resolve_reuse(files, ["l_orderkey"]).select("l_orderkey", "variant", F.col("source").cast("string").alias("source"), F.col("data").cast("string").alias("data"), "status")


@query(r"""WITH t AS (SELECT event_id, ts::DATE AS d FROM events), s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'on ' || day(d) || 'th of ' || monthname(d) || ', ' || year(d) || ' at noon' WHEN 1 THEN 'seen ' || substr(monthname(d), 1, 3) || '. ' || day(d) || ', ' || year(d) WHEN 2 THEN strftime(d, '%Y/%m/%d') || ' 10:00'
WHEN 3 THEN 'since ' || monthname(d) || ' ' || year(d) WHEN 4 THEN 'in ' || year(d) || ' they met' ELSE strftime(d, '%m/%d/%Y') END AS said, CASE event_id % 6 WHEN 3 THEN date_trunc('month', d)::DATE WHEN 4 THEN date_trunc('year', d)::DATE ELSE d END AS found FROM t)
SELECT event_id, said, found::VARCHAR AS found FROM s""")
def f9_dates_in_running_text(spark, sf_dir):
    """dates written in six ways, read back; what a text doesn't say is the first."""
    d = F.to_date("ts")
    e = table(spark, sf_dir, "events").select("event_id", d.alias("d"), (F.col("event_id") % 6).alias("k"), F.date_format(d, "MMMM").alias("month"), F.date_format(d, "MMM").alias("mon"), F.dayofmonth(d).alias("day"), F.year(d).alias("year"))
    forms = ["on %dth of %s, %d at noon", "seen %s. %d, %d", "%s 10:00", "since %s %d", "in %d they met", "%s"]
    args = [("day", "month", "year"), ("mon", "day", "year"), (F.date_format("d", "yyyy/MM/dd"),), ("month", "year"), ("year",), (F.date_format("d", "MM/dd/yyyy"),)]
    said = F.lit(None).cast("string")
    for k, (form, cols) in enumerate(zip(forms, args)):
        said = F.when(F.col("k") == k, F.format_string(form, *cols)).otherwise(said)
    return e.withColumn("said", said).select("event_id", "said", dates.date_with_year(F.col("said")).cast("string").alias("found"))


@query(r"""WITH t AS (SELECT event_id, '{"value": "' || event_type || '\d\n' || CASE WHEN event_id % 3 = 0 THEN '\\' WHEN event_id % 3 = 1 THEN '\x\' ELSE '\t\"' END || '"}' AS reply FROM events)
SELECT event_id, replace(replace(reply, '\d', '\\d'), '\x', '\\x') AS repaired FROM t""")
def f23_repaired_escapes(spark, sf_dir):
    """illegal escapes in JSON replies made literal, legal ones kept."""
    tail = F.when(F.col("event_id") % 3 == 0, F.lit("\\\\")).when(F.col("event_id") % 3 == 1, F.lit("\\x\\")).otherwise(F.lit('\\t\\"'))
    reply = F.concat(F.lit('{"value": "'), "event_type", F.lit("\\d\\n"), tail, F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", T.repair_json_escapes(reply).alias("repaired"))


QUERIES, ORACLES = query.queries, query.oracles
