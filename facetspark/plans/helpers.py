"""Queries over the smaller operators of shaping, counting and choosing."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from facetspark.functions import text as T
from facetspark.operators import context, coverage, gate, reports, similarity, units
from facetspark.plans.common import Register, table
from facetspark.plans.reports import EVIDENCE_SQL, PACKED_SQL, RECORDS_SQL, _evidence, _records, rounded
from facetspark.plans.retrieval import _search, _vectors, sim_sql

query = Register()


@query("""WITH s AS (SELECT u.vec_id AS uid, CASE WHEN a.vec_id < 3 THEN 'one' ELSE 'two' END AS key, a.vec_id AS anchor, list_dot_product(a.embedding::DOUBLE[], u.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings u ON a.vec_id < 6),
r AS (SELECT *, row_number() OVER (PARTITION BY uid, key ORDER BY score DESC, anchor) AS r FROM s), c AS (SELECT uid, key, avg(score) AS score FROM r WHERE r <= 2 GROUP BY ALL)
SELECT uid, round(max(score) FILTER (key = 'one'), 6) AS one, round(max(score) FILTER (key = 'two'), 6) AS two, round(0.25 + 2 * max(score) FILTER (key = 'one') - max(score) FILTER (key = 'two'), 6) AS gate FROM c GROUP BY 1""")
def p1_gate_components(spark, sf_dir):
    """The mean of a unit's two best anchors in two sets, as a feature matrix, and a linear gate over it."""
    v = _vectors(spark, sf_dir)
    s = similarity.score_all(v.where("uid < 6").select(F.col("uid").alias("qid"), "vec"), v)
    c = gate.component_scores(s.select("uid", F.when(F.col("qid") < 3, "one").otherwise("two").alias("key"), F.col("qid").alias("anchor"), "score"), 2)
    x = c.groupBy("uid").pivot("key", ["one", "two"]).agg(F.first("score"))
    return gate.apply_gate(x, ["one", "two"], [2.0, -1.0], 0.25).select("uid", *rounded("one", "two", "gate"))


@query(f"WITH {sim_sql('s', depth=100)} SELECT qid, uid // 4 AS owner, round(max(score), 6) AS score FROM s GROUP BY ALL")
def h51_owner_best(spark, sf_dir):
    """The best score of an owner's units."""
    r = _search(spark, sf_dir, 100).withColumn("owner", F.floor(F.col("uid") / 4))
    return similarity.max_fold(r, "owner").select("qid", "owner", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT c.conv_id, list(turn) FILTER (role = 'user' AND turn > 0) AS ev FROM conversations c GROUP BY 1), p AS (SELECT conv_id, coalesce(len(ev), 0) = 0 AS is_null, coalesce(list_has_any(ev, [4, 9]), false) AS refused FROM e)
SELECT is_null, refused, NOT is_null AND NOT refused AS in_population, count(*) AS n FROM p GROUP BY ALL""")
def p13_population_predicates(spark, sf_dir):
    """Questions without evidence, those whose evidence a run refused, and the population that is left."""
    turns = F.collect_list(F.when((F.col("role") == "user") & (F.col("turn") > 0), F.col("turn")))
    e = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("ev"))
    p = e.select((F.size("ev") == 0).alias("is_null"), F.arrays_overlap("ev", F.array(F.lit(4), F.lit(9)).cast("array<bigint>")).alias("refused"))
    return p.groupBy("is_null", "refused", (~F.col("is_null") & ~F.col("refused")).alias("in_population")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, greatest(0, least(lo + n, 1200) - lo)::BIGINT AS chars FROM s WHERE least(lo + n, 1200) > lo""")
def h47_clipped_spans(spark, sf_dir):
    """How many characters of each turn a context that is cut at 1,200 shows."""
    s = units.joined_turns(table(spark, sf_dir, "conversations"))
    return s.select("conv_id", "turn", coverage.clipped(F.col("start"), F.col("end"), 1200).cast("long").alias("chars")).where("chars > 0")


@query(r"""WITH s AS (SELECT conv_id, turn, length(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS n FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, coalesce(sum(n + 1) OVER w, 0)::BIGINT AS lo, coalesce(sum(n + 1) OVER w, 0)::BIGINT + n AS hi FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def h55_normalised_bounds(spark, sf_dir):
    """Where normalised pieces lie in the text that joins them."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(T.collapse(F.col("text"))).alias("text"))
    s = units.joined_turns(t, gap=1)
    return s.select("conv_id", "turn", F.col("start").alias("lo"), F.col("end").alias("hi"))


@query(f"""WITH {RECORDS_SQL}, m AS (SELECT corpus, arm, round(avg(coalesce(correct, false)::INT), 9) AS m FROM rc GROUP BY ALL) SELECT corpus, arg_max(arm, (m, arm = 'arm1', -ascii(substr(arm, 4)))) AS chosen FROM m GROUP BY 1""")
def h17_variant_choice(spark, sf_dir):
    """The variant with the higher mean; the shipped one keeps a tie."""
    m = _records(spark, sf_dir).groupBy("corpus", "arm").agg(F.round(reports.share(F.coalesce("correct", F.lit(False))), 9).alias("m"))
    return reports.chosen_variant(m, "corpus", "arm", "m", "arm1").select("corpus", "chosen")


@query(f"""WITH {RECORDS_SQL}, s AS (SELECT qtype, count(*) FILTER (NOT missing) AS have, count(*) AS want FROM rc GROUP BY 1) SELECT qtype, CASE WHEN have = 0 THEN 'none' WHEN have * 5 < want * 2 THEN 'partial' ELSE 'run' END AS status FROM s""")
def h30_export_status(spark, sf_dir):
    """Whether an export is there, in part, or not at all, by what it covers."""
    s = _records(spark, sf_dir).groupBy("qtype").agg(F.count_if(~F.col("missing")).alias("have"), F.count("*").alias("want"))
    return s.select("qtype", reports.completeness(F.col("have"), F.col("want"), 0.4).alias("status"))


@query("""WITH k AS (SELECT l_orderkey % 9 + 1 AS k, l_returnflag AS arm, avg(l_extendedprice * (l_orderkey % 9 + 1)) AS v FROM lineitem GROUP BY ALL) SELECT arm, count(*) AS points, round(regr_slope(ln(v), ln(k)), 6) AS exponent FROM k GROUP BY 1""")
def h63_decay_exponent(spark, sf_dir):
    """Values regrouped by k, and the slope of their logarithms."""
    k = F.col("l_orderkey") % 9 + 1
    g = table(spark, sf_dir, "lineitem").groupBy(k.alias("k"), F.col("l_returnflag").alias("arm")).agg(F.avg(F.col("l_extendedprice") * k).alias("v"))
    return g.groupBy("arm").agg(F.count("*").alias("points"), F.round(F.regr_slope(F.log("v"), F.log("k")), 6).alias("exponent"))


@query(r"""WITH w AS (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}{4,}'))) AS word FROM documents), n AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM n),
k AS (SELECT lang, string_agg(word, ',' ORDER BY r) AS keywords FROM r WHERE r <= 5 GROUP BY 1), e AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS size FROM documents)
SELECT e.lang, any_value(size) AS size, any_value(keywords) AS keywords, md5(string_agg(substr(text, 1, 160), '|' ORDER BY r)) AS excerpts_md5 FROM e LEFT JOIN k ON k.lang IS NOT DISTINCT FROM e.lang WHERE r <= 3 GROUP BY 1""")
def a11_group_payloads(spark, sf_dir):
    """What a group is named from: its size, the words that most of its members have, and the beginnings of three of them."""
    d = table(spark, sf_dir, "documents")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)))
    n = d.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return reports.group_payloads(d, n, "lang", "doc_id", "text", keywords=5, excerpts=3, chars=160).select("lang", "size", "keywords", F.md5("excerpts").alias("excerpts_md5"))


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE text IS NOT NULL),
c AS (SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (a <= 3) AS x, string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (b <= 3) AS y FROM t GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (x <> y) AS differ FROM c""")
def a27_contexts_that_differ(spark, sf_dir):
    """How many questions two arms, the longest and the first turns, give different contexts."""
    t = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    w = W.partitionBy("conv_id")
    t = t.withColumn("a", F.row_number().over(w.orderBy(F.desc(F.length("text")), "turn"))).withColumn("b", F.row_number().over(w.orderBy("turn")))
    turns = lambda rank: F.sort_array(F.collect_list(F.when(F.col(rank) <= 3, F.col("turn"))))
    c = t.groupBy("conv_id").agg(turns("a").alias("x"), turns("b").alias("y"))
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("x") != F.col("y")).alias("differ"))


@query(f"""WITH {sim_sql('s', depth=100)}, {EVIDENCE_SQL}, j AS (SELECT e.qid, bool_and(coalesce(rank, 999) <= 20) AS joint FROM e LEFT JOIN s USING (qid, uid) GROUP BY 1)
SELECT label AS kind, count(*) AS n, round(avg(joint::INT), 6) AS joint_hit FROM j JOIN embeddings ON vec_id = qid GROUP BY 1""")
def a45_joint_hit_by_type(spark, sf_dir):
    """The share of questions of each type all of whose evidence is among the first twenty."""
    j = coverage.joint_hit(_evidence(spark, sf_dir), _search(spark, sf_dir, 100), 20)
    kinds = _vectors(spark, sf_dir).select(F.col("uid").alias("qid"), F.col("label").alias("kind"))
    return j.join(kinds, "qid").groupBy("kind").agg(F.count("*").alias("n"), F.round(reports.share(F.col("joint")), 6).alias("joint_hit"))


@query(r"""SELECT role AS kind, count(*) AS records, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS words, count(DISTINCT conv_id) AS groups, count(*) FILTER (length(text) > 1000) AS long_records FROM conversations GROUP BY 1""")
def s23_dataset_counts(spark, sf_dir):
    """What a dataset's manifest says of each type: records, words, groups and long records."""
    t = table(spark, sf_dir, "conversations")
    return t.groupBy(F.col("role").alias("kind")).agg(
        F.count("*").alias("records"), F.sum(F.size(T.words(F.col("text")))).cast("long").alias("words"), F.countDistinct("conv_id").alias("groups"), F.count_if(F.length("text") > 1000).alias("long_records"))


@query(f"""WITH {PACKED_SQL}, h AS (SELECT qid, turn FROM k), e AS (SELECT DISTINCT conv_id AS qid, turn // 4 AS session FROM conversations WHERE role = 'user'), g AS (SELECT DISTINCT qid, turn // 4 AS session FROM h)
SELECT e.qid, bool_and(g.session IS NOT NULL) AS session_joint, count(*) AS sessions FROM e LEFT JOIN g USING (qid, session) GROUP BY 1""")
def e20_session_joint_recall(spark, sf_dir):
    """Whether every stretch of four turns with evidence has a turn in the context."""
    t = table(spark, sf_dir, "conversations")
    u = t.where("text IS NOT NULL").select(F.col("conv_id").alias("qid"), "turn", F.length("text").cast("long").alias("tokens"))
    u = u.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("tokens"), "turn"))).where("rank <= 5")
    have = context.budget_take(u, 2000, ["qid"], ["rank"]).select("qid", F.floor(F.col("turn") / 4).alias("session")).distinct().withColumn("got", F.lit(True))
    need = t.where("role = 'user'").select(F.col("conv_id").alias("qid"), F.floor(F.col("turn") / 4).alias("session")).distinct()
    return need.join(have, ["qid", "session"], "left").groupBy("qid").agg(F.bool_and(F.col("got").isNotNull()).alias("session_joint"), F.count("*").alias("sessions"))


QUERIES, ORACLES = query.queries, query.oracles
