"""Queries over answers, scores, failure buckets, test records, samples and graphs."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from facetspark.functions import dates, text as T
from facetspark.operators import communities, context, coverage, gate, graph, reports, select, similarity, stats
from facetspark.plans.common import Register, table
from facetspark.plans.retrieval import _search, _vectors, contained, sim_sql
from facetspark.plans.texts import EVERY_PHRASE_SQL, NORM, PHRASES_SQL, PRUNED_SQL, _content, _occurrences, _weighted

query = Register()
long = lambda c: F.col(c).cast("long").alias(c)
rounded = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


@query(rf"""WITH d AS (SELECT doc_id, split_part(text, '.', 1) AS p, split_part(text, '.', 2) AS s FROM documents WHERE text IS NOT NULL),
j AS (SELECT a.doc_id, {NORM.format('a.p')} AS p, {NORM.format('b.p')} AS g FROM d a JOIN d b ON b.doc_id IN (a.doc_id - 1, a.doc_id + 1) UNION ALL SELECT doc_id, {NORM.format('p')}, {NORM.format('s')} FROM d),
t AS (SELECT doc_id, array_to_string(p, ' ') AS p, array_to_string(g, ' ') AS g FROM j) SELECT doc_id, bool_or(p = g) AS exact, bool_or(contains(p, g)) AS substring, count(*) AS n_aliases FROM t GROUP BY 1""")
def e26_answers_over_aliases(spark, sf_dir):
    """A document's first sentence as prediction, its second and its neighbours' first ones as aliases."""
    first = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.substring_index("text", ".", 1).alias("prediction"), F.split_part("text", F.lit("."), F.lit(2)).alias("second"))
    near = first.select(F.explode(F.array(F.col("doc_id") - 1, F.col("doc_id") + 1)).alias("doc_id"), F.col("prediction").alias("alias"))
    aliases = near.unionByName(first.select("doc_id", F.col("second").alias("alias")))
    return reports.answers_over_aliases(first.select("doc_id", "prediction").join(aliases, "doc_id"), "doc_id")


@query("""WITH r AS (SELECT user_id, event_type, CASE event_id % 4 WHEN 0 THEN 'Answer: ' || chr((65 + event_id % 6)::INT) || '.' WHEN 1 THEN '(' || chr((97 + event_id % 5)::INT) || ')' WHEN 2 THEN ' C ' ELSE 'it is B' END AS reply FROM events),
p AS (SELECT event_type, upper(nullif(regexp_extract(reply, '(?i)^\\s*(?:answer\\s*:\\s*)?\\(?([a-d])\\)?[.\\s]*$', 1), '')) AS letter FROM r) SELECT event_type, letter, count(*) AS n FROM p GROUP BY ALL""")
def f27_option_letters(spark, sf_dir):
    """the options that replies name, with nothing beside them."""
    n = F.col("event_id")
    letter = lambda base, mod: F.chr((F.lit(base) + n % mod).cast("long"))
    reply = F.when(n % 4 == 0, F.concat(F.lit("Answer: "), letter(65, 6), F.lit("."))).when(n % 4 == 1, F.concat(F.lit("("), letter(97, 5), F.lit(")"))).when(n % 4 == 2, " C ").otherwise("it is B")
    return table(spark, sf_dir, "events").groupBy("event_type", reports.mcq_letter(reply).alias("letter")).agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT user_id * 10000 + event_id // 5 AS q, CASE event_id % 9 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 8 THEN (CASE WHEN event_type = 'error' THEN NULL ELSE 0.0 END) ELSE 0.0 END AS score FROM events),
g AS (SELECT q, count(score) AS n, count(*) AS c, sum(score) AS s FROM j GROUP BY 1) SELECT q, round(CASE WHEN n = c THEN s / c END, 6) AS rubric FROM g""")
def e29_rubric_mean(spark, sf_dir):
    """JSON verdicts on rubric items, plain or fenced, some not valid; the mean where all are."""
    n = F.col("event_id") % 9
    good = F.when(n == 0, '{"score": 1, "reason": "x"}').when(n == 1, '```json\n{"score": 0.5}\n```').when((n == 8) & (F.col("event_type") == "error"), '{"score": 0.7}').otherwise('{"score": 0.0}')
    t = table(spark, sf_dir, "events").select((F.col("user_id") * 10000 + F.floor(F.col("event_id") / 5)).alias("q"), reports.rubric_score(good).alias("score"))
    items = t.withColumn("expected", F.count("*").over(W.partitionBy("q")))
    return reports.rubric_mean(items, "q", "expected").select("q", F.round("rubric", 6).alias("rubric"))


EVIDENCE_SQL = "e AS (SELECT q.vec_id AS qid, u.vec_id AS uid FROM embeddings q JOIN embeddings u ON q.vec_id % 50 = 0 AND u.vec_id BETWEEN q.vec_id AND q.vec_id + 19 AND u.label = q.label)"


def _evidence(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("uid", "label")
    asked = v.where("uid % 50 = 0").select(F.col("uid").alias("qid"), F.col("label").alias("own"), F.explode(F.sequence(F.col("uid"), F.col("uid") + 19)).alias("uid"))
    return asked.join(v, "uid").where("label = own").select("qid", "uid")


@query(f"""WITH {sim_sql('s', depth=100)}, {EVIDENCE_SQL}, h AS (SELECT s.qid, s.rank, row_number() OVER (PARTITION BY s.qid ORDER BY s.rank) AS nth FROM s JOIN e USING (qid, uid) WHERE rank <= 10),
m AS (SELECT qid, sum(nth / rank) AS s, count(*) AS n FROM h GROUP BY 1), t AS (SELECT qid, count(*) AS relevant FROM e GROUP BY 1)
SELECT qid, round(coalesce(s, 0) / least(relevant, 10), 6) AS ap, round(coalesce(n, 0) / relevant, 6) AS hit_fraction, n IS NOT NULL AS hit FROM t LEFT JOIN m USING (qid)""")
def e8_capped_average_precision(spark, sf_dir):
    """E8 and E9."""
    return reports.capped_precision(_search(spark, sf_dir, 100), _evidence(spark, sf_dir), 10).select("qid", *rounded("ap", "hit_fraction"), "hit")


@query(f"""WITH {sim_sql('s', depth=100)}, {EVIDENCE_SQL} SELECT qid, round(avg((coalesce(rank, 999) <= 5)::INT), 6) AS recall_at_5, round(avg((coalesce(rank, 999) <= 10)::INT), 6) AS recall_at_10, round(avg((coalesce(rank, 999) <= 100)::INT), 6) AS recall_at_100,
round(avg((coalesce(rank, 999) <= 12)::INT), 6) AS evidence_recall_at_budget, bool_and(coalesce(rank, 999) <= 12)::INT AS all_evidence_at_budget FROM e LEFT JOIN s USING (qid, uid) GROUP BY 1""")
def e25_retrieval_metrics(spark, sf_dir):
    """E25, V16 and Q20's scores: recall at three depths, and evidence among the twelve units that a budget holds."""
    r = _search(spark, sf_dir, 100)
    m = reports.budget_retrieval(r, r.where("rank <= 12"), _evidence(spark, sf_dir))
    return m.select("qid", *rounded("recall_at_5", "recall_at_10", "recall_at_100", "evidence_recall_at_budget"), "all_evidence_at_budget")


@query()
def e14_alpha_ndcg(spark, sf_dir):
    """Labels and the parity of ids as subtopics, the first hundred hits as pool."""
    r = _search(spark, sf_dir, 100)
    topics = _vectors(spark, sf_dir).select("uid", F.explode(F.array(F.concat(F.lit("l"), "label"), F.concat(F.lit("p"), F.col("uid") % 2))).alias("subtopic"))
    return reports.alpha_ndcg(r.where("rank <= 20").select("qid", "uid", "rank"), r.select("qid", "uid").join(topics, "uid"), r.select("qid", "uid", "rank")).select("qid", *rounded("alpha_dcg", "ideal", "alpha_ndcg"))


@query(f"""WITH {sim_sql('s', depth=20)}, q AS (SELECT vec_id AS qid, label AS own FROM embeddings WHERE vec_id % 50 = 0),
a AS (SELECT qid, avg((label <> own)::INT) AS d FROM s JOIN q USING (qid) GROUP BY 1), m AS (SELECT count(DISTINCT label) FILTER (label IN (7, 8, 9)) / 3 AS c FROM s)
SELECT qid, round(d, 6) AS distractor_rate, round(c, 6) AS minority_coverage FROM a, m""")
def e17_distractors_and_minorities(spark, sf_dir):
    """The share of a selection that is about nothing asked, and of three small groups that any selection reaches."""
    s = _search(spark, sf_dir, 20).join(_vectors(spark, sf_dir).select("uid", "label"), "uid")
    own = _vectors(spark, sf_dir).where("uid % 50 = 0").select(F.col("uid").alias("qid"), F.col("label").alias("own"))
    d = s.join(own, "qid").groupBy("qid").agg(reports.share(F.col("label") != F.col("own")).alias("distractor_rate"))
    c = s.agg((F.countDistinct(F.when(F.col("label").isin(7, 8, 9), F.col("label"))) / 3).alias("minority_coverage"))
    return d.crossJoin(F.broadcast(c)).select("qid", *rounded("distractor_rate", "minority_coverage"))


@query(f"""WITH {EVIDENCE_SQL}, a AS (SELECT vec_id AS uid, list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS score FROM embeddings),
k AS (SELECT uid FROM a WHERE score >= (SELECT quantile_cont(score, 0.4) FROM a)) SELECT qid, round(avg((k.uid IS NOT NULL)::INT), 6) AS kept_share FROM e LEFT JOIN k USING (uid) GROUP BY 1""")
def e37_relevant_kept_by_a_gate(spark, sf_dir):
    """How much of each query's relevant material passes a gate on similarity to one objective."""
    v = _vectors(spark, sf_dir)
    scored = similarity.score_all(v.where("uid = 0").select(F.col("uid").alias("qid"), "vec"), v).select("uid", "score")
    kept = gate.quantile_gate(scored, "score", 0.4).select("uid", F.lit(True).alias("kept"))
    return _evidence(spark, sf_dir).join(kept, "uid", "left").groupBy("qid").agg(F.round(reports.share(F.col("kept").isNotNull()), 6).alias("kept_share"))


@query(r"""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(substr(text, 1, 1500), '\s+', ' ', 'g'))) AS shown, text FROM documents), f AS (SELECT item_id, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS fact FROM benchmark),
l AS (SELECT f.item_id, d.doc_id, contains(shown, fact) AS contained FROM f JOIN d ON contains(d.text, f.text))
SELECT item_id, count(doc_id) AS n_located, count(*) FILTER (contained) AS n_contained, coalesce(bool_and(contained), false) AND count(doc_id) > 0 AS fact_joint, coalesce(bool_or(contained), false) AS doc_hit FROM f LEFT JOIN l USING (item_id) GROUP BY 1""")
def e23_facts_in_rendered_documents(spark, sf_dir):
    """Items located in documents, and whether the 1,500 characters shown of each hold them."""
    norm = lambda c: F.lower(T.collapse(F.col(c)))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    at = contained(d, items).join(d.select("uid", F.substring("text", 1, 1500).alias("shown")), "uid").join(items.withColumnRenamed("text", "fact"), "qid")
    l = at.select("qid", F.contains(norm("shown"), norm("fact")).alias("contained"))
    agg = items.select("qid").join(l, "qid", "left").groupBy("qid").agg(F.count("contained").alias("n_located"), F.count_if("contained").alias("n_contained"), F.bool_and("contained").alias("all"), F.bool_or("contained").alias("any"))
    return agg.select(F.col("qid").alias("item_id"), "n_located", "n_contained", F.coalesce("all", F.lit(False)).alias("fact_joint"), F.coalesce("any", F.lit(False)).alias("doc_hit"))


PACKED_SQL = """t AS (SELECT conv_id AS qid, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, sum(n) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM t WHERE rank <= 5), k AS (SELECT *, least(n, 2000 - (upto - n)) AS taken, upto > 2000 AS truncated FROM r WHERE upto - n < 2000),
c AS (SELECT t.qid, t.turn, t.n, t.rank <= 5 AS found, k.taken IS NOT NULL AND k.taken >= least(t.n / 2, 2000) AS covered, coalesce(k.truncated, false) AS cut FROM t LEFT JOIN k USING (qid, turn) WHERE t.role = 'user'),
sc AS (SELECT q.conv_id AS qid, coalesce(bool_and(covered), false) AS joint, coalesce(bool_and(found), false) AS found, coalesce(sum(cut::INT), 0)::BIGINT AS truncated_evidence, count(c.turn) = 0 AS missing FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN c ON c.qid = q.conv_id GROUP BY 1)"""


def _scores(spark, sf_dir):
    """Scores of conversations packed into 2,000 characters from their five longest turns, with the user's turns as evidence."""
    t = table(spark, sf_dir, "conversations")
    u = t.where("text IS NOT NULL").select(F.col("conv_id").alias("qid"), "turn", "role", F.length("text").cast("long").alias("tokens"))
    u = u.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("tokens"), "turn")))
    shown = context.budget_take(u.where("rank <= 5"), 2000, ["qid"], ["rank"]).select("qid", "turn", "taken", "truncated")
    e = u.where("role = 'user'").join(shown, ["qid", "turn"], "left")
    covered = F.col("taken").isNotNull() & (F.col("taken") >= coverage.cover_threshold(F.col("tokens")))
    agg = e.groupBy("qid").agg(F.bool_and(covered).alias("joint"), F.bool_and(F.col("rank") <= 5).alias("found"), F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated_evidence"), F.lit(False).alias("missing"))
    every = t.select(F.col("conv_id").alias("qid")).distinct().join(agg, "qid", "left")
    return every.select("qid", F.coalesce("joint", F.lit(False)).alias("joint"), F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("truncated_evidence", F.lit(0)).cast("long").alias("truncated_evidence"), F.coalesce("missing", F.lit(True)).alias("missing"))


@query(f"WITH {PACKED_SQL} SELECT qid, joint, found, truncated_evidence, missing FROM sc")
def e22_question_scores(spark, sf_dir):
    """Joint recall in the context and among the candidates; a question without evidence is a row of zeros, and missing."""
    return _scores(spark, sf_dir)


CASES_SQL = f"{PACKED_SQL}, cs AS (SELECT sc.*, l.quality = 1 AS prim, CASE WHEN sc.qid % 3 <> 0 THEN l.toxic = 0 AND l.quality = 1 AND sc.qid % 5 <> 0 END AS sec, sc.qid % 11 <> 0 AS indexed FROM sc LEFT JOIN labels l ON l.doc_id = sc.qid), bk AS (SELECT *, sec IS NOT NULL AS decidable, CASE WHEN coalesce(prim, true) THEN 0 WHEN sec IS NOT NULL AND sec <> prim THEN 5 WHEN NOT indexed THEN 1 WHEN NOT found THEN 2 WHEN NOT joint THEN 3 ELSE 4 END AS bucket FROM cs)"


def _cases(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), (F.col("quality") == 1).alias("primary"), "toxic")
    s = _scores(spark, sf_dir).join(l, "qid", "left")
    second = F.when(F.col("qid") % 3 != 0, (F.col("toxic") == 0) & F.col("primary") & (F.col("qid") % 5 != 0))
    return reports.failure_bucket(s.withColumn("second", second).withColumn("indexed", F.col("qid") % 11 != 0).withColumn("rendered", F.col("joint")))


@query(f"WITH {CASES_SQL} SELECT qid, bucket::INT AS bucket, decidable FROM bk")
def e33_failure_buckets(spark, sf_dir):
    """Why an answer is wrong, by the first rule that holds. The rules of each kind of corpus are in e34 and e35."""
    return _cases(spark, sf_dir).select("qid", "bucket", "decidable")


@query(f"WITH {CASES_SQL} SELECT qid % 4 AS qtype, count(*) FILTER (bucket = 5) AS bucket_5, count(*) FILTER (bucket = 1) AS bucket_1, count(*) FILTER (bucket = 2) AS bucket_2, count(*) FILTER (bucket = 3) AS bucket_3, count(*) FILTER (bucket = 4) AS bucket_4, count(*) AS n_wrong, count(*) FILTER (NOT decidable) AS n_undecidable FROM bk WHERE bucket <> 0 GROUP BY 1")
def a25_bucket_counts(spark, sf_dir):
    return reports.bucket_counts(_cases(spark, sf_dir).withColumn("qtype", F.col("qid") % 4), ["qtype"])


@query(f"WITH {PACKED_SQL} SELECT qid % 3 AS grp, count(*) AS n, count(*) FILTER (missing) AS n_missing, round(avg(joint::INT), 6) AS joint, round(avg(found::INT), 6) AS found, round(avg(CASE WHEN NOT missing THEN truncated_evidence END), 6) AS truncated_evidence FROM sc GROUP BY 1")
def a21_score_summary(spark, sf_dir):
    """Means of scores over all questions, those that are null left out, with the number that is missing."""
    s = _scores(spark, sf_dir).select((F.col("qid") % 3).alias("grp"), "missing", F.col("joint").cast("int").alias("joint"), F.col("found").cast("int").alias("found"), F.when(~F.col("missing"), F.col("truncated_evidence")).alias("truncated_evidence"))
    return reports.summarise(s, ["grp"], ["joint", "found", "truncated_evidence"]).select("grp", "n", "n_missing", *rounded("joint", "found", "truncated_evidence"))


RECORDS_SQL = "rc AS (SELECT d.doc_id, d.lang AS corpus, 'arm' || d.doc_id % 3 AS arm, d.source AS qtype, l.quality = 1 AS correct, CASE WHEN d.doc_id % 2 = 0 THEN l.toxic = 0 AND l.quality = 1 END AS sec, d.n_chars < 400 AS abst, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id))"


def _records(spark, sf_dir):
    l = table(spark, sf_dir, "labels").withColumn("judged", F.lit(True))
    d = table(spark, sf_dir, "documents").join(l, "doc_id", "left")
    correct = F.col("quality") == 1
    return d.select(
        "doc_id", F.col("lang").alias("corpus"), F.concat(F.lit("arm"), F.col("doc_id") % 3).alias("arm"), F.col("source").alias("qtype"), correct.alias("correct"),
        F.when(F.col("doc_id") % 2 == 0, (F.col("toxic") == 0) & correct).alias("second"), (F.col("n_chars") < 400).alias("abstention"), F.col("judged").isNull().alias("missing"),
    )


@query(f"""WITH {RECORDS_SQL} SELECT corpus, arm, count(*) AS n, count(*) FILTER (missing) AS n_missing, round(avg(coalesce(correct, false)::INT), 6) AS acc_all, round(avg(CASE WHEN NOT abst THEN coalesce(correct, false)::INT END), 6) AS acc_answerable,
round(avg(CASE WHEN abst THEN coalesce(correct, false)::INT END), 6) AS acc_abstention, count(sec) AS second_n, round(avg(sec::INT), 6) AS second_acc, count(*) FILTER (sec <> correct) AS n_disagree FROM rc GROUP BY ALL""")
def a24_accuracy_tables(spark, sf_dir):
    """Accuracy of arms by corpus, with the second judge beside the first."""
    c = reports.accuracy_cell(_records(spark, sf_dir), ["corpus", "arm"])
    return c.select("corpus", "arm", "n", "n_missing", *rounded("acc_all", "acc_answerable", "acc_abstention"), "second_n", *rounded("second_acc"), "n_disagree")


@query(f"""WITH {RECORDS_SQL}, c AS (SELECT qtype, correct, count(*) AS n FROM rc WHERE correct IS NOT NULL GROUP BY ALL) SELECT qtype, round(max(n) / sum(n), 6) AS majority_rate, sum(n)::BIGINT AS n FROM c GROUP BY 1""")
def a26_majority_rate(spark, sf_dir):
    c = _records(spark, sf_dir).where("correct IS NOT NULL").groupBy("qtype", "correct").agg(F.count("*").alias("n"))
    return c.groupBy("qtype").agg(F.round(F.max("n") / F.sum("n"), 6).alias("majority_rate"), F.sum("n").alias("n"))


@query(f"""WITH {RECORDS_SQL}, b AS (SELECT * FROM rc WHERE correct IS NOT NULL AND sec IS NOT NULL) SELECT arm, corpus, count(*) AS n, count(*) FILTER (correct = sec) AS agree, round(avg((correct = sec)::INT), 6) AS agreement FROM b GROUP BY GROUPING SETS ((arm, corpus), ())""")
def a28_judge_agreement(spark, sf_dir):
    """How often two judges agree, for each cell and over all."""
    both = _records(spark, sf_dir).where("correct IS NOT NULL AND second IS NOT NULL").withColumn("same", F.col("correct") == F.col("second"))
    return both.groupingSets([["arm", "corpus"], []], "arm", "corpus").agg(F.count("*").alias("n"), F.count_if("same").alias("agree"), F.round(reports.share(F.col("same")), 6).alias("agreement"))


@query(f"""WITH {RECORDS_SQL}, c AS (SELECT qtype, arm, avg(coalesce(correct, false)::INT) AS a FROM rc GROUP BY ALL), p AS (PIVOT c ON arm IN ('arm0', 'arm1', 'arm2') USING first(a) GROUP BY qtype),
s AS (SELECT 'arm1-arm0' AS step, coalesce(arm0, 0) AS a, coalesce(arm1, 0) AS b FROM p UNION ALL SELECT 'arm2-arm1', coalesce(arm1, 0), coalesce(arm2, 0) FROM p)
SELECT step, count(*) AS n, round(avg(b - a), 6) AS delta, count(*) FILTER (b - a > 1e-12) AS wins, count(*) FILTER (abs(b - a) <= 1e-12) AS ties, count(*) FILTER (b - a < -1e-12) AS losses FROM s GROUP BY 1""")
def x8_consecutive_arms(spark, sf_dir):
    """Each arm against the one before it over the same questions."""
    v = _records(spark, sf_dir).groupBy(F.col("qtype").alias("qid"), "arm").agg(reports.share(F.coalesce("correct", F.lit(False))).alias("value"))
    return stats.compare(reports.consecutive_arms(v, ["arm0", "arm1", "arm2"]), ["step"]).select("step", "n", F.round("delta", 6).alias("delta"), "wins", "ties", "losses")


@query(f"""WITH {RECORDS_SQL}, v AS (SELECT arm, corpus, coalesce(correct, false)::INT AS v FROM rc), g AS (SELECT avg(v) FILTER (corpus = 'en' AND arm = 'arm1') - avg(v) FILTER (corpus = 'en' AND arm = 'arm0') AS a, avg(v) FILTER (corpus = 'fr' AND arm = 'arm1') - avg(v) FILTER (corpus = 'fr' AND arm = 'arm0') AS b FROM v)
SELECT round(a, 6) AS first_gain, round(b, 6) AS second_gain, round(a - b, 6) AS difference FROM g""")
def x18_interaction(spark, sf_dir):
    """The gain of one arm over another in two corpora, and the difference of the gains."""
    v = _records(spark, sf_dir).select("arm", F.col("corpus").alias("grp"), F.coalesce("correct", F.lit(False)).cast("int").alias("value"))
    return reports.interaction(v, ("arm0", "arm1"), ("en", "fr")).select(*rounded("first_gain", "second_gain", "difference"))


@query(f"""WITH {RECORDS_SQL}, c AS (SELECT qtype, count(*) FILTER (correct AND arm = 'arm0') AS a, count(*) FILTER (correct AND arm = 'arm1') AS b, count(*) FILTER (correct IS NOT NULL) AS n FROM rc GROUP BY 1),
t AS (SELECT qtype AS test, CASE WHEN qtype < 'src15' THEN 'A' ELSE 'B' END AS family, n > 15 AS ran, qtype LIKE '%7' AS part, (b - a) / n AS delta, greatest(0, least(1, 1 - abs(b - a) / 8)) ** 6 AS p, a AS losses, b AS wins FROM c),
h AS (SELECT *, ran AND NOT part AS ok FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS i, count(*) OVER (PARTITION BY family) AS m FROM h WHERE ok),
j AS (SELECT test, max(least(1, (m - i + 1) * p)) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING) AS holm_p FROM r)
SELECT test, family, round(holm_p, 6) AS holm_p, CASE WHEN NOT ran THEN 'not run' WHEN part THEN 'partial' WHEN delta <= 0 THEN 'failed' WHEN holm_p <= 0.05 THEN 'shown' ELSE 'not shown' END AS label, losses - wins AS net_losses, ran AND NOT part AND losses - wins <= 3 AS holds FROM h LEFT JOIN j USING (test)""")
def x11_decisions(spark, sf_dir):
    """Tests in families, adjusted over those that ran to the end, with their readings and the non-inferiority rule."""
    c = _records(spark, sf_dir).groupBy(F.col("qtype").alias("test")).agg(F.count_if(F.col("correct") & (F.col("arm") == "arm0")).alias("losses"), F.count_if(F.col("correct") & (F.col("arm") == "arm1")).alias("wins"), F.count("correct").alias("n"))
    gap = F.col("wins") - F.col("losses")
    t = c.select("test", F.when(F.col("test") < "src15", "A").otherwise("B").alias("family"), (F.col("n") > 15).alias("ran"), F.endswith("test", F.lit("7")).alias("partial"), (gap / F.col("n")).alias("delta"),
                 F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(gap) / 8)), 6).alias("p"), "losses", "wins")
    ok = stats.holm(t.where("ran AND NOT partial"), "family").select("test", "holm_p", F.col("significant").alias("holm_significant"))
    return reports.reading(t.join(ok, "test", "left")).select("test", "family", F.round("holm_p", 6).alias("holm_p"), "label", "net_losses", "holds")


@query("""WITH r AS (SELECT event_type AS stage, CASE WHEN user_id % 2 = 0 THEN 'one' ELSE 'two' END AS corpus, event_id // 4 AS invocation, value AS usd FROM events),
o AS (SELECT stage, invocation, arg_min(usd, (corpus, usd)) AS usd FROM (SELECT stage, corpus, invocation, max(usd) AS usd FROM r GROUP BY ALL) GROUP BY ALL), m AS (SELECT stage, corpus, invocation, max(usd) AS usd FROM r GROUP BY ALL)
SELECT stage, corpus, round(sum(usd), 6) AS usd, count(*) AS invocations FROM m GROUP BY ALL UNION ALL SELECT stage, NULL, round(sum(usd), 6), count(*) FROM o GROUP BY ALL""")
def a35_ledger(spark, sf_dir):
    """Spending of stages by corpus, and in all with each invocation counted once."""
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"), F.when(F.col("user_id") % 2 == 0, "one").otherwise("two").alias("corpus"), F.floor(F.col("event_id") / 4).alias("invocation")).agg(F.max("value").alias("usd"))
    return reports.ledger(r, "stage", "corpus", "invocation", "usd")


@query("""SELECT event_type AS status, coalesce(props LIKE '%1%', false) AS paid, count(*) AS calls, round(sum(value), 4) AS usd, round(sum(value) FILTER (value > 50), 4) AS large FROM events GROUP BY ALL""")
def a33_meter(spark, sf_dir):
    """Calls and spending by status and role, with a conditional sum."""
    paid = F.coalesce(F.contains("props", F.lit("1")), F.lit(False))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status"), paid.alias("paid")).agg(
        F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("usd"), F.round(F.sum(F.when(F.col("value") > 50, F.col("value"))), 4).alias("large"))


ROBIN_SQL = "l AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS label FROM embeddings)"


@query(f"""WITH {ROBIN_SQL}, s AS (SELECT label, count(*) AS size FROM l GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY label = -1, size DESC, label) AS place FROM s),
t AS (SELECT vec_id, l.label, row_number() OVER (PARTITION BY l.label ORDER BY sha256('13|' || vec_id), vec_id) AS turn, place FROM l JOIN p USING (label)), k AS (SELECT * FROM t WHERE label <> -1 OR turn <= 8)
SELECT * FROM (SELECT vec_id, label, row_number() OVER (ORDER BY label <> -1, turn, place) AS pos FROM k) WHERE pos <= 30""")
def l15_topic_stratified_sample(spark, sf_dir):
    """A quarter of the sample from the residue, the rest from the topics in turn, the largest first."""
    d = _vectors(spark, sf_dir).select(F.col("uid").alias("vec_id"), F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("label"))
    return select.round_robin(d, "label", [select.seeded(13, F.col("vec_id")), F.col("vec_id")], 30).select("vec_id", "label", long("pos"))


@query()
def l16_hash_stratified_sample(spark, sf_dir):
    """A sample with every language and source in it, quotas corrected one by one, in the order of a hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", F.coalesce("lang", F.lit("none")), "source").alias("stratum"))
    n = d.groupBy("stratum").agg(F.count("*").alias("n"))
    return select.draw_by_quota(d, select.least_one_quota(n, 150, "stratum"), "stratum", "doc_id", 13)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('13|' || doc_id), doc_id) AS nth FROM documents) SELECT doc_id, s.subset FROM r, (VALUES ('small', 20), ('medium', 60), ('large', 150)) s(subset, size) WHERE nth <= size""")
def l12_nested_subsets(spark, sf_dir):
    """Subsets of a seeded order that lie in each other."""
    return select.nested_subsets(table(spark, sf_dir, "documents"), "doc_id", {"small": 20, "medium": 60, "large": 150}, 13)


@query("""WITH t AS (SELECT lang AS topic, doc_id AS unit FROM documents), c AS (SELECT source AS community, doc_id AS unit FROM documents), s AS (SELECT topic, community, count(*) AS shared FROM t JOIN c USING (unit) GROUP BY ALL HAVING count(*) >= 5),
nt AS (SELECT topic, count(*) AS nt FROM t GROUP BY 1), nc AS (SELECT community, count(*) AS nc FROM c GROUP BY 1), j AS (SELECT topic, community, round(shared * (1 - shared / (nt + nc - shared)), 9) AS d FROM s JOIN nt USING (topic) JOIN nc USING (community)),
r AS (SELECT *, row_number() OVER (ORDER BY d DESC, topic, community) AS nth, count(*) OVER () AS n FROM j) SELECT topic, community, round(d, 6) AS d FROM r WHERE nth <= least(ceil(0.2 * n), 500)""")
def p18_flagged_pairs(spark, sf_dir):
    """The fifth of topic and community pairs that differ most."""
    d = table(spark, sf_dir, "documents")
    b = graph.bridge(d.select(F.col("lang").alias("topic"), F.col("doc_id").alias("unit")), d.select(F.col("source").alias("community"), F.col("doc_id").alias("unit"))).withColumn("d", F.round("d", 9))
    return select.flag_pairs(b, "d", ["topic", "community"]).select("topic", "community", F.round("d", 6).alias("d"))


@query(f"""WITH {PHRASES_SQL}, m AS (SELECT phrase AS entity, unit AS doc FROM every), k AS (SELECT entity FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND least(64, greatest(2, floor((SELECT count(DISTINCT doc) FROM m) / 2))))
SELECT x.doc AS a, y.doc AS b, count(*) AS weight FROM m x JOIN m y ON x.entity = y.entity AND x.doc < y.doc SEMI JOIN k ON k.entity = x.entity GROUP BY ALL""")
def j13_shared_entity_pairs(spark, sf_dir):
    """Pairs of turns that name the same things, those that too many name left out."""
    return graph.shared_entity_pairs(_occurrences(spark, sf_dir).select(F.col("phrase").alias("entity"), F.col("unit").alias("doc")))


@query()
def g11_document_communities(spark, sf_dir):
    """Communities of turns by the things they share, by modularity."""
    pairs = graph.shared_entity_pairs(_occurrences(spark, sf_dir).select(F.col("phrase").alias("entity"), F.col("unit").alias("doc")))
    return communities.modularity_communities(pairs.where("weight >= 2"))


@query(f"""WITH {EVERY_PHRASE_SQL}, {PRUNED_SQL}, e AS (SELECT 'unit:' || unit AS src, 'mentions' AS kind, 'phrase:' || phrase AS dst FROM occ UNION ALL SELECT 'phrase:' || a, 'near', 'phrase:' || b FROM pruned UNION ALL SELECT 'unit:' || conv_id * 1000 + turn, 'said_by', 'role:' || role FROM conversations)
SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY 1""".replace("'unit:' || conv_id * 1000 + turn", "'unit:' || (conv_id * 1000 + turn)"))
def g16_evidence_graph(spark, sf_dir):
    """The typed edges of the evidence graph, summed up by type."""
    occ, freq = _content(spark, sf_dir)
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    near = graph.prune(graph.pmi(graph.cooccurrence(occ), freq))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit"), "role")
    e = occ.select(name("unit", "unit").alias("src"), F.lit("mentions").alias("kind"), name("phrase", "phrase").alias("dst")).unionByName(
        near.select(name("phrase", "a").alias("src"), F.lit("near").alias("kind"), name("phrase", "b").alias("dst"))).unionByName(
        turns.select(name("unit", "unit").alias("src"), F.lit("said_by").alias("kind"), name("role", "role").alias("dst")))
    return e.groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query(f"""WITH {EVERY_PHRASE_SQL}, {PRUNED_SQL}, m AS (SELECT p AS id, ascii(p) % 7 AS community FROM (SELECT a AS p FROM pruned UNION SELECT b FROM pruned)), e AS (SELECT x.community AS ca, y.community AS cb FROM pruned JOIN m x ON x.id = a JOIN m y ON y.id = b),
i AS (SELECT ca AS community, count(*) AS inside FROM e WHERE ca = cb GROUP BY 1), s AS (SELECT community, count(*) AS size FROM m GROUP BY 1), t AS (SELECT count(*) AS edges, avg((ca = cb)::INT) AS intra FROM e)
SELECT count(*) AS communities, sum(size)::BIGINT AS nodes, any_value(edges) AS edges, round(max(size) / sum(size), 6) AS largest_share, round(2 * any_value(edges) / (sum(size) * (sum(size) - 1)), 6) AS density, round(any_value(intra), 6) AS intra_share,
round(avg(CASE WHEN size >= 2 THEN coalesce(inside, 0) / (size * (size - 1) / 2) END), 6) AS within_density FROM s LEFT JOIN i USING (community), t""")
def a19_graph_diagnostics(spark, sf_dir):
    """Shares and densities of a grouping of the pruned graph, here by the first letter."""
    e = graph.prune(_weighted(spark, sf_dir))
    ids = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    d = graph.diagnostics(e, ids.withColumn("community", F.ascii("id") % 7))
    return d.select("communities", "nodes", "edges", *rounded("largest_share", "density", "intra_share", "within_density"))


@query(f"""WITH {EVERY_PHRASE_SQL}, {PRUNED_SQL}, d AS (SELECT p, count(*) AS degree FROM (SELECT a AS p FROM pruned UNION ALL SELECT b FROM pruned) GROUP BY 1) SELECT degree, count(*) AS nodes FROM d GROUP BY 1""")
def a41_degree_distribution(spark, sf_dir):
    e = graph.prune(_weighted(spark, sf_dir))
    d = e.select(F.col("a").alias("p")).union(e.select("b")).groupBy("p").agg(F.count("*").alias("degree"))
    return d.groupBy("degree").agg(F.count("*").alias("nodes"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey % 500 AS a, 1000 + l_partkey % 700 AS b FROM lineitem WHERE l_discount >= 0.09), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), s AS (SELECT o_custkey AS qid, o_orderkey % 500 AS node FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000),
h1 AS (SELECT DISTINCT qid, b.b AS node FROM s JOIN b ON s.node = b.a), h2 AS (SELECT DISTINCT qid, b.b AS node FROM h1 JOIN b ON h1.node = b.a), r AS (SELECT DISTINCT qid, node FROM s UNION SELECT * FROM h1 UNION SELECT * FROM h2)
SELECT qid, count(*) AS reached, sum(node)::BIGINT AS checksum FROM r GROUP BY 1""")
def j23_two_hops(spark, sf_dir):
    """What lies within two steps of a customer's large urgent orders, over orders and parts that lines link."""
    l = table(spark, sf_dir, "lineitem").where("l_discount >= 0.09").select((F.col("l_orderkey") % 500).alias("a"), (1000 + F.col("l_partkey") % 700).alias("b")).distinct()
    s = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 450000").select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 500).alias("node"))
    return graph.expand(s, l).groupBy("qid").agg(F.count("*").alias("reached"), F.sum("node").alias("checksum"))


@query(f"""WITH {EVERY_PHRASE_SQL}, {PRUNED_SQL}, ut AS (SELECT conv_id * 1000 + turn AS unit, i AS topic, CASE i WHEN turn % 4 THEN 0.7 ELSE 0.1 END AS p FROM conversations, range(0, 4) r(i)),
pt AS (SELECT topic, i, cos(topic * 2 + i) AS x FROM range(0, 4) a(topic), range(0, 3) b(i)), ms AS (SELECT phrase, topic, sum(p) AS p FROM occ JOIN ut USING (unit) GROUP BY ALL), tv AS (SELECT phrase, i, sum(p * x) / (SELECT sum(p) FROM ms m2 WHERE m2.phrase = ms.phrase) AS x FROM ms JOIN pt USING (topic) GROUP BY phrase, i),
nv AS (SELECT phrase, list(x / n ORDER BY i) AS v FROM tv JOIN (SELECT phrase, sqrt(sum(x * x)) AS n FROM tv GROUP BY 1) USING (phrase) GROUP BY phrase)
SELECT a, b, round(weight * (1 + greatest(-1, least(1, list_dot_product(x.v, y.v)))), 9) AS weight FROM pruned JOIN nv x ON x.phrase = a JOIN nv y ON y.phrase = b""")
def a15_topic_weighted_edges(spark, sf_dir):
    """Phrases as means of topic prototypes by the mass of their units, and edges weighted by one plus the cosine of their ends."""
    occ, freq = _content(spark, sf_dir)
    edges = graph.prune(graph.pmi(graph.cooccurrence(occ), freq))
    turns = table(spark, sf_dir, "conversations")
    topic = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("topic")
    mass = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit"), "turn", topic).select("unit", "topic", F.when(F.col("topic") == F.col("turn") % 4, 0.7).otherwise(0.1).alias("p"))
    proto = turns.select((F.col("turn") % 4).cast("int").alias("topic")).distinct().select("topic", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).withColumn("x", F.cos(F.col("topic") * 2 + F.col("i")))
    f = graph.topic_factor(edges, graph.topic_vectors(occ, mass, F.broadcast(proto)))
    return f.select("a", "b", F.round(F.col("weight") * F.col("factor"), 9).alias("weight"))


@query(r"""SELECT conv_id, turn, regexp_matches(lower(text), '\b(before|previous|previously|formerly|used to|at the time|history|historical|when|changed|changes|evolved|timeline|ever|between|how many times)\b|\b(?:19|20)\d{2}\b') AS historical, trim(lower(text)) LIKE 'yes%' AS yes, contains(text, chr(0)) AS nul
FROM conversations WHERE text IS NOT NULL""")
def p15_history_questions(spark, sf_dir):
    """Predicates over turns: about the past, a yes, a byte that a database refuses."""
    t = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return t.select("conv_id", "turn", dates.asks_for_history(F.col("text")).alias("historical"), F.startswith(F.trim(F.lower("text")), F.lit("yes")).alias("yes"), F.contains("text", F.lit("\0")).alias("nul"))


QUERIES, ORACLES = query.queries, query.oracles
