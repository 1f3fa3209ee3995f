"""Queries over adapters, units, dates, shapes and predicates."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from facetspark.functions import dates, shapes, text as T, vectors
from facetspark.operators import channels, context, graph, units
from facetspark.plans.common import Register, table
from facetspark.plans.retrieval import _search, sim_sql
from facetspark.plans.texts import SENT, WORDS
from facetspark.sources import files

query = Register()
long = lambda c: F.col(c).cast("long").alias(c)


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 200) / 170))::BIGINT * 170 + 1, 170)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, s // 170 AS pos, md5(regexp_replace(array_to_string(w[s + 1 : s + 200], ''), '\s+$', '')) AS chunk_md5 FROM r""")
def t8_spaced_word_chunks(spark, sf_dir):
    """Runs of 200 words that overlap by 30 and keep their white space; the run that reaches the end is the last."""
    w = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.spaced_words(F.col("text")).alias("w"))
    c = w.select("doc_id", F.posexplode(T.spaced_chunks(F.col("w"))).alias("pos", "chunk"))
    return c.select("doc_id", long("pos"), F.md5("chunk").alias("chunk_md5"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\w+\W*') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, w, unnest(range(0, len(w), 500)) AS s FROM w WHERE len(w) BETWEEN 1 AND 1000)
SELECT doc_id, s // 500 AS pos, len(w[s + 1 : s + 500]) AS tokens, md5(regexp_replace(array_to_string(w[s + 1 : s + 500], ''), '\W+$', '')) AS piece_md5 FROM r""")
def t10_token_pieces(spark, sf_dir):
    """Pieces of 500 tokens from the first token's start to the last one's end; texts of over 1,000 tokens have none."""
    tokens = F.regexp_extract_all("text", F.lit(r"\w+\W*"), F.lit(0))
    w = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tokens.alias("w")).where(F.size("w").between(1, 1000))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(500)), lambda i: F.slice("w", i + 1, 500))
    c = w.select("doc_id", F.posexplode(runs).alias("pos", "run"))
    return c.select("doc_id", long("pos"), F.size("run").cast("long").alias("tokens"), F.md5(F.regexp_replace(F.array_join("run", ""), r"\W+$", "")).alias("piece_md5"))


@query(r"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\n[ \t]*\n+|\n') AS p, regexp_extract_all(text, '\n[ \t]*\n+|\n') AS s FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i, p[i] AS p, coalesce(length(s[i]), 0) AS gap FROM (SELECT doc_id, p, s, unnest(range(1, len(p) + 1)) AS i FROM p)),
a AS (SELECT *, coalesce(sum(length(p) + gap) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, spot + length(p) - length(regexp_replace(p, '^\s+', '')) AS "start", spot + length(regexp_replace(p, '\s+$', '')) AS "end" FROM a WHERE regexp_matches(p, '\S')""")
def t16_span_pieces(spark, sf_dir):
    """Paragraphs and lines as trimmed absolute spans."""
    return units.spans_between(table(spark, sf_dir, "documents"), r"\n[ \t]*\n+|\n")


PARTS_SQL = rf"""t AS (SELECT *, {SENT.format('text', 3)} AS us, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: len({WORDS.format('x')}) >= 3) AS al FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN CASE WHEN len(us) = 0 THEN [trim(text)] ELSE us END ELSE CASE WHEN len(al) = 0 THEN [trim(text)] ELSE al END END AS p FROM t),
f AS (SELECT conv_id, turn, role, len(p) AS n, unnest(p) AS line, unnest(range(0, len(p))) AS i FROM p),
g AS (SELECT *, CASE WHEN role = 'user' OR n <= 10 THEN i WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1) ELSE n % 10 + (i - (n % 10) * (n // 10 + 1)) // (n // 10) END AS pos FROM f),
parts AS (SELECT conv_id, turn, role, pos, string_agg(line, chr(10) ORDER BY i) AS part FROM g GROUP BY ALL)"""


@query(rf"""WITH {PARTS_SQL} SELECT 's' || conv_id AS container, 's' || conv_id || '#' || turn AS owner, 's' || conv_id || '#' || turn AS unit, -1 AS pos, role, md5(text) AS text_md5 FROM conversations WHERE text IS NOT NULL
UNION ALL SELECT 's' || conv_id, 's' || conv_id || '#' || turn, 's' || conv_id || '#' || turn || '/' || pos, pos, role, md5(part) FROM parts""")
def t14_session_units(spark, sf_dir):
    """Turns and their parts under ids that name session, turn and part."""
    return units.turn_units(table(spark, sf_dir, "conversations")).select("container", "owner", "unit", long("pos"), "role", F.md5("text").alias("text_md5"))


@query()
def t15_document_units(spark, sf_dir):
    """Chunks packed from paragraphs, and the sentences in them, under ids that name document, chunk and sentence."""
    d = table(spark, sf_dir, "documents")
    chunk = units.pack(d, 120).join(d.select("doc_id", "text"), "doc_id")
    body = chunk.select(F.concat(F.lit("d"), "doc_id").alias("container"), F.concat(F.lit("d"), "doc_id", F.lit("#"), "pos").alias("owner"), F.expr("substring(text, start + 1, end - start)").alias("body"))
    inner = body.select("container", "owner", F.posexplode(T.sentences(F.col("body"))).alias("j", "s")).select("container", "owner", F.concat("owner", F.lit("/"), "j").alias("unit"), F.md5("s").alias("text_md5"))
    return body.select("container", "owner", F.col("owner").alias("unit"), F.md5("body").alias("text_md5")).unionByName(inner)


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM conversations WHERE text IS NOT NULL),
d AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS doc FROM conversations GROUP BY 1), c AS (SELECT conv_id, unnest(range(0, length(doc), 700)) AS lo, doc FROM d),
f AS (SELECT conv_id, lo // 700 AS chunk, strpos(doc, substr(doc, lo + 1, 250)) - 1 AS found, length(substr(doc, lo + 1, 250)) AS n FROM c)
SELECT f.conv_id, chunk, found, min(turn) AS first_turn, max(turn) AS last_turn FROM f JOIN s ON s.conv_id = f.conv_id AND s.lo + s.n > found AND s.lo < found + f.n GROUP BY ALL""")
def t24_located_chunks(spark, sf_dir):
    """Sessions as one text; pieces of it are searched in the text and named by the turns they overlap."""
    t = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    spans = units.joined_turns(t).select(F.col("conv_id").alias("k"), F.col("turn").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    doc = t.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("doc"))
    c = doc.select("conv_id", "doc", F.explode(F.sequence(F.lit(0), F.length("doc") - 1, F.lit(700))).alias("lo")).withColumn("piece", F.substring("doc", F.col("lo") + 1, F.lit(250)))
    found = c.select(F.col("conv_id").alias("k"), F.floor(F.col("lo") / 700).alias("chunk"), (F.expr("instr(doc, piece)") - 1).cast("long").alias("b_start"), F.length("piece").alias("n"))
    both = context.overlaps(spans, found.withColumn("b_end", F.col("b_start") + F.col("n")), "k")
    return both.groupBy(F.col("k").alias("conv_id"), "chunk", F.col("b_start").alias("found")).agg(F.min("a_id").alias("first_turn"), F.max("a_id").alias("last_turn"))


@query(rf"""WITH w AS (SELECT doc_id, unnest({WORDS.format('text')}) AS w, unnest(range(0, len({WORDS.format('text')}))) AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, sum(len(regexp_extract_all(w, '\w+'))) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS used FROM w)
SELECT doc_id, count(*) FILTER (used <= 60) AS words FROM s GROUP BY 1""")
def t25_cut_to_tokens(spark, sf_dir):
    """The longest whole-word beginning of a text within 60 tokens."""
    w = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return w.select("doc_id", T.cut_to_tokens(F.col("w"), 60).cast("long").alias("words"))


@query(rf"""WITH w AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, text, w, CASE WHEN len(w) > 180 THEN range(0, len(w), 120) WHEN len(w) > 0 THEN [0] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, text, unnest(s) AS s, w FROM r), v AS (SELECT doc_id, s, CASE WHEN len(w) <= 180 THEN text ELSE array_to_string(w[s + 1 : s + 180], ' ') END AS body, len(w) <= 180 OR len(w[s + 1 : s + 180]) >= 15 AS ok FROM u),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i, body FROM v WHERE ok) SELECT doc_id || '##raw' || i AS card_id, doc_id, 'chunk' || i AS aspect, md5(body) AS text_md5 FROM c""")
def t3_raw_chunk_cards(spark, sf_dir):
    """Windows as cards named after document and place."""
    split = table(spark, sf_dir, "documents").select("doc_id", "text", T.words(F.col("text")).alias("w"))
    c = split.select("doc_id", F.posexplode(T.card_windows(F.col("w"), F.col("text"))).alias("i", "body"))
    return c.select(F.concat("doc_id", F.lit("##raw"), "i").alias("card_id"), "doc_id", F.concat(F.lit("chunk"), "i").alias("aspect"), F.md5("body").alias("text_md5"))


@query(r"""WITH s AS (SELECT item_id, text, regexp_matches(text, '\bthe\b') AS has, regexp_replace(text, '\bthe\b', chr(1)) AS t FROM benchmark),
p AS (SELECT item_id, CASE WHEN has THEN split_part(t, chr(1), 1) ELSE text END AS subject, CASE WHEN has THEN list_filter(list_transform(string_split(split_part(t, chr(1), 2), ','), lambda x: trim(x, ' .,')), lambda x: x <> '') ELSE [regexp_replace(text, '^\s+|\s+$', '', 'g')] END AS a FROM s)
SELECT item_id, i - 1 AS pos, md5(regexp_replace(subject, '^\s+|\s+$', '', 'g')) AS subject_md5, md5(a[i]) AS attribute_md5 FROM (SELECT item_id, subject, a, unnest(range(1, len(a) + 1)) AS i FROM p)""")
def t6_attributes(spark, sf_dir):
    """What follows a text's first `the`, split at commas, with what stands before it as subject."""
    a = table(spark, sf_dir, "benchmark").select("item_id", T.attributes(F.col("text"), "the").alias("a"))
    flat = a.select("item_id", "a.subject", F.posexplode("a.attributes").alias("pos", "x"))
    return flat.select("item_id", long("pos"), F.md5("subject").alias("subject_md5"), F.md5("x").alias("attribute_md5"))


@query("""WITH g AS (SELECT conv_id, role AS label, min(turn) AS first, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations GROUP BY ALL)
SELECT conv_id, label, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS pos, turns FROM g""")
def r9_groups_in_first_seen_order(spark, sf_dir):
    """A conversation's items by label, groups in the order in which they first occur."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("role").alias("label")).agg(F.min("turn").alias("first"), F.sort_array(F.collect_list("turn")).alias("t"))
    pos = F.row_number().over(W.partitionBy("conv_id").orderBy("first")).cast("long")
    return g.select("conv_id", "label", pos.alias("pos"), F.array_join(F.col("t").cast("array<string>"), ",").alias("turns"))


@query("""SELECT vec_id, round(CASE WHEN n > 0 THEN embedding[1]::DOUBLE / n ELSE 0 END, 6) AS first, round(CASE WHEN n > 0 THEN list_sum(list_transform(embedding, lambda x: x::DOUBLE / n)) ELSE 0 END, 6) AS total
FROM (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""")
def r17_unit_rows(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m-%d') AS fuzzy, date_trunc('minute', ts) AS chat_time FROM events")
def f8_dates_in_texts(spark, sf_dir):
    """Dates and times read from texts in three forms, built from the events' moments."""
    t = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    iso = F.concat(F.col("event_type"), F.lit(" at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("."))
    fuzzy = F.concat(F.lit("seen on "), F.date_format("ts", "MMMM d, yyyy"), F.lit(" by "), F.col("user_id").cast("string"))
    chat = F.lower(F.date_format("ts", "h:mm a")), F.date_format("ts", "d MMMM, yyyy")
    return t.select(
        "event_id", dates.iso_date(iso).alias("day"), dates.iso_time(iso).alias("clock"), dates.date_with_year(fuzzy).cast("string").alias("fuzzy"),
        dates.chat_time(F.concat(chat[0], F.lit(" on "), chat[1])).cast("timestamp_ntz").alias("chat_time"),
    )


PREDICATE_SQL = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""WITH t AS (SELECT o_orderpriority AS raw FROM orders UNION ALL SELECT p_name || ': ' || p_brand FROM part UNION ALL SELECT n_name FROM nation), p AS (SELECT raw, {PREDICATE_SQL.format('raw')} AS p FROM t)
SELECT CASE p WHEN '1_urgent' THEN 'urgent' WHEN '5_low' THEN 'low' ELSE p END AS predicate, count(*) AS n FROM p GROUP BY 1""")
def f5_predicates(spark, sf_dir):
    """names made canonical, with aliases."""
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("raw"))
    raw = raw.unionByName(table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(": "), "p_brand").alias("raw"))).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("raw")))
    return raw.groupBy(T.predicate(F.col("raw"), {**T.PREDICATE_ALIASES, "1_urgent": "urgent", "5_low": "low"}).alias("predicate")).agg(F.count("*").alias("n"))


@query(r"""WITH s AS (SELECT e.*, (SELECT min(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.ts > e.ts AND x.event_type <> e.event_type) AS upto FROM events e)
SELECT event_id, md5('user ' || user_id || CASE WHEN value < 0 THEN ' NOT ' ELSE ' ' END || 'does ' || event_type || ' [valid ' || strftime(ts, '%Y-%m-%d') || ' to ' || coalesce(strftime(upto, '%Y-%m-%d'), 'open') || ']' || CASE WHEN upto IS NULL THEN '' ELSE ' [superseded]' END) AS line_md5,
strftime(ts, '%Y-%m-%d') || ' to ' || coalesce(strftime(upto, '%Y-%m-%d'), 'present') AS range FROM s""")
def f12_fact_lines(spark, sf_dir):
    """Facts as lines with negation, validity and a mark where they are superseded."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("user_id").alias("slot"), F.col("ts").alias("clock"), F.col("event_type").alias("object"))
    f = context.supersede(e)
    day = lambda c: F.date_format(F.col(c), "yyyy-MM-dd")
    line = F.concat(
        F.lit("user "), F.col("user_id").cast("string"), F.when(F.col("value") < 0, " NOT ").otherwise(" "), F.lit("does "), "object",
        F.lit(" [valid "), day("clock"), F.lit(" to "), F.coalesce(day("superseded_at"), F.lit("open")), F.lit("]"), F.when(F.col("superseded_at").isNull(), "").otherwise(" [superseded]"),
    )
    return f.select("event_id", F.md5(line).alias("line_md5"), dates.date_range(day("clock"), day("superseded_at")).alias("range"))


@query("""SELECT conv_id, sha256(string_agg(role || chr(31) || coalesce(text, ''), chr(30) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY 1""")
def f14_turn_digests(spark, sf_dir):
    """a digest of a conversation's roles and texts with separators that can't be mistaken."""
    one = F.struct("turn", F.concat("role", F.lit("\x1f"), F.coalesce("text", F.lit(""))).alias("t"))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"), F.count("*").alias("turns"))
    return g.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: x["t"]), "\x1e"), 256).alias("digest"), "turns")


def shape_sql(text: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({text}, '(?i)" + "|".join(p).replace("'", "''") + f"') THEN '{name}'" for name, p in shapes.RULES.items())
    words = WORDS.format(text)
    capital = rf"""len(list_filter(range(2, len({words}) + 1), lambda i: regexp_matches(regexp_replace(({words})[i], '^["''(“‘\[]+', ''), '^\p{{Lu}}') AND NOT regexp_matches(regexp_replace(({words})[i - 1], '["'')”’\]]+$', ''), '[.!?]$'))) > 0"""
    return f"CASE {cases} WHEN {capital} THEN 'entity' ELSE 'local' END"


@query(f"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'How long ago was ' WHEN 1 THEN 'Please recommend ' WHEN 2 THEN 'what did ' ELSE '' END || split_part(text, '.', 1) AS q FROM documents WHERE text IS NOT NULL) SELECT doc_id, {shape_sql('q')} AS shape FROM t""")
def f17_question_shapes(spark, sf_dir):
    """shapes of questions made of the documents' first sentences, by the ordered rules."""
    opening = F.when(F.col("doc_id") % 4 == 0, "How long ago was ").when(F.col("doc_id") % 4 == 1, "Please recommend ").when(F.col("doc_id") % 4 == 2, "what did ").otherwise("")
    t = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat(opening, F.substring_index("text", ".", 1)).alias("q"))
    return t.select("doc_id", shapes.shape(F.col("q")).alias("shape"))


@query("""WITH t AS (SELECT event_id, CASE event_type WHEN 'error' THEN ' Temporal ' WHEN 'click' THEN 'multi-hop.' WHEN 'view' THEN 'LOCAL' ELSE event_type END AS reply, CASE event_id % 5 WHEN 0 THEN 'multi-session' WHEN 1 THEN 'null_query' WHEN 2 THEN 'temporal_query' WHEN 3 THEN 'odd' ELSE 'single-session-user' END AS kind, value < 1 AS abstain FROM events),
o AS (SELECT *, CASE WHEN abstain THEN 'unanswerable' WHEN kind = 'multi-session' THEN 'cross-topic' WHEN kind = 'null_query' THEN 'unanswerable' WHEN kind = 'temporal_query' THEN 'temporal' WHEN kind = 'single-session-user' THEN 'local' END AS oracle, lower(trim(reply)) AS label FROM t),
p AS (SELECT *, label IN ('local', 'entity', 'thematic', 'cross-topic', 'multi-hop', 'temporal', 'lexical', 'unanswerable') AS ok FROM o)
SELECT CASE WHEN ok THEN label ELSE 'local' END AS shape, NOT ok AS off_list, oracle, count(*) AS n FROM p GROUP BY ALL""")
def f21_labels_against_the_oracle(spark, sf_dir):
    """Replies parsed strictly, beside the shape that the type of the question stands for."""
    kind = F.when(F.col("event_id") % 5 == 0, "multi-session").when(F.col("event_id") % 5 == 1, "null_query").when(F.col("event_id") % 5 == 2, "temporal_query").when(F.col("event_id") % 5 == 3, "odd").otherwise("single-session-user")
    reply = F.when(F.col("event_type") == "error", " Temporal ").when(F.col("event_type") == "click", "multi-hop.").when(F.col("event_type") == "view", "LOCAL").otherwise(F.col("event_type"))
    t = table(spark, sf_dir, "events").select(shapes.parse_label(reply).alias("p"), shapes.oracle_shape(kind, F.col("value") < 1).alias("oracle"))
    return t.groupBy("p.shape", "p.off_list", "oracle").agg(F.count("*").alias("n"))


TITLE_SQL = r"""regexp_extract(html, '<title>([^<]*)</title>', 1)"""


@query(rf"""WITH c AS (SELECT page_id, url, {TITLE_SQL} AS title FROM pages), n AS (SELECT *, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS norm FROM c),
r AS (SELECT page_id AS ref, CASE page_id % 3 WHEN 0 THEN title WHEN 1 THEN 'no such title' ELSE '  ' || replace(title, ' ', '   ') END AS title, CASE WHEN page_id % 3 = 1 THEN url ELSE 'none' END AS url FROM c),
a AS (SELECT title, max(page_id) AS doc FROM c WHERE title <> '' GROUP BY 1), b AS (SELECT url, max(page_id) AS doc FROM c GROUP BY 1), d AS (SELECT norm, max(page_id) AS doc FROM n WHERE norm <> '' GROUP BY 1)
SELECT ref, coalesce(a.doc, b.doc, d.doc) AS doc, CASE WHEN a.doc IS NOT NULL THEN 'title' WHEN b.doc IS NOT NULL THEN 'url' WHEN d.doc IS NOT NULL THEN 'normalised title' ELSE 'none' END AS resolved_by
FROM r LEFT JOIN a USING (title) LEFT JOIN b USING (url) LEFT JOIN d ON d.norm = lower(trim(regexp_replace(r.title, '\s+', ' ', 'g')))""")
def j4_evidence_resolution(spark, sf_dir):
    """References to pages by title, else by URL, else by normalised title; of several pages the last counts."""
    norm = lambda c: F.lower(T.collapse(F.col(c)))
    c = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    r = c.select(
        F.col("page_id").alias("ref"), F.when(F.col("page_id") % 3 == 0, F.col("title")).when(F.col("page_id") % 3 == 1, "no such title").otherwise(F.concat(F.lit("  "), F.replace("title", F.lit(" "), F.lit("   ")))).alias("title"),
        F.when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("none").alias("url"),
    ).withColumn("norm", norm("title"))
    last = lambda key, out: c.withColumn("norm", norm("title")).where(F.col(key) != "").groupBy(key).agg(F.max("page_id").alias(out))
    j = r.join(last("title", "a"), "title", "left").join(last("url", "b"), "url", "left").join(last("norm", "d"), "norm", "left")
    by = F.when(F.col("a").isNotNull(), "title").when(F.col("b").isNotNull(), "url").when(F.col("d").isNotNull(), "normalised title").otherwise("none")
    return j.select("ref", F.coalesce("a", "b", "d").alias("doc"), by.alias("resolved_by"))


@query("""WITH f AS (SELECT conv_id, turn AS sid, md5(text) AS content, first_value(md5(text)) OVER (PARTITION BY turn ORDER BY conv_id) AS original FROM conversations)
SELECT conv_id, CASE WHEN content IS NOT DISTINCT FROM original THEN 'sess' || sid ELSE 'sess' || sid || '@' || conv_id END AS session_id FROM f""")
def s10_sessions_without_conflicts(spark, sf_dir):
    """A session id that several questions use for other content than the first one gets the question's id added."""
    return files.deconflicted(table(spark, sf_dir, "conversations").withColumn("sid", F.concat(F.lit("sess"), "turn")), "sid", "conv_id", F.md5("text")).select("conv_id", F.col("unique_id").alias("session_id"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n > 1 THEN l_partkey || '@occ' || n ELSE l_partkey::VARCHAR END AS occurrence_id FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 100 + l_linenumber, l_suppkey) AS n FROM lineitem)""")
def s22_occurrence_ids(spark, sf_dir):
    """Ids that say which occurrence they are, from the second on."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("key"), F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("n"), "l_suppkey").alias("place"))
    return files.occurrence_ids(t, "key", "place").select("l_orderkey", "l_linenumber", "occurrence_id")


@query("""WITH m AS (SELECT conv_id, turn, role, text, turn % 3 + 1 AS plan, CASE WHEN turn % 4 = 0 THEN 'day ' || turn ELSE ' ' END AS anchor FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY plan, turn) - 1 AS ordinal FROM m)
SELECT conv_id, ordinal, turn AS message_id, role, last_value(nullif(trim(anchor), '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY ordinal) AS time_anchor FROM o WHERE true QUALIFY trim(coalesce(text, '')) <> ''""")
def s13_nested_chats(spark, sf_dir):
    """Chats nested as plan-N lists of messages, flattened in the order of N, with time anchors carried forward and blank messages left out."""
    t = table(spark, sf_dir, "conversations")
    anchor = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("day "), "turn")).otherwise(" ")
    one = F.struct("turn", F.col("turn").alias("id"), "role", F.coalesce("text", F.lit("")).alias("content"), anchor.alias("time_anchor"))
    plans = t.groupBy("conv_id", F.concat(F.lit("plan-"), F.col("turn") % 3 + 1).alias("plan")).agg(F.sort_array(F.collect_list(one)).alias("m"))
    chats = plans.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("plan", "m"))).alias("plans"))
    flat = files.chat_messages(chats, files.plans_in_order(F.col("plans")), "conv_id")
    return flat.select("conv_id", long("ordinal"), "message_id", "role", "time_anchor")


@query(f"""WITH {sim_sql('s', depth=10)}, {sim_sql('h', 32, 10)}, q AS (SELECT doc_id, quality FROM labels WHERE quality > 0),
u AS (SELECT qid, uid, min(l * 1000 + rank) AS spot FROM (SELECT qid, uid, 0 AS l, rank FROM s UNION ALL SELECT qid, uid, 1, rank FROM h) GROUP BY ALL)
SELECT qid, uid, row_number() OVER (PARTITION BY qid ORDER BY spot) AS pos, coalesce(quality, 0) AS relevance FROM u LEFT JOIN q ON q.doc_id = uid""")
def s11_candidate_pools(spark, sf_dir):
    """Candidate pools of two rankings without repeats in order, with positive judgements alone."""
    pool = channels.union_in_order([_search(spark, sf_dir, 10), _search(spark, sf_dir, 10, 32)], "uid")
    rel = table(spark, sf_dir, "labels").where("quality > 0").select(F.col("doc_id").alias("uid"), F.col("quality").alias("relevance"))
    return pool.join(rel, "uid", "left").select("qid", "uid", F.col("rank").cast("long").alias("pos"), F.coalesce("relevance", F.lit(0)).alias("relevance"))


@query(r"""WITH e AS (SELECT conv_id, turn, 'see D' || conv_id || ':' || (turn + 1) || '; D' || conv_id || ':' || (turn + 40) || ' and D' || conv_id || ':' || (turn + 1) AS evidence FROM conversations WHERE role = 'user'),
x AS (SELECT conv_id, turn, unnest(regexp_extract_all(evidence, 'D\d+:\d+')) AS id FROM e), k AS (SELECT 'D' || conv_id || ':' || turn AS id FROM conversations), d AS (SELECT DISTINCT conv_id, turn, id FROM x)
SELECT conv_id, turn, count(k.id) AS resolved, count(*) - count(k.id) AS unresolved, count(*) = count(k.id) AS complete FROM d LEFT JOIN k USING (id) GROUP BY ALL""")
def s17_evidence_ids(spark, sf_dir):
    """Evidence ids found in texts, told apart by whether the conversation has the turn."""
    t = table(spark, sf_dir, "conversations")
    ref = lambda n: F.concat(F.lit("D"), "conv_id", F.lit(":"), F.col("turn") + n)
    e = t.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("see "), ref(1), F.lit("; "), ref(40), F.lit(" and "), ref(1)).alias("evidence"))
    known = t.select(ref(0).alias("id"))
    return files.evidence_ids(e, "evidence", r"D\d+:\d+", known, ["conv_id", "turn"])


@query("""WITH c AS (SELECT p_partkey, unnest([p_brand, p_type, p_name, 'size ' || p_size]) AS opt, unnest([true, false, false, false]) AS right_one FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256('42|' || p_partkey || '|' || opt), opt) AS r FROM c)
SELECT p_partkey, substr('ABCD', r, 1) AS letter, opt, right_one AS correct FROM o""")
def s18_shuffled_options(spark, sf_dir):
    """A right answer and three others as options A to D, in an order that a seeded hash gives."""
    p = table(spark, sf_dir, "part")
    one = lambda c, right: F.struct(c.alias("opt"), F.lit(right).alias("correct"))
    c = p.select("p_partkey", F.explode(F.array(one(F.col("p_brand"), True), one(F.col("p_type"), False), one(F.col("p_name"), False), one(F.concat(F.lit("size "), "p_size"), False))).alias("x")).select("p_partkey", "x.*")
    return files.shuffled_options(c, "p_partkey", "opt", 42)


@query("""WITH t AS (SELECT text, min(doc_id) AS id, list_sort(list(DISTINCT source)) AS aliases, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT sha256(text) AS passage_id, id AS first_doc, array_to_string(aliases, '|') AS aliases, n FROM t""")
def s20_passages_by_text(spark, sf_dir):
    """Passages with ids made of their exact text, and the names under which they came."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("passage_id"), "doc_id", "source")
    g = d.groupBy("passage_id").agg(F.min("doc_id").alias("first_doc"), F.array_join(F.sort_array(F.collect_set("source")), "|").alias("aliases"), F.count("*").alias("n"))
    return g


@query("""WITH m AS (SELECT vec_id, label AS topic_id, 'variant' || vec_id % 2 AS variant FROM embeddings WHERE label > 0), g AS (SELECT variant, topic_id, list(vec_id) AS members FROM m GROUP BY ALL)
SELECT variant, topic_id, unnest(members) AS unit FROM g WHERE variant = 'variant1'""")
def s28_group_members(spark, sf_dir):
    """Groups with lists of members under other column names, without the outlier group, of one variant, a row a member."""
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("member"), F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("topic"), F.concat(F.lit("variant"), F.col("vec_id") % 2).alias("variant"))
    lists = raw.groupBy("variant", "topic").agg(F.collect_list("member").alias("members"))
    return files.group_members(lists, {"topic_id": ["topic_id", "topic"], "members": ["members", "units"]}, "variant1").select("variant", "topic_id", "unit")


LINK_SETS_SQL = """t AS (SELECT lang AS topic, doc_id AS unit FROM documents), c AS (SELECT source AS community, doc_id AS unit FROM documents), s AS (SELECT topic, community, count(*) AS shared FROM t JOIN c USING (unit) GROUP BY ALL HAVING count(*) >= 5),
n AS (SELECT community, count(*) AS n FROM c GROUP BY 1), pr AS (SELECT topic, community, shared / n AS w, shared % 7 <> 0 AS parse_ok FROM s JOIN n USING (community))"""


@query(f"""WITH {LINK_SETS_SQL}, l AS (SELECT 'R2' AS link_set, topic, community, w FROM pr WHERE parse_ok UNION ALL SELECT 'R3', topic, community, w FROM pr WHERE parse_ok AND w >= 0.7) SELECT link_set, topic, community, round(w, 6) AS w FROM l""")
def s29_link_sets(spark, sf_dir):
    """Proposals of links as named sets: none (R0), all that parsed (R2), those of weight 0.7 and more."""
    d = table(spark, sf_dir, "documents")
    c = d.select(F.col("source").alias("community"), F.col("doc_id").alias("unit"))
    pairs = graph.bridge(d.select(F.col("lang").alias("topic"), F.col("doc_id").alias("unit")), c)
    p = pairs.join(c.groupBy("community").agg(F.count("*").alias("n")), "community").select("topic", "community", (F.col("shared") / F.col("n")).alias("w"), (F.col("shared") % 7 != 0).alias("parse_ok"))
    return graph.link_sets(p).select("link_set", "topic", "community", F.round("w", 6).alias("w"))


@query("""WITH m AS (SELECT DISTINCT l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN 'p' || l_partkey ELSE l_partkey::VARCHAR END AS chunk FROM lineitem)
SELECT l_suppkey, count(*) AS n, md5(string_agg(chunk, ',' ORDER BY NOT regexp_matches(chunk, '^[0-9]+$'), CASE WHEN regexp_matches(chunk, '^[0-9]+$') THEN chunk::BIGINT END, chunk)) AS mentions_md5 FROM m GROUP BY 1""")
def s30_mentions_numeric_first(spark, sf_dir):
    """What mentions an entity, without repeats, numeric ids first and by their number, then the others."""
    chunk = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).otherwise(F.col("l_partkey").cast("string"))
    m = table(spark, sf_dir, "lineitem").select("l_suppkey", chunk.alias("chunk")).distinct()
    listed = m.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct(*files.numeric_first(F.col("chunk")), "chunk"))).alias("l"), F.count("*").alias("n"))
    return listed.select("l_suppkey", "n", F.md5(F.array_join(F.transform("l", lambda x: x["chunk"]), ",")).alias("mentions_md5"))


QUERIES, ORACLES = query.queries, query.oracles
