"""Queries over texts and conversations: units, cleaning, keywords, deduplication, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from facetspark.functions import text as T
from facetspark.operators import communities, context, graph, metrics, units
from facetspark.sources.scratch import written

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


WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
#: Sentences without lookbehind: mark the ends, then split.
SENT = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n\n+', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) >= {1})"


@query(f"""WITH s AS (SELECT doc_id, {SENT.format('text', 4)} AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i - 1 AS pos, md5(s[i]) AS sentence_md5, length(s[i]) AS n_chars FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""")
def t1_sentences(spark, sf_dir):
    s = units.exploded(table(spark, sf_dir, "documents"), T.sentences(F.col("text")), "doc_id", "s")
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("s").alias("sentence_md5"), F.length("s").cast("long").alias("n_chars"))


def window_sql(size: int, overlap: int, tail: int) -> str:
    return f"""WITH w AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, text, w, CASE WHEN len(w) > {size} THEN range(0, len(w), {size - overlap}) WHEN len(w) > 0 THEN [0] ELSE [] END AS starts FROM w),
u AS (SELECT doc_id, text, unnest(starts) AS s, w FROM r), v AS (SELECT doc_id, s, w[s + 1 : s + {size}] AS run, len(w) <= {size} AS short, text FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS pos, len(run) AS n_words, md5(CASE WHEN short THEN text ELSE array_to_string(run, ' ') END) AS window_md5 FROM v WHERE short OR len(run) >= {tail}"""


def _windowed(spark, sf_dir, spans):
    split = table(spark, sf_dir, "documents").select("doc_id", "text", T.words(F.col("text")).alias("w"))
    w = split.select("doc_id", F.posexplode(spans(F.col("w"), F.col("text"))).alias("pos", "s"))
    return w.select("doc_id", F.col("pos").cast("long").alias("pos"), F.size(T.words(F.col("s"))).cast("long").alias("n_words"), F.md5("s").alias("window_md5"))


@query(window_sql(180, 60, 15))
def t2_card_windows(spark, sf_dir):
    """Windows of 180 words that overlap by 60; a short text stays whole, white space and all."""
    return _windowed(spark, sf_dir, T.card_windows)


@query(window_sql(180, 60, 20))
def t4_sub_chunks(spark, sf_dir):
    return _windowed(spark, sf_dir, T.sub_chunks)


@query(window_sql(100, 0, 1))
def t5_word_chunks(spark, sf_dir):
    return _windowed(spark, sf_dir, T.word_chunks)


@query()
def t7_packed_chunks(spark, sf_dir):
    return units.pack(table(spark, sf_dir, "documents"), 120)


@query(rf"""WITH t AS (SELECT *, {SENT.format('text', 3)} AS us, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: len({WORDS.format('x')}) >= 3) AS al FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN CASE WHEN len(us) = 0 THEN [trim(text)] ELSE us END ELSE CASE WHEN len(al) = 0 THEN [trim(text)] ELSE al END END AS p FROM t),
f AS (SELECT conv_id, turn, role, len(p) AS n, unnest(p) AS line, unnest(range(0, len(p))) AS i FROM p),
g AS (SELECT *, CASE WHEN role = 'user' OR n <= 10 THEN i WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1) ELSE n % 10 + (i - (n % 10) * (n // 10 + 1)) // (n // 10) END AS pos FROM f)
SELECT conv_id, turn, role, pos, md5(string_agg(line, chr(10) ORDER BY i)) AS part_md5 FROM g GROUP BY ALL""")
def t12_turn_parts(spark, sf_dir):
    p = units.split_turns(table(spark, sf_dir, "conversations"))
    return p.select("conv_id", "turn", "role", F.col("pos").cast("long").alias("pos"), F.md5("part").alias("part_md5"))


@query("SELECT conv_id, turn, ntile(3) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations")
def t13_position_groups(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.ntile(3).over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("grp"))


#: The cleaning of a body as SQL, step by step; marks as in functions.text.
CLEAN_SQL = r"""a AS (SELECT id, raw, list_min(list_filter([{marks}], lambda x: x > 0)) AS cut FROM src),
b AS (SELECT id, trim(array_to_string(list_filter(regexp_split_to_array(CASE WHEN cut IS NULL THEN raw ELSE substr(raw, 1, cut - 1) END, '\r\n|\n|\r'), lambda x: NOT regexp_matches(x, '^\s*>')), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own FROM a),
c AS (SELECT id, own, list_min(list_filter([{signs}], lambda x: x > length(own) * 0.66)) AS cut FROM b),
d AS (SELECT id, trim(CASE WHEN cut IS NULL THEN own ELSE substr(own, 1, cut) END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own FROM c),
body AS (SELECT id, trim(regexp_replace(regexp_replace(own, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d)""".format(
    marks=", ".join(f"strpos(lower(raw), '{m}')" for m in T.REPLY_MARKERS),
    signs=", ".join("CASE WHEN contains(lower(own), {0}) THEN length(own) - strpos(reverse(lower(own)), reverse({0})) - {1} + 1 ELSE -1 END".format("'" + m.replace("\n", "' || chr(10) || '") + "'", len(m)) for m in T.SIGNATURE_MARKERS),
)
#: A mail made of two turns, as one that answers and quotes the other.
MAIL_SQL = """src AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text || CASE a.turn % 4 WHEN 0 THEN chr(10) || 'Thanks,' || chr(10) || 'A.' WHEN 1 THEN chr(10) || '-- ' || chr(10) || 'B.' ELSE '' END || chr(10) || CASE a.turn % 3 WHEN 0 THEN '-----Original Message-----' || chr(10) || b.text
ELSE '> ' || replace(b.text, chr(10), chr(10) || '> ') END AS raw FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _mails(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("quoted"))
    sign = F.when(F.col("turn") % 4 == 0, "\nThanks,\nA.").when(F.col("turn") % 4 == 1, "\n-- \nB.").otherwise("")
    quote = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("-----Original Message-----\n"), "quoted")).otherwise(F.concat(F.lit("> "), F.replace("quoted", F.lit("\n"), F.lit("\n> "))))
    return t.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", sign, F.lit("\n"), quote).alias("raw"))


@query(f"WITH {MAIL_SQL}, {CLEAN_SQL} SELECT id, md5(body) AS body_md5, length(body) AS n_chars FROM body")
def t19_clean_body(spark, sf_dir):
    """Mails that quote and sign, without quotes and signatures and with white space made regular."""
    body = T.clean_body(F.col("raw"))
    return _mails(spark, sf_dir).select("id", F.md5(body).alias("body_md5"), F.length(body).cast("long").alias("n_chars"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
h AS (SELECT doc_id, CAST(concat('0x', substr(md5(s), 1, 7)) AS BIGINT) AS h FROM s),
m AS (SELECT doc_id, i, min((h * ((i * 2654435761 + 1) % 4294967296)) % 4294967296) AS m FROM h, range(0, 32) r(i) GROUP BY ALL),
g AS (SELECT doc_id, string_agg(m::VARCHAR, ',' ORDER BY i) AS signature FROM m GROUP BY 1)
SELECT doc_id, md5(signature) AS signature_md5, min(doc_id) OVER (PARTITION BY signature) AS first_id FROM g""")
def t21_minhash_signatures(spark, sf_dir):
    g = written(units.minhash_groups(table(spark, sf_dir, "documents")))  # used twice
    first = g.groupBy("signature").agg(F.min("doc_id").alias("first_id"))
    return g.join(first, "signature").select("doc_id", F.md5("signature").alias("signature_md5"), "first_id")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")
def p8_first_seen_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    first = d.where("text_sha256 IS NOT NULL").groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_sha256")
    return first.unionByName(d.where("text_sha256 IS NULL"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n_words FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) BETWEEN 20 AND 2000")
def p7_word_count_filter(spark, sf_dir):
    n = F.size(T.words(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_words")).where(F.col("n_words").between(20, 2000))


@query(r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM t WHERE word NOT IN ('that', 'this', 'with', 'from', 'what') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) SELECT * FROM r WHERE rank <= 15""")
def a10_keywords(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    n = t.where(~F.col("word").isin("that", "this", "with", "from", "what")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return n.withColumn("rank", nth.cast("long")).where("rank <= 15")


@query(r"SELECT item_id, md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')) AS answer_md5 FROM benchmark")
def f2_normalised_answers(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(T.normalise_answer(F.col("text"))).alias("answer_md5"))


SHAPES = [("when", r"^(quand|wann|when)\b"), ("list", r",.*,.*,"), ("long", r"^.{400,}"), ("quote", r'"')]


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in SHAPES) +
       r" WHEN len(list_filter(list_slice(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), 2, 1000000), lambda w: regexp_matches(w, '^[A-Z][a-z]'))) > 0 THEN 'entity' ELSE 'local' END AS shape FROM conversations WHERE role = 'user'")
def f17_query_shapes(spark, sf_dir):
    text = F.lower("text")
    shape = F.when(text.rlike(SHAPES[0][1]), SHAPES[0][0])
    for name, pattern in SHAPES[1:]:
        shape = shape.when(text.rlike(pattern), name)
    shape = shape.when(T.capitalised_inside(F.col("text")), "entity").otherwise("local")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", shape.alias("shape"))


TOKENS = r"len(regexp_extract_all(text, '\w+'))"


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))).cast("long").alias("tokens"))


@query(f"""WITH t AS (SELECT conv_id, turn, {TOKENS} AS tokens FROM conversations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY tokens DESC, turn ROWS UNBOUNDED PRECEDING) AS upto FROM t)
SELECT conv_id, turn, tokens, least(tokens, 150 - (upto - tokens))::BIGINT AS taken, upto > 150 AS truncated FROM r WHERE upto - tokens < 150 AND (upto <= 150 OR 150 - (upto - tokens) >= 20)""")
def k17_budget_take(spark, sf_dir):
    t = _tokens(spark, sf_dir).drop("role").withColumn("first", -F.col("tokens"))
    return context.budget_take(t, 150, ["conv_id"], ["first", "turn"], least=20).select("conv_id", "turn", "tokens", F.col("taken").cast("long").alias("taken"), "truncated")


@query(f"""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN {TOKENS} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_tokens FROM conversations""")
def k23_carry_forward(spark, sf_dir):
    t = _tokens(spark, sf_dir).withColumn("own", F.when(F.col("role") == "user", F.col("tokens")))
    return context.carry_forward(t, ["conv_id"], ["turn"], "own", "last_user_tokens").select("conv_id", "turn", "last_user_tokens")


@query("""SELECT conv_id, turn, role FROM conversations c WHERE role = 'user' OR EXISTS (SELECT 1 FROM conversations q WHERE q.conv_id = c.conv_id AND q.turn = 0 AND regexp_matches(lower(q.text), '\\?'))""")
def p10_speaker_rule(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    asked = t.where((F.col("turn") == 0) & F.lower("text").rlike(r"\?")).select("conv_id").distinct().withColumn("asks", F.lit(True))
    return t.join(asked, "conv_id", "left").where((F.col("role") == "user") | F.col("asks")).select("conv_id", "turn", "role")


NORM = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


@query(f"""WITH p AS (SELECT a.conv_id * 1000 + a.turn AS id, {NORM.format('b.text')} AS p, {NORM.format('a.text')} AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
x AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(p) AS t FROM p) GROUP BY ALL), y AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(g) AS t FROM p) GROUP BY ALL),
s AS (SELECT id, sum(least(x.n, y.n)) AS same FROM x JOIN y USING (id, t) GROUP BY 1)
SELECT id, round(CASE WHEN len(p) + len(g) > 0 THEN 2 * coalesce(same, 0) / (len(p) + len(g)) ELSE 0 END, 6) AS f1 FROM p LEFT JOIN s USING (id)""")
def e27_token_f1(spark, sf_dir):
    """Token F1 of each turn's answer against the turn before."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(T.normalise_answer(F.col("text"))).alias("t"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("p"))
    pairs = t.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "p", F.col("t").alias("g"))
    return metrics.token_f1(pairs, "id", F.col("p"), F.col("g")).select("id", F.round("f1", 6).alias("f1"))


@query(f"""WITH t AS (SELECT conv_id, turn, {TOKENS} AS tokens FROM conversations),
p AS (SELECT a.conv_id, sign(a.turn - b.turn) AS sx, sign(a.tokens - b.tokens) AS sy FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn)
SELECT conv_id, round(CASE WHEN sum(abs(sx)) > 0 AND sum(abs(sy)) > 0 THEN sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))) END, 6) AS tau FROM p GROUP BY 1""")
def e30_kendall_tau_b(spark, sf_dir):
    out = metrics.kendall_tau_b(_tokens(spark, sf_dir).withColumn("at", F.col("turn")), "conv_id", "at", "tokens", "turn")
    return out.select("conv_id", F.round("tau", 6).alias("tau"))


#: Words that stand for someone, in the languages of the tables.
PRONOUNS = (
    "she", "they", "them", "this", "that", "these", "those", "what", "which",
    "elle", "elles", "nous", "vous", "leur", "cette", "celui",
    "sie", "dies", "diese", "dieser", "welche",
    "ella", "ellos", "este", "esta", "esto",
)
#: A unit's phrases are its different words of four letters and more, the first fifty of them; a stand-in for noun phrases.
PHRASES_SQL = rf"""wd AS (SELECT conv_id * 1000 + turn AS unit, regexp_extract_all(lower(text), '\p{{L}}{{4,}}') AS w FROM conversations),
fp AS (SELECT unit, phrase, min(i) AS i FROM (SELECT unit, unnest(w) AS phrase, unnest(range(0, len(w))) AS i FROM wd) GROUP BY ALL),
every AS (SELECT unit, phrase, phrase IN {PRONOUNS} AS pron FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY i) AS r FROM fp) WHERE r <= 50),
hr AS (SELECT phrase, count(*) AS f, 2 * count(*) FILTER (pron) > count(*) AS pronoun FROM every GROUP BY 1),
hub AS (SELECT *, row_number() OVER (ORDER BY f DESC, phrase) <= floor(0.005 * (SELECT count(*) FROM hr)) AS hub FROM hr),
fr AS (SELECT phrase, f FROM hub WHERE NOT hub AND NOT pronoun), occ AS (SELECT unit, phrase FROM every SEMI JOIN fr USING (phrase)),
pr AS (SELECT x.phrase AS a, y.phrase AS b, count(*) AS n FROM occ x JOIN occ y ON x.unit = y.unit AND x.phrase < y.phrase GROUP BY ALL),
tt AS (SELECT (SELECT sum(n) FROM pr) AS pairs, (SELECT sum(f) FROM fr) AS total),
w AS (SELECT a, b, n, x.f AS fa, y.f AS fb, n / pairs * log2((n / pairs) / (x.f / total * y.f / total)) AS weight FROM pr JOIN fr x ON x.phrase = a JOIN fr y ON y.phrase = b, tt)"""

#: The same with all different words of a unit, however long it is.
EVERY_PHRASE_SQL = PHRASES_SQL.replace("(SELECT *, row_number() OVER (PARTITION BY unit ORDER BY i) AS r FROM fp) WHERE r <= 50", "fp")


def _occurrences(spark, sf_dir, first: int | None = 50):
    """(unit, phrase, pron): a unit's first phrases, or with None all of them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)))
    found = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit"), F.explode(F.slice(words, 1, first) if first else words).alias("phrase"))
    return found.withColumn("pron", F.col("phrase").isin(*PRONOUNS))


def _content(spark, sf_dir):
    """Occurrences (unit, phrase, pron, f) of the phrases that the hub rule leaves, of all in a unit, and their frequencies (phrase, f)."""
    occ = written(_occurrences(spark, sf_dir, None))  # used twice
    freq = graph.hub_rule(occ).where("NOT hub AND NOT pronoun").select("phrase", "f")
    return graph.meet(occ, freq, "phrase"), freq


def _weighted(spark, sf_dir):
    occ, freq = _content(spark, sf_dir)
    return graph.pmi(graph.cooccurrence(occ), freq)


@query(f"WITH {EVERY_PHRASE_SQL} SELECT a, b, n, round(weight, 9) AS weight FROM w")
def a13_cooccurrence_pmi(spark, sf_dir):
    """Phrases that share a unit, after the hub rule, weighted by pointwise mutual information times probability."""
    return _weighted(spark, sf_dir).select("a", "b", "n", F.round("weight", 9).alias("weight"))


PRUNED_SQL = """dg AS (SELECT p, count(*) AS deg FROM (SELECT a AS p FROM w UNION ALL SELECT b FROM w) GROUP BY 1), ego AS (SELECT p FROM dg ORDER BY deg DESC, p LIMIT 1),
w2 AS (SELECT * FROM w WHERE a NOT IN (FROM ego) AND b NOT IN (FROM ego) AND fa >= 2 AND fb >= 2),
pruned AS (SELECT * FROM w2 WHERE weight >= (SELECT quantile_cont(weight, 0.4) FROM w2) AND weight > 0)"""


@query(f"WITH {EVERY_PHRASE_SQL}, {PRUNED_SQL} SELECT a, b, n, round(weight, 9) AS weight FROM pruned")
def p17_pruned_graph(spark, sf_dir):
    return graph.prune(_weighted(spark, sf_dir)).select("a", "b", "n", F.round("weight", 9).alias("weight"))


@query()
def g10_phrase_communities(spark, sf_dir):
    """Communities of the pruned graph by modularity."""
    return communities.modularity_communities(graph.prune(_weighted(spark, sf_dir)))


@query("""WITH t AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY source) AS p FROM t)
SELECT source, sum(c)::BIGINT AS n, round(sum(-p * log2(p)), 6) AS entropy FROM p GROUP BY 1""")
def a18_topic_entropy(spark, sf_dir):
    return graph.entropy(table(spark, sf_dir, "documents"), "source", "lang").withColumn("entropy", F.round("entropy", 6))


@query("""WITH t AS (SELECT lang AS topic, doc_id AS unit FROM documents), c AS (SELECT source AS community, doc_id AS unit FROM documents),
s AS (SELECT topic, community, count(*) AS shared FROM t JOIN c USING (unit) GROUP BY ALL HAVING count(*) >= 5), nt AS (SELECT topic, count(*) AS nt FROM t GROUP BY 1), nc AS (SELECT community, count(*) AS nc FROM c GROUP BY 1),
j AS (SELECT *, shared / (nt + nc - shared) AS jaccard FROM s JOIN nt USING (topic) JOIN nc USING (community)) SELECT topic, community, shared, round(jaccard, 6) AS jaccard, round(shared * (1 - jaccard), 6) AS d FROM j""")
def j9_topic_community_bridge(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    b = graph.bridge(d.select(F.col("lang").alias("topic"), F.col("doc_id").alias("unit")), d.select(F.col("source").alias("community"), F.col("doc_id").alias("unit")))
    return b.select("topic", "community", "shared", F.round("jaccard", 6).alias("jaccard"), F.round("d", 6).alias("d"))


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM n) SELECT source, lang FROM r WHERE r = 1""")
def a16_plurality_label(spark, sf_dir):
    return graph.plurality(table(spark, sf_dir, "documents"), "source", "lang")
