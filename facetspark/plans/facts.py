"""Queries over facts with quotes and over topic rows of units and owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetspark.operators import facts
from facetspark.plans.answers import NORMAL
from facetspark.plans.common import Register, table

query = Register()

PLACED_SQL = """u AS (SELECT 'c' || conv_id || '/' || turn AS uid, 'c' || conv_id AS owner FROM conversations), t AS (SELECT DISTINCT label AS topic_id FROM embeddings WHERE label % 4 <> 0),
r AS (SELECT 'c' || user_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE '/' || event_id % 4 END AS unit_id, event_id % 12 AS topic_id, value AS prob FROM events),
p AS (SELECT *, CASE WHEN topic_id NOT IN (SELECT topic_id FROM t) THEN 'topic' WHEN unit_id IN (SELECT uid FROM u) THEN 'direct' WHEN unit_id IN (SELECT owner FROM u) THEN 'owner' ELSE 'unit' END AS found FROM r)"""


def _placed(spark, sf_dir):
    owner = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    units = table(spark, sf_dir, "conversations").select(F.concat(owner("conv_id"), F.lit("/"), F.col("turn").cast("string")).alias("uid"), owner("conv_id").alias("owner"))
    part = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("/"), (F.col("event_id") % 4).cast("string")))
    rows = table(spark, sf_dir, "events").select(F.concat(owner("user_id"), part).alias("unit_id"), (F.col("event_id") % 12).alias("topic_id"), F.col("value").alias("prob"))
    return facts.placed_topics(rows, units, table(spark, sf_dir, "embeddings").where("label % 4 <> 0").select(F.col("label").alias("topic_id"))), units


@query(f"""WITH {PLACED_SQL} SELECT uid, topic_id, round(sum(prob), 6) AS prob FROM
(SELECT unit_id AS uid, topic_id, prob FROM p WHERE found = 'direct' UNION ALL SELECT uid, topic_id, prob FROM p JOIN (SELECT DISTINCT * FROM u) u ON p.unit_id = u.owner WHERE found = 'owner') GROUP BY ALL""")
def j14_unit_topics(spark, sf_dir):
    """Topics of turns from events that name a turn or a whole conversation."""
    placed, units = _placed(spark, sf_dir)
    return facts.unit_topics(placed, units).select("uid", "topic_id", F.round("prob", 6).alias("prob"))


@query(f"WITH {PLACED_SQL} SELECT found, count(*) AS n, count(DISTINCT unit_id) AS ids FROM p GROUP BY 1")
def j14_ignored_rows(spark, sf_dir):
    """How many topic rows are read directly, through an owner, or ignored for their topic or unit."""
    return _placed(spark, sf_dir)[0].groupBy("found").agg(F.count("*").alias("n"), F.countDistinct("unit_id").alias("ids"))


@query(rf"""WITH w AS (SELECT doc_id, '12. ' || text AS source, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, source, 1 + doc_id % 17 AS nth, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 's' END AS subject, CASE WHEN doc_id % 5 = 0 THEN 'not said' ELSE array_to_string(w[1:6], ' ') END AS quote,
  CASE WHEN doc_id % 7 = 0 THEN 'no such object' ELSE array_to_string(w[2:3], ' ') END AS object, CASE WHEN doc_id % 13 = 0 THEN 'rumour' ELSE 'state' END AS kind FROM w WHERE len(w) > 0),
n AS (SELECT *, {NORMAL.format('source')} AS s, {NORMAL.format('quote')} AS q, {NORMAL.format('object')} AS o,
  list_filter(string_split_regex(source, '\r\n|\n|\r'), lambda x: regexp_matches(x, '^\s*\d+\.\s') AND contains({NORMAL.format('x')}, {NORMAL.format('quote')})) AS lines FROM f)
SELECT doc_id, CASE WHEN nth > 16 THEN 'beyond' WHEN trim(subject) = '' OR trim(object) = '' OR trim(quote) = '' THEN 'missing' WHEN NOT contains(s, q) THEN 'quote' WHEN NOT contains(q, o) THEN 'object' WHEN kind <> 'state' THEN 'enum' ELSE 'accepted' END AS verdict,
  CASE WHEN len(lines) = 1 THEN regexp_extract(lines[1], '^\s*(\d+)\.\s', 1)::BIGINT END AS serial FROM n""")
def p21_quoted_facts(spark, sf_dir):
    """Facts that quote the beginning of their document; some quote what isn't there, name another object, or break another rule."""
    words = F.filter(F.split("text", r"[ \n]+"), lambda x: x != "")
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("12. "), "text").alias("source"), words.alias("w")).where("size(w) > 0")
    every = lambda n, odd, rest: F.when(F.col("doc_id") % n == 0, odd).otherwise(rest)
    f = d.select(
        "doc_id", "source", (1 + F.col("doc_id") % 17).alias("nth"), every(11, " ", "s").alias("subject"), F.lit("Was born in").alias("predicate"),
        every(5, "not said", F.array_join(F.slice("w", 1, 6), " ")).alias("quote"), every(7, "no such object", F.array_join(F.slice("w", 2, 2), " ")).alias("object"),
        every(13, "rumour", "state").alias("kind"), F.lit("one").alias("cardinality"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"),
    )
    return facts.validated(f).select("doc_id", "verdict", "serial")


QUERIES, ORACLES = query.queries, query.oracles
