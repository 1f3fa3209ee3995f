"""Queries over the star schema, events and labels: joins, grouping sets, frames, as-of facts, samples, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from facetspark.operators import context, select, stats

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


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 4) AS discount
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def a22_grouping_sets(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    g = t.groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []], F.col("l_returnflag"), F.col("l_linestatus"))
    return g.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 4).alias("discount"))


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p,
round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS price_f FROM orders GROUP BY 1""")
def a23_conditional_cells(spark, sf_dir):
    s = lambda x: F.col("o_orderstatus") == x
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(s("F")).alias("n_f"), F.count_if(s("O")).alias("n_o"), F.count_if(s("P")).alias("n_p"), F.round(F.avg(F.when(s("F"), F.col("o_totalprice"))), 4).alias("price_f")
    )


@query("""SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95,
count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def a31_cohort_percentiles(spark, sf_dir):
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return t.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.expr("percentile(o_totalprice, 0.5)"), 4).alias("p50"),
        F.round(F.expr("percentile(o_totalprice, 0.95)"), 4).alias("p95"), F.countDistinct("o_custkey").alias("customers"),
    )


@query("SELECT n_regionkey, round(regr_slope(ln(o_totalprice), ln(1 + c_acctbal)), 6) AS slope, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND o_totalprice > 0 GROUP BY 1")
def a42_log_log_slope(spark, sf_dir):
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).where("o_totalprice > 0")
    t = t.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.groupBy("n_regionkey").agg(F.round(F.regr_slope(F.log("o_totalprice"), F.log(1 + F.col("c_acctbal"))), 6).alias("slope"), F.count("*").alias("n"))


@query("SELECT least(9, floor(l_discount * 100))::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def a40_histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.least(F.lit(9), F.floor(F.col("l_discount") * 100)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, max(n) AS peak, round(count(*) / (greatest(1e-9, date_diff('microsecond', min(ts), max(ts)) / 6e7)), 6) AS per_minute FROM
(SELECT event_type, ts, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1""")
def k28_sliding_minute_peak(spark, sf_dir):
    """The largest number of events within a minute. Time is cut into hours, and an hour's last minute is seen by the next hour too."""
    hour, minute = 3_600_000_000, 60_000_000
    t = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("hour", F.floor(F.col("us") / hour))
    late = t.where(F.col("us") >= (F.col("hour") + 1) * hour - minute).withColumn("hour", F.col("hour") + 1)
    both = t.withColumn("own", F.lit(True)).unionByName(late.withColumn("own", F.lit(False)))
    w = W.partitionBy("event_type", "hour").orderBy("us").rangeBetween(-minute, 0)
    counted = both.withColumn("n", F.count("*").over(w)).where("own")
    minutes = F.greatest(F.lit(1e-9), (F.max("us") - F.min("us")) / 6e7)
    return counted.groupBy("event_type").agg(F.max("n").alias("peak"), F.round(F.count("*") / minutes, 6).alias("per_minute"))


@query("""SELECT e.event_id, e.user_id, (SELECT min(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.ts > e.ts AND x.event_type <> e.event_type) AS superseded_at FROM events e""")
def j16_supersession(spark, sf_dir):
    """When each event's state is replaced: the user's next event of another type."""
    return _superseded(spark, sf_dir).select("event_id", "user_id", "superseded_at")


def _superseded(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("user_id").alias("slot"), F.col("ts").alias("clock"), F.col("event_type").alias("object"))
    return context.supersede(e)


@query("""WITH s AS (SELECT e.*, (SELECT min(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.ts > e.ts AND x.event_type <> e.event_type) AS upto FROM events e)
SELECT event_id, event_type FROM s WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' AND (upto IS NULL OR upto > TIMESTAMP '2024-01-10 00:00:00')""")
def p14_visible_as_of(spark, sf_dir):
    seen = context.visible(_superseded(spark, sf_dir), F.to_timestamp(F.lit("2024-01-10 00:00:00")))
    return seen.select("event_id", F.col("object").alias("event_type"))


@query("""SELECT e.event_id, coalesce('customer ' || c.c_name, 'supplier ' || s.s_name, 'nation ' || n.n_name) AS resolved,
CASE WHEN c.c_custkey IS NOT NULL THEN 'customer' WHEN s.s_suppkey IS NOT NULL THEN 'supplier' WHEN n.n_nationkey IS NOT NULL THEN 'nation' ELSE 'none' END AS resolved_by
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id * 40 LEFT JOIN supplier s ON s.s_suppkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = e.user_id""")
def j4_cascading_lookup(spark, sf_dir):
    e, c, s, n = (table(spark, sf_dir, x) for x in ("events", "customer", "supplier", "nation"))
    j = e.join(c, F.col("c_custkey") == F.col("user_id") * 40, "left").join(s, F.col("s_suppkey") == F.col("user_id"), "left").join(F.broadcast(n), F.col("n_nationkey") == F.col("user_id"), "left")
    name = F.coalesce(*[F.concat(F.lit(f"{k} "), F.col(x)) for k, x in (("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"))])
    by = F.when(F.col("c_custkey").isNotNull(), "customer").when(F.col("s_suppkey").isNotNull(), "supplier").when(F.col("n_nationkey").isNotNull(), "nation").otherwise("none")
    return j.select("event_id", name.alias("resolved"), by.alias("resolved_by"))


@query("""SELECT 'lineitem without order' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
SELECT 'order without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
SELECT 'repeated order key', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1) UNION ALL
SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def s24_integrity(spark, sf_dir):
    t = lambda x: table(spark, sf_dir, x)
    lost = lambda a, b, on: a.join(b, on, "left_anti")
    rules = [
        ("lineitem without order", lost(t("lineitem"), t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))),
        ("order without customer", lost(t("orders"), t("customer"), F.col("o_custkey") == F.col("c_custkey"))),
        ("repeated order key", t("orders").groupBy("o_orderkey").count().where("count > 1")),
        ("label without document", t("labels").join(t("documents").select("doc_id"), "doc_id", "left_anti")),
    ]
    out = None
    for name, bad in rules:
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT source, n * 100 / sum(n) OVER () AS x FROM s),
b AS (SELECT source, floor(x) AS b, x - floor(x) AS f FROM e), q AS (SELECT source, (b + (row_number() OVER (ORDER BY round(f, 9) DESC, source) <= 100 - sum(b) OVER ())::INT)::BIGINT AS quota FROM b),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('13|' || doc_id), doc_id) AS nth FROM documents) SELECT doc_id, source FROM d JOIN q USING (source) WHERE nth <= quota""")
def l10_proportional_sample(spark, sf_dir):
    """A hundred documents, sources in proportion, in seeded order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    quotas = select.largest_remainder(d.groupBy("source").agg(F.count("*").alias("n")), 100, "source")
    return select.draw_by_quota(d, quotas, "source", "doc_id", 13).select("doc_id", "source")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7|' || o_orderkey), o_orderkey) AS round FROM orders),
p AS (SELECT *, row_number() OVER (ORDER BY round, o_orderpriority) AS pos FROM r) SELECT o_orderkey, o_orderpriority, pos FROM p WHERE pos <= 50""")
def l13_round_robin_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    turns = select.top_by(o, ["o_orderpriority"], [select.seeded(7, F.col("o_orderkey")), F.col("o_orderkey")], 50, "round")  # no more than 50 rounds can be needed
    return turns.withColumn("pos", F.row_number().over(W.orderBy("round", "o_orderpriority")).cast("long")).where("pos <= 50").select("o_orderkey", "o_orderpriority", "pos")


@query("SELECT source, count(*) FILTER (quality = 1 AND toxic = 1) AS both, count(*) FILTER (quality = 1 AND toxic = 0) AS only_x, count(*) FILTER (quality = 0 AND toxic = 1) AS only_y, count(*) FILTER (quality = 0 AND toxic = 0) AS neither FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def x6_mcnemar_cells(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return stats.mcnemar_cells(j, ["source"], "quality", "toxic")


@query("""WITH t AS (SELECT p_type AS family, p_brand AS test, avg(p_retailprice) / 2000 AS p FROM part GROUP BY ALL),
r AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p) AS raw FROM t)
SELECT family, test, round(max(raw) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING), 6) AS holm_p FROM r""")
def x5_holm_adjusted(spark, sf_dir):
    t = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("family"), F.col("p_brand").alias("test")).agg((F.avg("p_retailprice") / 2000).alias("p"))
    return stats.holm(t, "family").select("family", "test", F.round("holm_p", 6).alias("holm_p"))


@query("""SELECT n_name, c_mktsegment, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS top_customer, round(max(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def a3_best_fold(spark, sf_dir):
    t = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    best = F.max(F.struct(F.col("c_acctbal").alias("b"), (-F.col("c_custkey")).alias("m")))
    return t.groupBy("n_name", "c_mktsegment").agg(best.alias("x")).select("n_name", "c_mktsegment", (-F.col("x.m")).alias("top_customer"), F.round("x.b", 2).alias("balance"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only R', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM b)""")
def u3_set_operations(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    a, b = (t.where(F.col("l_returnflag") == x).select("l_partkey").distinct() for x in "RA")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return one(a.intersect(b), "both").unionByName(one(a.subtract(b), "only R")).unionByName(one(a.union(b).distinct(), "either"))


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS a_id, epoch(l_shipdate)::BIGINT AS a_start, epoch(l_shipdate)::BIGINT + l_quantity::BIGINT * 86400 AS a_end FROM lineitem)
SELECT a.k, a.a_id, b.a_id AS b_id, least(a.a_end, b.a_end) - greatest(a.a_start, b.a_start) AS shared FROM a JOIN a b ON a.k = b.k AND a.a_id < b.a_id AND a.a_end > b.a_start AND a.a_start < b.a_end""")
def j6_interval_overlap(spark, sf_dir):
    """Lines of an order whose periods (as many days as their quantity) overlap."""
    start = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("a_id"), start.alias("a_start"), (start + F.col("l_quantity").cast("long") * 86400).alias("a_end"))
    b = a.select("k", *[F.col(f"a_{x}").alias(f"b_{x}") for x in ("id", "start", "end")])
    both = context.overlaps(a, b, "k").where("a_id < b_id")
    return both.select("k", "a_id", "b_id", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("shared"))
