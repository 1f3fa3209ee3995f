"""Paired comparisons, corrections and intervals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from facetspark.sources.scratch import cut

DRAWS = 10_000


def paired(population: DataFrame, a: DataFrame, b: DataFrame, key: str = "qid") -> DataFrame:
    """(key, a, b) for the whole population; what an arm lacks counts as zero."""
    zero = lambda df, name: df.select(key, F.col("value").alias(name))
    return population.join(zero(a, "a"), key, "left").join(zero(b, "b"), key, "left").select(key, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def compare(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Means, delta, wins, ties, losses and effect size (delta over the sample deviation of differences) for each key."""
    d = F.col("b") - F.col("a")
    return pairs.withColumn("d", d).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("delta"),
        F.count_if(F.col("d") > 1e-12).alias("wins"), F.count_if(F.abs("d") <= 1e-12).alias("ties"), F.count_if(F.col("d") < -1e-12).alias("losses"),
        F.when(F.stddev_samp("d") > 0, F.avg("d") / F.stddev_samp("d")).alias("effect"),
    )


def _draws(rows: DataFrame, name: str, unit: str, each: int, draws: int) -> DataFrame:
    """Rows with draw and digits: every row in every draw, with 32 / each hexadecimal digits that a hash of draws and unit gives it.

    One hash serves `each` draws, and tasks make the draws of the rows that they hold.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // each))).alias("_block")
    hashed = rows.select("*", blocks).withColumn("_h", F.md5(F.concat_ws("|", F.lit(name), "_block", F.col(unit).cast("string"))))
    wide = 32 // each
    parts = F.array(*[F.struct((F.col("_block") * each + j).alias("draw"), F.substring("_h", j * wide + 1, wide).alias("digits")) for j in range(each)])
    return hashed.select(*rows.columns, F.explode(parts).alias("_d")).select(*rows.columns, "_d.draw", "_d.digits").where(F.col("draw") < draws)


def sign_flips(pairs: DataFrame, key: str, draws: int = DRAWS) -> DataFrame:
    """(key, p): the share of draws, with one added, whose mean difference under random signs is at least the observed one.

    Signs are bits of a hash of draw and question, so draws are summed by partial aggregates and no task sees all questions.
    """
    d = cut(pairs.select(key, "qid", (F.col("b") - F.col("a")).alias("d")))  # used twice
    drawn = _draws(d, "flip", "qid", 32, draws).groupBy(key, "draw").agg(F.avg(F.when(F.col("digits") >= "8", F.col("d")).otherwise(-F.col("d"))).alias("m"))
    seen = d.groupBy(key).agg(F.avg("d").alias("observed"))
    hits = drawn.join(F.broadcast(seen), key)  # a row for each test
    return hits.groupBy(key).agg(((F.count_if(F.abs("m") >= F.abs("observed") - 1e-12) + 1) / F.lit(draws + 1)).alias("p"))


#: Upper ends of the 16-bit numbers that stand for 0, 1, 2, ... of a Poisson variable with mean 1.
POISSON = [round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]


def bootstrap_interval(rows: DataFrame, key: str, unit: str, total: str, size: str, draws: int = DRAWS) -> DataFrame:
    """(key, low, high): the 95 % percentile interval of sum(total) / sum(size) when units are drawn with replacement.

    How often a unit is drawn is Poisson with mean 1, from a hash of draw and unit; so units may be spread over all tasks.
    """
    drawn = _draws(rows.select(key, unit, F.col(total).alias("_t"), F.col(size).alias("_s")), "boot", unit, 8, draws)
    number = F.conv("digits", 16, 10).cast("int")
    weight = sum((F.when(number >= edge, 1).otherwise(0) for edge in POISSON[1:]), F.when(number >= POISSON[0], 1).otherwise(0))
    ratios = drawn.withColumn("_w", weight).groupBy(key, "draw").agg((F.sum(F.col("_w") * F.col("_t")) / F.nullif(F.sum(F.col("_w") * F.col("_s")), F.lit(0))).alias("r"))
    q = lambda x: F.expr(f"percentile(r, {x})")  # noqa: E731 - over the draws of a test, which are a fixed number
    return ratios.groupBy(key).agg(q(0.025).alias("low"), q(0.975).alias("high"))


def holm(tests: DataFrame, family: str, p: str = "p", name: str = "test", alpha: float = 0.05) -> DataFrame:
    """holm_p and significant for each test of a family: step-down from the smallest p."""
    w = W.partitionBy(family).orderBy(p, name)
    i, m = F.row_number().over(w), F.count("*").over(W.partitionBy(family))
    steps = tests.withColumn("_raw", F.least(F.lit(1.0), (m - i + 1) * F.col(p)))
    adjusted = F.max("_raw").over(w.rowsBetween(W.unboundedPreceding, 0))
    return steps.withColumn("holm_p", adjusted).withColumn("significant", F.col("holm_p") <= alpha).drop("_raw")


def mcnemar_cells(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The four cells of two binary judgements; rows with a null are left out."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cell = lambda i, j: F.count_if((F.col(x) == i) & (F.col(y) == j))
    return ok.groupBy(*keys).agg(cell(1, 1).alias("both"), cell(1, 0).alias("only_x"), cell(0, 1).alias("only_y"), cell(0, 0).alias("neither"))


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact p for the two discordant cells."""
    n = b + c
    if n == 0:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)


def order_statistics(df: DataFrame, col: str, ranks, keep: int = 1000) -> dict[int, float]:
    """The values of a numeric column at the one or two ranks (from 0, ascending) that ranks(n) names; none without values.

    Values are counted once; then the span that holds the wanted ranks is halved 1,024-fold a round, with a row a bin
    at the driver, until at most `keep` different values are left in it. No task and no buffer holds all values.
    """
    counts = cut(df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("c")))
    n, low, high = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.min("v"), F.max("v")).first()
    if not n:
        return {}
    first, last = ranks(n)
    before, inside = 0, counts
    while high > low and inside.limit(keep + 1).count() > keep:
        width = (high - low) / 1024
        bins = F.least(F.lit(1023), F.floor((F.col("v") - low) / width)).cast("int")
        rows = sorted(inside.groupBy(bins.alias("b")).agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["b"])
        edges = []
        upto = before
        for r in rows:
            if upto <= last and upto + r["c"] > first:
                edges.append((upto, r["lo"], r["hi"]))
            upto += r["c"]
        before, narrower = edges[0][0], (edges[0][1], edges[-1][2])
        if narrower == (low, high):
            break
        low, high = narrower
        inside = counts.where(F.col("v").between(low, high))
    values, upto = {}, before
    for v, c in sorted((r["v"], r["c"]) for r in inside.collect()):  # at most `keep` rows
        for rank in (first, last):
            if upto <= rank < upto + c:
                values[rank] = v
        upto += c
    return values


def exact_percentile(df: DataFrame, col: str, share: float) -> float | None:
    """The linearly interpolated percentile, exact at every size; None without values."""
    sizes = []
    found = order_statistics(df, col, lambda n: (sizes.append(n), math.floor(share * (n - 1)), math.ceil(share * (n - 1)))[1:])
    if not found:
        return None
    at = share * (sizes[0] - 1)
    low, high = found[math.floor(at)], found[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))
