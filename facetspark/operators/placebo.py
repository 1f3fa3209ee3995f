"""Placebo links: as many, between the same ends with the same degrees, but none of the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from facetspark.operators.select import seeded
from facetspark.sources.scratch import written

#: Swaps tried in a round, at least PARTNERS for each bad position; and rounds without a swap after which the repair ends.
TRIES, PARTNERS, PATIENCE = 200_000, 8, 5
#: Rows of a table that is broadcast, at most; larger ones are shuffled.
SMALL = 500_000


def _near(df: DataFrame, rows: int) -> DataFrame:
    """df, which has up to so many rows, as the small side of a join."""
    return F.broadcast(df) if rows <= SMALL else df.hint("merge")


def _positions(df: DataFrame, h: str) -> DataFrame:
    """The rows with their position from 0 in the order of h, ties by the other columns, in the place of h.

    Rows are dealt by ranges of h, numbered as they lie in sorted parts, and moved up by the parts before: a row a part.
    """
    row = F.monotonically_increasing_id().bitwiseAND(2**33 - 1)  # the id's other bits are the part
    placed = df.repartitionByRange(h).sortWithinPartitions(h, *[c for c in df.columns if c != h])
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_row", row).drop(h))
    before = F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = placed.groupBy("_part").count().select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn("pos", F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def _moved(now: DataFrame, moves: DataFrame | None, rows: int) -> DataFrame:
    """now with the communities that positions have got by swaps (pos, to)."""
    if moves is None:
        return now
    return now.join(_near(moves, rows), "pos", "left").select("pos", "topic", F.coalesce("to", "community").alias("community"), "w")


def placebo_links(links: DataFrame, seed: int = 42, rounds: int = 50, distinct: bool = False) -> DataFrame:
    """(topic, community, w, coincident, repeated): links (topic, community, w) with their communities shuffled.

    Every topic and every community keeps its number of links, and a weight stays with its topic. Positions in one random
    order of the links get the communities of another. A position is bad where its pair is a given link or stands at another
    position too. In each round bad positions propose swaps of communities with random positions, where both new
    pairs are neither given nor present; of proposals that share a position or a new pair the first in random order is made. A made
    swap leaves two good positions, so the repair only gains. What is still coincident or repeated after it is marked,
    as where no placebo exists.

    All links are shuffled to be named, matched and searched for bad positions, once. As a swap makes no pair that is given or present, later bad
    positions are among the first ones: rounds keep them and the swaps made in tables of their own, and scan the links where they lie for the positions
    and pairs that they ask for. Only where these are over SMALL are the links shuffled again.

    Same seed and links, same result, however they are partitioned. Links are rows: repeated ones count as often as they stand.
    distinct says that no pair of links is repeated, so that they needn't be searched for that; the result is the same.
    """
    named = links.select("topic", "community", F.col("w").cast("double").alias("w"))
    same = W.partitionBy("topic", "community").orderBy("w")
    named = named.withColumn("_nth", F.lit(1) if distinct else F.row_number().over(same))
    key = F.concat_ws("|", F.col("topic").cast("string"), F.col("community").cast("string"), F.col("_nth").cast("string"))
    drawn = lambda s: F.unhex(F.substring(seeded(seed + s, key), 1, 16))
    named = written(named.withColumn("_h0", drawn(0)).withColumn("_h1", drawn(1)))
    n, idle = named.count(), 0
    given = named.where("_nth = 1").select("topic", "community")
    topics, communities = _positions(named.select("_h0", "topic", "w"), "_h0"), _positions(named.select("_h1", "community"), "_h1")
    now, moves, made_moves = written(topics.join(communities.hint("merge"), "pos").select("pos", "topic", "community", "w")), None, 0

    present = now.select("topic", "community", F.lit(1).alias("stands"), F.lit(False).alias("real"))
    present = present.unionByName(given.select("topic", "community", F.lit(0).alias("stands"), F.lit(True).alias("real")))
    flags = present.repartition("topic", "community").groupBy("topic", "community").agg(F.sum("stands").alias("times"), F.max("real").alias("real"))
    flags = written(flags.where("times > 1 OR (times > 0 AND real)").select(F.col("topic").alias("t"), F.col("community").alias("c"), "real"))
    on = F.col("topic").eqNullSafe(F.col("t")) & F.col("community").eqNullSafe(F.col("c"))
    flagged = written(now.join(_near(flags, flags.count()), on).select("pos", "topic", "community", "real"))
    whole = F.col("topic").isNotNull() & F.col("community").isNotNull()
    nulls, bad = flagged.where(~whole).withColumn("real", F.lit(False)), flagged.where(whole)  # a null pair is no given link, and isn't swapped
    for r in range(rounds):
        left = bad.count()
        if not left:
            break
        partners = min(n, max(PARTNERS, TRIES // left))
        asked = left * partners
        # positions are in random order, so those from a random one on are random; a few bad positions try all others
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "i") % n + F.col("k"), F.lit(n))
        tries = bad.select(F.col("pos").alias("i"), F.col("topic").alias("ti"), F.col("community").alias("ci"), F.explode(F.sequence(F.lit(0), F.lit(partners - 1))).alias("k")).withColumn("j", draw)
        current = _moved(now, moves, made_moves)
        other = current.select(F.col("pos").alias("j"), F.col("topic").alias("tj"), F.col("community").alias("cj"))
        tries = written(other.join(_near(tries, asked), "j").where("i <> j AND ti <> tj AND ci <> cj"))
        pairs = tries.select(F.col("ti").alias("topic"), F.col("cj").alias("community")).unionByName(tries.select(F.col("tj").alias("topic"), F.col("ci").alias("community")))
        taken = given.unionByName(current.select("topic", "community")).join(_near(pairs.distinct(), 2 * asked), ["topic", "community"], "left_semi")
        taken = written(taken.distinct())
        for t, c in (("ti", "cj"), ("tj", "ci")):
            tries = tries.join(_near(taken, 2 * asked), (tries[t] == taken["topic"]) & (tries[c] == taken["community"]), "left_anti")
        what = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y"))
        touched = F.array(what("position", "i", "i"), what("position", "j", "j"), what("pair", "ti", "cj"), what("pair", "tj", "ci"))
        first = F.row_number().over(W.partitionBy("what").orderBy(F.xxhash64(F.lit(seed), F.lit(r), "k", "i", "j"), "i", "k"))
        ranked = tries.select("i", "j", "k", "ci", "cj", F.posexplode(touched).alias("part", "what")).withColumn("place", first)
        made = written(ranked.groupBy("i", "j", "k", "ci", "cj").agg(F.max("place").alias("place")).where("place = 1"))
        swaps = made.count()
        if not swaps:
            idle += 1
            if partners == n or idle == PATIENCE:
                break
            continue
        idle = 0
        swapped = made.select(F.col("i").alias("pos"), F.col("cj").alias("to")).unionByName(made.select(F.col("j").alias("pos"), F.col("ci").alias("to")))
        times = F.count("*").over(W.partitionBy("topic", "community"))
        bad = bad.join(_near(swapped, 2 * swaps), "pos", "left_anti").withColumn("times", times)
        bad = written(bad.where("times > 1 OR real").drop("times"))
        moves = written(swapped if moves is None else moves.join(_near(swapped, 2 * swaps), "pos", "left_anti").unionByName(swapped))
        made_moves += 2 * swaps
        if made_moves > SMALL:
            now, moves, made_moves = written(_moved(now, moves, made_moves)), None, 0
    nth = F.row_number().over(W.partitionBy("topic", "community").orderBy("pos"))
    marks = bad.unionByName(nulls).select("pos", F.col("real").alias("coincident"), (nth > 1).alias("repeated"))
    told = _moved(now, moves, made_moves).join(_near(written(marks), flagged.count()), "pos", "left")
    return told.select("topic", "community", "w", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("coincident", "repeated")])
