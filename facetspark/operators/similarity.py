"""Similarity of a query set to all vectors, folding to parents, ranks and fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from facetspark.functions.vectors import unit
from facetspark.sources.scratch import cut

#: Query vectors that a task holds at a time; more queries are taken in blocks, one scan of the units each.
BLOCK_BYTES = 16_000_000
#: Unit vectors and scores that a task holds at a time, rows that it gives at a time, and pairs that a task scores.
UNIT_BYTES, SCORE_BYTES, ROWS, PAIRS = 8_000_000, 8_000_000, 100_000, 200_000_000


def score_all(queries: DataFrame, units: DataFrame, depth: int | None = None, group: str | None = None) -> DataFrame:
    """(qid, uid, score): dot products of every query (qid, vec) with every unit (uid, vec).

    With depth only the best `depth` of the units that a task holds at a time are given for a query (ties by smaller uid), which hold the
    best of all; with a group column of the units, the best `depth` of each group. Query vectors are broadcast in blocks of bounded size; units are dealt
    over as many tasks as their pairs with a block call for, and a task holds bounded parts of vectors and scores. Null vectors score nothing.
    """
    spark = units.sparkSession
    queries = queries.where("qid IS NOT NULL AND vec IS NOT NULL")
    units = units.where("vec IS NOT NULL")
    count = units.count()
    total = queries.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0] * 8
    blocks = max(1, -(-total // BLOCK_BYTES))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, uid {units.schema['uid'].dataType.simpleString()}, score double"
    qid_type, uid_type = to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(units.schema["uid"].dataType)
    out = []
    for b in range(blocks):
        rows = sorted(queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "vec").collect(), key=lambda r: r["qid"])
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(([r["qid"] for r in rows], np.array([r["vec"] for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            names = pa.array(ids, qid_type)

            def best(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                every = pa.Table.from_batches(held).combine_chunks()
                uid, n = every.column(0).combine_chunks(), every.num_rows
                flat = every.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                u, g = np.array(uid.to_pylist()), np.unique(np.array(every.column(2).to_pylist()), return_inverse=True)[1]
                place = np.lexsort((u, g))  # groups lie together, each by uid
                u, g, flat = u[place], g[place], flat[place]
                starts = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), n)
                uid = uid.take(pa.array(place))
                step = max(1, SCORE_BYTES // (8 * n))
                for at in range(0, len(ids), step):
                    scores = matrix[at : at + step] @ flat.T
                    if depth is None:
                        q, c = np.indices(scores.shape).reshape(2, -1)
                    else:
                        near = np.ones(scores.shape, bool)
                        for lo, hi in zip(starts[:-1], starts[1:]):
                            if hi - lo > depth > 0:  # what is below a group's depth-th score is none of its best
                                part = scores[:, lo:hi]
                                near[:, lo:hi] = ~(part < np.partition(part, hi - lo - depth, axis=1)[:, hi - lo - depth, None])
                        q, c = np.nonzero(near)
                        order = np.lexsort((c, -scores[q, c], g[c], q))
                        q, c = q[order], c[order]
                        runs = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (g[c[1:]] != g[c[:-1]])))
                        keep = np.arange(len(q)) - np.repeat(runs, np.diff(np.append(runs, len(q)))) < depth
                        q, c = q[keep], c[keep]
                    for i in range(0, len(q), ROWS):
                        x, y = q[i : i + ROWS], c[i : i + ROWS]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(at + x)), uid.take(pa.array(y)), pa.array(scores[x, y])], ["qid", "uid", "score"])

            held, size = [], 0
            for batch in batches:
                if len(batch):
                    held.append(batch)
                    size += 8 * len(batch.column(1).flatten())
                if size >= UNIT_BYTES:
                    yield from best(held)
                    held, size = [], 0
            if held:
                yield from best(held)

        dealt = -(-len(rows) * count // PAIRS)
        spread = units.repartition(dealt) if dealt > 1 else units
        out.append(spread.select("uid", "vec", F.lit(0).alias("grp") if group is None else F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp")).mapInArrow(run, kinds))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], kinds)


def ranked(scored: DataFrame, keys: list[str], k: int | None = None, score: str = "score", uid: str = "uid") -> DataFrame:
    """rank from 1 within the keys, by score descending, then uid; the best k where given."""
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), F.asc(uid))))
    return out if k is None else out.where(F.col("rank") <= k)


def top_k(queries: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """The best k units of each query, written once, as a ranking is used several times in most plans."""
    return cut(ranked(score_all(queries, units, depth=k), ["qid"], k))


def max_fold(scored: DataFrame, parent: str = "parent") -> DataFrame:
    """(qid, parent, score): the best unit of each parent."""
    return scored.groupBy("qid", parent).agg(F.max("score").alias("score"))


def rank_fold(ranking: DataFrame, parent: str, depth: int) -> DataFrame:
    """Parents by their best rank, ranked anew, down to depth."""
    best = ranking.groupBy("qid", parent).agg(F.min("rank").alias("first"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("first", parent))).where(F.col("rank") <= depth).drop("first")


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of long-form rankings (qid, uid, rank, weight): score, rank and where each hit came from.

    Channels of weight 0 or less are left out; a missing rank adds nothing; ties go to the smaller uid.
    """
    used = rankings.where(F.col("weight") > 0)
    fused = used.groupBy("qid", "uid").agg(
        F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.sort_array(F.collect_list(F.struct("channel", "rank"))).alias("via")
    )
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "uid")))


def centroids(vectors: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, centroid): the mean vector of each key, with length one."""
    parts = vectors.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return mean.select(key, unit(F.col("mean")).alias("centroid"))


def assign(scored: DataFrame, threshold: float, residue: Column | None = None) -> DataFrame:
    """(uid, label, score): each unit's best centroid (qid), or the residue label where its score is under the threshold."""
    best = scored.groupBy("uid").agg(F.max(F.struct(F.col("score"), (-F.col("qid")).alias("minus"))).alias("b"))
    score = F.col("b.score")
    return best.select("uid", F.when(score >= threshold, -F.col("b.minus")).otherwise(F.lit(-1) if residue is None else residue).alias("label"), score.alias("score"))


def softmax_top(scored: DataFrame, k: int) -> DataFrame:
    """(uid, qid, p, rank): softmax over all centroids' scores of a unit, the k likeliest; ties to the smaller qid."""
    w = W.partitionBy("uid")
    e = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    return e.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "qid"))).where(F.col("rank") <= k).select("uid", "qid", "p", "rank")
