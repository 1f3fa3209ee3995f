"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, as in tests on one machine, a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="facetspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/facetspark/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cells_for(rows: int) -> int:
    """Cells for a two-level ranking of so many rows: as many as each holds rows, so that both levels stay small."""
    return max(1, math.isqrt(rows))


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: Column, cells: int, out: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in two levels.

    Rows of a key are dealt by `spread` over `cells` cells, ranked inside each cell, and moved up by the
    rows of the cells before. No task holds more than one cell of a key, so a key with most of the rows
    doesn't end up in one task. The order runs by cell, then by `order`.
    """
    cell = f"_{out}_cell"
    dealt = df.withColumn(cell, F.pmod(spread, F.lit(cells)).cast("int"))
    inside = dealt.withColumn(out, (F.row_number().over(W.partitionBy(*keys, cell).orderBy(*order)) - 1).cast("long"))
    if cells == 1:
        return inside.drop(cell)
    before = W.partitionBy(*keys).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*keys, cell).agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(cell).alias("_cell"), "_start")
    )
    same = F.col(cell) == F.col("_cell")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        inside.join(starts, same)
        .withColumn(out, F.col(out) + F.col("_start"))
        .drop(cell, "_cell", "_start", *[f"_k{i}" for i in range(len(keys))])
    )
