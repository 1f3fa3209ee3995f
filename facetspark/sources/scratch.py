"""The folder that driver and executors share, and cuts of lineage through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine, as in tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="facetspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    ensure_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again. For long loops: a checkpoint keeps statistics and constraints of the plan before
    it, which grow from round to round; a table that is read has none."""
    spark = df.sparkSession
    path = f"{ensure_dir(spark).rstrip('/')}/facetspark/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
