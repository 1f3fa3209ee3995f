"""Structured Streaming: items that arrive later, assigned to existing clusters; windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from facetspark.functions.vectors import dot

#: Centroids up to this many numbers are broadcast to the stream's tasks.
MAX_NUMBERS = 4_000_000


def assign_batch(items: DataFrame, centroids: DataFrame, threshold: float = 0.4) -> DataFrame:
    """items (uid, vec), centroids (label, centroid) -> (uid, label, score); -1 under the threshold, ties to the lower label."""
    size = centroids.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()[0]
    if size > MAX_NUMBERS:
        raise ValueError(f"centroids of over {MAX_NUMBERS} numbers; assign them in blocks")
    scored = items.select("uid", "vec").crossJoin(F.broadcast(centroids.select("label", "centroid"))).withColumn("score", dot(F.col("vec"), F.col("centroid")))
    best = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "label"))
    first = scored.withColumn("r", best).where("r = 1")
    return first.select("uid", F.when(F.col("score") >= threshold, F.col("label")).otherwise(F.lit(-1)).alias("label"), "score")


def assign_stream(stream: DataFrame, centroids: DataFrame, assigned: str, residue: str, checkpoint: str, threshold: float = 0.4):
    """Assign each micro-batch and write it by batch number; what fits no cluster goes to the residue, for later discovery.

    A batch that is repeated after a failure overwrites its own folder, so nothing is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = assign_batch(batch, centroids, threshold).persist()
        done.where("label <> -1").write.mode("overwrite").parquet(f"{assigned}/batch={number}")
        done.where("label = -1").select("uid").write.mode("overwrite").parquet(f"{residue}/batch={number}")
        done.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events in time windows and types; events later than `late` are dropped once the watermark has passed their window."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = t.groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")
