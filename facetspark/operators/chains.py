"""Chains of reuse: what a record stands for when it points to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from facetspark.sources.scratch import written


def resolve_reuse(files: DataFrame, group: list[str], name: str = "variant", data: str = "data", points: str = "reused_from") -> DataFrame:
    """The columns of group, name, source, data and status of files that hold data or point to another file of their group.

    Pointers are doubled: a file without data takes what its target points to, and its target's data once that has any. A chain stays in its
    group, so rounds end once no pointer moves, and after about log2(n) joins where n files of a group stand in a circle, however many
    groups there are. status is own, reused, missing (the chain ends at a file that isn't there
    or has neither data nor a pointer) or cycle; source is the file the data come from. Names are unique in a group; null ones are left out.
    """
    keys = [F.col(c) for c in group]
    known = written(files.where(F.col(name).isNotNull()).select(*keys, F.col(name).alias("_name"), F.col(data).alias("_data"), F.col(points).alias("_to")))
    open_ = known.where("_data IS NULL AND _to IS NOT NULL").select(*group, "_name", "_to")
    # after r rounds a pointer has gone 2^r steps or stands at an end; only cycles go on for more steps than their group has open files
    per = open_.groupBy(*group).agg(F.count("*").alias("n"))
    steps, most, goes = 1, per.agg(F.max("n")).first()[0] or 0, True
    while steps <= most and goes:
        on = open_.select(*group, F.col("_name").alias("_to"), F.col("_to").alias("_next"))
        open_ = written(open_.join(on, [*group, "_to"], "left").select(*group, "_name", F.coalesce("_next", "_to").alias("_to"), F.col("_next").isNotNull().alias("_moved")))
        goes, open_, steps = not open_.where("_moved").isEmpty(), open_.drop("_moved"), steps * 2
    # where a pointer stands: at another one that still goes on, at data, or at an end
    stand = open_.select(*group, F.col("_name").alias("_to"), F.lit(True).alias("_goes_on"), F.lit(None).cast(known.schema["_data"].dataType).alias("_data"))
    stand = stand.unionByName(known.where("_data IS NOT NULL").select(*group, F.col("_name").alias("_to"), F.lit(False).alias("_goes_on"), "_data"))
    found = open_.join(stand, [*group, "_to"], "left")
    status = F.when(F.col("_goes_on"), "cycle").when(F.col("_data").isNotNull(), "reused").otherwise("missing")
    reused = found.select(*group, F.col("_name").alias(name), F.when(F.col("_data").isNotNull(), F.col("_to")).alias("source"), F.col("_data").alias(data), status.alias("status"))
    own = known.where("_data IS NOT NULL OR _to IS NULL").select(
        *group, F.col("_name").alias(name), F.when(F.col("_data").isNotNull(), F.col("_name")).alias("source"), F.col("_data").alias(data), F.when(F.col("_data").isNotNull(), "own").otherwise("missing").alias("status")
    )
    return own.unionByName(reused)
