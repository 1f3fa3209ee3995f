"""Sharding by balanced label propagation over groups of equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from facetspark.llm.shared import cells_for, cut, ranked

#: Bytes that a row needs besides its text.
ROW_BYTES = 16
#: Rounds of label propagation at most; it stops at the first round that moves nothing.
ROUNDS = 8


def propagate(state: DataFrame, quota: list[int], rounds: int, cells: int) -> DataFrame:
    """Move members of each group towards the shard that holds most of their neighbours.

    state: (grp, shard, cnt), how many members of a group a shard holds; all members of a group are each
    other's neighbours, so that a group takes at most as many rows as there are shards. quota: how many
    linked rows each shard may hold. Each round
    1. every group names its fullest shard as the target of its members elsewhere;
    2. for each pair of shards, as many rows may move as want to move the other way, and into free room
       beyond that (a table with a row for each pair of shards);
    3. movers of a pair are admitted largest first up to that number.
    No shard passes its quota in any round, as swaps keep sizes and the rest fills free room only.
    """
    spark = state.sparkSession
    shards = len(quota)
    room = spark.createDataFrame([(j, int(q)) for j, q in enumerate(quota)], "shard int, quota long")
    group = W.partitionBy("grp")
    for _ in range(rounds):
        # ties between shards fall by a hash, so that pairs don't all run to low shards
        lean = F.struct(F.col("cnt"), F.xxhash64("grp", "shard").alias("h"), F.col("shard"))
        # a group that no shard can hold heads for the fullest shards that still have room, one after the other
        held = state.groupBy("shard").agg(F.sum("cnt").alias("held"))
        free = room.join(held, "shard", "left").select("shard", (F.col("quota") - F.coalesce("held", F.lit(0))).alias("free"))
        seen = state.join(F.broadcast(free), "shard")
        wish = (
            seen.withColumn("top", F.max(lean).over(group))
            .withColumn("open", F.max(F.when(F.col("free") > 0, lean)).over(group))
            .withColumn("to", F.when((F.col("top.cnt") < F.sum("cnt").over(group)) & (F.col("shard") == F.col("top.shard")), F.lit(None)).otherwise(F.coalesce("open.shard", "top.shard")))
            .where(F.col("to").isNotNull() & (F.col("to") != F.col("shard")))
            .where(F.col("cnt") <= F.coalesce(F.col("open.cnt"), F.col("top.cnt")))
            .select("grp", "shard", "to", "cnt")
        )
        wish = cut(wish)
        ask = wish.groupBy("shard", "to").agg(F.sum("cnt").alias("want"))
        back = ask.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("want").alias("other"))
        pairs = ask.join(back, ["shard", "to"], "left").withColumn("swap", F.least("want", F.coalesce("other", F.lit(0))))
        earlier = W.partitionBy("to").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
        spare = F.greatest(F.lit(0), F.col("free") - F.coalesce(F.sum(F.col("want") - F.col("swap")).over(earlier), F.lit(0)))
        limits = (
            pairs.join(free.withColumnRenamed("shard", "to"), "to")
            .withColumn("may", F.col("swap") + F.least(F.col("want") - F.col("swap"), spare))
            .select("shard", "to", "may")
        )  # a row for each pair of shards at most: shards * shards
        keyed = wish.withColumn("cell", F.pmod(F.xxhash64("grp"), F.lit(cells)).cast("int"))
        cell_sum = keyed.groupBy("shard", "to", "cell").agg(F.sum("cnt").alias("n")).withColumn(
            "base", F.coalesce(F.sum("n").over(W.partitionBy("shard", "to").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ).select("shard", "to", "cell", "base")
        upto = W.partitionBy("shard", "to", "cell").orderBy(F.desc("cnt"), "grp").rowsBetween(W.unboundedPreceding, -1)
        moved = cut(
            keyed.withColumn("before", F.coalesce(F.sum("cnt").over(upto), F.lit(0)))
            .join(cell_sum, ["shard", "to", "cell"])
            .join(F.broadcast(limits), ["shard", "to"])
            .withColumn("go", F.least("cnt", F.greatest(F.lit(0), F.col("may") - F.col("base") - F.col("before"))))
            .where("go > 0")
            .select("grp", "shard", "to", "go")
        )
        if moved.isEmpty():
            break
        change = moved.select("grp", "shard", (-F.col("go")).alias("cnt")).unionByName(
            moved.select("grp", F.col("to").alias("shard"), F.col("go").alias("cnt"))
        )
        state = cut(state.unionByName(change).groupBy("grp", "shard").agg(F.sum("cnt").alias("cnt")).where("cnt > 0"))
    return state


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents over shards with row counts at most one apart, equal texts together where quotas allow.

    Linked documents are those whose text another document has too (128-bit hash, byte length and CRC-32).
    They start dealt evenly, and balanced label propagation moves them together; the quota of a shard is its
    final number of rows, so the rows without links fill up what is left, exactly. Returned: id, size (UTF-8
    bytes of the text plus 16), text_crc32, law ('rows'), shard, slot (0, 1, ... in each shard), grown_shard
    (null under this law), group_rows (documents with this text).

    All rankings run in two levels (see `ranked`), so neither a hot text nor a shard is sorted by one task.

    Defined results: a null text has 0 bytes, CRC-32 0 and no links. Null and repeated ids are rows like any
    other; which of several rows with one id and one text gets which slot is open. With fewer rows than
    shards some shards stay empty. An empty table gives no rows. Only the two named columns are read.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).select(
        "_id",
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("_crc"),
        F.when(text.isNotNull(), F.unhex(F.concat(F.md5(text), F.hex(F.crc32(text)), F.lpad(F.hex(F.octet_length(text)), 16, "0")))).alias("_grp"),
    )
    rows = cut(rows.withColumn("_grp", F.when(F.length("_grp") > 0, F.col("_grp"))))
    counts = rows.where("_grp IS NOT NULL").groupBy("_grp").agg(F.count("*").alias("_n")).where("_n > 1")
    counts = cut(counts)
    total, linked = rows.count(), counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    target = [total // shards + (j < total % shards) for j in range(shards)]
    cells = cells_for(total)
    spread = F.xxhash64("_id")
    alone = F.xxhash64(F.col("_id"), F.col("_bytes"), F.col("_crc"))
    marked = rows.join(counts, "_grp", "left")
    members = cut(ranked(marked.where("_n IS NOT NULL"), ["_grp"], [F.col("_id")], spread, cells, "_at"))

    # start: the groups' rows laid end to end and dealt in turn, so that shards hold equal numbers of linked rows
    by_group = counts.select(F.col("_grp").alias("grp"), F.col("_n").alias("n")).withColumn("cell", F.pmod(F.xxhash64("grp"), F.lit(cells)).cast("int"))
    starts = by_group.groupBy("cell").agg(F.sum("n").alias("rows")).withColumn("part", F.lit(0))
    starts = starts.withColumn("base", F.coalesce(F.sum("rows").over(W.partitionBy("part").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("cell", "base")
    laid = by_group.withColumn("off", F.coalesce(F.sum("n").over(W.partitionBy("cell").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).join(starts, "cell")
    first = F.col("base") + F.col("off")
    dealt = laid.withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(shards)).cast("int") - 1)))
    state = cut(
        dealt.select("grp", F.pmod(first + F.col("i"), F.lit(shards)).cast("int").alias("shard"), F.ceil((F.col("n") - F.col("i")) / shards).cast("long").alias("cnt"))
    )
    state = propagate(state, target, rounds, cells)

    held = {r["shard"]: r["held"] for r in state.groupBy("shard").agg(F.sum("cnt").alias("held")).collect()}  # a number for each shard
    # linked rows: slots run through the groups of a shard, then ranges of a group's ranks go to its shards
    keyed = state.withColumn("cell", F.pmod(F.xxhash64("grp"), F.lit(cells)).cast("int"))
    sums = keyed.groupBy("shard", "cell").agg(F.sum("cnt").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).select("shard", "cell", "base")
    placed = (
        keyed.withColumn("off", F.coalesce(F.sum("cnt").over(W.partitionBy("shard", "cell").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(sums, ["shard", "cell"])
        .withColumn("lo", F.coalesce(F.sum("cnt").over(W.partitionBy("grp").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .groupBy("grp")
        .agg(F.collect_list(F.struct("lo", (F.col("lo") + F.col("cnt")).alias("hi"), "shard", (F.col("base") + F.col("off")).alias("slot"))).alias("ranges"))
    )
    at = F.filter("ranges", lambda r: (r["lo"] <= F.col("_at")) & (F.col("_at") < r["hi"]))[0]
    joined = members.join(placed.withColumnRenamed("grp", "_grp"), "_grp").withColumn("_to", at)
    together = joined.select("_id", "_bytes", "_crc", F.col("_to.shard").alias("shard"), (F.col("_to.slot") + F.col("_at") - F.col("_to.lo")).alias("slot"), "_n")
    # the rest fills the shards up to their targets
    singles = marked.where("_n IS NULL").select("_id", "_bytes", "_crc", F.lit(1).cast("long").alias("_n"), F.lit(0).alias("_all"))
    singles = ranked(singles, ["_all"], [F.col("_id"), F.col("_crc")], alone, cells_for(total - linked), "_at")
    shard, slot, upto = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    edges = []
    for j in range(shards):
        more = target[j] - held.get(j, 0)
        if more:
            edges.append((upto, upto + more, j, held.get(j, 0)))
        upto += more
    for low, high, j, have in reversed(edges):
        inside = F.col("_at") < high
        shard, slot = F.when(inside, F.lit(j)).otherwise(shard), F.when(inside, F.col("_at") - low + have).otherwise(slot)
    rest = singles.select("_id", "_bytes", "_crc", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), "_n")
    return together.unionByName(rest).select(
        F.col("_id").alias(id_col),
        (F.col("_bytes") + ROW_BYTES).alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_n").alias("group_rows"),
    )
