"""Units of documents and conversations: sentences, windows, turns, sub-units, dated display."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetspark.functions import text as T

#: Shingles that are hashed at a time.
BLOCK_SHINGLES = 2048


def exploded(docs: DataFrame, spans: Column, id_col: str, out: str) -> DataFrame:
    """(id, pos from 0, span) for each span; documents without spans give none."""
    return docs.select(id_col, F.posexplode(spans).alias("pos", out))


def split_turns(turns: DataFrame, cap: int = 10) -> DataFrame:
    """turns (conv_id, turn, role, text) -> (conv_id, turn, role, pos, part).

    A user's turn splits into sentences of at least three words, or stays whole; any other turn into lines of
    at least three words, which are joined into `cap` near-equal groups where there are more.
    """
    user = T.sentences(F.col("text"), 3)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.size(T.words(x)) >= 3)
    whole = lambda c: F.when(F.size(c) == 0, F.array(F.trim("text"))).otherwise(c)
    parts = turns.where("text IS NOT NULL").withColumn("p", F.when(F.col("role") == "user", whole(user)).otherwise(whole(lines)))
    flat = parts.select("conv_id", "turn", "role", F.size("p").alias("n"), F.posexplode("p").alias("i", "line"))
    # the first n % cap groups have a line more, as ntile deals them
    small, more = F.floor(F.col("n") / cap), F.col("n") % cap
    group = F.when(F.col("i") < more * (small + 1), F.floor(F.col("i") / (small + 1))).otherwise(more + F.floor((F.col("i") - more * (small + 1)) / small))
    pos = F.when((F.col("role") == "user") | (F.col("n") <= cap), F.col("i")).otherwise(group).cast("int")
    grouped = flat.withColumn("pos", pos).groupBy("conv_id", "turn", "role", "pos").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("l"))
    return grouped.select("conv_id", "turn", "role", "pos", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("part"))


def pack(docs: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, start, end, tokens): paragraphs packed greedily into chunks of at most `budget` words, without overlap.

    A paragraph over the budget is split at sentence ends, a sentence over it is a chunk of its own. Offsets
    count characters from 0, the end is exclusive. Greedy packing carries state from piece to piece, so each
    document is packed by itself.
    """
    import re

    kind = dict(docs.dtypes)[id_col]

    def pieces(text: str, a: int, b: int, pattern: str):
        at = a
        for m in re.finditer(pattern, text[a:b]):
            yield at, a + m.start()
            at = a + m.end()
        yield at, b

    def run(batches):
        for pdf in batches:
            out = []
            for key, text in zip(pdf["id"], pdf["text"]):
                if text is None:
                    continue
                spans = []
                for a, b in pieces(text, 0, len(text), r"\n{2,}"):
                    if len(text[a:b].split()) > budget:
                        spans += pieces(text, a, b, r"(?<=[.!?])\s+")
                    elif text[a:b].strip():
                        spans.append((a, b))
                start = end = None
                held = n = 0
                for a, b in spans:
                    w = len(text[a:b].split())
                    if not w:
                        continue
                    if start is not None and held + w > budget:
                        out.append((key, n, start, end, held))
                        n, start, held = n + 1, None, 0
                    start, end, held = a if start is None else start, b, held + w
                if start is not None:
                    out.append((key, n, start, end, held))
            yield pd.DataFrame(out, columns=["id", "pos", "start", "end", "tokens"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, f"id {kind}, pos long, start long, end long, tokens long").withColumnRenamed("id", id_col)


def minhash_groups(docs: DataFrame, permutations: int = 32, n: int = 5) -> DataFrame:
    """(doc_id, signature): minima of `permutations` linear hashes over the n-word shingles, as one string; shorter texts have none.

    White space is made regular by Spark; a task hashes a document's shingles once and takes all minima over blocks of them in numpy.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    factors = np.array([(i * 2654435761 + 1) % (1 << 32) for i in range(permutations)], np.uint32)[:, None]

    def signature(said: str) -> str | None:
        data = said.encode()
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
        if not data or len(starts) < n:
            return None
        starts, ends, least = starts[: len(starts) - n + 1].tolist(), ends[n - 1 :].tolist(), np.full(permutations, (1 << 32) - 1, np.uint32)
        for lo in range(0, len(starts), BLOCK_SHINGLES):
            spans = zip(starts[lo : lo + BLOCK_SHINGLES], ends[lo : lo + BLOCK_SHINGLES])
            first = np.frombuffer(b"".join([md5(data[x:y]).digest() for x, y in spans]), ">u4")[::4].astype(np.uint32) >> np.uint32(4)  # the first seven hex digits
            least = np.minimum(least, (first * factors).min(axis=1))  # numbers of 32 bits wrap at the modulus
        return ",".join(map(str, least.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([signature(t.as_py()) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "signature"]).filter(made.is_valid())

    said = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return docs.where("text IS NOT NULL").select("doc_id", said.alias("said")).mapInArrow(run, f"doc_id {kind}, signature string")


def first_seen(docs: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows with a null key all stay."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(order))
    return docs.withColumn("_nth", nth).where((F.col("_nth") == 1) | F.col(key).isNull()).drop("_nth")


def spans_between(docs: DataFrame, separator: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, start, end): what stands between matches of the separator, trimmed, as offsets from 0; blank pieces are left out.

    Offsets are running sums over the lengths of pieces and separators, so no text is searched twice.
    """
    t = F.col("_t")
    cutup = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_t")).select(
        id_col, F.posexplode(F.arrays_zip(F.split(t, separator).alias("p"), F.regexp_extract_all(t, F.lit(separator), F.lit(0)).alias("s"))).alias("i", "x")
    )
    before = W.partitionBy(id_col).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("x.p") + F.coalesce(F.length("x.s"), F.lit(0))).over(before), F.lit(0))
    placed = cutup.withColumn("at", at).where(F.col("x.p").rlike(r"\S"))
    start = F.col("at") + F.length("x.p") - F.length(F.regexp_replace("x.p", r"^\s+", ""))
    end = F.col("at") + F.length(F.regexp_replace("x.p", r"\s+$", ""))
    pos = F.row_number().over(W.partitionBy(id_col).orderBy("i")) - 1
    return placed.select(id_col, pos.cast("long").alias("pos"), start.alias("start"), end.alias("end"))


def turn_units(turns: DataFrame) -> DataFrame:
    """(container, owner, unit, pos, role, text) of turns (conv_id, turn, role, text): a turn is s<conv>#<turn>, its parts <owner>/<j>."""
    owner = F.concat(F.lit("s"), "conv_id", F.lit("#"), "turn")
    whole = turns.where("text IS NOT NULL").select(owner.alias("owner"), owner.alias("unit"), F.lit(-1).alias("pos"), "role", "text")
    parts = split_turns(turns).select(owner.alias("owner"), F.concat(owner, F.lit("/"), "pos").alias("unit"), "pos", "role", F.col("part").alias("text"))
    return whole.unionByName(parts).withColumn("container", T.container(F.col("owner")))


def joined_turns(turns: DataFrame, gap: int = 2) -> DataFrame:
    """(conv_id, turn, start, end): where each turn's text lies in the session's text, `gap` characters between turns."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + gap).over(before), F.lit(0))
    return turns.where("text IS NOT NULL").select("conv_id", "turn", start.alias("start"), (start + F.length("text")).alias("end"))
