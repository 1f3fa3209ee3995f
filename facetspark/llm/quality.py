"""Quality classifier: interpolated modified Kneser-Ney over byte n-grams of trusted text, thresholds by language."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetspark.llm.shared import cut, new_path
from facetspark.llm.words import BASE, U

ORDER = 5
#: The share of a language's trusted documents that its threshold lets pass.
QUANTILE = 0.995
#: Parts of the trusted documents; each part is scored by the model of the others.
FOLDS = 5
#: Bits of a broadcast sieve of labelled ids (4 MB); a fuller sieve lets more rows through to the join.
SIEVE_BITS = 25
#: Log-perplexities are counted in bins of this width for the quantiles.
BIN = 1e-4
#: Rows of the model that a task holds, on average over the shards.
MODEL_ROWS = 4_000_000
#: Bytes of text that are counted, and scored, at a time.
TEXT_BYTES, SCORE_BYTES = 1 << 20, 1 << 18
LANGUAGE_NONE = "und"
#: Contexts of two bytes are dealt over the shards by an odd multiplier modulo their number.
PIVOTS, MIX_PIVOT = 1 << 16, 40_503
EMPTY = U(2**64 - 1)


def _keys(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each place the last `order` bytes up to it as an integer; data begins with order - 1 bytes of padding."""
    out = np.zeros(len(data) - order + 1, U)
    for j in range(order):
        out = (out << U(8)) | data[j : len(data) - order + 1 + j]
    return out


def _packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all places of some texts, each padded with zeros, and how many places each has."""
    pad = bytes(ORDER - 1)
    data = np.frombuffer(pad.join([b"", *texts]), np.uint8).astype(U)
    sizes = np.array([len(t) for t in texts])
    if len(data) < ORDER:
        return np.empty(0, U), sizes
    real = np.ones(len(data) - ORDER + 1, bool)
    starts = np.cumsum(sizes + ORDER - 1)[:-1] - (ORDER - 1)
    for j in range(ORDER - 1):
        at = starts + j
        real[at[at < len(real)]] = False
    return _keys(data)[real], sizes


def _slices(column: pa.Array, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) with about `size` bytes at a time; a longer text comes alone and whole."""
    first, texts, held = 0, [], 0
    for i, x in enumerate(column):
        t = (x.as_py() or "").encode()
        if texts and held + len(t) > size:
            yield first, texts
            first, texts, held = i, [], 0
        texts.append(t)
        held += len(t)
    if texts:
        yield first, texts


def count_ngrams(texts: DataFrame, parts: int = 0) -> DataFrame:
    """(key, n): how often each n-gram of the highest order occurs in the texts (first column).

    With parts, n is an array: a count for each part, which the second column names from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(1).to_numpy() if parts else None
            for first, some in _slices(batch.column(0), TEXT_BYTES):
                every, sizes = _packed(some)
                keys, at, n = np.unique(every, return_inverse=True, return_counts=True)
                columns = [pa.array(keys.view(np.int64)), pa.array(n)]
                if parts:
                    of = np.repeat(part[first : first + len(sizes)], sizes)
                    columns[1:] = [pa.array(np.bincount(at[of == i], minlength=len(keys))) for i in range(parts)]
                yield pa.RecordBatch.from_arrays(columns, ["key", *names])

    names = [f"n{i}" for i in range(parts)] or ["n"]
    sums = texts.mapInArrow(run, "key long, " + ", ".join(f"{x} long" for x in names)).groupBy("key").agg(*[F.sum(x).alias(x) for x in names])
    return sums.select("key", F.array(*names).alias("n")) if parts else sums


def without_each(counts: DataFrame, parts: int) -> DataFrame:
    """(key, array of n) -> (part, key, n): the counts of all parts but one; part -1 has all of them."""
    total = reduce(Column.__add__, [F.col("n")[i] for i in range(parts)])
    each = [F.struct(F.lit(i).cast("long").alias("part"), n.alias("n")) for i, n in [(-1, total), *((i, total - F.col("n")[i]) for i in range(parts))]]
    return counts.select("key", F.explode(F.array(*each)).alias("_x")).select("_x.part", "key", "_x.n").where("n > 0")


def discounts(count_of: dict[int, int]) -> list[float]:
    """D1, D2 and D3+ from how many n-grams occur once, twice, three and four times."""
    n = [count_of.get(i, 0) for i in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return [min(float(i), max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else min(0.5, i) for i in (1, 2, 3)]


def model(counts: DataFrame) -> DataFrame:
    """(kind, ord, key, value): log-probabilities of seen n-grams ('p') and log-weights of seen contexts ('g').

    The highest order uses counts, the others continuation counts: how many different bytes stand before.
    Each order is joined with its context sums and with the order below by key, so that count tables stay
    sharded over the cluster. Counts with a column `part` give a model for each part. Only the number of n-grams
    that occur once, twice, three and four times comes to the driver.
    """
    by = [c for c in counts.columns if c == "part"]
    orders = {ORDER: cut(counts)}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))
        orders[k] = cut(orders[k + 1].groupBy(*by, low.alias("key")).agg(F.count("*").alias("n")))
    below, parts = None, []
    for k in range(1, ORDER + 1):
        seen: dict = {}
        for r in orders[k].groupBy(*by, F.least("n", F.lit(5)).alias("n")).agg(F.count("*").alias("c")).collect():  # five rows a part
            seen.setdefault(r["part"] if by else 0, {})[r["n"]] = r["c"]
        found = {p: discounts(x) for p, x in sorted(seen.items())}
        off = [F.element_at(F.create_map(*[F.lit(v) for p, d in found.items() for v in (p, float(d[i]))]), F.col("part").cast("int") if by else F.lit(0)) for i in range(3)]
        cutoff = F.when(F.col("n") == 1, off[0]).when(F.col("n") == 2, off[1]).otherwise(off[2])
        grams = orders[k].withColumn("ctx", F.shiftright("key", 8)).withColumn("off", cutoff)
        context = grams.groupBy(*by, "ctx").agg(F.sum("n").alias("total"), F.sum("off").alias("mass")).select(*by, "ctx", "total", (F.col("mass") / F.col("total")).alias("gamma"))
        both = grams.join(context, [*by, "ctx"])
        own = (F.col("n") - F.col("off")) / F.col("total")
        if below is None:
            now = both.select(*by, "key", (own + F.col("gamma") / 256).alias("p"))
        else:
            both = both.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            now = both.join(below.select(*by, F.col("key").alias("low"), F.col("p").alias("q")), [*by, "low"]).select(*by, "key", (own + F.col("gamma") * F.col("q")).alias("p"))
        below = cut(now)
        parts.append(below.select(*by, F.lit("p").alias("kind"), F.lit(k).alias("ord"), "key", F.log(F.greatest("p", F.lit(1e-30))).alias("value")))
        parts.append(context.select(*by, F.lit("g"), F.lit(k), "ctx", F.log(F.greatest("gamma", F.lit(1e-30)))))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@dataclass(frozen=True)
class Shelf:
    """Models in the shared folder: a folder for each part, and in it one for each shard, and one (-1) that all shards need."""

    path: str
    shards: int


def shelve(trained: DataFrame) -> Shelf:
    """Write models (with or without `part`) to the shared folder, in shards of about MODEL_ROWS rows.

    A row's shard is a hash of the last two bytes of its context, which all orders from three up share; the two lowest
    orders (65,792 rows at most) are needed with every shard.
    """
    spark = trained.sparkSession
    if "part" not in trained.columns:
        trained = trained.withColumn("part", F.lit(0))
    first = new_path(spark, "quality-model")
    context = F.when(F.col("kind") == "p", F.shiftright("key", 8)).otherwise(F.col("key"))
    pivot = F.when(F.col("ord") < 3, F.lit(-1)).otherwise(context.bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("pivot")
    table = F.when(F.col("kind") == "p", F.col("ord")).otherwise(-F.col("ord")).cast("byte").alias("table")
    rows = trained.select(F.col("part").cast("int").alias("part"), table, "key", F.col("value").cast("float").alias("value"), pivot)
    rows.write.parquet(first)
    rows = spark.read.parquet(first)
    most = rows.groupBy("part").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    shelf = Shelf(new_path(spark, "quality-shelf"), max(1, -(-most // MODEL_ROWS)))
    spread = F.pmod(F.col("pivot") * F.lit(MIX_PIVOT), F.lit(PIVOTS)) % shelf.shards
    shard = F.when(F.col("pivot") < 0, F.lit(-1)).otherwise(spread).cast("int")
    rows.withColumn("shard", shard).drop("pivot").repartition("part", "shard").write.partitionBy("part", "shard").parquet(shelf.path)
    return shelf


def _tables_of(shelf: Shelf, part: int, shard: int) -> dict:
    """The lookup tables of one shard, which a task holds while it scores."""
    files, root = fs.FileSystem.from_uri(shelf.path)
    found = []
    for k in (-1, shard):
        folder = f"{root}/part={part}/shard={k}"
        if files.get_file_info(folder).type == fs.FileType.Directory:
            found.append(dataset.dataset(folder, filesystem=files, format="parquet").to_table(columns=["table", "key", "value"], use_threads=False))
    rows = pa.concat_tables(found) if found else pa.table({"table": pa.array([], pa.int8()), "key": pa.array([], pa.int64()), "value": pa.array([], pa.float32())})
    at, keys, values = (rows[c].to_numpy() for c in ("table", "key", "value"))
    tables = {}
    for kind, k in ((kind, k) for kind in "pg" for k in range(1, ORDER + 1)):
        mine = at == (k if kind == "p" else -k)
        tables[kind, k] = Table(keys[mine].view(U), values[mine])
    del rows, found, at, keys, values
    pa.default_memory_pool().release_unused()
    return tables


class Table:
    """Values by 64-bit key in open addressing, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2.5 * len(keys)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys, self.values = np.full(1 << self.bits, EMPTY), np.zeros(1 << self.bits, np.float32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at[left]] == EMPTY
            self.keys[at[left[free]]] = keys[left[free]]
            done = self.keys[at[left]] == keys[left]
            self.values[at[left[done]]] = values[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(BASE)) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where missing) and which were found."""
        at = self._slot(keys)
        there = self.keys[at]
        found = there == keys
        out = np.where(found, self.values[at], np.float32(0))
        left = np.flatnonzero(~found & (there != EMPTY))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]], found[left[hit]] = self.values[at[left[hit]]], True
            left = left[~hit & (there != EMPTY)]
        return out, found


def log_probabilities(tables: dict, keys: np.ndarray) -> np.ndarray:
    """Log-probability of each place: the longest seen n-gram's, times the weights of longer seen contexts."""
    out, found = tables["p", ORDER].get(keys)
    out = out.astype(np.float64)
    left = np.flatnonzero(~found)
    for k in range(ORDER - 1, 0, -1):
        if not len(left):
            return out
        out[left] += tables["g", k + 1].get((keys[left] >> U(8)) & U((1 << 8 * k) - 1))[0]
        value, found = tables["p", k].get(keys[left] & U((1 << 8 * k) - 1))
        out[left] += value
        left = left[~found]
    out[left] += tables["g", 1].get(np.zeros(len(left), U))[0] - math.log(256)
    return out


def score(docs: DataFrame, shelf: Shelf, part: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, n_bytes and log_p (summed over the text's bytes) for every whole text; texts aren't shuffled.

    Each place of a text belongs to one shard of the model, by its context. A task reads its shard from the shared
    folder and sums over the places of that shard; shards are scored by tasks of their own, so no task holds
    more than one, and a row's sums (a number a shard) are added up after one exchange. A model of one shard
    needs none. Joining every place of every text with the model's rows would shuffle several times the input.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    now = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.xxhash64(text_col).alias("_text_hash"), F.col(text_col).alias("_text"))
    names = ["_id", *[f"_{i}" for i in range(len(keep))], "_text_hash"]
    ddl = ", ".join([f"_id {kinds[id_col]}", *[f"_{i} {kinds[c]}" for i, c in enumerate(keep)], "_text_hash long, n_bytes long, log_p double"])

    def scored(shard: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = _tables_of(shelf, part, shard)
            for batch in batches:
                total, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                for first, texts in _slices(batch.column(batch.num_columns - 1), SCORE_BYTES):
                    keys, n = _packed(texts)
                    row = np.repeat(np.arange(len(n)), n)
                    if shelf.shards > 1:
                        mine = (((keys >> U(8)) & U(0xFFFF)).astype(np.int64) * MIX_PIVOT) % PIVOTS % shelf.shards == shard
                        keys, row = keys[mine], row[mine]
                    total[first : first + len(n)] = np.bincount(row, log_probabilities(tables, keys), minlength=len(n))
                    size[first : first + len(n)] = n
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size), pa.array(total)], [*names, "n_bytes", "log_p"])

        return now.mapInArrow(run, ddl)

    if shelf.shards == 1:
        out = scored(0)
    else:
        # rows that agree in id, kept columns and text are counted, and come out as often as they went in
        each = reduce(DataFrame.unionByName, [scored(i).withColumn("_shard", F.lit(i)) for i in range(shelf.shards)])
        each = each.groupBy(*names, "n_bytes", "_shard").agg(F.max("log_p").alias("log_p"), F.count("*").alias("_copies"))
        whole = each.groupBy(*names, "n_bytes").agg(F.sum("log_p").alias("log_p"), F.max("_copies").alias("_copies"))
        out = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "log_p")


def _sieved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose _id may be among ids (one column): a bit for each hash, broadcast, so that other texts aren't shuffled."""
    if rows.schema["_id"].dataType != ids.schema[0].dataType:
        return rows  # equal numbers of different types have different hashes
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    cell, bit = lambda c: F.shiftright(place(c), 15), lambda c: place(c).bitwiseAND(F.lit(32767))
    bits = ids.groupBy(cell(ids.columns[0]).alias("_cell")).agg(F.bitmap_construct_agg(bit(ids.columns[0])).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit("_id"), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit("_id").bitwiseAND(F.lit(7)) + 1).cast("int"))) != 0
    return rows.join(F.broadcast(bits), cell("_id") == F.col("_cell")).where(there).drop("_cell", "_bits")


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    label_id: str = "doc_id", quality_col: str = "quality", toxic_col: str | None = "toxic", quantile: float = QUANTILE,
) -> DataFrame:
    """id, lang, n_bytes, perplexity (of a byte), threshold, kept for every row of docs.

    Trusted are the documents that a label calls good (quality 1) and not toxic; all of them train the model.
    A language's threshold is the quantile of its trusted documents' perplexity, over bins of BIN in the
    logarithm; a language without trusted documents takes that of all. Documents above it are rejected.
    The perplexities of the quantile are out of fold: trusted documents are cut into FOLDS parts by a hash
    of the text (so exact copies share a part), and a part is scored by the model of the others.

    Defined results: null and empty texts have no perplexity and are rejected. A null lang counts as 'und'
    for the threshold and is returned as null. Labels with nulls, of unknown ids or repeated have no effect
    beyond one good label; a document with a good and a bad label isn't trusted. Without trusted text all
    documents with text are kept. With fewer than FOLDS trusted texts, or copies of one alone, none can be
    held out, and the quantile is that of the model's own texts. Repeated rows are judged alike. An empty
    table gives no rows.
    """
    good = F.col(quality_col) == 1
    if toxic_col:
        good = good & (F.coalesce(F.col(toxic_col), F.lit(0)) == 0)
    trusted = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_label")).agg(F.min(F.coalesce(good, F.lit(False))).alias("_good")).where("_good").select("_label")
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    # labels grow with the documents, so they are merged at every size; texts that pass the sieve are shuffled this once
    part = F.pmod(F.xxhash64("_text"), F.lit(FOLDS)).alias("part")
    # an inner join, as a semi-join would be moved below the sieve; trusted ids are distinct
    counts = cut(count_ngrams(_sieved(src, trusted).join(trusted.hint("merge"), F.col("_id") == F.col("_label")).select("_text", part), FOLDS))
    key = F.coalesce("_lang", F.lit(LANGUAGE_NONE))
    # a text's first place alone has a context of nothing but padding
    texts = counts.where("key BETWEEN 0 AND 255").agg(*[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(FOLDS)]).first()
    bits = F.when(F.col("n_bytes") > 0, -F.col("log_p") / F.col("n_bytes")).alias("bits")
    if not sum(texts):
        scored = src.select("_id", "_lang", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("bits"))
        held_out = scored
    elif sum(texts) < FOLDS or max(texts) == sum(texts):
        whole = shelve(model(without_each(counts, FOLDS).where("part < 0").drop("part")))
        held_out = scored = cut(score(src, whole, 0, "_id", "_text", ("_lang",)).select("*", bits))
    else:
        shelf = shelve(model(without_each(counts, FOLDS)))
        scored = cut(score(src, shelf, -1, "_id", "_text", ("_lang",)).select("*", bits))
        folds = [score(_sieved(src.where(part == i), trusted), shelf, i, "_id", "_text", ("_lang",)).select("_id", "_lang", bits) for i in range(FOLDS)]
        held_out = reduce(DataFrame.unionAll, folds)
    own = held_out.join(trusted, F.col("_id") == F.col("_label"), "left_semi").where("bits IS NOT NULL")
    hist = own.select(F.explode(F.array(F.struct(key.alias("l"), F.lit(False).alias("every")), F.struct(F.lit("").alias("l"), F.lit(True).alias("every")))).alias("k"), F.ceil(F.col("bits") / BIN).alias("bin"))
    hist = cut(hist.groupBy("k.l", "k.every", "bin").agg(F.count("*").alias("c")))
    # bins are few: log-perplexities of bytes lie within some tens, so a language has some 100,000 of them at most
    upto = W.partitionBy("l", "every").orderBy("bin")
    limits = (
        hist.withColumn("to", F.sum("c").over(upto)).withColumn("all", F.sum("c").over(W.partitionBy("l", "every")))
        .where(F.col("to") >= F.col("all") * quantile).groupBy("l", "every").agg((F.min("bin") * BIN).alias("limit"))
    )
    every = limits.where("every").agg(F.max("limit").alias("_every"))
    mine = limits.where("NOT every").select(F.col("l").alias("_key"), F.col("limit").alias("_own"))
    joined = scored.withColumn("_key", key).join(mine, "_key", "left").crossJoin(F.broadcast(every))
    limit = F.coalesce("_own", "_every")
    return joined.select(
        F.col("_id").alias(id_col), F.col("_lang").alias(lang_col), "n_bytes", F.exp("bits").alias("perplexity"), F.exp(limit).alias("threshold"),
        ((F.col("n_bytes") > 0) & F.coalesce(F.col("bits") <= limit, F.lit(True))).alias("kept"),
    )
