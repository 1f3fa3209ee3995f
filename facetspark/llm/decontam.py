"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from facetspark.llm.words import BASE, U, mix, new_key, word_hashes

SEED_WORDS = 4
#: Of an item's seeds those stay that are among its rarest share, or in at most this share of the documents.
RAREST, RARE_DOCS = 0.75, 1e-4
MATCH, MISMATCH, GAP = 2, -1, -1
#: A hit: the alignment score is at least this share of a perfect one, and at least that of so many words.
THRESHOLD, LEAST_WORDS = 0.4, 8
#: Benchmark text that is held by a task at a time; a larger benchmark is taken in blocks, one scan of the documents each.
BLOCK_BYTES = 8_000_000
#: Candidates that are aligned side by side.
ALIGN_ROWS = 256
BITS = 20


def seeds_of(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every run of n words, and of n out of n + 1 words with one inner word left out."""
    runs = max(0, len(words) - n + 1)
    gapped = max(0, runs - 1)
    if not runs:
        return np.empty(0, U), np.empty(0, np.int64)
    hashes, h = [], mix(words[:runs] + U(n))
    for j in range(1, n):  # h: the hash of the first j words, which the run without its word j shares
        skip = h[:gapped]
        for k in range(j + 1, n + 1):
            skip = mix(skip * U(BASE) + words[k : k + gapped])
        hashes.append(skip + U(j))
        h = mix(h * U(BASE) + words[j : j + runs])
    return np.concatenate([h, *hashes]), np.concatenate([np.arange(runs), *[np.arange(gapped)] * (n - 1)])


class Items:
    """A block of benchmark items: word hashes, and the seeds as a sorted table of (seed, item, place)."""

    def __init__(self, rows: list[tuple], seed_words: int, key: int = 0):
        self.ids, self.key = [i for i, _ in rows], key
        self.words = [word_hashes(text, key) for _, text in rows]
        self.n = seed_words
        seeds, items, places = [], [], []
        for k, w in enumerate(self.words):
            got, at = seeds_of(w, seed_words)
            seeds.append(got)
            items.append(np.full(len(got), k, np.int64))
            places.append(at)
        self._set(*(np.concatenate(x) if x else np.empty(0, t) for x, t in ((seeds, U), (items, np.int64), (places, np.int64))))

    def _set(self, seeds: np.ndarray, items: np.ndarray, places: np.ndarray) -> None:
        order = np.lexsort((places, items, seeds))
        self.seed, self.item, self.place = seeds[order], items[order], places[order]
        self.keys, self.first = np.unique(self.seed, return_index=True)
        self.last = np.append(self.first[1:], len(self.seed))
        self.sieve = np.zeros(1 << BITS, bool)
        self.sieve[(self.keys & U((1 << BITS) - 1)).astype(np.int64)] = True

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document where a seed stands, and which."""
        grams, places = seeds_of(words, self.n)
        near = np.flatnonzero(self.sieve[(grams & U((1 << BITS) - 1)).astype(np.int64)]) if len(self.keys) else np.empty(0, np.int64)
        at = np.searchsorted(self.keys, grams[near])
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == grams[near[hit]]
        return places[near[hit]], at[hit]

    def keep_rare(self, docs_of_seed: np.ndarray, docs: int) -> None:
        """Drop each item's most common seeds; the rarest stay however common they are, so that no item is lost."""
        often = np.repeat(docs_of_seed, self.last - self.first)
        order = np.lexsort((often, self.item))
        first, size = np.unique(self.item[order], return_index=True, return_counts=True)[1:]
        least = often[order][first + np.ceil(RAREST * size).astype(np.int64) - 1]  # the commonest that each item surely keeps
        at = np.empty(len(order), np.int64)
        at[order] = np.repeat(np.arange(len(first)), size)
        keep = (often <= RARE_DOCS * docs) | (often <= least[at])
        self._set(self.seed[keep], self.item[keep], self.place[keep])


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of item against passage, word by word, and where in the passage the best alignment ends.

    Rows of the score matrix are computed for many pairs at once; the gap along a row is a running maximum.
    """
    n, m, w = len(items), max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((n, m), U), np.zeros((n, w), U)
    real_a, real_b = np.zeros((n, m), bool), np.zeros((n, w), bool)
    for i, (x, y) in enumerate(zip(items, passages)):
        a[i, : len(x)], b[i, : len(y)] = x, y
        real_a[i, : len(x)], real_b[i, : len(y)] = True, True
    slope = -GAP * np.arange(w, dtype=np.int32)
    score, best, end = np.zeros((n, w + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(m):
        same = (b == a[:, i : i + 1]) & real_b & real_a[:, i : i + 1]
        step = np.maximum(score[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), score[:, 1:] + GAP)
        score[:, 1:] = np.maximum.accumulate(np.maximum(step, 0) + slope, axis=1) - slope
        row = score.max(axis=1)
        up = row > best
        if up.any():
            end[up], best[up] = score[up].argmax(axis=1), row[up]
    return best, end


def _candidates(words: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(item, from, to) word spans round seeds; seeds further apart than two items make two passages."""
    at, seed = items.found(words)
    if not len(at):
        return []
    counts = (items.last - items.first)[seed]
    flat = np.repeat(items.first[seed], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    item, place = items.item[flat], np.repeat(at, counts)
    order = np.lexsort((place, item))
    item, place = item[order], place[order]
    size = np.array([len(w) for w in items.words])[item]
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(item) != 0) | (np.diff(place) > 2 * size[1:]))))
    ends = np.append(begins[1:], len(item)) - 1
    return [(int(item[i]), max(0, int(place[i] - size[i])), min(len(words), int(place[j] + size[j] + items.n + 1))) for i, j in zip(begins, ends)]


def _hits(texts: list, items: Items, threshold: float, least_words: int) -> dict[tuple[int, int], tuple[float, int, int]]:
    """Best (score, from, to) for each (row, item) that reaches the threshold."""
    todo, words = [], {}
    for row, text in enumerate(texts):
        w = word_hashes(text, items.key)
        if found := _candidates(w, items):
            words[row] = w
            todo += [(row, *x) for x in found]
    todo.sort(key=lambda x: (x[3] - x[2], len(items.words[x[1]])))
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    at = 0
    while at < len(todo):
        room = max(1, min(ALIGN_ROWS, 4_000_000 // max(1, todo[min(at + ALIGN_ROWS, len(todo)) - 1][3] - todo[min(at + ALIGN_ROWS, len(todo)) - 1][2])))
        part = todo[at : at + room]
        at += room
        score, end = align([items.words[k] for _, k, _, _ in part], [words[r][x:y] for r, _, x, y in part])
        for (r, k, x, _), s, e in zip(part, score.tolist(), end.tolist()):
            m = len(items.words[k])
            share = s / (MATCH * m)
            if share >= threshold and s >= MATCH * min(m, least_words):
                new = (share, -max(0, x + e - m), x + e)
                out[r, k] = max(out.get((r, k), new), new)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    seed_words: int = SEED_WORDS, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """A row for each document and benchmark item whose passage the document holds: id, item, score, from_word, to_word.

    Words are A-Z lower-cased runs between ASCII white space. Every run of seed_words words of an item, whole
    or with one more word left out inside, is a seed; its documents are counted over the whole corpus, and each item keeps its rarer seeds. A document
    with a seed gives a passage of the item's length to either side, and the best local alignment of item
    and passage (match 2, mismatch and gap -1) is scored as a share of a perfect one. Copies with up to
    about a third of their words changed reach the default of 0.4.

    Words are hashed under a secret key of the run, so that nobody can write words that count as an item's but are others.

    Documents are scanned where they lie, twice for each block of the benchmark (BLOCK_BYTES of text), and
    nothing is shuffled but one count for each seed and task.

    Defined results: null texts and texts without words match nothing; neither do items of fewer than
    seed_words words, nor items with a null text. Null ids are kept as they are. Repeated documents or
    items give a row each time. Empty tables give no rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    tests = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text")).where("_text IS NOT NULL")
    item_kind = tests.schema["_item"].dataType.simpleString()
    total = tests.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    found, key = [], new_key()
    for block in range(blocks):
        rows = [tuple(r) for r in tests.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block).collect()]  # BLOCK_BYTES on average
        items = Items(sorted(rows, key=repr), seed_words, key)
        if not len(items.keys):
            continue
        plain = spark.sparkContext.broadcast(items)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = plain.value
            seen = np.zeros(len(known.keys) + 1, np.int64)
            for batch in batches:
                for text in batch.column(0):
                    seen[-1] += 1
                    at, seed = known.found(word_hashes(text.as_py(), known.key))
                    if len(at):
                        seen[np.unique(seed)] += 1
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["seed", "docs"])

        counts = src.select("_text").mapInArrow(count, "seed long, docs long").groupBy("seed").agg(F.sum("docs").alias("docs"))
        often = np.zeros(len(items.keys) + 1, np.int64)
        for r in counts.collect():  # one row for each seed of the block
            often[r["seed"]] = r["docs"]
        items.keep_rare(often[:-1], int(often[-1]))
        rare = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], rare=rare) -> Iterator[pa.RecordBatch]:
            known = rare.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    hits = sorted(_hits(part.column(1).to_pylist(), known, threshold, least_words).items())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array([r for (r, _), _ in hits], pa.int64())),
                            pa.array([k for (_, k), _ in hits], pa.int64()),
                            pa.array([x[0] for _, x in hits], pa.float64()),
                            pa.array([-x[1] for _, x in hits], pa.int64()),
                            pa.array([x[2] for _, x in hits], pa.int64()),
                        ],
                        ["_id", "_k", "score", "from_word", "to_word"],
                    )

        names = spark.createDataFrame([(k, i) for k, i in enumerate(items.ids)], f"_k long, _item {item_kind}")
        found.append(src.mapInArrow(scan, f"_id {kind}, _k long, score double, from_word long, to_word long").join(F.broadcast(names), "_k"))
    if not found:
        return spark.createDataFrame([], f"{id_col} {kind}, {item_col} {item_kind}, score double, from_word long, to_word long")
    return reduce(DataFrame.unionByName, found).select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "score", "from_word", "to_word")
