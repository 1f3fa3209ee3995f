"""Alignment of two tokenizers' tokens over whole texts, and how often their ids are linked in all texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from facetspark.llm import bpe
from facetspark.llm.shared import stash

#: Tokens of the first tokenizer in a chunk of documents; a longer document is a chunk of its own.
CHUNK_TOKENS = 1 << 18
#: Values of the shorter list that are looked up at a time.
BLOCK = 512
#: Bits of the second tokenizer's id in the key of a pair.
SHIFT = 20
MAX_MODEL_BYTES = 64_000_000
#: Texts with longer stretches without or with white space alone are encoded by the operator of this package.
STRETCH = 20_000
STRETCHES = re.compile(rf"\S{{{STRETCH}}}|\s{{{STRETCH}}}")
#: Characters handed to the second tokenizer at a time.
BATCH_CHARS = 1 << 20


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of `short` how many of `long` are smaller; both ascend strictly.

    The search for a block of values goes on from where the last one ended: steps double until they pass the block's last
    value, a binary search finds its place between the last two steps, and the block's values are searched for before it.
    """
    ranks = np.empty(len(short), np.int64)
    at, n = 0, len(long)
    for i in range(0, len(short), BLOCK):
        block = short[i : i + BLOCK]
        low, step = at, len(block)
        high = low + step
        while high < n and long[high] < block[-1]:
            low, step = high, 2 * step
            high += step
        top = low + int(np.searchsorted(long[low : min(high + 1, n)], block[-1]))
        ranks[i : i + len(block)] = at + np.searchsorted(long[at : top + 1], block)
        at = int(ranks[i + len(block) - 1])
    return ranks


class Alignment(NamedTuple):
    """Token indices: link k holds tokens a[k] and b[k]; group g ends before a_cuts[g] and b_cuts[g]; links of token i of the
    driving (shorter) list begin at first[i]."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    first: np.ndarray
    a_drives: bool


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> Alignment:
    """Groups and links of two segmentations of the same bytes, given where their tokens end.

    Ends found in both lists cut groups. A token of the shorter list overlaps the other list's tokens from the one
    after the last end up to its own start, to the first one that ends where it does or later: ranks of its two ends.
    """
    a_drives = len(a_ends) <= len(b_ends)
    short, long = (a_ends, b_ends) if a_drives else (b_ends, a_ends)
    rank = gallop(short, long)
    common = long[np.minimum(rank, len(long) - 1)] == short if len(short) else np.empty(0, bool)
    begin = np.concatenate(([0], (rank + common)[:-1])) if len(short) else np.empty(0, np.int64)
    n = rank - begin + 1
    first = np.concatenate(([0], np.cumsum(n)))
    mine = np.repeat(np.arange(len(short)), n)
    other = np.arange(first[-1]) + np.repeat(begin - first[:-1], n)
    cuts, other_cuts = np.flatnonzero(common) + 1, rank[common] + 1
    return Alignment(mine, other, cuts, other_cuts, first, True) if a_drives else Alignment(other, mine, other_cuts, cuts, first, False)


def by_ranks(first: bpe.ByteBPE) -> bool:
    """Merging the pair whose joint bytes are the token of lowest id gives what the vocabulary's list of merges gives.

    It does if merges are listed by the id they make, and each token's bytes alone come out as that token. For
    say that x and y stand side by side, all lower merges done, and x + y is a token. No merge has crossed the ends of
    the stretch, so inside it stands what the lower merges make of its bytes alone: the listed pair, which is (x, y).
    """
    ascending = all(a < b for a, b in zip(first.results, first.results[1:]))
    return ascending and all(first.merge(first.strings[i]) == [i] for i in first.results)


class Pair:
    """Two tokenizers and the bytes of their tokens. With `ranked` (see by_ranks) the first one's merges are done by tiktoken."""

    def __init__(self, spec: str, model: bytes, ranked: bool):
        self.first = bpe.loaded(spec)
        self.ranked = tiktoken.Encoding("first", pat_str=bpe.PATTERN, mergeable_ranks={self.first.strings[i]: i for i in {*self.first.of_byte, *self.first.results}}, special_tokens={}) if ranked else None
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.second.get_piece_size()
        self.a_strings = self.first.strings
        self.b_strings = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.second.id_to_piece, range(n)))]
        if max(len(self.a_strings), n) >= 1 << SHIFT:
            raise ValueError(f"ids of {1 << SHIFT} and more are not supported")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in s], np.int64) for s in (self.a_strings, self.b_strings))
        self.kinds = [np.dtype("<u2" if len(s) <= 1 << 16 else "<u4") for s in (self.a_strings, self.b_strings)]
        self._told: dict[str, np.ndarray] = {}

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text by both tokenizers; none where either's bytes differ from a space and the text."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            for text, second in zip(texts[at:end], self.second.encode(texts[at:end], num_threads=1)):
                whole = " " + text
                first = self._first(whole) if text else ()
                data = whole.encode()
                same = text and b"".join(map(self.b_strings.__getitem__, second)) == data and b"".join(map(self.a_strings.__getitem__, first.tolist())) == data
                yield (first.astype(self.kinds[0]), np.array(second, self.kinds[1])) if same else (np.empty(0, self.kinds[0]), np.empty(0, self.kinds[1]))
            at = end

    def _first(self, text: str) -> np.ndarray:
        if self.ranked is None or len(text) >= STRETCH and STRETCHES.search(text):
            return np.frombuffer(b"".join(map(self.first.known.__getitem__, self.first.pieces(text))), np.int32)
        return np.array(self.ranked.encode_ordinary(text), np.int32)

    def align(self, a: np.ndarray, b: np.ndarray) -> Alignment:
        """The alignment of the ids of one text or several, one after the other."""
        return align(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]))

    def keys(self, a: np.ndarray, b: np.ndarray, found: Alignment) -> np.ndarray:
        return a[found.a].astype(np.int64) << SHIFT | b[found.b]

    def told(self, mark: str) -> np.ndarray:
        """The decimal of each id, followed by the mark."""
        if mark not in self._told:
            self._told[mark] = np.array([b"%d" % i + mark.encode() for i in range(max(len(self.a_strings), len(self.b_strings)))], object)
        return self._told[mark]

    def groups(self, a: np.ndarray, b: np.ndarray, found: Alignment, a_bounds: np.ndarray, b_bounds: np.ndarray) -> list[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
        out = np.empty(len(a) + len(b), object)
        a_from, b_from = (np.concatenate(([0], x)) for x in (found.a_cuts, found.b_cuts))
        a_place = np.arange(len(a)) + np.repeat(b_from[:-1], np.diff(a_from))
        b_place = np.arange(len(b)) + np.repeat(found.a_cuts, np.diff(b_from))
        out[a_place], out[b_place] = self.told(",")[a], self.told(",")[b]
        a_last, b_last = found.a_cuts - 1, found.b_cuts - 1
        out[a_place[a_last]], out[b_place[b_last]] = self.told("|")[a[a_last]], self.told(";")[b[b_last]]
        edges = (a_bounds + b_bounds).tolist()
        return [b"".join(out[x:y].tolist())[:-1].decode() for x, y in zip(edges, edges[1:])]


_LOADED: dict[str, Pair] = {}


def _pair(shared) -> Pair:
    """The tokenizers, built once in each worker."""
    name = f"{shared.id}"
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Pair(*shared.value)
    return _LOADED[name]


class _Shared(NamedTuple):
    id: int
    held: object

    @property
    def value(self):
        return self.held.value


def _share(docs: DataFrame, vocab: str | None, pieces: str | None) -> _Shared:
    with open(vocab or bpe.default_vocab(), encoding="utf-8") as f:
        spec = f.read()
    with open(pieces or default_pieces(), "rb") as f:
        model = f.read()
    if len(spec) + len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"vocabulary files over {MAX_MODEL_BYTES} bytes")
    held = docs.sparkSession.sparkContext.broadcast((spec, model, by_ranks(bpe.loaded(spec))))
    return _Shared(held._jbroadcast.id(), held)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, kind))


def _chunks(src: DataFrame, shared: _Shared) -> DataFrame:
    """A row for each chunk of documents: their ids and token counts, all their tokens packed, and the linked pairs of ids with
    how often each is linked in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, pack = _pair(shared), zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 32
        ids, first, second, held = [], [], [], 0

        def flushed() -> pa.RecordBatch:
            nonlocal number, held
            a, b = np.concatenate(first), np.concatenate(second)
            keys, times = np.unique(pair.keys(a, b, pair.align(a, b)), return_counts=True)
            of = pa.concat_arrays(ids)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of),
                    _lists([np.array([len(x) for x in first])], pa.int64()), _lists([np.array([len(x) for x in second])], pa.int64()),
                    pa.array([pack.compress(a.tobytes())], pa.binary()), pa.array([pack.compress(b.tobytes())], pa.binary()),
                    _lists([keys], pa.int64()), _lists([times], pa.int64()),
                ],
                ["chunk", "ids", "n_a", "n_b", "a", "b", "pairs", "times"],
            )
            number, held = number + 1, 0
            ids.clear(), first.clear(), second.clear()
            return row

        for batch in batches:
            start = 0
            texts = [t.as_py() or "" for t in batch.column(1)]
            for i, (a, b) in enumerate(pair.encode(texts)):
                first.append(a), second.append(b)
                held += len(a)
                if held >= CHUNK_TOKENS:
                    ids.append(batch.column(0).slice(start, i + 1 - start))
                    start = i + 1
                    yield flushed()
            if start < batch.num_rows:
                ids.append(batch.column(0).slice(start))
        if first:
            yield flushed()

    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"chunk long, ids array<{kind}>, n_a array<long>, n_b array<long>, a binary, b binary, pairs array<long>, times array<long>")


def token_alignment(docs: DataFrame, vocab: str | None = None, pieces: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A space and the text are encoded by a byte-level BPE vocabulary (A), the text by a sentencepiece model (B, which adds the
    space), special tokens' strings as plain text. Ends that both have cut the tokens into groups; a link is a pair of tokens
    whose bytes overlap. A pair of ids counts all links between them in all texts. n_best are the links whose pair counts
    most of all pairs of its B id (ties too), count_sum adds the counts of all links. `groups` reads `a1,a2|b1;a3|b2,b3`.

    1. Tasks encode and align documents where they lie, and write chunks of them with each chunk's distinct pairs.
    2. Chunks' pairs are summed by Spark, and joined back to chunks with their totals: a chunk has far fewer distinct pairs
       than links, so links are never shuffled. The best count of each B id is broadcast (a row for each id of B at most).
    3. Each chunk meets its pairs; tokens are aligned again, which is cheaper than storing links.

    Defined results: a null or empty text, or one whose tokens of A or of B don't give back a space and the text, has zeros
    and empty groups. Null or repeated ids are rows like any other. An empty table gives no rows. Only the two
    named columns are read. The vocabulary files (MAX_MODEL_BYTES at most) are broadcast.
    """
    shared = _share(docs, vocab, pieces)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    chunks = stash(_chunks(src, shared), "token-chunks")
    pairs = chunks.select("chunk", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    counts = pairs.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    known = pairs.select("chunk", "pair").join(counts, "pair").join(F.broadcast(best), "b").select(F.col("chunk").alias("of"), "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    names = ["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def told(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        pair, unpack = _pair(shared), zstandard.ZstdDecompressor()
        have = pairs.column("pair").to_numpy()
        order = np.argsort(have)
        have, n, top = have[order], pairs.column("n").to_numpy()[order], pairs.column("best").to_numpy()[order]
        out = []
        for i in range(documents.num_rows):
            row = {c: documents.column(c)[i] for c in ("ids", "n_a", "n_b", "a", "b")}
            a, b = (np.frombuffer(unpack.decompress(row[c].as_py()), k).astype(np.int64) for c, k in zip("ab", pair.kinds))
            n_a, n_b = (row[c].values.to_numpy() for c in ("n_a", "n_b"))
            a_bounds, b_bounds = (np.concatenate(([0], np.cumsum(x))) for x in (n_a, n_b))
            found = pair.align(a, b)
            at = np.searchsorted(have, pair.keys(a, b, found))
            edges = found.first[a_bounds if found.a_drives else b_bounds]
            summed = [np.diff(np.concatenate(([0], np.cumsum(x)))[edges]) for x in (top[at].astype(np.int64), n[at].astype(np.int64))] if len(at) else [np.zeros(len(n_a), np.int64)] * 2
            n_groups = np.diff(np.searchsorted(found.a_cuts, a_bounds, side="right"))
            counts = [n_a, n_b, n_groups, np.diff(edges), *summed]
            groups = pa.array(pair.groups(a, b, found, a_bounds, b_bounds), pa.string())
            out.append(pa.Table.from_arrays([row["ids"].values, *(pa.array(x, pa.int64()) for x in counts), groups], names))
        return pa.concat_tables(out)

    columns = f"_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    held = chunks.select("chunk", "ids", "n_a", "n_b", "a", "b").groupBy("chunk")
    return held.cogroup(known.groupBy("of")).applyInArrow(told, columns).withColumnRenamed("_id", id_col)
