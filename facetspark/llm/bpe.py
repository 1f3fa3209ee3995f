"""Byte-level BPE encoding and decoding with a public vocabulary file."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers.pre_tokenizers import ByteLevel

#: The published split before the merges, with white space as Unicode's property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Texts of these characters alone are split by the same rule with plain classes, several times as fast; letters
#: come first here, as no two of the first four alternatives can begin alike.
LETTERS, BLANKS = "A-Za-zÀ-ÖØ-öø-ÿ", "\\t\\n\\r "
UNCOMMON = f"[^{BLANKS}!-~À-ÖØ-öø-ÿ]"
COMMON = f" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^{BLANKS}{LETTERS}0-9]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
#: Pieces that a worker remembers in each of two tables; a full table replaces the older one.
CACHE_PIECES = 150_000
#: Documents that a worker holds ids of at a time.
ROWS = 500
#: Vocabulary files up to this size are broadcast.
MAX_VOCAB_BYTES = 64_000_000
#: Bits of an id in the key of a pair, and of a place in a queue entry.
SHIFT, PLACE = 20, 40
PLACE_MASK = (1 << PLACE) - 1


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the others from 256 up."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


def newer(text: str) -> bool:
    """The text has code points that Python's Unicode tables don't have yet; the splitters' tables may differ in them."""
    return any(category(c) == "Cn" for c in set(text))


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: str):
        told = json.loads(spec)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = told["model"]["vocab"]
        added = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        if max([*vocab.values(), *added.values()]) >= 1 << SHIFT:
            raise ValueError(f"ids of {1 << SHIFT} and more are not supported")
        self.strings = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for word, i in [*vocab.items(), *added.items()]:
            self.strings[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        self.of_byte = [vocab[c] for c in letters]
        self.merges: dict[int, int] = {}  # rank, moved up to make room for a place, by pair
        self.results: list[int] = []  # id by rank
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << SHIFT | vocab[b]] = rank << PLACE
            self.results.append(vocab[a + b])
        self.first = [self.merges.get(self.of_byte[a] << SHIFT | self.of_byte[b], -1) for a in range(256) for b in range(256)]
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.any_pieces = regex.compile(PATTERN).findall
        self.common_pieces, self.uncommon = re.compile(COMMON).findall, re.compile(UNCOMMON).search
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.known = _Known(self)

    def pieces(self, text: str) -> list[str]:
        if not self.uncommon(text):
            return self.common_pieces(text)
        if newer(text):  # whether those are letters is the library's to say
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return self.any_pieces(text)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the lowest merge rank first, leftmost of equals.

        Symbols are a doubly linked list in two arrays. A queue entry is merge rank and place in one number; it is
        stale, and skipped, when it is no longer the entry of its place.
        """
        n = len(piece)
        first, rank_of, result = self.first, self.merges.get, self.results
        now = [r | i if (r := first[a << 8 | b]) >= 0 else -1 for i, (a, b) in enumerate(zip(piece, piece[1:]))]
        queue = [x for x in now if x >= 0]
        ids = list(map(self.of_byte.__getitem__, piece))
        if not queue:
            return ids
        now.append(-1)
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = heappop(queue)
            i = top & PLACE_MASK
            if now[i] != top:
                continue
            j = after[i]
            ids[i] = x = result[top >> PLACE]
            ids[j] = now[j] = -1
            k = after[i] = after[j]
            now[i] = -1
            if k < n:
                before[k] = i
                if (r := rank_of(x << SHIFT | ids[k])) is not None:
                    now[i] = r | i
                    heappush(queue, r | i)
            h = before[i]
            if h >= 0:
                now[h] = -1
                if (r := rank_of(ids[h] << SHIFT | x)) is not None:
                    now[h] = r | h
                    heappush(queue, r | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers, one after the other."""
        if self.split_added is None or not any(x in text for x in self.added):
            return b"".join(map(self.known.__getitem__, self.pieces(text)))
        out = []
        for part in self.split_added.split(text):
            if part in self.added:
                out.append(array("i", [self.added[part]]).tobytes())
            else:
                out += map(self.known.__getitem__, self.pieces(part))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Known(dict):
    """The encoded ids by piece; computes what is missing.

    When CACHE_PIECES have come together the table becomes the old one, in which pieces are still found and from
    which they are taken over; so the common ones stay and memory is bounded.
    """

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.bpe.merge(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_LOADED: dict[bytes, ByteBPE] = {}


def loaded(spec: str) -> ByteBPE:
    """The vocabulary's encoder, built once in each worker."""
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(spec)
    return _LOADED[key]


def _shared(docs: DataFrame, vocab: str | None):
    with open(vocab or default_vocab(), encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MAX_VOCAB_BYTES:
        raise ValueError(f"vocabulary file over {MAX_VOCAB_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(spec)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _encoded(bpe: ByteBPE, texts: pa.Array) -> pa.Array:
    got = [bpe.encode(text.as_py() or "") for text in texts]
    ends = np.cumsum([0, *map(len, got)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), np.int32)))


def _decoded(bpe: ByteBPE, codes: pa.Array) -> pa.Array:
    return pa.array([bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in codes], pa.string())


def encode(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of every whole text, without special tokens added.

    A special token's string inside a text becomes that token, as the tokenizers library has it by default.

    Defined results: a null or empty text has no ids. Null or repeated ids are rows like any other. An empty
    table gives no rows. Only the two named columns are read. The vocabulary (a bounded file) is broadcast;
    each document is encoded where it lies, with no shuffle.
    """
    spec = _shared(docs, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _encoded(bpe, part.column(1))], ["_id", "ids"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, ids array<int>").select(F.col("_id").alias(id_col), "ids")


def lengths(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens of every whole text: the size of what `encode` gives, counted by the worker. Results are defined as there."""
    spec = _shared(docs, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            n = [len(bpe.encode(text.as_py() or "")) // 4 for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["_id", "n_tokens"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, n_tokens long").withColumnRenamed("_id", id_col)


def decode(codes: DataFrame, vocab: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and text: the vocabulary strings of the ids, concatenated and read as UTF-8.

    Bytes that are not UTF-8 become U+FFFD. Null ids count as none. Ids outside the vocabulary raise.
    """
    spec = _shared(codes, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _decoded(bpe, part.column(1))], ["_id", "ids", "text"])

    src = codes.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("ids"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, ids array<int>, text string").select(F.col("_id").alias(id_col), "ids", "text")


def round_trip(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass: id, ids, and the text decoded from the ids. Results are defined as there."""
    spec = _shared(docs, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for part in _parts(batches):
            ids = _encoded(bpe, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), ids, _decoded(bpe, ids)], ["_id", "ids", "text"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, ids array<int>, text string").withColumnRenamed("_id", id_col)
