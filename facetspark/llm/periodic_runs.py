"""Periodic runs of words, by a dictionary of basic factors over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A run has so many words at least, and so many times its period.
LEAST_WORDS, TIMES = 24, 3
#: Words that a worker holds at a time; a longer text is held alone.
GROUP_WORDS = 1 << 18
SCHEMA = "_id {}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _grouped(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ordered by (key, place), and a mark where the key is another than the one before. Places are ascending."""
    bits = max(1, int(places[-1]).bit_length())
    if int(keys.max()).bit_length() + bits < 63:
        packed = np.sort(keys << bits | places)
        key, place = packed >> bits, packed & ((1 << bits) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        key, place = keys[order], places[order]
    fresh = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    return place, fresh


def runs_of(names: np.ndarray, longest: int, least: int = LEAST_WORDS, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs in a sequence of names (integers from 0), by start, then period.

    The factor of length L = 2^k at each place gets a name, equal for equal factors, made of the names of its halves.
    A place's successor is the next place with the same factor. Where it lies at most L further on, the two overlap or
    touch and lie within 2 L words: there the occurrences form an arithmetic progression, and its difference is the
    smallest period of the stretch from the one to the end of the other. A run of period q and 3 q words or more shows
    as such progressions at the level with L/2 < q <= L. Progressions are extended to both sides place by place: neighbouring
    places whose successors lie q further on belong to one stretch, which ends where the period does. Each run is proposed by
    several progressions, and comes out of that once.

    Only factors that occur twice are named on, so the work beyond the first levels is on repeated text alone.
    No run is longer than `longest` words.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not all proposed")
    n, size = len(names), 1
    place, fresh = _grouped(names.astype(np.int64), np.arange(n, dtype=np.int64)) if n else (np.empty(0, np.int64), np.empty(0, bool))
    found = []
    name_at = np.full(n, -1, np.int64)
    while len(place) > 1:
        again = ~fresh[1:]
        gap = np.where(again, place[1:] - place[:-1], 0)
        near = np.flatnonzero((gap > size // 2) & (gap <= size))
        if len(near):
            at, step = place[:-1][near], gap[near]
            order = np.lexsort((at, step))
            at, step = at[order], step[order]
            head = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(step) != 0))))
            tail = np.concatenate((head[1:], [len(at)])) - 1
            found.append(np.stack((at[head], at[tail] - at[head] + step[head] + size, step[head])))
        if size // 2 * times >= longest:
            break
        # names of the factors twice as long, for those whose halves both occur again
        repeated = np.zeros(len(place), bool)
        repeated[1:] = again
        repeated[:-1] |= again
        ids = np.cumsum(fresh) - 1
        kept = place[repeated]
        name_at[kept] = ids[repeated]
        kept = np.sort(kept)
        other = kept + size
        inside = other < n
        both = kept[inside][name_at[other[inside]] >= 0]
        keys = name_at[both] * (ids[-1] + 1) + name_at[both + size]
        name_at[kept] = -1
        if not len(both):
            break
        place, fresh = _grouped(keys, both)
        size *= 2
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = np.concatenate(found, axis=1)
    long = np.flatnonzero((length >= least) & (length >= times * period))
    long = long[np.lexsort((period[long], start[long]))]
    return start[long], length[long], period[long]


class _Numbers(dict):
    """The number of each word, in the order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _marked(texts: list[list[bytes]], least: int, times: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[str]]:
    """For each list of words its runs, and the words that are kept, joined by spaces."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))
    number = _Numbers()
    words = np.fromiter((x for t in texts for x in map(number.__getitem__, t)), np.int64, base[-1])
    # a word of another document is another word
    names = np.repeat(np.arange(len(texts)), sizes) * max(1, len(number)) + words
    start, length, period = runs_of(names, int(sizes.max(initial=0)), least, times)
    cover = np.zeros(base[-1] + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    keep = np.cumsum(cover)[:-1] == 0
    cuts = np.searchsorted(start, base)
    runs, collapsed = [], []
    for i, t in enumerate(texts):
        a, b = cuts[i], cuts[i + 1]
        runs.append((start[a:b] - base[i], length[a:b], period[a:b]))
        kept = t if a == b else [t[j] for j in np.flatnonzero(keep[base[i] : base[i + 1]]).tolist()]
        collapsed.append(b" ".join(kept).decode())
    return runs, collapsed


def _groups(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of the texts, for as many rows at a time as GROUP_WORDS allows; with the number of the first row."""
    first, held, n = 0, [], 0
    for i, text in enumerate(column):
        words = (text.as_py() or "").encode().split()  # bytes are split at exactly the six ASCII white space characters
        held.append(words)
        n += len(words)
        if n >= GROUP_WORDS:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, times: int = TIMES) -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period; by start, then period) and the collapsed text.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of at least max(least_words, times * q) words with
    smallest period q that no neighbouring word extends. In the collapsed text, words that a run holds after its first
    period are left out; the others are joined by one space.

    Defined results: a null, empty or blank text has no words, no runs and an empty collapsed text. Null or
    repeated ids are rows like any other; texts never meet. An empty table gives no rows. Only the two named columns
    are read. A text is worked on where it lies: no shuffle, and memory grows with one text or GROUP_WORDS words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch.column(1)):
                runs, collapsed = _marked(texts, least_words, times)
                ends = np.cumsum([0, *(len(r[0]) for r in runs)])
                parts = [pa.array(np.concatenate([r[k] for r in runs]), pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)), pa.array([len(t) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"])),
                        pa.array(collapsed, pa.string()),
                    ],
                    ["_id", "n_words", "runs", "collapsed"],
                )

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return src.mapInArrow(run, SCHEMA.format(src.schema["_id"].dataType.simpleString())).withColumnRenamed("_id", id_col)
