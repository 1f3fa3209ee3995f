"""Removal of long repeated byte strings, by suffix arrays over contracted neighbourhoods.

A string of `window` bytes holds SPREAD places where a core of window - SPREAD + 1 bytes can start. One of them
stands for the string: that which lies a multiple of SPREAD bytes before the grain with the smallest hash (the
first of equal ones), a grain being a few bytes anywhere in the string. So equal strings are found at the same
place of each copy, and one place stands for many strings (mod-minimizers: some 50 on the test tables, where the
core with the smallest hash stands for 31). What can repeat lies round cores that occur twice.

Polynomial hashes choose the places alone, which needs no more than that equal strings have equal ones. Whether
cores and neighbourhoods are equal is decided by BLAKE2b digests of their bytes.

Occurrences of one core agree on all but the SPREAD - 1 bytes before and after it, so each is written as
those bytes with one symbol for the core between them. The suffix array of a core's occurrences, by linear
grouping, puts equal strings side by side: they are suffixes that agree on SPREAD symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from facetspark.llm.shared import stash
from facetspark.llm.suffixes import suffix_array
from facetspark.llm.words import BASE, BLOCK_BYTES, U, mix

WINDOW = 400
#: Places of a string that can stand for it; as many bits as a mask has, and a power of two.
SPREAD = 64
#: Bytes of a grain at least; it has more, so that grain and core differ by a multiple of SPREAD.
GRAIN = 8
#: A core with more different neighbourhoods is decided by counting its strings one by one instead.
HOT = 4096
#: Symbols that are sorted at a time: whole cores up to about this many, as few as a processor's cache holds.
SORT_SYMBOLS = 20_000
#: Neighbourhoods for each task that sorts; how many bytes they have says little about the time it takes.
PIECES_A_TASK = 10_000
#: Rows of one key that a join may put together; a key with as many is dealt over several tasks.
CROWD = 2_000
ALL = -1


def _powers(base: int) -> np.ndarray:
    out = np.empty(BLOCK_BYTES + 1, U)
    out[0], out[1] = 1, base
    size, top = 2, base * base % 2**64
    while size < len(out):
        n = min(size, len(out) - size)
        out[size : size + n] = out[:n] * U(top)
        size += n
        top = top * top % 2**64
    return out


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        _TABLES["up"] = _powers(BASE)
        _TABLES["down"] = _powers(pow(BASE, -1, 2**64))
        _TABLES["byte"] = mix(np.arange(1, 257, dtype=U) * U(BASE))
    return _TABLES


def _grain_hashes(data: np.ndarray, grain: int) -> np.ndarray:
    """A polynomial hash of every run of `grain` bytes."""
    t, n = _tables(), len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum(t["byte"][data] * t["up"][:n], out=sums[1:])
    return (sums[grain:] - sums[:-grain]) * t["down"][: n + 1 - grain]


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each run of w values."""
    size = 1
    while 2 * size <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :])


def places(data: np.ndarray, window: int) -> np.ndarray:
    """The places that stand for some string. Long texts are taken in stretches; a place that two stretches choose is given once."""
    core, step = window - SPREAD + 1, BLOCK_BYTES - 2 * window
    grain = GRAIN + (core - GRAIN) % SPREAD  # then later strings never have earlier places
    low, found, last = U(BLOCK_BYTES.bit_length()), [], -1
    for a in range(0, max(0, len(data) - window + 1), step):
        n = min(step, len(data) - window + 1 - a)  # strings that start here
        v = _grain_hashes(data[a : a + n + window - 1], grain)
        least = _sliding_min(v >> low << low | np.arange(len(v), dtype=U), window - grain + 1)
        start = np.arange(n, dtype=U)
        chosen = start + (least - start & U(SPREAD - 1))  # the low bits of least are the grain's place
        chosen = a + chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))].astype(np.int64)
        if chosen[0] == last:
            chosen = chosen[1:]
        if len(chosen):
            found.append(chosen)
            last = int(chosen[-1])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def digests(data: bytes, at: np.ndarray, window: int) -> np.ndarray:
    """For each place the 128-bit digest of its core, as two numbers."""
    core, view = window - SPREAD + 1, memoryview(data)
    return np.frombuffer(b"".join([blake2b(view[p : p + core], digest_size=16).digest() for p in at.tolist()]), np.int64).reshape(-1, 2)


def surroundings(data: bytes, at: np.ndarray, window: int) -> np.ndarray:
    """For each place the 128-bit digest of its whole neighbourhood and the core's place in it."""
    view, salts, parts = memoryview(data), [n.to_bytes(2, "little") for n in range(SPREAD)], []
    for p in at.tolist():
        before = SPREAD - 1 if p >= SPREAD else p
        parts.append(blake2b(view[p - before : p + window], digest_size=16, salt=salts[before]).digest())
    return np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)


def _shared(sides: list[bytes]) -> list[int]:
    """For each of the byte strings the longest start that it shares with another."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for x, y in zip(order, order[1:]):
        n = min(len(sides[x]), len(sides[y]))
        if differ := int.from_bytes(sides[x][:n], "little") ^ int.from_bytes(sides[y][:n], "little"):
            n = ((differ & -differ).bit_length() - 1) // 8
        out[x], out[y] = max(out[x], n), max(out[y], n)
    return out


def _trimmed(sides: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """A core's neighbourhoods without the outer bytes that they share with no other: no string that reaches these can repeat."""
    before, after = _shared([b[::-1] for b, _ in sides]), _shared([a for _, a in sides])
    return [(b[len(b) - x :], a[:y]) for (b, a), x, y in zip(sides, before, after)]


def repeats(groups: list[list[tuple[bytes, bytes]]]) -> list[list[int]]:
    """For each core the masks of its neighbourhoods (bytes before, bytes after).

    Bit j of a mask: the string that begins j bytes before the core also stands in another neighbourhood of it.
    """
    text, starts = [], []
    groups = [_trimmed(sides) for sides in groups]
    for g, sides in enumerate(groups):
        for before, after in sides:
            starts.append(len(text))
            if len(before) + len(after) < SPREAD - 1:
                continue  # too short for a string that repeats
            text += [b + 1 for b in before]
            text.append(257 + g)
            text += [b + 1 for b in after]
            text.append(0)
    symbols = np.array(text, np.int64)
    owner = np.full(len(symbols), -1, np.int64)
    offset = np.zeros(len(symbols), np.int64)
    n = 0
    for sides in groups:
        for before, after in sides:
            s, b = starts[n], len(before)
            j = np.arange(max(0, SPREAD - 1 - len(after)), b + 1)  # strings whose end is inside too
            owner[s + b - j], offset[s + b - j] = n, j
            n += 1
    order = suffix_array(symbols)
    a, b = order[:-1], order[1:]
    pair = (owner[a] >= 0) & (owner[b] >= 0)
    a, b = a[pair], b[pair]
    masks = np.zeros(n, U)
    for at in range(0, len(a), 50_000):
        x, y = a[at : at + 50_000], b[at : at + 50_000]
        run = np.arange(SPREAD)
        same = (symbols[x[:, None] + run] == symbols[y[:, None] + run]).all(axis=1)
        for side in (x[same], y[same]):
            np.bitwise_or.at(masks, owner[side], U(1) << offset[side].astype(U))
    values = iter(masks.view(np.int64).tolist())
    return [[next(values) for _ in sides] for sides in groups]


def _scan(rows: DataFrame, window: int, cores_only: bool = False) -> DataFrame:
    """The places of every text: their cores, and, unless cores_only, their neighbourhoods, rows and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, out = 0, []
            for *key, text in zip(*batch.columns):
                text = text.as_py()
                if text and len(text) * 4 >= window:
                    data = text.encode()
                    at = places(np.frombuffer(data, np.uint8), window)
                    cores = digests(data, at, window)
                    if cores_only:
                        out.append((cores,))
                    else:
                        name = np.array([[k.as_py() for k in key]], np.int64)
                        out.append((cores, surroundings(data, at, window), np.repeat(name, len(at), axis=0), at.reshape(-1, 1)))
                    held += len(at)
                if held > 100_000:
                    yield _members(out)
                    held, out = 0, []
            if out:
                yield _members(out)

    names = CORE if cores_only else [*CORE, *AROUND, *KEY, "at"]
    return rows.mapInArrow(run, ", ".join(f"{c} {'int' if c == 'at' else 'long'}" for c in names))


def _members(out: list[tuple]) -> pa.RecordBatch:
    """Columns of the pieces of each place, in order; the offset, where there is one, is the last and shorter."""
    columns = [np.ascontiguousarray(c) for block in map(np.concatenate, zip(*out)) for c in block.T]
    names = [*CORE, *AROUND, *KEY, "at"][: len(columns)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "at" else pa.int64()) for n, c in zip(names, columns)], names)


#: The 128 bits of a core's digest, of a neighbourhood's, and of a row's.
CORE, AROUND, KEY = ["core", "more"], ["around", "around_more"], ["key", "key_more"]
PIECE = "core long, more long, around long, around_more long, kinds long, before binary, after binary"


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of id and text; the id's length keeps the two apart."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    told = F.concat(F.coalesce(F.length(F.col(id_col).cast("string")), F.lit(-1)).cast("string"), F.lit(":"), name, F.coalesce(F.col(text_col), F.lit("")))
    half = lambda at: F.conv(F.substring(F.md5(told), at, 16), 16, -10).cast("long")
    return [half(1).alias(KEY[0]), half(17).alias(KEY[1])]


def _dealt(many: DataFrame, crowded: DataFrame, keys: list[str], n: str, by: list[str]) -> DataFrame:
    """many with a part for each row: 0, or, for the keys of CROWD rows in crowded, one of several by a hash."""
    return many.join(F.broadcast(_parts(crowded, keys, n)), keys, "left").select(*many.columns, F.coalesce(F.pmod(F.hash(*by), F.col("parts")), F.lit(0)).alias("part"))


def _parts(crowded: DataFrame, keys: list[str], n: str) -> DataFrame:
    return crowded.where(F.col(n) >= CROWD).select(*keys, (2 * F.col(n) / CROWD).cast("int").alias("parts"))


def _met(many: DataFrame, few: DataFrame, keys: list[str], crowded: DataFrame, n: str, by: list[str]) -> DataFrame:
    """many joined with few, which has a row for a key at most; rows of a crowded key meet in several tasks."""
    last = F.coalesce(F.col("parts") - 1, F.lit(0))
    copies = few.join(F.broadcast(_parts(crowded, keys, n)), keys, "left").select(*few.columns, F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return _dealt(many, crowded, keys, n, by).join(copies, [*keys, "part"]).drop("part")


def _pieces(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes before and after the wanted places."""
    spots = wanted.groupBy(*KEY).agg(F.collect_list(F.struct(*CORE, *AROUND, "kinds", "at")).alias("spots"))
    core = window - SPREAD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spots in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode()
                for x in spots.as_py():
                    p = x["at"]
                    out.append((*(x[c] for c in (*CORE, *AROUND)), x["kinds"], data[max(0, p - SPREAD + 1) : p], data[p + core : p + window]))
            kinds = (*[pa.int64()] * 5, pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 7, kinds)], [*CORE, *AROUND, "kinds", "before", "after"])

    return rows.join(spots, KEY).select("text", "spots").mapInArrow(run, PIECE)


def _sorted_masks(pieces: DataFrame, tasks: int) -> DataFrame:
    """Masks from suffix arrays; all neighbourhoods of a core are in one task, and come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[tuple[int, int], list[tuple[int, int]]]] = []
        groups: list[list[tuple[bytes, bytes]]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            masks = repeats(groups)
            rows = [(*c, *a, m) for (c, arounds), ms in zip(names, masks) for a, m in zip(arounds, ms)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [()] * 5)], [*CORE, *AROUND, "mask"])

        for batch in batches:
            for *name, _, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                core, around = tuple(name[:2]), tuple(name[2:])
                if not names or names[-1][0] != core:
                    if held > SORT_SYMBOLS:
                        yield flush()
                        names, groups, held = [], [], 0
                    names.append((core, []))
                    groups.append([])
                names[-1][1].append(around)
                groups[-1].append((before, after))
                held += len(before) + len(after) + 2
        if names:
            yield flush()

    return pieces.repartition(tasks, *CORE).sortWithinPartitions(*CORE, *AROUND).mapInArrow(run, "core long, more long, around long, around_more long, mask long")


def _counted_masks(pieces: DataFrame) -> DataFrame:
    """Masks of hot cores: one row for each string, counted by a 128-bit hash."""
    steps = F.sequence(F.greatest(F.lit(0), F.lit(SPREAD - 1) - F.length("after")), F.length("before"))
    strings = pieces.where(F.length("before") + F.length("after") >= SPREAD - 1).select(
        *CORE, *AROUND, F.explode(steps).alias("j"), "before", "after"
    )
    head = F.substring("before", F.length("before") - F.col("j") + 1, F.col("j"))
    tail = F.substring("after", F.lit(1), F.lit(SPREAD - 1) - F.col("j"))
    # head and tail of strings with one j have fixed lengths
    named = strings.select(*CORE, *AROUND, "j", F.md5(F.concat(head, tail)).alias("s"))
    string = [*CORE, "j", "s"]
    often = named.groupBy(*string).agg(F.count("*").alias("c")).where("c > 1")
    return _met(named, often, string, often, "c", AROUND).groupBy(*CORE, *AROUND).agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_bytes, spans and kept for every row: the text's UTF-8 bytes without what repeats.

    Removed is each byte that a string of `window` bytes covers which also starts anywhere else, in the same
    text or another; all strings are judged on the input. spans: the maximal removed runs as (start, end);
    kept: the other bytes, concatenated (they may cut a character).

    Cores that occur once are dropped after one exchange of hashes. A neighbourhood that occurs twice as a
    whole is all repeated. Others go through suffix arrays, a task for some cores at a time; a core with over
    `hot` different neighbourhoods is counted string by string instead, which needs no group in one task.
    Cores and neighbourhoods are compared by 128-bit digests of their bytes.

    Defined results: a null text is empty. Rows are told apart by 128 bits of a hash of id and text, so null and
    repeated ids are rows like any other, and equal rows repeat each other. Texts shorter than the window are
    kept whole. An empty table gives no rows. Only the two named columns are read.
    """
    if window < 2 * SPREAD:
        raise ValueError(f"the window must have {2 * SPREAD} bytes at least")
    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(*_row_key(id_col, text_col), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    members = _scan(rows.select(*KEY, "text"), window)
    twice = _scan(rows.select("text"), window, cores_only=True).groupBy(*CORE).agg(F.count("*").alias("c")).where("c > 1")
    twice = stash(twice, "substring-cores")
    members = stash(_met(members, twice.select(*CORE), CORE, twice, "c", [*KEY, "at"]), "substring-members")
    around = members.groupBy(*CORE, *AROUND).agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "at")).alias("one"))
    around = stash(around.select(*CORE, *AROUND, "n", "one.*"), "substring-around")
    kinds = around.groupBy(*CORE).agg(F.count("*").alias("kinds")).where("kinds > 1")
    pieces = stash(_pieces(rows.select(*KEY, "text"), _met(around, kinds, CORE, kinds, "kinds", AROUND), window), "substring-pieces")
    tasks = 1 + pieces.count() // PIECES_A_TASK
    masks = _sorted_masks(pieces.where(F.col("kinds") <= hot), tasks).unionByName(_counted_masks(pieces.where(F.col("kinds") > hot)))
    single = around.where("n = 1").select(*CORE, *AROUND)
    masks = masks.where("mask <> 0").join(single, [*CORE, *AROUND], "left_semi")
    masks = masks.unionByName(around.where("n > 1").select(*CORE, *AROUND, F.lit(ALL).cast("long").alias("mask")))
    marks = _met(members, masks, [*CORE, *AROUND], around, "n", [*KEY, "at"]).groupBy(*KEY).agg(F.collect_list(F.struct("at", "mask")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, kept = [], [], []
            for text, marks in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                runs = _runs(len(data), marks, window) if marks.is_valid else np.empty((0, 2), np.int64)
                n.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in runs.tolist()])
                at, parts = 0, []
                for a, b in runs.tolist():
                    parts.append(data[at:a])
                    at = b
                kept.append(b"".join([*parts, data[at:]]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["_id", "n_bytes", "spans", "kept"])

    done = rows.join(marks, KEY, "left").select("_id", "text", "marks")
    return done.mapInArrow(run, f"_id {id_kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary").withColumnRenamed("_id", id_col)


def _runs(n: int, marks: pa.Scalar, window: int) -> np.ndarray:
    """The maximal runs that the marked strings cover."""
    flat = marks.values
    at, mask = flat.field("at").to_numpy().astype(np.int64), flat.field("mask").to_numpy()
    whole = mask == ALL
    first, last = np.maximum(at[whole] - SPREAD + 1, 0), np.minimum(at[whole], n - window)
    ok = first <= last
    some, bits = at[~whole], mask[~whole].view(U)
    hit = (bits[:, None] >> np.arange(SPREAD, dtype=U)) & U(1)
    i, j = np.nonzero(hit)
    starts = some[i] - j
    begin, end = np.concatenate((first[ok], starts)), np.concatenate((last[ok] + window, starts + window))
    if not len(begin):
        return np.empty((0, 2), np.int64)
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > reach[:-1]))
    stops = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(begin) - 1]))
    return np.stack((begin[new], reach[stops]), axis=1)
