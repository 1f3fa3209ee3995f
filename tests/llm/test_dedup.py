"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.llm import components, decontam, exact_dedup, near_dedup, substring_dedup, words
from facetspark.llm.suffixes import suffix_array

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def exact_by_hand(pairs):
    norm = [(i, len(t or ""), re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in pairs]
    out = []
    for i, _, x in norm:
        same = [(-n, float("inf") if j is None else j, j) for j, n, y in norm if y == x]
        keep = min(same, key=lambda z: z[:2])[2]
        out.append((i, keep, len(same), i == keep, hashlib.sha256(x.encode()).hexdigest()))
    return out


def order(x):
    return sorted(x, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_compares_texts_even_where_hashes_collide(spark, docs, weak):
    key = (lambda x: F.length(x) % 3) if weak else exact_dedup.hash128
    got = exact_dedup.exact_dedup(docs, key=key)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert order(rows(got)) == order(exact_by_hand(rows(docs.select("doc_id", "text"))))


def test_exact_dedup_of_nothing(none):
    assert rows(exact_dedup.exact_dedup(none)) == []


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_by_hand(pairs):
    """Component of each id by comparing all pairs."""
    sets = {}
    for i, t in pairs:
        sets.setdefault(i, []).append(shingles(t))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = find(a), find(b)
                top[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def test_near_dedup_of_awkward_documents(docs):
    got = near_dedup.near_dedup(docs)
    by_hand = near_by_hand(rows(docs.where("doc_id IS NOT NULL").select("doc_id", "text")))
    for doc_id, n, component, kept in rows(got):
        assert component == (None if doc_id is None else by_hand[doc_id])
        assert kept == (component == doc_id)
    assert order(r[:2] for r in rows(got)) == order((i, len(shingles(t))) for i, t in rows(docs.select("doc_id", "text")))


def test_near_dedup_on_the_smallest_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    by_hand = near_by_hand(rows(d.select("doc_id", "text")))
    assert {r[0]: r[2] for r in rows(near_dedup.near_dedup(d))} == by_hand


def test_near_dedup_chains_edited_copies(spark):
    rng, base = random.Random(5), [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r[0]: r[2] for r in rows(near_dedup.near_dedup(d))} == near_by_hand(list(enumerate(texts)))


def test_near_dedup_of_nothing(none):
    assert rows(near_dedup.near_dedup(none)) == []


def test_signature_fills_empty_bins_alike():
    a = np.unique(np.random.default_rng(1).integers(0, 2**64, 3, dtype=np.uint64))
    assert set(near_dedup.signature(a).tolist()) <= set(a.tolist()) and len(near_dedup.signature(a)) == near_dedup.BINS


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(rows(components.components(e)))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_suffix_array_by_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        x = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(30))] * rng.choice([1, 1, 3])
        assert suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def removed_by_hand(texts, window):
    seen = {}
    for t in texts:
        for p in range(len(t) - window + 1):
            seen[t[p : p + window]] = seen.get(t[p : p + window], 0) + 1
    out = []
    for t in texts:
        on = np.zeros(len(t), bool)
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                on[p : p + window] = True
        runs = int((np.diff(np.concatenate(([0], on.astype(int)))) == 1).sum())
        out.append((len(t), int(on.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~on])))
    return out


def test_only_what_may_repeat_is_sorted(monkeypatch):
    rng, sorted_symbols = random.Random(3), []
    some = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    groups = []
    for _ in range(60):
        sides = [(some(63), some(63)) for _ in range(2)]
        for _ in range(rng.randint(0, 5)):
            b, a = rng.choice(sides)
            x, y = rng.randint(0, 63), rng.randint(0, 63)
            sides.append((some(63 - x) + b[len(b) - min(x, len(b)) :], a[:y] + some(63 - y)) if rng.random() < 0.8 else (b[rng.randint(0, 63) :], a))
        groups.append(list(dict.fromkeys(sides)))
    monkeypatch.setattr(substring_dedup, "suffix_array", lambda x: sorted_symbols.append(len(x)) or suffix_array(x))
    got = substring_dedup.repeats(groups)
    for sides, masks in zip(groups, got):
        strings = [{(j, b[len(b) - j :] if j else b"", a[: 63 - j]) for j in range(len(b) + 1) if len(a) >= 63 - j} for b, a in sides]
        for i, mask in enumerate(masks):
            others = set().union(*(strings[:i] + strings[i + 1 :]))
            assert {j for j in range(64) if mask >> j & 1} == {x[0] for x in strings[i] & others}
    assert sum(m != 0 for ms in got for m in ms) > 50 and sorted_symbols[0] < 0.8 * sum(len(b) + len(a) + 2 for s in groups for b, a in s)


@pytest.mark.parametrize(("window", "hot"), [(128, 4096), (200, 1)])
def test_substring_dedup_by_brute_force(spark, window, hot):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé") for _ in range(700)) for _ in range(3)]
    texts = ["a" * 500, "ab" * 300, "", None, "é" * 200, "x"]
    for _ in range(50):
        y = rng.choice(base)[rng.randrange(200) :][: rng.randrange(100, 500)]
        if rng.random() < 0.4:
            q = rng.randrange(len(y))
            y = y[:q] + "Z" + y[q:]
        texts.append("".join(rng.choice("ab") for _ in range(rng.randrange(70))) + y)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_hand = removed_by_hand([(t or "").encode() for t in texts], window)
    for r in substring_dedup.substring_dedup(d, window=window, hot=hot).collect():
        assert (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) == by_hand[r.doc_id]


def test_sorting_tasks_follow_the_neighbourhoods(spark, monkeypatch):
    rng, tasks = random.Random(9), []
    base = "".join(rng.choice("abcdef") for _ in range(300))
    texts = [rng.choice("xyz") * rng.randrange(1, 60) + base[: rng.randrange(150, 300)] + f"end {i}" for i in range(40)]
    sort = substring_dedup._sorted_masks
    monkeypatch.setattr(substring_dedup, "PIECES_A_TASK", 10)
    monkeypatch.setattr(substring_dedup, "_sorted_masks", lambda pieces, *n: [x := sort(pieces, *n), tasks.append(x.rdd.getNumPartitions())][0])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_hand = removed_by_hand([t.encode() for t in texts], 128)
    for r in substring_dedup.substring_dedup(d, window=128).collect():
        assert (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) == by_hand[r.doc_id]
    assert tasks[0] >= 4


def test_crowded_keys_are_dealt_over_tasks(spark):
    many = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    few = many.groupBy("k").agg(F.count("*").alias("c")).where("k % 2 = 1")
    got = substring_dedup._met(many, few, ["k"], few, "c", ["x"])
    assert rows(got.select("k", "x", "c")) == rows(many.join(few, "k").select("k", "x", "c"))
    dealt = substring_dedup._dealt(many, few, ["k"], "c", ["x"])
    assert dealt.groupBy("k", "part").count().agg(F.max("count")).first()[0] < 2000 and dealt.count() == 5000


@pytest.mark.parametrize("hot", [4096, 3])
def test_substring_dedup_with_crowds_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "CROWD", 4)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdef") for _ in range(400))
    texts = [rng.choice(["", "x", "yz"]) * rng.randrange(1, 60) + base[rng.randrange(3) * 20 : rng.randrange(250, 400)] + rng.choice(["", "end", f"end {i}"]) for i in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_hand = removed_by_hand([t.encode() for t in texts], 128)
    got = substring_dedup.substring_dedup(d, window=128, hot=hot).collect()
    assert len(got) == 60
    for r in got:
        assert (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) == by_hand[r.doc_id]


def test_substring_dedup_of_awkward_documents(docs, none):
    got = substring_dedup.substring_dedup(docs).collect()
    by_hand = removed_by_hand([(t or "").encode() for _, t in rows(docs.select("doc_id", "text"))], 400)
    assert order((r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) for r in got) == order(by_hand)
    assert rows(substring_dedup.substring_dedup(none)) == []


def test_places_do_not_depend_on_stretches(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).choice(b"abc") for _ in range(5000)), np.uint8)
    whole = substring_dedup.places(data, 200)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 900)
    assert whole.tolist() == substring_dedup.places(data, 200).tolist()


def test_a_place_stands_for_many_strings():
    rng = random.Random(5)
    some = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    data = some(60_000)
    n, at = len(data) - 399, substring_dedup.places(np.frombuffer(data, np.uint8), 400)
    assert len(at) * 50 < n and at[0] < 64 and n - 1 <= at[-1] < n + 63 and 0 < np.diff(at).min() and np.diff(at).max() <= 64
    for _ in range(50):  # what stands for a string depends on its bytes alone
        p, before = rng.randrange(n), rng.randrange(300)
        copy = substring_dedup.places(np.frombuffer(some(before) + data[p : p + 400] + some(200), np.uint8), 400) - before + p
        alone = substring_dedup.places(np.frombuffer(data[p : p + 400], np.uint8), 400) + p
        assert len(alone) == 1 and alone[0] in at and alone[0] in copy


def thue_morse(blocks, a, b):
    """The Thue-Morse word over two strings and its complement: polynomial hashes modulo a power of two take them for equal."""
    bits = [bin(i).count("1") % 2 for i in range(blocks)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_texts_with_equal_polynomial_hashes_are_told_apart(spark):
    p, q = thue_morse(1024, "a", "b")
    p2, q2 = thue_morse(128, '["', "aX")
    d = spark.createDataFrame([(1, p), (2, q), (3, "L" * 40 + p2 + "R" * 104), (4, "L" * 40 + q2 + "R" * 104)], "doc_id long, text string")
    assert [r.component_id for r in near_dedup.near_dedup(d).orderBy("doc_id").collect()] == [1, 2, 3, 4]
    by_hand = removed_by_hand([r.text.encode() for r in d.orderBy("doc_id").collect()], 400)
    for r in substring_dedup.substring_dedup(d).collect():
        assert (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) == by_hand[r.doc_id - 1]


def test_near_dedup_around_a_common_passage(spark):
    """Documents that share three quarters of their shingles with one another (similarity 0.6), and some real links among them."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(60)]
    texts = [" ".join(template + [f"own{k}x{i}" for i in range(20)]) for k in range(120)]
    texts += [" ".join(template + [f"own{k}x{i}" for i in range(16)] + [f"new{k}y{i}" for i in range(4)]) for k in range(0, 120, 7)]
    texts += [" ".join(template[: rng.randrange(40, 60)]) for _ in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_by_hand(list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(d).collect()} == want


def test_the_smallest_id_and_ids_that_are_strings(spark):
    low = -(2**63)
    d = spark.createDataFrame([(low, "a b c d e f"), (5, "a b c d e f"), (7, "other")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(d).collect()} == {low: low, 5: low, 7: 7}
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(d).collect()} == {low: low, 5: low, 7: 7}
    named = d.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(named).collect()}["d5"] == f"d{low}"
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(named).collect()}["d5"] == f"d{low}"


def test_words_made_to_collide_are_told_apart(spark):
    """Two words whose hashes agree without a key: alone, among others, and against a benchmark item."""
    a, b = "nwcxkydp)<w#=_[!", "collides,[;@:v1*"
    assert words.word_hashes(a) == words.word_hashes(b) and words.word_hashes(a, 5) != words.word_hashes(b, 5)
    rows = [(1, a), (2, b), (3, " ".join([a] * 12)), (4, " ".join([b] * 12)), *[(5 + k, " ".join(f"w{i} {x}" for i in range(12))) for k, x in enumerate((a, b))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_dedup(docs).collect()} == {(i, i) for i, _ in rows}
    items = spark.createDataFrame([(9, " ".join([a] * 10))], "item_id long, text string")
    assert [r.doc_id for r in decontam.decontaminate(docs, items).collect()] == [3]


def test_rows_are_told_apart_by_id_and_text(spark):
    rows = [(None, "a"), ("", "a"), ("a", ""), ("1", ":a"), ("1:", "a"), (None, None), ("", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    keys = {tuple(r) for r in df.select(*substring_dedup._row_key("doc_id", "text")).collect()}
    assert len(keys) == len(rows) and len({k for k, _ in keys}) == len({k for _, k in keys}) == len(rows)
