"""Periodic runs, licence notices and token alignment against brute force."""

import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from facetspark.llm import bpe, license_scan, periodic_runs, queries, token_alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def smallest_period(x):
    return next(q for q in range(1, len(x) + 1) if x[q:] == x[: len(x) - q])


def runs_by_hand(x, least, times):
    """Every maximal stretch of every period, its smallest period worked out for itself."""
    out = set()
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and smallest_period(x[i : i + size]) == q:
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 12)), max_size=6), st.integers(3, 10), st.integers(3, 4))
def test_runs_equal_those_by_hand(parts, least, times):
    x = [w for unit, n in parts for w in unit * n]
    got = periodic_runs.runs_of(np.array(x, np.int64), len(x), least, times)
    assert list(zip(*(v.tolist() for v in got))) == runs_by_hand(x, least, times)


def test_long_periods_and_keys_that_do_not_fit_one_number():
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 50, 700)
    x = np.concatenate((rng.integers(0, 50, 300), np.tile(unit, 5)[:3000], rng.integers(0, 50, 200), np.zeros(40, np.int64)))
    want = runs_by_hand(x.tolist(), 24, 3)
    assert {q for _, _, q in want} >= {1, 700}
    for names in (x, x * (1 << 54)):
        got = periodic_runs.runs_of(names, len(x))
        assert list(zip(*(v.tolist() for v in got))) == want
    with pytest.raises(ValueError):
        periodic_runs.runs_of(x, len(x), times=2)


def op11_by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words, 24, 3)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    digest = hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(collapsed_by_hand(words, runs).encode()).hexdigest()
    return (len(runs), *top, top[1] and 1000 * top[1] // top[2], digest, kept)


def test_op11(spark, texts):
    rows = queries.op11_periodic_runs(spark, SF).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 5
    for r in rows:
        assert tuple(r)[1:] == op11_by_hand(r.doc_id, texts[r.doc_id])


def test_periodic_runs_of_odd_texts(spark, docs, none, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 50)
    extra = spark.createDataFrame([(50, "a b " * 40 + "c"), (51, "x" + " y" * 90), (52, " ".join("p q r s".split() * 30)), (53, "z\x0bz\x0cz\r" * 9)], "doc_id long, text string")
    src = docs.select("doc_id", "text").unionByName(extra)
    got = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs.periodic_runs(docs.unionByName(extra, allowMissingColumns=True)).collect())
    want = collections.Counter()
    for r in src.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = runs_by_hand(words, 24, 3) if len(words) < 5000 else None
        if runs is None:
            [runs] = [x[2] for x in got if x[0] == r.doc_id]
        want[r.doc_id, len(words), tuple(runs), collapsed_by_hand(words, runs)] += 1
    assert got == want
    assert periodic_runs.periodic_runs(none).collect() == []


def words_by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def places_by_hand(words):
    out = []
    for label, text in license_scan.PHRASES:
        p = text.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(out)


def notices_by_hand(words):
    """Every template at every offset."""
    out = set()
    for t in license_scan.TEMPLATES:
        have, total, seen = 0, 0, []
        for text in t.passages:
            p = words_by_hand(text)
            total += len(p)
            best = 0
            for o in range(-len(p), len(words)):
                n = sum(0 <= o + j < len(words) and words[o + j] == w for j, w in enumerate(p))
                if 10 * n >= 7 * len(p):
                    seen.append(words[max(o, 0) : o + len(p)])
                    best = max(best, n)
            have += best
        within = lambda k, s: any(s[i : i + len(k)] == k for i in range(len(s)))
        if seen and 10 * have >= 7 * total and all(any(within(words_by_hand(k), s) for s in seen) for k in t.keys):
            out.add((t.label, round(have / total, 9)))
    return out


def test_op12(spark, texts):
    rows = queries.op12_license_scan(spark, SF).collect()
    assert len(rows) == len(texts) and len({r.labels for r in rows}) > 3
    for r in rows:
        words = words_by_hand(texts[r.doc_id])
        places = places_by_hand(words)
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {x for _, x in places}
        assert r.base_labels == ",".join(sorted(base))
        notices = notices_by_hand(words) if len(words) < 1500 else None
        if notices is not None:
            assert r.labels == ",".join(sorted(base | {x for x, _ in notices}))
            assert r.score == round(max((s for _, s in notices), default=0.5 if base else 0), 6)
        assert base <= set(r.labels.split(",")) | ({""} if not base else set()) and 0 <= r.score <= 1


def test_notices_of_edited_and_hostile_texts(spark, docs, none):
    apache = " ".join(license_scan.TEMPLATES[7].passages)
    mit = " ".join(license_scan.TEMPLATES[9].passages)
    edited = mit.replace("copy", "COPIES").replace("software", "library", 1)
    made = {
        100: apache, 101: mit, 102: edited, 103: "x " * 400 + mit + " y" * 300, 104: "license " * 3000 + "mit license mit license", 105: "MIT-License; Apache/License\ncc_by",
        106: "this work is licensed under the gnu general public license version 2 and this work is licensed under the gnu general public license version 3",
        107: "permission is hereby granted free of charge " * 3, 108: "GNU GENERAL PUBLIC LICENSE", 109: "cc by cc by cc by nc 4 0", 110: "under the mit license", 111: "",
        112: "this work was licensed under gnu general public license version 3",
    }
    src = docs.unionByName(spark.createDataFrame(list(made.items()), "doc_id long, text string"), allowMissingColumns=True)
    plain = spark.createDataFrame([(i, t) for i in range(200, 260) for t in ["plain words of no licence at all"]], "doc_id long, text string")
    rows = license_scan.license_scan(src.unionByName(plain, allowMissingColumns=True)).collect()
    assert len(rows) == src.count() + 60
    for r in rows:
        if r.doc_id in made:
            words = words_by_hand(made[r.doc_id])
            assert [(p.start, p.label) for p in r.places] == places_by_hand(words), r.doc_id
            if len(words) < 2000:
                best = {}
                for x in r.notices:
                    best.setdefault((x.label, round(x.share, 9)), x)
                assert set(best) == notices_by_hand(words), r.doc_id
    by = {r.doc_id: {x.label for x in r.notices} for r in rows}
    assert by[101] == by[102] == by[103] == {"mit"} and by[100] == {"apache-2.0"} and by[106] == {"gpl-2.0", "gpl-3.0"} and by[107] == set()
    assert license_scan.license_scan(none).collect() == []


def test_rarity_counts_all_texts_and_does_not_change_results(spark):
    rows = [(i, "the license" if i % 2 else "the") for i in range(64)]
    got = license_scan.rarity(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), {b"the", b"license", b"none"})
    assert got[b"the"] == 0 and abs(got[b"license"] - np.log(65 / 33)) < 1e-12 and abs(got[b"none"] - np.log(65)) < 1e-12
    words = [w.encode() for w in words_by_hand("so: Released under an MIT license. This work is licensed under the GNU General Public License, version 3")]
    found = [license_scan.RareIndex(license_scan.PHRASES, license_scan.TEMPLATES, {w: s * len(w) for w in words}).scan(words) for s in (0, 1, -1)]
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=60), st.lists(st.booleans(), min_size=1, max_size=60))
def test_alignment_equals_overlaps_by_hand(x, y):
    n = max(len(x), len(y))
    ends = [np.array([i + 1 for i in range(n) if (i < len(z) and z[i]) or i == n - 1]) for z in (x, y)]
    assert_aligned(*ends)


def assert_aligned(a_ends, b_ends):
    found = token_alignment.align(a_ends, b_ends)
    a, b = (list(zip([0, *e.tolist()], e.tolist())) for e in (a_ends, b_ends))
    want = {(i, j) for i, (s, e) in enumerate(a) for j, (u, v) in enumerate(b) if max(s, u) < min(e, v)}
    assert set(zip(found.a.tolist(), found.b.tolist())) == want and len(found.a) == len(want)
    both = sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
    assert a_ends[found.a_cuts - 1].tolist() == both == b_ends[found.b_cuts - 1].tolist()


def test_galloping_over_lists_of_unlike_lengths(monkeypatch):
    rng = np.random.default_rng(3)
    for block in (1, 7, 512):
        monkeypatch.setattr(token_alignment, "BLOCK", block)
        for m, n in ((1, 5000), (50, 5000), (3000, 3001), (0, 10)):
            short, long = (np.sort(rng.choice(20_000, k, replace=False)) for k in (m, n))
            assert np.array_equal(token_alignment.gallop(short, long), np.searchsorted(long, short))


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(bpe.default_vocab())
    a.no_truncation(), a.no_padding()
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=token_alignment.default_pieces())


def aligned_by_hand(tokenizers, texts):
    """Rows of the contract from the libraries' tokens, groups and links counted byte by byte."""
    first, second = tokenizers
    back = {c: i for i, c in enumerate(bpe.byte_letters())}
    vocab = {i: w for w, i in first.get_vocab(with_added_tokens=False).items()}
    rows, count = [], collections.Counter()
    for text in texts:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        pieces = [second.id_to_piece(i) for i in b]
        sa, sb = [bytes(back[c] for c in vocab[i]) for i in a], [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(sa) != (" " + text).encode() or b"".join(sb) != (" " + text).encode():
            rows.append(([], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in sa]).tolist(), np.cumsum([len(x) for x in sb]).tolist()
        owner_a, owner_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]).tolist() for s in (sa, sb))
        links = sorted(set(zip(owner_a, owner_b)))
        count.update((a[i], b[j]) for i, j in links)
        ends, groups, i, j = set(ea) & set(eb), [], 0, 0
        for end in sorted(ends):
            x, y = ea.index(end, i) + 1, eb.index(end, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        rows.append((a, b, groups, [(a[i], b[j]) for i, j in links]))
    best = collections.defaultdict(int)
    for (x, y), n in count.items():
        best[y] = max(best[y], n)
    return [
        (len(a), len(b), len(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, g, links in rows
    ]


def test_op13(spark, texts, tokenizers, monkeypatch):
    ids = sorted(texts)
    want = dict(zip(ids, aligned_by_hand(tokenizers, [texts[i] for i in ids])))
    rows = queries.op13_token_alignment(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)


def test_first_tokens_equal_the_library(tokenizers):
    """Every code point between others, stretches too long for the fast path, and special tokens' strings."""
    shared = [open(bpe.default_vocab(), encoding="utf-8").read(), open(token_alignment.default_pieces(), "rb").read()]
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}b 1{c} {c}x{c}{c}\n{c}'s" for c in points[i : i + 200]) for i in range(0, 0x30000, 200)]
    texts += ["x" * 30_000 + " y", " " * 30_000 + "z", "<|endoftext|> <|endoftext|>", "don't we'll I'VE", "\r\n\r\n  \t x"]
    want = [e.ids for e in tokenizers[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    pair = token_alignment.Pair(*shared, True)
    assert token_alignment.by_ranks(pair.first)
    assert [pair._first(" " + t).tolist() for t in texts] == want
    slow = token_alignment.Pair(*shared, False)
    assert [slow._first(" " + t).tolist() for t in (*texts[::20], *texts[-5:])] == [*want[::20], *want[-5:]]


def test_merges_that_ranks_do_not_give_are_noticed():
    letters = bpe.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)} | {"ab": 256, "bc": 257, "abc": 258}
    spec = lambda merges: '{"model": {"vocab": ' + json.dumps(vocab) + ', "merges": ' + json.dumps(merges) + "}}"
    assert token_alignment.by_ranks(bpe.ByteBPE(spec(["a b", "b c", "ab c"])))
    assert not token_alignment.by_ranks(bpe.ByteBPE(spec(["a b", "b c", "a bc"])))
    assert not token_alignment.by_ranks(bpe.ByteBPE(spec(["b c", "a b", "a bc"])))


def test_alignment_of_odd_texts(spark, docs, none, tokenizers, monkeypatch):
    monkeypatch.setattr(token_alignment, "CHUNK_TOKENS", 40)
    odd = ["▁", "a▁b", "<s> </s> <unk> <0x41>", "<|endoftext|>", "日本語\U0001f600‍", " lead", "trail  ", "\x00\x01", "é ﬁ", "\t\n", "İ", "x" * 400, "　wide", "12 345 6"]
    src = docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    given = src.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *w) for r, w in zip(given, aligned_by_hand(tokenizers, [r.text for r in given])))
    rows = token_alignment.token_alignment(src.repartition(3)).collect()
    got = collections.Counter((*tuple(r)[:7], hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in rows)
    assert got == want
    assert token_alignment.token_alignment(none).collect() == []
    assert token_alignment.token_alignment(docs.where("text IS NULL")).select("n_links", "groups").distinct().collect() == [(0, "")]
