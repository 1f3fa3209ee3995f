"""Encoding, token counts, language identification, quality model and decontamination."""

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from facetspark.llm import bpe, decontam, langid, quality, token_counts, words

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def order(x):
    return sorted(x, key=repr)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_agrees_with_the_tokenizers_library(spark, docs, library):
    odd = ["    \x1c\x1d a　b\n\n\n c", "don't I'LL we've 12345 ½ ٣ 日本語 🙂👩‍👩‍👧 \x85  z", " " * 50 + "x", "\u0000​", "<|endoftext|", "﻿abc"]
    real = [r[0] for r in rows(spark.read.parquet(f"{SF}/documents.parquet").select("text"))]
    texts = [t for _, t in rows(docs.select("doc_id", "text"))] + odd + real
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, ids, text in rows(bpe.decode(bpe.encode(d))):
        want = library.encode(texts[i] or "", add_special_tokens=False).ids
        assert ids == want
        assert text == library.decode(want, skip_special_tokens=False)


def test_round_trip_is_decode_of_encode(docs, none):
    assert order(rows(bpe.round_trip(docs))) == order(rows(bpe.decode(bpe.encode(docs))))
    assert rows(bpe.round_trip(none)) == []


def test_bpe_of_nothing_and_of_null_ids(spark, none):
    assert rows(bpe.decode(bpe.encode(none))) == []
    codes = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert order(r[2] for r in rows(bpe.decode(codes))) == ["", ""]


def test_token_counts_answer_every_limit(docs, none, library):
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows(docs.select("doc_id", "text"))]
    sums = token_counts.token_counts(docs)
    got = {r.n_tokens: r for r in sums.collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert (r.n_docs, r.docs_from) == (lengths.count(limit), sum(x >= limit for x in lengths))
        assert r.kept_total == sum(min(x, limit) for x in lengths) and r.kept_total + r.lost_total == sum(lengths)
    for r in token_counts.at_limits(sums, [0, 1, 7, 33, 10**7]).collect():
        assert (r.docs, r.docs_cut, r.kept_total) == (len(lengths), sum(x > r.context_limit for x in lengths), sum(min(x, r.context_limit) for x in lengths))
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == sorted(lengths)[math.ceil(r.share * len(lengths)) - 1]
    assert rows(token_counts.token_counts(none)) == []


def test_language_identification_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = langid.identify(d, ~held_out).join(d.select("doc_id", "lang", held_out.alias("held")), "doc_id").where("held").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_identification_of_awkward_documents(docs, none):
    got = langid.identify(docs, F.lit(True))
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == docs.count()
    for i in (5, 6, 7, 12):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[1].lang_pred in ("en", "fr")
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}
    assert rows(langid.identify(none, F.lit(True))) == []


def test_temperature_prefers_honest_scores():
    logits = np.array([[4.0, 0.0]] * 10)
    assert langid.temperature(logits, np.array([0] * 7 + [1] * 3)) > 2


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by the textbook, over bytes."""
    counts = [None] * (order + 1)
    counts[order] = collections.Counter()
    for t in texts:
        b = bytes(order - 1) + t
        for i in range(len(t)):
            counts[order][b[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    d = [quality.discounts(collections.Counter(min(c, 5) for c in counts[k].values())) if k else None for k in range(order + 1)]

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        seen = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        total = sum(seen.values())
        if not total:
            return p(gram[1:])
        c = seen.get(gram, 0)
        off = lambda x: d[k][min(x, 3) - 1] if x else 0.0
        gamma = sum(off(x) for x in seen.values()) / total
        return (c - off(c)) / total + gamma * p(gram[1:])

    return p


@pytest.mark.parametrize("rows_of_model", [quality.MODEL_ROWS, 150])
def test_quality_model_is_kneser_ney(spark, monkeypatch, rows_of_model):
    """Whole and in shards."""
    monkeypatch.setattr(quality, "MODEL_ROWS", rows_of_model)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(4)]
    shelf = quality.shelve(quality.model(quality.count_ngrams(spark.createDataFrame([(t,) for t in texts], "text string"))))
    assert (shelf.shards > 1) == (rows_of_model == 150)
    asked = [texts[0], "abca bc", "zzz", "", None, "été"]
    twice = [*enumerate(asked), (0, texts[0])]
    found = quality.score(spark.createDataFrame(twice, "doc_id long, text string"), shelf).collect()
    assert len(found) == len(twice)
    got = {r.doc_id: r.log_p for r in found}
    p = kneser_ney([t.encode() for t in texts], quality.ORDER)
    for i, t in enumerate(asked):
        b = bytes(quality.ORDER - 1) + (t or "").encode()
        want = sum(math.log(p(b[j : j + quality.ORDER])) for j in range(len(b) - quality.ORDER + 1))
        assert got[i] == pytest.approx(want, abs=1e-3)


def test_quality_of_awkward_documents(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, None), (16, 1, 0), (16, 0, 0), (99, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.count() == docs.count()
    by_id = {r.doc_id: r for r in got.collect()}
    assert not any(by_id[i].kept for i in (5, 6)) and by_id[1].kept and by_id[8].kept and not by_id[12].kept
    assert by_id[5].perplexity is None
    unlabelled = {r.doc_id: r.kept for r in quality.classify(docs, labels.limit(0)).collect()}
    assert unlabelled[12] and not unlabelled[6]
    assert rows(quality.classify(none, labels)) == []


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max([best, *new])
    return best


def test_alignment_is_smith_waterman():
    rng = random.Random(4)
    xs = [np.array([rng.randrange(4) for _ in range(rng.randrange(1, 12))], np.uint64) for _ in range(40)]
    ys = [np.array([rng.randrange(4) for _ in range(rng.randrange(1, 20))], np.uint64) for _ in range(40)]
    got, _ = decontam.align(xs, ys)
    assert got.tolist() == [smith_waterman(x.tolist(), y.tolist()) for x, y in zip(xs, ys)]


def test_decontamination_finds_copies_and_edited_copies(spark):
    rng = random.Random(6)
    item = " ".join(f"b{rng.randrange(10**6)}" for _ in range(40))
    edited = item.split()
    for i in range(3, 40, 6):
        edited[i] = "changed"
    noise = lambda n: " ".join(f"n{rng.randrange(300)}" for _ in range(n))
    texts = [noise(300) + " " + item.upper() + "\n" + noise(200), noise(50) + " " + " ".join(edited) + " " + noise(20), noise(400), None, "", item]
    many = [(100 + i, noise(30) + " " + item) for i in range(200)]  # a leak that is common isn't taken for a common phrase
    d = spark.createDataFrame([*enumerate(texts), *many], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, noise(2)), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.decontaminate(d, b).collect()}
    assert set(got) == {(0, 1), (1, 1), (5, 1), *((i, 1) for i, _ in many)}
    assert got[0, 1].score == 1.0 and got[5, 1].score == 1.0 and 0.5 < got[1, 1].score < 1
    assert (got[0, 1].from_word, got[0, 1].to_word) == (300, 340)


def test_decontamination_in_blocks_and_of_awkward_documents(spark, docs, none, monkeypatch):
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    whole = order(rows(decontam.decontaminate(real, b)))
    held = {(i, k) for i, t in rows(real.select("doc_id", "text")) for k, x in rows(b.select("item_id", "text")) if x in t}
    assert held <= {r[:2] for r in whole}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    assert order(rows(decontam.decontaminate(real, b))) == whole
    assert rows(decontam.decontaminate(docs, b)) == []
    assert rows(decontam.decontaminate(none, b)) == [] and rows(decontam.decontaminate(docs, b.limit(0))) == []


def test_word_hashes_of_long_texts_come_in_blocks(monkeypatch):
    text = " ".join(f"Wort{i}" for i in range(3000)) + "   x" + "y" * 3000 + "\x0bende"
    whole = words.word_hashes(text)
    assert len(whole) == len(text.split()) and len(set(whole.tolist())) == len(set(text.split()))
    assert words.word_hashes(text.upper()).tolist() == whole.tolist()
    monkeypatch.setattr(words, "BLOCK_BYTES", 5000)
    assert words.word_hashes(text).tolist() == whole.tolist()
    assert hashlib.sha256(whole.tobytes()).hexdigest() == hashlib.sha256(words.word_hashes(text).tobytes()).hexdigest()


def test_quality_keeps_held_out_clean_documents_of_every_language(spark):
    """A model's own texts are less perplexing to it than unseen ones, and so no measure for a threshold."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1 AND toxic = 0")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 2
    got = quality.classify(d, clean.where(~held)).join(clean.where(held).select("doc_id"), "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        kept = [r.kept for r in got if r.lang == lang]
        assert len(kept) > 3 and np.mean(kept) >= 0.75, (lang, kept)
    assert np.mean([r.kept for r in got]) > 0.9


@pytest.mark.parametrize("step", [3, 4])
def test_decontamination_finds_copies_with_evenly_spread_edits(step):
    item = [f"b{i}" for i in range(40)]
    copy = ["changed" if i % step == step - 1 else w for i, w in enumerate(item)]
    items = decontam.Items([(1, " ".join(item))], decontam.SEED_WORDS)
    assert (0, 0) in decontam._hits([" ".join(copy)], items, decontam.THRESHOLD, decontam.LEAST_WORDS)
