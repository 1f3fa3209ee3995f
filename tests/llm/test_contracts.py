"""Every registered query of the training-data operators on the smallest tables, against brute force."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from facetspark.llm import bpe, decontam, langid, quality, queries, words
from tests.llm.test_dedup import near_by_hand, removed_by_hand, shingles
from tests.llm.test_text_models import smith_waterman

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(bpe.default_vocab())
    tok.no_truncation(), tok.no_padding()
    return tok


def test_op1_finds_what_alignment_of_all_pairs_finds(spark, texts):
    """Every document is aligned with every item by Smith-Waterman; at the threshold nothing else is found."""
    items = {r.item_id: words.word_hashes(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {}
    for i, t in texts.items():
        w = words.word_hashes(t)
        for k, x in items.items():
            if len(np.intersect1d(w, x)) < decontam.THRESHOLD * len(x):
                continue  # fewer common words than the score needs matches
            score, _ = decontam.align([x], [w])
            if score[0] / (2 * len(x)) >= decontam.THRESHOLD and score[0] >= 2 * min(len(x), decontam.LEAST_WORDS):
                want[i, k] = round(score[0] / (2 * len(x)), 6)
    got = {(r.doc_id, r.item_id): r.score for r in queries.op1_benchmark_decontamination(spark, SF).collect()}
    missed = set(want) - set(got)
    assert got.items() <= want.items() and len(got) >= 3
    assert len(missed) <= 0.05 * len(want), missed
    a, b = next(iter(items.values()))[:12], next(iter(items.values()))[2:14]
    assert decontam.align([a], [b])[0][0] == smith_waterman(a.tolist(), b.tolist())


def test_op2(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    top = {}
    for i, p in pages.items():
        top[p] = max(top.get(p, i), i)
    rows = queries.op2_warc_capture_index(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        p = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if top[p] == r.page_id else ("revisit", top[p]))


def test_op3(spark, texts):
    ids = sorted(texts)
    want = dict(zip(ids, removed_by_hand([(texts[i] or "").encode() for i in ids], 400)))
    for r in queries.op3_suffix_array_dedup(spark, SF).collect():
        n, removed, spans, kept = want.pop(r.doc_id)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    assert not want


def test_op4(spark, texts):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out and langs[r.doc_id] and any(c.isalpha() for c in texts[r.doc_id] or "")]
    assert np.mean(held) > 0.9


def test_op4_takes_a_null_id_as_not_held_out(spark, tmp_path):
    rows = [(i, f"text {i} of letters", "en") for i in range(30)] + [(None, "text of letters", "xx"), (None, None, "xx")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r for r in queries.op4_language_id(spark, str(tmp_path)).collect() if r.doc_id is None]
    assert sorted((r.held_out, r.lang_pred) for r in got) == [(False, "en"), (False, "und")]  # nothing is learned from them


def test_languages_beyond_the_sample_are_learned(spark):
    rows = [(1, f"text {i % 7} of letters", "en") for i in range(60)] + [(i, f"wort {chr(97 + i % 26) * 5}", f"l{i}") for i in range(230)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(d, F.lit(True), sample_docs=8).collect()}
    assert len({lang for _, lang in got}) > 5


def test_op5(spark, texts):
    want = near_by_hand(list(texts.items()))
    rows = queries.op5_minhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(shingles(t)), want[i], want[i] == i) for i, t in texts.items()}


def test_op6_thresholds_are_quantiles_of_trusted_documents(spark):
    rows = queries.op6_kneser_ney_quality(spark, SF).collect()
    labels = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels[r.doc_id].append(r.quality == 1 and not r.toxic)
    trusted = [r for r in rows if labels[r.doc_id] and all(labels[r.doc_id]) and r.perplexity]
    assert np.mean([r.kept for r in trusted]) >= 0.95
    assert all(r.kept == (r.n_bytes > 0 and np.log(r.perplexity) <= np.log(r.threshold) + 1e-6) for r in rows if r.perplexity)
    assert len({(r.lang, r.threshold) for r in rows}) == len({r.lang for r in rows})
    assert quality.QUANTILE == 0.995


def test_op7_and_op10(spark, texts, library):
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    for r in queries.op7_bpe_round_trip(spark, SF).collect():
        x = ids[r.doc_id]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(x), digest(",".join(map(str, x))), digest(library.decode(x, skip_special_tokens=False)))
    n = np.array([len(x) for x in ids.values()])
    for r in queries.op10_token_counts(spark, SF).collect():
        assert (r.n_docs, r.docs_from, r.tokens_from, r.kept_total) == ((n == r.n_tokens).sum(), (n >= r.n_tokens).sum(), n[n >= r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum())


def test_op8(spark, texts):
    rows = queries.op8_label_propagation_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = collections.defaultdict(list)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(len(slots[i]) for i in range(40)) <= 1
    places = collections.defaultdict(set)
    for r in rows:
        places[texts[r.doc_id]].add(r.shard)
    copies = collections.Counter(t for t in texts.values() if t)
    split = [t for t, c in copies.items() if 1 < c <= len(rows) // 40 and len(places[t]) > 1]
    assert len(split) <= 0.2 * sum(1 < c for c in copies.values())
