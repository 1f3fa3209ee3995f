"""BM25 in blocks, phrases in long texts and containment of short items, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from facetspark.operators import channels, coverage, lexical, similarity
from facetspark.plans.retrieval import contained


def rows(df):
    return [tuple(r) for r in df.collect()]


def brute_bm25(docs, queries):
    split = [(u, re.findall(r"\w\w+", t.lower())) for u, t in docs if t is not None]
    n, avg = len(split), sum(len(t) for _, t in split) / len(split)
    df = Counter(w for _, t in split for w in set(t))
    out = {}
    for q, text in queries:
        for w in re.findall(r"\w\w+", (text or "").lower()):
            for u, t in split:
                if tf := t.count(w):
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    out[q, u] = out.get((q, u), 0) + idf * tf / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
    return out


def test_bm25_is_the_same_in_one_block_and_in_many(spark):
    draw = random.Random(4)
    word = lambda: draw.choice(["the", "of", "Ash", "birch", "cedar", "x", "élan", "elm"])
    docs = [(u, " ".join(word() for _ in range(draw.randint(0, 30)))) for u in range(40)] + [(40, None), (41, "")]
    queries = [(q, " ".join(word() for _ in range(4))) for q in range(9)] + [(9, None), (10, "")]
    want = brute_bm25(docs, queries)
    d, q = spark.createDataFrame(docs, "uid long, text string"), spark.createDataFrame(queries, "qid long, text string")
    for size in (16_000_000, 300):
        got = {(r.qid, r.uid): r.score for r in lexical.bm25(d, q, block_bytes=size).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert rows(lexical.bm25(d.limit(0), q)) == [] and rows(lexical.bm25(d, q.limit(0))) == []


def test_phrases_of_every_length_are_found_in_long_texts(spark, monkeypatch):
    draw = random.Random(7)
    texts = [("long", [draw.choice("abcdefg") for _ in range(20_000)]), ("short", ["a", "b"]), ("none", []), (None, ["c", "a", "b"])]
    phrases = list({(k, tuple(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6)))) for k in "KLMN" for _ in range(6)}) + [("E", ())]
    want = set()
    for q, words in texts:
        line = " " + " ".join(words) + " "
        for key in {k for k, _ in phrases}:
            hits = [" ".join(p) for k, p in phrases if k == key and p and f" {' '.join(p)} " in line]
            if hits:
                want.add((q, key, min(hits, key=lambda h: (-len(h), h))))
    q = spark.createDataFrame(texts, "qid string, words array<string>")
    p = spark.createDataFrame([(k, list(w)) for k, w in phrases], "key string, words array<string>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for size in (1, channels.PHRASE_BYTES):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            monkeypatch.setattr(channels, "PHRASE_BYTES", size)
            got = rows(channels.phrase_matches(q, p))
            assert len(got) == len(set(got)) and set(got) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert rows(channels.phrase_matches(q, p.limit(0))) == []


def test_items_of_any_length_are_found_where_they_stand(spark):
    docs = [(1, "one two  three\nfour five six seven eight"), (2, "twofold phone two"), (3, ""), (4, None), (5, "one two three four five six"), (6, "aé x"), (6, "aé x")]
    items = ["one two  three\nfour five six seven", "two three four", "e t", "one tw", "one", "o", "é", "", None, "hone two", " two ", "two  three\n", "four five six s", "zebra", "one two three four five six "]
    d = spark.createDataFrame(docs, "uid long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "qid long, text string")
    want = sorted({(q, u) for q, x in enumerate(items) for u, t in docs if x is not None and t is not None and x in t})
    assert sorted(rows(contained(d, i))) == want
    assert rows(contained(d, i.limit(0))) == [] and rows(contained(d.limit(0), i)) == []


def test_search_deals_pairs_over_tasks_and_keeps_the_best_of_each_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 4)), 1)
    x[200:260] = x[:60]  # ties
    units = spark.createDataFrame([(i, [float(y) for y in v], f"g{i % 3}") for i, v in enumerate(x)], "uid long, vec array<double>, grp string")
    asked = units.where("uid % 50 = 0").select(F.col("uid").alias("qid"), "vec")
    monkeypatch.setattr(similarity, "PAIRS", 500)
    scored = similarity.score_all(asked, units, 5, "grp")
    assert scored.rdd.getNumPartitions() == 7  # 8 queries, 400 units
    got = {}
    for r in scored.collect():
        got.setdefault((r.qid, r.uid % 3), []).append((-round(r.score, 9), r.uid))
    for q in range(0, 400, 50):
        for g in range(3):
            assert sorted(got[q, g])[:5] == sorted((-round(float(x[q] @ x[i]), 9), i) for i in range(g, 400, 3))[:5]
    assert similarity.score_all(asked, units).count() == 3200


def test_group_channel_looks_up_scored_units_only(spark):
    groups = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.7), (1, "d", 0.6), (1, "none", 1.0), (2, "d", 0.1)], "qid long, grp string, score double")
    members = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("d", 3), (None, 4), ("c", 5)], "grp string, uid long")
    scores = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.6), (1, 3, 0.9), (1, 4, 0.9), (2, 3, 0.2), (2, 1, 0.3)], "qid long, uid long, score double")
    got = coverage.group_channel(groups, members, scores)
    assert sorted((r.qid, r.uid, r["rank"]) for r in got.collect()) == [(1, 1, 2), (1, 2, 1), (2, 3, 1)]
    assert not re.search(r"Join \[grp#\w+\], \[grp#\w+\], Inner", got._jdf.queryExecution().executedPlan().toString())


def test_bm25_takes_tasks_by_its_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"red blue w{i}") for i in range(60)], "uid long, text string")
    asked = spark.createDataFrame([(q, "red blue") for q in range(20)], "qid long, text string")
    whole = sorted(map(tuple, lexical.bm25(docs, asked).collect()))
    monkeypatch.setattr(lexical, "TASK_PAIRS", 300)  # of 2 * 60 * 20
    scored = lexical.bm25(docs, asked)
    assert scored.rdd.getNumPartitions() == 8 and sorted(map(tuple, scored.collect())) == whole


def test_null_and_empty_groups_are_two(spark):
    units = spark.createDataFrame([(1, [1.0], None), (2, [2.0], ""), (3, [0.5], None), (4, [3.0], "x")], "uid long, vec array<double>, grp string")
    got = similarity.score_all(spark.createDataFrame([(0, [1.0])], "qid long, vec array<double>"), units.coalesce(1), 1, "grp")
    assert sorted(r.uid for r in got.collect()) == [1, 2, 4]
