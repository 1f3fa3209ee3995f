"""WARC archives and index, and sharding."""

import base64
import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from facetspark.llm import sharding, warc


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def pages(spark):
    data = [(i, f"http://www{i % 3}.Example.com/p{i % 7}?q={i}", f"<p>{i % 5}</p>" * (i % 4)) for i in range(60)]
    data += [(100, None, "x"), (101, "http://a.b/c d\n", None), (102, "", "é\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://n.o/", "x"), (103, "http://[bad", "big" * 50_000), (59, data[59][1], data[59][2])]
    return spark.createDataFrame(data, "page_id long, url string, html string").withColumn("file", F.lit("clash"))


def test_archives_come_back_through_the_index(pages):
    captures = warc.write_archives(pages)
    directory = warc.write_index(captures, block_lines=7)
    assert sorted(map(repr, rows(warc.scan_index(directory)))) == sorted(map(repr, rows(captures)))
    got = warc.read_records(warc.scan_index(directory)).collect()
    data = [(i, u, (h or "").encode()) for i, u, h in rows(pages.select("page_id", "url", "html"))]
    assert len(got) == len(data)
    top = {}
    for i, _, p in data:
        top[p] = max(top.get(p, -1), -1 if i is None else i)
    payload = {i: p for i, _, p in data}
    for r in got:
        p = payload[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert r.record_type == ("response" if r.page_id == top[p] else "revisit")
        assert r.refers_to == (None if r.record_type == "response" else top[p])
        if r.record_type == "response":
            assert bytes(r.payload) == p
    hits = warc.lookup(pages.select(F.col("page_id").alias("asked"), "url"), directory)
    keys = Counter(warc.url_key(u) for _, u, _ in data)
    found = Counter(r.asked for r in hits.collect())
    for i, u, _ in data:
        if i != 59:
            assert found[i] == keys[warc.url_key(u)]
    assert rows(warc.lookup(pages.limit(1).select(F.lit("http://not.there/").alias("url")), directory)) == []


def test_small_payloads_need_not_be_revisits(pages):
    kinds = Counter(r.record_type for r in warc.read_records(warc.write_archives(pages, min_revisit_bytes=10**9)).collect())
    assert kinds == {"response": 66}


def test_a_record_is_a_member_of_its_own():
    data, digest = warc.record(5, "http://a/", b"hi", None, False)
    assert warc.parse(gzip.decompress(gzip.compress(data)))["payload"] == b"hi" and data.endswith(b"\r\n\r\n")
    assert warc.url_key("HTTPS://m.Example.org:8080/A?b#c") == "org,example,m:8080)/a?b"


def test_no_pages(pages):
    directory = warc.write_index(warc.write_archives(pages.limit(0)))
    assert rows(warc.read_records(warc.scan_index(directory))) == []
    assert rows(warc.lookup(pages.select("url"), directory)) == []


def check_shards(got, n, shards):
    counts = Counter(r.shard for r in got)
    assert len(got) == n and max(counts.values()) - min(counts[j] for j in range(shards)) <= 1
    for j in range(shards):
        assert sorted(r.slot for r in got if r.shard == j) == list(range(counts[j]))


def test_shards_are_even_and_keep_copies_together(spark):
    texts = [f"group {i % 50}" for i in range(200)] + ["hot"] * 300 + [f"single {i}" for i in range(400)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard_documents(d, shards=8).collect()
    check_shards(got, 900, 8)
    of = {}
    for r in got:
        of.setdefault(texts[r.doc_id], set()).add(r.shard)
        assert r["size"] == len(texts[r.doc_id]) + 16
    assert sum(len(x) > 1 for t, x in of.items() if t.startswith("group")) <= 3 and len(of["hot"]) <= 4


def test_shards_when_all_documents_are_linked(spark):
    d = spark.createDataFrame([(i, f"t{i % 30}") for i in range(90)], "doc_id long, text string")
    got = sharding.shard_documents(d, shards=7).collect()
    check_shards(got, 90, 7)
    of = {}
    for r in got:
        of.setdefault(r.doc_id % 30, set()).add(r.shard)
    assert sum(len(x) == 1 for x in of.values()) >= 10  # without free room only swaps can bring groups together


def test_shards_of_awkward_documents(docs, none):
    got = sharding.shard_documents(docs, shards=3).collect()
    check_shards(got, docs.count(), 3)
    assert {r.text_crc32 for r in got if r.doc_id == 5} == {0} and {r.law for r in got} == {"rows"}
    assert rows(sharding.shard_documents(none)) == []
    check_shards(sharding.shard_documents(docs.limit(2), shards=40).collect(), 2, 40)
