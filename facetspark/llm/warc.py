"""WARC archives in the shared folder and a two-level capture index over them.

Level one: capture lines sorted by reversed-host URL key, in gzip blocks of BLOCK_LINES lines. Level two: a
sparse directory with one entry for each block. A lookup bisects the directory, reads the one block by its
range, bisects its lines, and reads each record by its range of the archive.

Files are written and read by tasks through pyarrow.fs, which opens file, hdfs, s3 and gs paths. Every task
attempt writes files of its own name, and only those of successful tasks are in the tables; so lost and
repeated tasks leave results whole.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from facetspark.llm.shared import cut, new_path, stash

BLOCK_LINES = 1000
#: A task begins another archive beyond this many bytes.
ARCHIVE_BYTES = 1 << 30
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "urlkey string, page_id long, record_type string, digest string, file string, at long, size long"
ENTRY = "first_key string, last_key string, part string, at long, size long, lines long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Bytes of archives, and lines of the index, that a reading task takes.
READ_BYTES, READ_LINES = 16 << 20, 16_000
#: Index parts are listed to every task of a lookup; there are as many as range partitions.
MAX_PARTS = 100_000


def url_key(url: str | None) -> str:
    """The URL's host with its labels reversed, then path and query, in lower case: com,example,www)/a?b. No URL: empty."""
    if not url:
        return ""
    try:
        found = urlsplit(url.strip())
        host = ",".join(reversed((found.hostname or "").split(".")))
        port = f":{found.port}" if found.port and found.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    return f"{host}{port}){found.path or '/'}{'?' + found.query if found.query else ''}".lower()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> tuple[bytes, str]:
    """One WARC/1.1 record and its payload digest. A revisit holds the HTTP headers alone."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """The fields of one record. Digest and size of a response are taken from its payload, those of a revisit from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    told = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(told["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    revisit = told["WARC-Type"] == "revisit"
    return {
        "page_id": int(told["X-Page-Id"]) if "X-Page-Id" in told else None,
        "url": told.get("WARC-Target-URI"),
        "payload_bytes": int(stated["Content-Length"]) if revisit else len(payload),
        "payload_digest": told["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32_sha1(payload),
        "record_type": told["WARC-Type"],
        "refers_to": int(told["X-Refers-To-Page"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def _open_dir(uri: str):
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path, recursive=True)
    return files, path


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record for each page; returns the captures (urlkey, page_id, record_type, digest, file, at, size).

    Of pages with equal payloads (SHA-1, length and a 64-bit hash agree) of at least min_revisit_bytes, the
    largest id is the response and the others are revisits of it. Sizes and ids alone are grouped; payloads
    move once, in the join with the groups, whose hot keys Spark can split, and are written by the task
    that joins them.

    Defined results: a null payload is empty; a null URL gives an empty key and no target URI; null ids
    lose to any other and rows that repeat the response's id are responses too. An empty table gives none.
    """
    spark = pages.sparkSession
    home = new_path(spark, "warc")
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    keyed = src.select("id", "url", "payload", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").alias("n"), F.xxhash64("payload").alias("x"))
    first = keyed.groupBy("sha", "n", "x").agg(F.max("id").alias("first"))
    rows = keyed.join(first, ["sha", "n", "x"]).select("id", "url", "payload", "first")
    schema = _arrow(CAPTURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open_dir(home)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for page_id, url, text, top in zip(*(batch.column(i) for i in range(4))):
                    page_id, url, payload, top = page_id.as_py(), url.as_py(), text.as_py().encode(), top.as_py()
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                    revisit = page_id != top and len(payload) >= min_revisit_bytes
                    data, digest = record(page_id, url, payload, top, revisit)
                    member = gzip.compress(data, LEVEL, mtime=0)
                    out.write(member)
                    found.append((url_key(url), page_id, "revisit" if revisit else "response", digest, f"{home}/{name}", at, len(member)))
                    at += len(member)
                yield _rows(found, schema)
        finally:
            if out is not None:
                out.close()

    return stash(rows.mapInArrow(run, CAPTURE), "warc-captures")


def write_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by URL key over the cluster and write them as compressed blocks; returns the directory.

    Each range partition becomes one index part. Directory: first_key, last_key, part, at, size, lines; one
    row for each block. Equal keys are told apart by page id and place, so a hot key spreads over parts.
    """
    home = new_path(captures.sparkSession, "warc-index")
    schema = _arrow(ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open_dir(home)
        part, out, at, lines, entries = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def flush():
            nonlocal at, out
            if out is None:
                out = files.open_output_stream(f"{path}/{part}", compression=None)
            block = gzip.compress("".join(f"{json.dumps(x)}\n" for x in lines).encode(), LEVEL, mtime=0)
            out.write(block)
            entries.append((lines[0][0], lines[-1][0], f"{home}/{part}", at, len(block), len(lines)))
            at += len(block)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                lines.append(list(row.values()))
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
        yield _rows(entries, schema)

    order = ["urlkey", "page_id", "file", "at"]
    dealt = captures.select(*[x.split()[0] for x in CAPTURE.split(", ")]).repartitionByRange(*order).sortWithinPartitions(*order)
    return stash(dealt.mapInArrow(run, ENTRY), "warc-directory")


def _block(files, path: str, at: int, size: int) -> list[list]:
    with files.open_input_file(path) as f:
        f.seek(at)
        return [json.loads(x) for x in zlib.decompress(f.read(size), 31).decode().splitlines()]


def scan_index(directory: DataFrame) -> DataFrame:
    """All captures, read block by block through the directory."""
    schema = _arrow(CAPTURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                files, path = fs.FileSystem.from_uri(x["part"])
                yield _rows(_block(files, path, x["at"], x["size"]), schema)

    # a number of tasks of its own: adaptive execution would go by the few bytes of the directory
    lines = directory.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    return directory.repartition(max(1, -(-lines // READ_LINES)), "part", "at").mapInArrow(run, CAPTURE)


def lookup(queries: DataFrame, directory: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of each query's URL key: the queries' columns, then those of a capture. No match gives no row.

    Only the list of index parts (their first and last keys; at most MAX_PARTS) goes to every task. A part's
    directory is read by the tasks that need it and bisected for the block.
    """
    spark = directory.sparkSession
    parts = directory.groupBy("part").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).orderBy("lo", "hi").limit(MAX_PARTS + 1).collect()
    if len(parts) > MAX_PARTS:
        raise ValueError(f"over {MAX_PARTS} index parts; write the index with fewer partitions")
    tops = [(r["lo"], r["hi"], r["part"]) for r in parts]
    ends = [t[1] for t in tops]
    keyed = cut(queries.withColumn("_q", F.monotonically_increasing_id()))  # the numbers must not change when tasks are repeated
    names = [c for c in queries.columns]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qs, ps = [], []
            ks = []
            for q, url in zip(batch.column(0), batch.column(1)):
                key = url_key(url.as_py())
                i = bisect.bisect_left(ends, key)
                while i < len(tops) and tops[i][0] <= key:
                    qs.append(q.as_py()), ks.append(key), ps.append(tops[i][2])
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(ks, pa.string()), pa.array(ps, pa.string())], ["_q", "_key", "part"])

    wanted = keyed.select("_q", F.col(url_col)).mapInArrow(keys, "_q long, _key string, part string")
    blocks = directory.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("first_key", "at", "size", "last_key"))).alias("blocks"))
    near = wanted.join(blocks, "part").sortWithinPartitions("part", "_key")
    schema = pa.schema([("_q", pa.int64()), *_arrow(CAPTURE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lines, keys_of = None, [], []
        for batch in batches:
            found = []
            for x in batch.to_pylist():
                files, path = fs.FileSystem.from_uri(x["part"])
                blocks, key = x["blocks"], x["_key"]
                i = bisect.bisect_left(blocks, key, key=lambda b: b["last_key"])
                while i < len(blocks) and blocks[i]["first_key"] <= key:
                    if last != (path, blocks[i]["at"]):
                        last = (path, blocks[i]["at"])
                        lines = _block(files, path, blocks[i]["at"], blocks[i]["size"])
                        keys_of = [y[0] for y in lines]
                    for y in lines[bisect.bisect_left(keys_of, key) : bisect.bisect_right(keys_of, key)]:
                        found.append((x["_q"], *y))
                    i += 1
            yield _rows(found, schema)

    hits = near.select("part", "_key", "_q", "blocks").mapInArrow(run, "_q long, " + CAPTURE)
    clash = {c: f"query_{c}" for c in names if c in [x.split()[0] for x in CAPTURE.split(", ")]}
    return keyed.withColumnsRenamed(clash).join(hits, "_q").drop("_q")


def read_records(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the captures, each read by its range, in the order of the archives."""
    schema = _arrow(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        try:
            for batch in batches:
                found, held = [], 0
                for file, at, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if file != name:
                        if f is not None:
                            f.close()
                        files, path = fs.FileSystem.from_uri(file)
                        name, f = file, files.open_input_file(path)
                    f.seek(at)
                    got = parse(gzip.decompress(f.read(size)))
                    if not payloads:
                        got["payload"] = None
                    found.append(tuple(got.values()))
                    held += len(got["payload"] or b"")
                    if held > 16_000_000:
                        yield _rows(found, schema)
                        found, held = [], 0
                yield _rows(found, schema)
        finally:
            if f is not None:
                f.close()

    # a stretch of an archive for each key, so that a large archive doesn't bind the number of tasks; the number
    # follows the bytes of the archives, as adaptive execution would go by those of the captures
    captures = cut(captures.select("file", "at", "size"))
    size = captures.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(1, -(-size // READ_BYTES))
    stretch = (F.col("at") / (READ_BYTES // 16)).cast("long")
    return captures.repartition(tasks, "file", stretch).sortWithinPartitions("file", "at").mapInArrow(run, RECORD)
