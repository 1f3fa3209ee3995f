"""Near-duplicates: one-permutation MinHash with optimal densification, bands, star-shaped candidates, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from facetspark.llm.components import components
from facetspark.llm.shared import cut, stash
from facetspark.llm.words import BASE, U, mix, new_key, shingle_set, shingle_set_and_print

#: Bins of the signature, as a power of two, and bins in a band. A link at similarity 0.75 shares at least
#: one of the 32 bands but for 5 cases in a million.
BIN_BITS, BAND_BINS = 7, 4
BINS = 1 << BIN_BITS
#: A link: LINK_NUM * union <= LINK_DEN * intersection.
LINK_NUM, LINK_DEN = 75, 100
#: Classes of set sizes within the factor LINK_DEN / LINK_NUM, for the exact join.
SIZE_STEPS = 4
PROBES = 1024


def _probes() -> np.ndarray:
    """For each attempt and empty bin the bin to copy from: a 2-universal choice that all documents share."""
    t, b = np.meshgrid(np.arange(PROBES, dtype=U), np.arange(BINS, dtype=U), indexing="ij")
    return (mix(mix(t + U(BASE)) ^ (b * U(0xD6E8FEB86659FD93))) >> U(64 - BIN_BITS)).astype(np.int64)


PROBE = _probes()
EDGES = np.arange(BINS, dtype=U) << U(64 - BIN_BITS)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin of one permutation; empty bins copy bins found by the shared probes.

    The hashes are sorted and well mixed, so that the top bits are the bin.
    """
    at = np.searchsorted(hashes, EDGES)
    low = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & ((low >> U(64 - BIN_BITS)) == np.arange(BINS, dtype=U))
    empty = np.flatnonzero(~full)
    done = 0
    while len(empty) and done < PROBES:
        tries = PROBE[done : done + (16 if done == 0 else PROBES), empty]
        hit = full[tries]
        found = hit.any(axis=0)
        low[empty[found]] = low[tries[hit[:, found].argmax(axis=0), found]]
        done += len(tries)
        empty = empty[~found]
    for b in empty:  # a few in ten thousand, where one bin is full
        low[b] = low[np.flatnonzero(full)[0]]
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, BAND_BINS)
    h = mix(np.arange(1, len(rows) + 1, dtype=U) * U(BASE))
    for j in range(BAND_BINS):
        h = mix(h * U(BASE) + rows[:, j])
    return h


def _signed(src: DataFrame, key: int) -> DataFrame:
    """(_id, _text) -> id, n (set size), print (128-bit hash of the set), bands. Bands are the same in every run; what decides is hashed under the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, bands = [], [], []
            for text in batch.column(1):
                s, size, told = shingle_set_and_print(text.as_py(), key)
                n.append(size)
                prints.append(told)
                bands.append(band_keys(signature(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "print", "bands"]
            )

    return src.mapInArrow(run, f"id {src.schema['_id'].dataType.simpleString()}, n long, print binary, bands array<long>")


def _sets(src: DataFrame, key: int) -> DataFrame:
    """(_id, _text) -> id, n, s (the sorted 64-bit shingle hashes under the key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), key=key) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "s"]
            )

    return src.mapInArrow(run, f"id {src.schema['_id'].dataType.simpleString()}, n long, s binary")


def _shared(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.as_py(), y.as_py()
                same = _shared(x, y)
                keep.append(LINK_DEN * same >= LINK_NUM * (len(x) // 8 + len(y) // 8 - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    kinds = dict(pairs.dtypes)
    return both.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}")


def _sizes_fit(n, m):
    """Sets of such sizes can be similar enough."""
    return LINK_DEN * F.least(n, m) >= LINK_NUM * F.greatest(n, m)


def _rest(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components that can be linked, by an exact prefix filter.

    Linked sets of n and m elements share at least o = LINK_NUM * (n + m) / (LINK_NUM + LINK_DEN) of them. With
    both ordered alike, the first that they share has place n - o + 1 at most in the one and m - o + 1 in the
    other. Ordered from rare to common, elements of a passage that many documents share come last.
    Elements that one document alone has need no row beyond their count. Sets meet by element and by both their
    size classes, each only in the classes that its place leaves possible; so documents of like size that share a
    common passage of less than the needed share don't meet at all.
    """
    items = _items(sets.join(labels, "id"))
    often = items.groupBy("w").agg(F.count("*").alias("f"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("f > 1")
    common = items.join(often, "w")
    # places in the order of a set: elements of its own first, then by (f, w); one row a document holds its shared elements
    lone = F.col("n") - F.size("c")
    first = F.col("n") - F.ceil(F.col("n") * LINK_NUM / LINK_DEN).cast("long") + 1
    kept = (
        common.groupBy("id", "n", "label")
        .agg(F.sort_array(F.collect_list(F.struct("f", "w", (F.col("l1") != F.col("l2")).alias("mixed")))).alias("c"))
        .where(first > lone)
        .select("id", "n", "label", lone.alias("lone"), F.posexplode(F.slice("c", F.lit(1), (first - lone).cast("int"))).alias("i", "c"))
        .where("c.mixed")
        .select("id", "n", "label", (F.col("lone") + F.col("i") + 1).alias("at"), F.col("c.w").alias("w"))
    )
    kept = stash(kept, "near-prefixes")
    # the largest partner that a place allows: LINK_NUM * (n + m) <= (LINK_NUM + LINK_DEN) * (n - at + 1)
    most = F.floor((LINK_NUM + LINK_DEN) * (F.col("n") - F.col("at") + 1) / F.lit(LINK_NUM)).cast("long") - F.col("n")
    kept = kept.withColumn("most", most).withColumn("size", _size_class(F.col("n")))
    largest = F.least(F.floor(F.col("n") * LINK_DEN / F.lit(LINK_NUM)).cast("long"), F.col("most"))
    smallest = F.ceil(F.col("n") * LINK_NUM / F.lit(LINK_DEN)).cast("long")
    # the smaller set of a pair meets the larger one under (w, class of the one, class of the other), where both places allow it
    small = kept.where(F.col("most") >= F.col("n")).select("*", F.explode(F.sequence("size", _size_class(largest))).alias("other"))
    large = kept.where(F.col("most") >= smallest).select("*", F.explode(F.sequence(_size_class(smallest), _size_class(F.least("n", "most")))).alias("other"))
    x, y = small.alias("x"), large.alias("y")
    near = (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most"))
    turn = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    met = (F.col("x.w") == F.col("y.w")) & (F.col("x.size") == F.col("y.other")) & (F.col("x.other") == F.col("y.size"))
    return (
        x.join(y, met & turn & near & (F.col("x.label") != F.col("y.label")) & _sizes_fit(F.col("x.n"), F.col("y.n")))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
    )


def _size_class(n):
    """The class of a set size; classes are a constant factor wide and rise with the size."""
    return F.floor(F.log(n.cast("double")) * (SIZE_STEPS / math.log(LINK_DEN / LINK_NUM))).cast("int")


def _items(named: DataFrame) -> DataFrame:
    """One row for each element of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w = np.frombuffer(batch.column(2)[i].as_py(), np.int64)
                place = pa.array(np.full(len(w), i, np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(place) for j in (0, 1, 3)), pa.array(w)], ["id", "n", "label", "w"])

    kinds = dict(named.dtypes)
    return named.select("id", "n", "s", "label").mapInArrow(run, f"id {kinds['id']}, n long, label {kinds['label']}, w long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are sets of five-word shingles (A-Z lower-cased, words between ASCII white space; fewer words
    are one shingle). Two are linked when 100 * intersection >= 75 * union. A component is named by its
    smallest id, which is the one kept.

    Shingles are hashed under a secret key of the run, so that nobody can write texts whose different shingles agree; the bands
    alone are not, so that every run has the same candidates.

    1. Equal sets fall together by a 128-bit hash of the set; the smallest id stands for them from here on.
    2. One-permutation MinHash with optimal densification gives 128 bins, in 32 bands of 4. Members of a
       band's bucket are paired with one member alone (a star), so a bucket of m gives m - 1 pairs, which
       are confirmed on the whole sets. The centre is the member with most neighbours over all bands, which is
       nearest to the others of a group of edited copies.
    3. A star can miss a link between two members that aren't linked with its centre. So every bucket
       that holds several components after that hands its members to an exact prefix-filter join
       between components, and its pairs are confirmed on the whole sets too.

    Defined results: null or blank texts have an empty set and no links. Null ids are rows of their own:
    component null, kept. Rows that repeat an id are one document, linked where any of its texts is, and
    are marked alike. An empty table gives no rows. Only the two named columns are read.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    key = new_key()
    signed = stash(_signed(src, key), "near-signed")
    known = signed.where("print IS NOT NULL AND id IS NOT NULL")
    classes = cut(known.groupBy("print").agg(F.min(F.struct("id", "n", "bands")).alias("r"), F.count("*").alias("copies")))
    reps = classes.select("r.*")
    rows = reps.select("id", "n", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    member = stash(rows.join(full, "key"), "near-members")
    ids = cut(member.groupBy("id").agg(F.sum("c").alias("near")))
    member = cut(member.join(ids, "id").select("key", "id", "n", F.struct((-F.col("near")).alias("fewer"), "id").alias("rank")))
    sets = stash(_sets(src.join(ids, src["_id"] == ids["id"], "left_semi"), key), "near-sets")
    hubs = member.groupBy("key").agg(F.min_by(F.struct("id", "n"), "rank").alias("h")).select("key", F.col("h.id").alias("hub"), F.col("h.n").alias("hub_n"))
    far = (F.col("id") != F.col("hub")) & _sizes_fit(F.col("n"), F.col("hub_n"))
    pairs = cut(member.join(hubs, "key").where(far).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    links = cut(confirm(pairs, sets))
    labels = cut(ids.join(components(links), "id", "left").select("id", F.coalesce("component", "id").alias("label")))
    named = member.join(labels, "id")
    mixed = named.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2").select("key")
    open_ids = cut(member.join(mixed, "key", "left_semi").select("id").distinct())
    more = confirm(_rest(sets.join(open_ids, "id", "left_semi"), labels), sets)
    found = components(links.unionByName(more))
    named = classes.select("print", F.col("r.id").alias("id")).join(found, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    # documents without a set match nothing; a key of their own keeps them from meeting in one task
    keyed = signed.select("id", "n", F.coalesce(F.col("print"), F.expr("cast(concat('-', cast(id as string)) as binary)")).alias("print"))
    done = keyed.join(named, "print", "left")
    component = F.coalesce("component_id", "id")
    return done.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )
