"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained with FTRL, calibrated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetspark.llm.shared import cut
from facetspark.llm.words import BASE, U, mix

#: Hashed features, and the n-gram lengths in characters.
BITS, GRAMS = 15, (1, 2, 3)
DIM = 1 << BITS
#: The classifier is fitted on at most so many different texts, spread evenly over the languages; one of each at least.
SAMPLE_DOCS = 4000
#: FTRL-proximal: learning rate, its smoothing, and the elastic net's two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
EPOCHS = 3
#: Characters that are hashed at a time; bounds the memory for very long texts.
BLOCK_CHARS = 1 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features that the lower-cased text has, and how often."""
    total = np.zeros(DIM, np.int64)
    text = text.lower()
    reach = max(GRAMS) - 1
    for at in range(0, len(text), BLOCK_CHARS):
        codes = np.frombuffer(text[at : at + BLOCK_CHARS + reach].encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        new = min(BLOCK_CHARS, len(codes))
        h = np.zeros(len(codes), U)
        for n in range(1, reach + 2):
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * U(BASE) + codes[n - 1 :] + U(n)
            if n in GRAMS:
                total += np.bincount((mix(h[:new]) >> U(64 - BITS)).astype(np.int64), minlength=DIM)
    found = np.flatnonzero(total)
    return found, total[found]


def weighted(found: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of the features, with unit length."""
    x = (1 + np.log(n)) * idf[found]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FTRL:
    """Follow the regularised leader, proximal, with an elastic net; weights that stay under the L1 penalty are zero."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = np.outer(x, p)
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that makes the held-back labels likeliest, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean())

    low, high, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: pd.DataFrame, classes: int, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights with a bias in the last row, temperature) from features of labelled documents.

    Every fifth row in hash order is held back for the temperature.
    """
    rows = rows.sort_values(["order", "y"], kind="stable").reset_index(drop=True)
    data = []
    for r in rows.itertuples():
        at = np.asarray(r.found, np.int64)
        data.append((np.append(at, DIM), np.append(weighted(at, np.asarray(r.n, np.int64), idf), 1.0), int(r.y)))
    back = [d for i, d in enumerate(data) if i % 5 == 4]
    train = [d for i, d in enumerate(data) if i % 5 != 4]
    model = FTRL(classes)
    for _ in range(EPOCHS):
        for at, x, y in train:
            model.learn(at, x, y)
    w = model.weights()
    logits = np.array([x @ w[at] for at, x, _ in back]).reshape(len(back), classes)
    return w, temperature(logits, np.array([y for *_, y in back], np.int64))


def _features(src: DataFrame) -> DataFrame:
    """(order, y, _text) -> order, y, found, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [counts(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f for f, _ in got], pa.list_(pa.int64())), pa.array([n for _, n in got], pa.list_(pa.int64()))],
                ["order", "y", "found", "n"],
            )

    return src.select("order", "y", "_text").mapInArrow(run, "order long, y int, found array<long>, n array<long>")


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """id, lang_pred and score for every row; learns from the rows where `learn` is true and lang isn't null.

    Document frequencies are counted over all rows it may learn from. The classifier is fitted on a bounded
    sample of them: at most sample_docs different texts in the order of a hash, with equal shares for the
    languages. Every language that occurs is learned, however many there are, from one text at least.
    Predictions read the text alone. The model is broadcast: 4 x DIM bytes (128 KB) for each language; the
    one task that fits it holds four times that.

    Defined results: null texts and texts without letters are 'und' with score 0; so is everything where
    there is nothing to learn from. Null ids are rows like any other. Ties go to the first language in
    alphabetical order. Repeated rows are predicted alike, and count once in the sample. An empty table gives no rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.coalesce(learn, F.lit(False)).alias("_learn"))
    known = src.where("_learn AND _lang IS NOT NULL AND _text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seen[counts(x.as_py())[0]] += 1
                seen[DIM] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["feature", "docs"])

    often = np.zeros(DIM + 1, np.int64)
    for r in known.select("_text").mapInArrow(count, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).collect():  # DIM + 1 rows
        often[r["feature"]] = r["docs"]
    idf = np.log((1 + often[DIM]) / (1 + often[:DIM])) + 1
    kind = src.schema["_id"].dataType.simpleString()
    if not often[DIM]:
        return src.select(F.col("_id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    texts = known.select("_lang", "_text", F.md5("_text").alias("_key"), F.xxhash64("_text").alias("order"))
    sizes = {r["_lang"]: r["n"] for r in texts.groupBy("_lang").agg(F.approx_count_distinct("order").alias("n")).collect()}  # a number for each language
    langs = sorted(sizes)
    share = max(1, sample_docs // len(langs))
    # hashes below this bound hold twice the share of the texts on average, so no task ranks a whole language
    bounds = [(y, x, min(1.0, 2 * (share + 16) / max(1, sizes[x]))) for y, x in enumerate(langs)]
    named = F.broadcast(spark.createDataFrame(bounds, "y int, _lang string, _bound double"))
    low = F.shiftrightunsigned(F.xxhash64(F.col("order")), 1) < F.col("_bound") * float(1 << 63)
    place = F.row_number().over(W.partitionBy("_lang").orderBy("order", "_key"))
    drawn = texts.join(named, "_lang").where(low).select("_lang", "y", "order", "_key").distinct()
    chosen = cut(drawn.withColumn("place", place).where(F.col("place") <= share).select("_lang", "_key", "y"))  # sample_docs rows, or one a language
    drawn = texts.join(F.broadcast(chosen), ["_lang", "_key"]).dropDuplicates(["_lang", "_key"])
    rows = _features(drawn).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
        lambda pdf: pd.DataFrame([(w.tobytes(), t) for w, t in [fit(pdf, len(langs), idf)]], columns=["w", "t"]), "w binary, t double"
    ).first()
    weights = np.frombuffer(rows["w"], np.float64).reshape(DIM + 1, len(langs)).astype(np.float32)
    model = spark.sparkContext.broadcast((weights, idf, rows["t"], langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, idf, t, langs = model.value
        for batch in batches:
            names, scores = [], []
            for x in batch.column(1):
                text = x.as_py()
                if not text or not LETTER.search(text):
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                found, n = counts(text)
                p = softmax((weighted(found, n, idf) @ w[found] + w[DIM]) / t)
                best = int(p.argmax())
                names.append(langs[best]), scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["_id", "lang_pred", "score"])

    return src.select("_id", "_text").mapInArrow(run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)
