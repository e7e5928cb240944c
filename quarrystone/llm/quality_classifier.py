"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Words are runs of letters, of digits and of other visible characters, in their case.  Features of
a text are its distinct n-grams of one and two words, hashed to ``BUCKETS``, each with the square
root of its share of the places; and n-grams of two and of four words by how often they occur in
the text (class of multiplicity), with their share of the places.  Values are kept to half precision,
in training and in scoring.

Training takes a bounded sample of labelled rows: at most ``TRAIN_ROWS``, the first by a hash of
the id, and of those, in that order, as many as have ``TRAIN_VALUES`` features together, so that the
sample fits one task; features are made where the texts lie, and one task runs the updates over the
sample in that order, ``EPOCHS`` times.  The weights (``BUCKETS`` numbers) go to the scoring tasks.

Defined results: a null or empty text has no features and gets the score of the bias; without
labelled rows every score is 0.5; documents with a null label teach nothing, nor do labels without
a document; an id labelled twice teaches by its smaller label and one with several texts by the smallest;
repeated documents each give their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, keep_rows, map_arrow, strings, table

BUCKETS = 1 << 18
#: Bound of the training sample, in rows.
TRAIN_ROWS = 10_000
#: Bound of the training sample, in features (6 bytes each).
TRAIN_VALUES = 1 << 24
EPOCHS = 3
#: Learning rate, its smoothing, and the two regularisers.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
PREDICT_AT = 0.3
#: Words kept with their hashes by a worker; the table starts anew when full.
KEPT_WORDS = 200_000
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Hashes(dict):
    def forget(self) -> None:
        self.clear()

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = zlib.crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = Hashes()
_MULT = np.uint64(0xC2B2AE3D27D4EB4F)
#: Salts of the n-gram lengths and multiplicity classes.
_SHIFT = np.uint64(64 - 18)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, ascending and distinct, and values."""
    words = WORD.findall(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    places, values = [], []
    gram = h
    for n in (1, 2, 3, 4):
        if n > 1:
            if len(h) < n:
                break
            gram = (gram[:-1] * _MULT) ^ (h[n - 1 :] + np.uint64(n))
        if n <= 2 or n == 4:
            found, times = np.unique(gram, return_counts=True)
        if n <= 2:
            places.append(((found * _MULT) >> _SHIFT).astype(np.int32))
            values.append(np.sqrt(times / len(gram)))
        if n in (2, 4):
            share = np.bincount(np.minimum(np.log2(times).astype(int), 7), times, 8) / len(gram)
            at = np.flatnonzero(share)
            places.append(np.array([zlib.crc32(b"times %d %d" % (n, k)) % BUCKETS for k in at], np.int32))
            values.append(share[at])
    at, first = np.unique(np.concatenate(places), return_inverse=True)
    return at, np.bincount(first, np.concatenate(values)).astype(np.float16).astype(np.float32)


def train(rows: Iterator[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by follow-the-regularised-leader updates; the last one is the bias."""
    rows = list(rows)
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for label, at, x in rows:
            at, x = np.append(at, BUCKETS), np.append(x.astype(np.float32), 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (sigmoid(float(w @ x)) - label) * x
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    return weights(z, n).astype(np.float32)


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(50.0, max(-50.0, x))))


def score(weights: np.ndarray, text: str) -> float:
    at, x = features(text)
    return float(sigmoid(float(weights[at] @ x) + float(weights[-1])))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, values: int = TRAIN_VALUES) -> np.ndarray:
    """Weights from at most ``rows`` labelled documents with ``values`` features together."""
    if rows > TRAIN_ROWS:
        raise ValueError(f"at most {TRAIN_ROWS} rows, as their ids go to every task")
    key = F.col(id_col)
    sample = (
        labels.filter(key.isNotNull() & F.col(label_col).isNotNull())
        .groupBy(key.alias("_id"))
        .agg(F.min(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    texts = docs.filter(F.col(text_col).isNotNull()).select(key.alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # The sample's rows are bounded by `rows`, so its ids can be sent to every task.
    known = texts.join(F.broadcast(sample), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_HASHES)
        for b in batches:
            found = [features(t) for t in strings(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([x.astype(np.float16).tobytes() for _, x in found], pa.binary())], ["_id", "_label", "at", "x"])

    kind = known.schema["_id"].dataType.simpleString()
    made = map_arrow(known, make, f"_id {kind}, _label int, at binary, x binary", 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, left = [], values
        for b in batches:
            for y, a, x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                left -= len(a) // 4
                if left >= 0:
                    rows.append((y, np.frombuffer(a, np.int32), np.frombuffer(x, np.float16)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([train(rows).tobytes()], pa.binary())], ["weights"])

    ordered = made.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "at")
    got = map_arrow(ordered, run, "weights binary", 512).collect()
    return np.frombuffer(bytes(got[0]["weights"]), np.float32) if got else np.zeros(BUCKETS + 1, np.float32)


def quality_scores(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text, in the input's partitions."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        claim(_HASHES)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(w, t) for t in strings(b.column(1))], pa.float64())], ["doc_id", "score"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(d, f, f"doc_id {kind}, score double", 512)


def of_quality(docs: DataFrame, weights: np.ndarray, least: float = PREDICT_AT, text_col: str = "text") -> DataFrame:
    """Rows whose text scores at least ``least``; the others go."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def keep(texts: list[str]) -> list[bool]:
        claim(_HASHES)
        return [score(held.value, t) >= least for t in texts]

    return keep_rows(docs, text_col, keep)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return quality_scores(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
