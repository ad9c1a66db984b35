"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, as a set: its words, their first five bytes (inflected and compound forms share them), pairs of
neighbouring words, and pairs with one word between (skip-grams), each hashed into 2^22 places. FTRL-proximal keeps a
gradient sum and a squared-gradient sum per coordinate, which gives each its own rate, and its L1 term leaves most
weights at exactly zero: what is broadcast is the list of the others.

Fit: on at most `MAX_ROWS` labelled rows, the ones whose hashed id is least (a bound, not a share: the model's size and its
one training task stay the same at any corpus size, however many rows share an id; equal rows of an id are one). One hash threshold holds for all labelled rows,
so both classes keep their natural share, and the intercept with it, whether or not the bound acts. Their features are
made in the tasks that hold the texts; the passes of the optimiser run over them in one task, in a fixed order. Scores:
every whole text, in place.

Defined cases: a null or empty text has no features and scores by the intercept; a doc id with several labels is toxic if
one says so; labels without a document and null labels are left out; with labelled rows of one kind only the model says that kind
(scores below 0.01 or above 0.99 on texts like them), without any every score is below 1e-9; repeated rows stay; other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.llm.batches import ALNUM, lower_bytes, small_batches

BITS = 22
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 8.0, 1.0, 5
MAX_ROWS, STEM = 12_000, 5
_SHIFT = np.uint32(32 - BITS)
_P = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393)]


def words_of(text: str | None) -> list[bytes]:
    return ALNUM.findall(lower_bytes(text.lower() if text and not text.isascii() else text))


def feature_places(words: list[bytes]) -> np.ndarray:
    """Places of all features of a text, in text order, with repeats."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint32)
    h = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    s = np.fromiter(map(zlib.crc32, [w[:STEM] for w in words]), np.uint32, n)
    parts = [h * _P[0] + _P[4], s * _P[1] + _P[0]]
    for gap, (p, q) in ((1, (_P[2], _P[3])), (2, (_P[3], _P[4]))):
        if n > gap:
            both = h[:-gap] * p ^ (h[gap:] + np.uint32(gap)) * q
            parts.append((both ^ (both >> np.uint32(15))) * _P[0])
    return np.concatenate(parts) >> _SHIFT


class Ftrl:
    """FTRL-proximal for sets of places; the intercept is place 2^BITS and free of the L1 term."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1, np.float32)
        self.n = np.zeros((1 << BITS) + 1, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(float(w.sum())) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def nonzero(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((np.abs(self.z) > L1) | (np.arange(len(self.z)) == 1 << BITS)).astype(np.int64)
        return at, self.weights(at)


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x >= 0 else math.exp(x) / (1.0 + math.exp(x))


def fit_rows(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) from rows of (distinct places with the intercept, label), in their order."""
    model = Ftrl()
    for _ in range(PASSES):
        for at, label in rows:
            model.learn(at, label)
    return model.nonzero()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, digests, labels, texts in small_batches(batches, 64):
        got = [np.unique(feature_places(words_of(t))).astype(np.int32) for t in texts]
        yield pa.RecordBatch.from_arrays([keys, pa.array(digests, pa.int64()), pa.array(labels, pa.int32()), pa.array(got, pa.list_(pa.int32()))], names=["rank", "digest", "toxic", "places"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        lists = batch.column(3)
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        for end, n, rank, digest, label in zip(ends, lists.value_lengths().to_numpy(), *(batch.column(i).to_pylist() for i in range(3))):
            rows.append((rank, np.append(flat[end - n:end], np.int32(1 << BITS)), label, digest))
    rows.sort(key=lambda r: (r[0], r[3]))
    if rows:
        at, w = fit_rows([(a, y) for _, a, y, _ in rows])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w.astype(np.float64))], names=["place", "weight"])


def sample_of_labels(labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic, rank): at most MAX_ROWS ids, those whose hash is least."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    return one.select("doc_id", "toxic", F.xxhash64("doc_id").alias("rank")).orderBy("rank", "doc_id").limit(MAX_ROWS)


def fit_features(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """rank, digest, toxic, places of the learned rows: at most MAX_ROWS ids, which may be broadcast, and at most MAX_ROWS rows."""
    sample = sample_of_labels(labels, label_col)
    one = docs.join(F.broadcast(sample), "doc_id").select("rank", F.xxhash64("text").alias("digest"), "toxic", "text").dropDuplicates(["rank", "digest"])
    return one.mapInArrow(_features, "rank bigint, digest bigint, toxic int, places array<int>").orderBy("rank", "digest").limit(MAX_ROWS)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of the fitted model."""
    got = fit_features(docs, labels, label_col).repartition(1).mapInArrow(_fit, "place bigint, weight double").toArrow()
    at, w = got.column("place").to_numpy(), got.column("weight").to_numpy()
    if len(at):
        return at, w
    return np.array([1 << BITS]), np.array([-30.0])


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The kept columns and a score column: every whole text under broadcast weights."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text_col in keep else [F.col(text_col).cast("string")]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"
    at_text = rows.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        inner = at < 1 << BITS
        dense[at[inner]] = w[inner]
        intercept = float(w[~inner].sum())
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = []
                for t in part.column(at_text).to_pylist():
                    places = feature_places(words_of(t))
                    hit = np.unique(places[dense[places] != 0])
                    out.append(sigmoid(intercept + float(dense[hit].sum(dtype=np.float64))))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(out, pa.float64())], names=[*keep, name])

    return rows.mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    out = scores(docs, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
