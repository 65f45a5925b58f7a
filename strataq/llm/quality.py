"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are present or not: its words and word pairs, and runs of one to three word shapes (letter
case, digits and punctuation, or that a word repeats the one before). Scores are sparse dot products.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, renamed, settle

#: Hashed features; a model is as many numbers at most (8 MB), so its size has nothing to do with the data's.
DIM = 1 << 20
#: Labelled documents to learn from, about; which ones, a hash of doc_id decides.
SAMPLE, EPOCHS = 12_000, 4
THRESHOLD = 0.7
CACHE = 300_000
#: Words of a text hashed at a time.
STEP = 1 << 17

_PUNCT = bytes(set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)))
_CLASS = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


class Tokens(dict):
    """Word -> hash of the word in the upper, of its shape in the lower 32 bits. Starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        core = word.strip(_PUNCT)
        mapped = word.translate(_CLASS)
        shape = bytes([c for k, c in enumerate(mapped[:64]) if k < 2 or c != mapped[k - 1] or c != mapped[k - 2]])
        value = self[word] = zlib.crc32(core.lower()) << 32 | zlib.crc32(shape)
        return value


_tokens = Tokens()


def _mix(a: np.ndarray, tag: int) -> np.ndarray:
    h = (a ^ np.uint64(tag * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ h >> np.uint64(32)) * np.uint64(0x165667B19E3779F9)) >> np.uint64(44)


def features(text: bytes | None) -> np.ndarray:
    """The sorted feature numbers of a whole text; none for null or without words."""
    words = (text or b"").split()
    found = []
    for at in range(0, len(words), STEP):
        both = np.fromiter(map(_tokens.__getitem__, words[max(0, at - 2) : at + STEP]), dtype=np.uint64)
        word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        shape[1:][word[1:] == word[:-1]] = 1  # repeats the word before
        odd = np.uint64(0x9E3779B97F4A7C15)
        pairs, runs = word[:-1] * odd + word[1:], shape[:-1] * odd + shape[1:]
        threes = runs[:-1] * odd + shape[2:]
        found.append(np.concatenate([_mix(word, 1), _mix(pairs, 2), _mix(shape, 3), _mix(runs, 4), _mix(threes, 5)]))
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.empty(0, dtype=np.int32)


@dataclass
class Ftrl:
    """FTRL-proximal: per-coordinate steps, weights exactly zero until their evidence exceeds ``l1``."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 1.0

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(DIM + 1), np.zeros(DIM + 1)  # the last one is the bias, which has no penalty

    def weights(self, idx: np.ndarray) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        l1 = np.where(idx == DIM, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, idx: np.ndarray, label: int) -> None:
        idx = np.append(idx, DIM)
        w = self.weights(idx)
        gradient = sigmoid(w.sum()) - label
        n = self.n[idx]
        sigma = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha
        self.z[idx] += gradient - sigma * w
        self.n[idx] = n + gradient * gradient


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def sample_of(labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, label) of about ``bound`` rows of (doc_id, label), or all: those whose hash is below a threshold.

    A doc_id with several labels counts once, with the larger; rows with null in either don't count.
    """
    known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, bound / max(1, known.count()))
    return known.filter(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def examples(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, label, idx) of the sampled documents. The sample is broadcast: its size is bounded. Of rows that share
    a doc_id one is an example, so the examples are as bounded."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "label", "idx"])

    made = chosen.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(run, "doc_id long, label int, idx array<int>")
    return made.groupBy("doc_id").agg(F.min(F.struct("label", "idx")).alias("e")).select("doc_id", "e.*")


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (DIM and the bias) from ``labels`` (doc_id, label). One task learns, in an order set by a hash;
    it holds the features of the sample, whose rows are bounded. Without examples all weights are zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(y, idx.values.to_numpy()) for b in batches for y, idx in zip(b.column("label").to_pylist(), b.column("idx"), strict=True)]
        model = Ftrl()
        for _ in range(epochs):
            for y, idx in held:
                model.learn(idx, y)
        every = np.arange(DIM + 1)
        w = model.weights(every)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(w[used])], ["i", "w"])

    ready = examples(docs, sample_of(labels, bound)).repartition(1).sortWithinPartitions(F.xxhash64(F.lit(5), "doc_id"))
    found = settle(ready.mapInArrow(run, "i int, w double")).toArrow()  # DIM + 1 rows at most
    weights = np.zeros(DIM + 1)
    weights[found.column("i").to_numpy()] = found.column("w").to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1; whole texts, nothing shuffled. A text without words scores by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    columns, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).cast(pa.binary())
            scores = [sigmoid(w[features(t.as_py())].sum() + w[DIM]) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*columns, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double")


def in_fold(modulus: int, rest: int) -> F.Column:
    """Rows held out: crc32 of doc_id as text, modulo; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    ``labels`` (doc_id, quality); rows held out (crc32 modulo 4 is 2) are never learned from. Null and empty
    texts get the score of no features. Rows that share a doc_id are scored each by its own text. An empty table
    gives an empty result; other columns are ignored.
    """
    known = labels.filter(~in_fold(4, 2)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    weights = train(docs, known)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights)
    return scored.select("doc_id", in_fold(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those the classifier rejects; it learns from the labelled ones among ``docs``.

    Null and empty texts score by the bias; repeated rows stay or go together; an empty table gives an empty
    result; all columns are kept, whatever their names.
    """
    known = labels.filter(~in_fold(4, 2)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    return renamed(score(numbered(docs), train(docs, known), f"_c{docs.columns.index('text')}").filter(F.col("score") >= THRESHOLD), docs)
