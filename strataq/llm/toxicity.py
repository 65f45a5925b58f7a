"""Toxicity by a factorization machine over hashed terms.

Besides a weight for each term, each term has a short vector; the product of two terms' vectors is the weight of
their meeting in a text, so a pair such as an insult with the mention of a group counts beyond what its terms
add up to. Sums over all pairs come from the sums of vectors and of their squares, linear in the terms.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .quality import in_fold, sample_of, sigmoid

DIM, FACTORS = 1 << 18, 4
#: Labelled documents to learn from, about; rounds over them, and the first rounds, in which terms learn alone, so
#: that pairs are left what no term explains.
SAMPLE, EPOCHS, ALONE = 16_000, 7, 2
THRESHOLD = 0.5
#: A term gets its vector once this many learned texts held it, whatever its own weight.
LEAST_TEXTS = 20
CACHE = 200_000
#: Lengths of the beginnings of words that are terms as well.
STEMS = (4, 5, 6)

_PUNCT = bytes(set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)))


class Terms(dict):
    """Word -> feature numbers of its terms: the word (lower case, punctuation around it dropped) and its first
    letters, which inflected forms share. Starts anew when full."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        term = word.decode("utf-8", "replace").lower().encode().strip(_PUNCT).decode("utf-8", "replace")
        terms = [term, *(f"{term[:n]}*" for n in STEMS if len(term) > n)]
        value = self[word] = tuple(zlib.crc32(t.encode()) * 0x9E3779B1 % (1 << 32) >> 14 for t in terms)
        return value


_terms = Terms()


def features(text: bytes | None) -> np.ndarray:
    """The sorted term numbers of a whole text; none for null or without words."""
    found: set[int] = set()
    for word in set((text or b"").split()):
        found.update(_terms[word])
    return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


class Machine:
    """Weights by follow-the-regularised-leader, so rare terms stay exactly zero; vectors by AdaGrad."""

    alpha, beta, l1, l2 = 0.5, 1.0, 5.0, 1.0
    rate, decay, spread, slow = 0.03, 1e-3, 0.01, 3.0

    def __init__(self) -> None:
        draw = np.random.default_rng(11)
        self.z, self.n = np.zeros(DIM + 1), np.zeros(DIM + 1)
        self.v, self.g = draw.normal(0, self.spread, (DIM, FACTORS)), np.full((DIM, FACTORS), self.slow)
        self.texts = np.zeros(DIM, dtype=np.int32)

    def weights(self, idx: np.ndarray) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        l1 = np.where(idx == DIM, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, idx: np.ndarray, label: int, pairs: bool = True) -> None:
        all_idx = np.append(idx, DIM)
        w = self.weights(all_idx)
        paired = idx[self.texts[idx] >= LEAST_TEXTS] if pairs else idx[:0]
        v = self.v[paired]
        total = v.sum(axis=0)
        gradient = sigmoid(w.sum() + 0.5 * float((total * total - (v * v).sum(axis=0)).sum())) - label
        n = self.n[all_idx]
        sigma = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha
        self.z[all_idx] += gradient - sigma * w
        self.n[all_idx] = n + gradient * gradient
        if len(paired) > 1:
            step = gradient * (total - v) + self.decay * v
            self.g[paired] += step * step
            self.v[paired] = v - self.rate * step / np.sqrt(self.g[paired])

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms with a weight or a vector, their weights, their vectors (zero where they have none); last the bias."""
        w = self.weights(np.arange(DIM + 1))
        used = np.append(np.flatnonzero((w[:-1] != 0) | (self.texts >= LEAST_TEXTS)), DIM)
        v = np.zeros((len(used), FACTORS))
        own = used[:-1]
        v[:-1] = np.where((self.texts[own] >= LEAST_TEXTS)[:, None], self.v[own], 0.0)
        return used, w[used], v


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """A row for each feature and the bias: weight, then vector. One task learns from the bounded sample."""
    sample = sample_of(labels, bound)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "label", "idx"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(y, idx.values.to_numpy()) for b in batches for y, idx in zip(b.column("label").to_pylist(), b.column("idx"), strict=True)]
        model = Machine()
        for _, idx in held:
            model.texts[idx] += 1
        for turn in range(epochs):
            for y, idx in held:
                model.learn(idx, y, turn >= ALONE)
        used, w, v = model.table()
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(w), pa.array(list(v), pa.list_(pa.float64()))], ["i", "w", "v"])

    ready = chosen.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(extract, "doc_id long, label int, idx array<int>")
    ready = ready.groupBy("doc_id").agg(F.min(F.struct("label", "idx")).alias("e")).select("doc_id", "e.*")  # one for each sampled doc_id
    ordered = ready.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(5), "doc_id"))
    found = settle(ordered.mapInArrow(run, "i int, w double, v array<double>")).toArrow()  # DIM + 1 rows at most
    model = np.zeros((DIM + 1, FACTORS + 1))
    at = found.column("i").to_numpy()
    if len(at):
        model[at, 0] = found.column("w").to_numpy()
        model[at, 1:] = np.array(found.column("v").to_pylist())
    return model


def score_of(model: np.ndarray, idx: np.ndarray) -> float:
    own = model[idx]
    v = own[:, 1:]
    total = v.sum(axis=0)
    return sigmoid(model[DIM, 0] + own[:, 0].sum() + 0.5 * float((total * total - (v * v).sum(axis=0)).sum()))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    ``labels`` (doc_id, toxic); rows held out (crc32 modulo 5 is 0) are never learned from. Null and empty
    texts get the score of no terms. Rows that share a doc_id are scored each by its own text. An empty table gives
    an empty result; other columns are ignored.
    """
    known = labels.filter(~in_fold(5, 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [score_of(model, features(t.as_py())) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", in_fold(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
