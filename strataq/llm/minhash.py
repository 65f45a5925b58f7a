"""Texts whose sets of word shingles are alike: the exact Jaccard coefficient of given pairs (``alike``), and by
MinHash those alike that SimHash does not link (``links``).

A text has BANDS keys of ROWS minima each. Two texts of Jaccard J share a key with probability
1 - (1 - J^ROWS)^BANDS: at J = 0.8 all but three pairs in a million do, above it fewer are missed. What shares a
key is compared by the whole sets, so no pair under the threshold is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import broadcast_if_small
from .common import WORD, settle

SIZE = 5
#: Least Jaccard coefficient of a link, as a fraction.
ALIKE, OF = 4, 5
BANDS, ROWS = 32, 5
#: A bucket with more texts than SMALL is compared in blocks of about BLOCK shingles, each by each.
SMALL, BLOCK = 32, 1 << 20
STEP = 1 << 16
#: Keys of the texts to compare are broadcast up to this number, so that only their texts are shuffled.
MANY = 1_000_000
#: The key of all texts without words.
NO_WORDS = 0

_draw = np.random.default_rng(17)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def shingles(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """The sorted different XXH64 hashes of a text's word shingles, words as in ``simhash.fingerprint``."""
    words = (text or b"").lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)][: len(words)], dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    found = []
    for start in range(0, len(words) - size + 1, STEP):  # a very long text in bounded memory
        part = words[start : start + STEP + size - 1]
        found.append(np.array([digest(s, 42) for s in map(join, zip(*(part[k:] for k in range(size)), strict=False))], dtype=np.uint64))
    return np.unique(np.concatenate(found))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set of shingles; none for an empty set."""
    if not len(found):
        return np.empty(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), 512):
        least = np.minimum(least, (found[start : start + 512, None] * _TIMES + _PLUS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def text_key(text: Column) -> Column:
    """The key of a text, one for all without words."""
    return F.when(text.rlike(WORD), F.xxhash64(text)).otherwise(F.lit(NO_WORDS).cast("long"))


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, shingles of the texts whose keys are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):  # one by one: sets of long texts are large
                found = shingles(batch.column(1)[k].cast(pa.binary()).as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([found], pa.list_(pa.int64()))], ["key", "shingles"])

    text = F.col("text").cast("string")
    own = docs.select(text_key(text).alias("key"), text.alias("text")).join(broadcast_if_small(wanted, MANY), "key", "left_semi")
    return own.groupBy("key").agg(F.first("text").alias("text")).mapInArrow(run, "key long, shingles array<long>")


def _forest(table: pa.Table) -> pa.Table:
    """Links of one group that join all that is linked in it: breadth first, each text reached once."""
    keys, first = np.unique(table.column("key").to_numpy(), return_index=True)
    rows = table.column("shingles").combine_chunks().take(pa.array(first))
    sizes = rows.value_lengths().to_numpy().astype(np.int64)
    tokens = np.unique(rows.flatten().to_numpy(), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    mark = np.zeros(len(tokens) + 1, dtype=np.int64)
    left, a, b = np.arange(len(keys)), [], []
    held = tokens  # those of what is left, in order
    while len(left):
        front, left, held = [left[0]], left[1:], held[sizes[left[0]] :]
        while front and len(left):
            x = front.pop()
            own = tokens[ends[x] - sizes[x] : ends[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[held], np.cumsum(sizes[left]) - sizes[left])
            mark[own] = 0
            near = (ALIKE + OF) * both >= ALIKE * (sizes[x] + sizes[left])
            if near.any():
                reached = left[near]
                a.append(np.full(len(reached), keys[x]))
                b.append(keys[reached])
                front.extend(reached)
                held, left = held[np.repeat(~near, sizes[left])], left[~near]
    empty = np.empty(0, dtype=np.int64)
    return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) of keys whose whole sets are alike."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("t")), "b")
    return both.filter((ALIKE + OF) * F.size(F.array_intersect("s", "t")) >= ALIKE * (F.size("s") + F.size("t"))).select("a", "b")


def buckets(prints: DataFrame) -> DataFrame:
    """key, n, band, m, total of texts that share a band. Of buckets that hold the same texts one is looked at."""
    classes = prints.filter(F.col("key") != NO_WORDS).groupBy("key", "n").agg(F.first("bands").alias("bands"))
    keyed = settle(classes.select("key", "n", F.explode("bands").alias("band")))
    shared = keyed.groupBy("band").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("key")).alias("mixed")).filter("m > 1")
    shared = shared.groupBy("m", "total", "mixed").agg(F.min("band").alias("band")).drop("mixed")
    return settle(keyed.join(shared, "band"))


def links(full: DataFrame, sets: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys of different texts that are alike, enough to join with ``near`` all that are linked.

    ``full``: ``buckets``; ``near``: pairs that are joined already. In small buckets each pair is tested, once, unless
    both are joined to one text; large ones are cut into blocks by hash, and each two blocks meet in a group of
    bounded size that yields a forest.
    """
    both = near.select("a", "b").union(near.select("b", "a"))
    hung = both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    small = full.filter(F.col("m") <= SMALL).join(hung, "key", "left").withColumn("root", F.coalesce("root", "key"))
    x, y = small.alias("x"), small.alias("y")
    may = (F.least("x.n", "y.n") * OF >= F.greatest("x.n", "y.n") * ALIKE) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & may).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    blocks = F.ceil(F.col("total") / BLOCK).cast("long")
    large = (
        full.filter(F.col("m") > SMALL)
        .withColumn("own", F.pmod(F.xxhash64("key"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key")
    )
    met = large.join(sets, "key").groupBy("band", "i", "j").applyInArrow(_forest, "a long, b long")
    return alike(pairs, sets).union(met).distinct()
