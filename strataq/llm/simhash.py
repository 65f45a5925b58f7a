"""Near duplicates by SimHash: 64-bit fingerprints of whole texts, linked at a few differing bits.

Candidates come from the pigeonring principle. Cut a fingerprint into a ring of ``m`` equal segments and let
two fingerprints differ in ``d_0 .. d_{m-1}`` bits, at most ``tau`` in all. Then some segment ``i`` starts a
chain whose every prefix stays within its share of the budget: ``d_i + .. + d_{i+l-1} <= floor(l * tau / m)``
for each length ``l``. With m = 8 and tau = 3 the budgets are 0 0 1 1 1 2 2 3, so two segments (16 bits) are
equal and the next three (24 bits) differ in one bit at most, hence are equal in one of their halves. Those
28 bits are the key a fingerprint is looked up by, at each of 8 starts and 2 halves. Pairs with the same key
must pass the chain's budgets, then the full Hamming test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import join_spread, numbered, renamed, settle

SEGMENTS, SEGMENT_BITS, MAX_BITS = 8, 8, 3
#: Bits two fingerprints may differ in over a chain of 1, 2, .. segments.
BUDGETS = [length * MAX_BITS // SEGMENTS for length in range(1, SEGMENTS + 1)]
EXACT = SEGMENT_BITS * BUDGETS.count(0)  # bits of a chain that are equal
ONCE = SEGMENT_BITS * BUDGETS.count(1)  # bits that follow and hold one difference at most
HALF = ONCE // 2
#: A bucket with more fingerprints than SMALL is compared in blocks of BLOCK, each by each.
SMALL, BLOCK = 32, 2048
#: Up to FEW edges are joined in one task, in place of some dozens of stages.
FEW = 100_000
STEP = 1 << 16


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of a text: majority of the XXH64 bits (seed 42) of its word shingles, repeats counted.

    bytes.lower and bytes.split know ASCII only, so A-Z are lowered and words end at the six ASCII white
    space characters. No words (or null): 0. Fewer words than ``size``: one shingle of them all.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, n, STEP):  # a very long text in bounded memory
        part = words[start : start + STEP + size - 1]
        shingles = map(join, zip(*(part[k:] for k in range(size)), strict=False)) if len(words) >= size else [join(words)]
        hashes = np.array([digest(s, 42) for s in shingles], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a signed long) of each row of ``docs``; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _within_budgets(a: Column, b: Column) -> Column:
    """Of two fingerprints turned so that the chain starts at the top bit: every prefix within its budget."""
    differ = a.bitwiseXOR(b)
    ok = F.bit_count(differ) <= MAX_BITS
    for k in range(SEGMENTS - 1, 0, -1):
        ok = (F.bit_count(F.shiftrightunsigned(differ, 64 - SEGMENT_BITS * k)) <= BUDGETS[k - 1]) & ok
    return ok


def ring_keys(classes: DataFrame) -> DataFrame:
    """fp, key, turned: a row for each start of the ring and each half of the segments with one difference."""
    entries = []
    for start in range(SEGMENTS):
        s = SEGMENT_BITS * start
        turned = F.col("fp") if not s else F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s))
        top = F.shiftrightunsigned(turned, 64 - EXACT)
        for half in range(2):
            low = F.shiftrightunsigned(turned, 64 - EXACT - HALF * (half + 1)).bitwiseAND(F.lit((1 << HALF) - 1))
            tag = F.lit((2 * start + half) << (EXACT + HALF))
            entries.append(F.struct(tag.bitwiseOR(F.shiftleft(top, HALF)).bitwiseOR(low).alias("key"), turned.alias("turned")))
    return classes.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.key", "e.turned")


def _forest(table: pa.Table) -> pa.Table:
    """Links of one block that join all that is linked in it: breadth first, each fingerprint reached once."""
    # unsigned: numpy counts the bits of a signed number's absolute value
    left = np.unique(table.column("fp").to_numpy().view(np.uint64))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:256], front[256:]
            near = np.bitwise_count(some[:, None] ^ left[None, :]) <= MAX_BITS
            reached = near.any(axis=0)
            a.append(some[near.argmax(axis=0)[reached]])
            b.append(left[reached])
            front, left = np.concatenate([front, left[reached]]), left[~reached]
    empty = np.empty(0, dtype=np.uint64)
    return pa.table({"a": np.concatenate([empty, *a]).view(np.int64), "b": np.concatenate([empty, *b]).view(np.int64)})


def links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints within MAX_BITS, enough to join all that are linked.

    In small buckets all pairs are tested in the join itself, so only links leave it. A large bucket is cut
    into blocks by hash; each two blocks meet in a group of their own, of bounded size, which yields a
    spanning forest: no more links than it has fingerprints, however many copies are alike.
    """
    keys = ring_keys(classes)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    full = settle(keys.join(sizes, "key"))
    small = full.filter(F.col("n") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    tested = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _within_budgets(F.col("x.turned"), F.col("y.turned")),
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    large = (
        full.filter(F.col("n") > SMALL)
        .withColumn("own", F.pmod(F.xxhash64("fp"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    met = large.groupBy("key", "i", "j").applyInArrow(_forest, "a long, b long")
    return tested.union(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root: the least node it is joined to.

    Large-star and small-star contraction: each round hangs neighbours on the least one they know, so the
    number of rounds grows with the logarithm of the longest chain. A null or looped edge joins nothing.
    """
    pair = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state = settle(pair.filter("u is not null and v is not null and u != v").distinct())
    held = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = settle(least.select("u", F.col("m").alias("v")).union(down).filter("u != v").distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == held:
            break
        held = now
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) as ``components`` has them, of all edges (a, b) of the batches."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a is not None and b is not None and a != b:
                a, b = sorted((find(root.setdefault(a, a)), find(root.setdefault(b, b))))
                root[b] = a
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(v) for v in root], pa.int64())], ["node", "root"])


def _grouped(edges: DataFrame) -> DataFrame:
    """``components`` of ``edges``; FEW of them, as counted, are joined in one task."""
    edges = settle(edges)
    return components(edges) if edges.count() > FEW else edges.coalesce(1).mapInArrow(_roots, "node long, root long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id that can be reached over links, the own included. Texts with equal
    fingerprints are one class and linked; n_links counts other classes found linked to the own (a spanning
    set of them in very large groups). Null and empty texts have fingerprint 0 and form a class like any
    other. Rows that repeat stay, each with the same answer; a row without doc_id gets the component of its
    text and counts for no component_id. An empty table gives an empty result; other columns are ignored.
    """
    prints = settle(fingerprints(docs))
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    edges = settle(links(classes))
    degree = edges.select(F.col("a").alias("fp")).union(edges.select("b")).groupBy("fp").agg(F.count("*").alias("n_links"))
    member = components(edges)
    reps = member.join(classes.withColumnRenamed("fp", "node"), "node")
    least = reps.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = member.join(least, "root").select(F.col("node").alias("fp"), "least_id").join(degree, "fp", "left")
    named = settle(classes.join(linked, "fp", "left").select("fp", "copies", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return join_spread(prints, named, "fp", "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def _one_of_each(docs: DataFrame, found: DataFrame, key: Column) -> DataFrame:
    """Of the rows of ``docs`` that ``found`` (first_id, key) names by doc_id and ``key``, one each: the first by the
    hash of the text. Rows without doc_id all stay."""
    own = numbered(docs)
    place = {c: F.col(f"_c{k}") for k, c in enumerate(docs.columns)}
    keyed = own.select("*", place["doc_id"].cast("long").alias("first_id"), key.alias("key"), F.xxhash64(place["text"]).alias("order"))
    kept = keyed.join(found, ["first_id", "key"], "left_semi")
    one = kept.groupBy("first_id", "key").agg(F.min_by(F.struct(*own.columns), "order").alias("row")).select("row.*")
    return renamed(one.union(own.filter(place["doc_id"].isNull())), docs)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), fp, and MinHash's n (different shingles) and bands of each row of ``docs``; nothing
    is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, bands = np.empty(len(batch), dtype=np.uint64), [], []
            for k, text in enumerate(batch.column(2).cast(pa.binary())):
                prints[k] = fingerprint(text.as_py())
                found = minhash.shingles(text.as_py())
                sizes.append(len(found))
                bands.append(minhash.band_keys(found))
            columns = [batch.column(0), batch.column(1), pa.array(prints.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp", "n", "bands"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), minhash.text_key(text).alias("key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long, n long, bands array<long>")


def candidates(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys of texts whose fingerprints are linked (``links``): of each fingerprint one text stands for
    it in links to others, and is paired with all that share it."""
    texts = settle(prints.filter(F.col("key") != minhash.NO_WORDS).select("fp", "key").distinct())
    classes = settle(texts.groupBy("fp").agg(F.min("key").alias("first_key"), F.count("*").alias("copies")))
    own = join_spread(texts, classes, "fp", "copies").select(F.col("first_key").alias("a"), F.col("key").alias("b")).filter("a != b")
    first = classes.select("fp", "first_key")
    left, right = first.toDF("a", "_a"), first.toDF("b", "_b")
    return own.union(links(classes.select("fp")).join(left, "a").join(right, "b").select("_a", "_b"))


def alike(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys of texts that are alike (``minhash``), enough to join all that are linked.

    First those that SimHash links, as in ``near_duplicates``, held against their whole sets. A Jaccard coefficient of
    0.8 makes up to some 20 of 64 bits differ, and no such radius leaves equal bits to look up by: what is alike
    among the rest is found by MinHash, so no link depends on the radius.
    """
    close = settle(candidates(prints))
    full = minhash.buckets(prints)
    wanted = full.select("key").union(close.select("a")).union(close.select("b")).distinct()
    sets = settle(minhash.sets(docs, settle(wanted)))
    near = settle(minhash.alike(close, sets))
    return near.union(minhash.links(full, sets, near))


def keep_alike(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of texts joined over pairs that share four fifths of their five-word
    shingles (``alike``): of the rows with the group's least doc_id, that of the least text key.

    Texts without words form one group. Rows that share a doc_id stay apart if their texts are of different
    groups, so that no group goes with another's. Rows without doc_id can't stand for a group; all of them stay.
    """
    prints = settle(signatures(docs))
    member = _grouped(alike(docs, prints)).withColumnRenamed("node", "key")
    first = prints.filter("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first_id")).join(member, "key", "left")
    found = first.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct("first_id", "key")).alias("kept")).select("kept.*")
    return _one_of_each(docs, found, minhash.text_key(F.col(f"_c{docs.columns.index('text')}").cast("string")))
