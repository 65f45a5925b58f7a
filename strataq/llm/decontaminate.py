"""Benchmark passages in documents, found by winnowing.

Of each sliding window of STRIDE hashes of K-word grams the least is kept as a fingerprint, in documents and
items alike. A span of WINDOW = K + STRIDE - 1 words that both hold has the same least gram in both, so every
such span shares a fingerprint. Shared fingerprints are joined, and each hit is extended: the windows around it
are compared word by word. Items of fewer than WINDOW words are one short window each; documents are searched
for grams of just those lengths.

Documents pass once, without a shuffle: they are held against a bitmap of fixed size that has a bit for each
fingerprint of the items, and only what may match goes on to the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, renamed, same, settle

WINDOW, K = 8, 5
STRIDE = WINDOW - K + 1
#: The bitmap has 2 ** BITS bits (2 MB), whatever the number of items; more items only let more through to the join.
BITS = 24
MIN_ITEMS = 2

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
FINGERPRINT = "hash long, width int, pos int, lead int, context string"


def words(text: bytes | None) -> list[bytes]:
    """A-Z lowered; runs of letters, digits and non-ASCII bytes."""
    return _WORD.findall((text or b"").lower())


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    mixed = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        mixed += hashes[k : k + n] * _ODD[k]
        mixed ^= mixed >> np.uint64(29)
    return mixed * _ODD[0]


def _winnowed(grams: np.ndarray) -> np.ndarray:
    """Where a gram is the least of some window; all of them if several are equally small."""
    n = len(grams) - STRIDE + 1
    keep = np.zeros(len(grams), dtype=bool)
    if n > 0:
        least = grams[:n].copy()
        for k in range(1, STRIDE):
            np.minimum(least, grams[k : k + n], out=least)
        for k in range(STRIDE):
            keep[k : k + n] |= grams[k : k + n] == least
    return keep


def fingerprints(found: list[bytes], widths: list[int], bitmap: np.ndarray | None = None) -> list[tuple[int, int, int, int, str]]:
    """(hash, width, pos, lead, context) of each fingerprint of a text; with a bitmap, of those with a bit in it.

    width is WINDOW for winnowed grams, else that of a short window. context: the words that any window around
    the gram can hold, of which the first ``lead`` precede it.
    """
    if not found:
        return []
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in found], dtype=np.uint64)
    out = []
    for width in [WINDOW, *widths]:
        grams = _grams(hashes, K if width == WINDOW else width)
        if not len(grams):
            continue
        keep = _winnowed(grams) if width == WINDOW else np.ones(len(grams), dtype=bool)
        if bitmap is not None:
            slots = (grams >> np.uint64(64 - BITS)).astype(np.int64)
            keep &= (bitmap[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1
        for pos in np.flatnonzero(keep):
            first = max(0, pos - (STRIDE - 1)) if width == WINDOW else pos
            last = pos + WINDOW if width == WINDOW else pos + width
            context = b" ".join(found[first:last]).decode("utf-8", "replace")
            out.append((int(grams[pos].view(np.int64)), width, int(pos), int(pos - first), context))
    return out


def item_fingerprints(items: DataFrame) -> DataFrame:
    """item_id and the fingerprints of each row of (item_id, text); one short window for an item of few words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = words(text.as_py())
                short = [len(found)] if 0 < len(found) < WINDOW else []
                rows += [(item, *f) for f in fingerprints(found, short)]
            yield _batch(rows, ["item_id", "hash", "width", "pos", "lead", "context"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"item_id long, {FINGERPRINT}")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def bitmap_of(prints: DataFrame) -> np.ndarray:
    """2 ** BITS bits, those of the given hashes set; at most 2 ** (BITS - 6) longs come to the driver."""
    slot = F.shiftrightunsigned("hash", 64 - BITS)
    cells = prints.select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) & 63L as int))").alias("bit"))
    held = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    bitmap[held.column("cell").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)
    return bitmap


def candidates(docs: DataFrame, bitmap: np.ndarray, widths: list[int]) -> DataFrame:
    """For each document a row of width 0 with its number of words, and its fingerprints that may be an item's."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = ["doc_id", "text_key", "n_words", "hash", "width", "pos", "lead", "context"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                raw = text.as_py() or b""
                found = words(raw)
                key = xxhash.xxh64_intdigest(raw, 42)  # as Spark's xxhash64 of the text
                key -= (key >> 63) << 64
                rows.append((doc, key, len(found), 0, 0, 0, 0, ""))
                rows += [(doc, key, 0, *f) for f in fingerprints(found, widths, shared.value)]
                if len(rows) >= 50_000:
                    yield _batch(rows, names, types)
                    rows = []
            yield _batch(rows, names, types)

    schema = f"doc_id long, text_key long, n_words long, {FINGERPRINT}"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def spans(shared: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, width, items) of the windows that occur, from joined fingerprints.

    Extends a hit to each window around it that both contexts hold in full, and compares their words.
    """

    def fits(at: F.Column) -> F.Column:
        ok = F.lit(True)
        for side in ("d", "i"):
            lead, n = F.col(f"{side}_lead"), F.size(f"{side}_words")
            ok = ok & (lead + at >= STRIDE - 1) & (lead + at - (STRIDE - 1) + WINDOW <= n)
        own, other = (F.slice(f"{s}_words", F.greatest(F.col(f"{s}_lead") + at - (STRIDE - 2), F.lit(1)), WINDOW) for s in ("d", "i"))
        return ok & (own == other)

    split = shared.withColumn("d_words", F.split("d_context", " ")).withColumn("i_words", F.split("i_context", " "))
    offsets = F.filter(F.sequence(F.lit(0), F.lit(STRIDE - 1)), fits)
    found = F.when(F.col("width") == WINDOW, F.transform(offsets, lambda at: F.col("pos") + at - (STRIDE - 1))).otherwise(
        F.when(F.col("d_context") == F.col("i_context"), F.array("pos")).otherwise(F.array().cast("array<int>"))
    )
    each = split.select("doc_id", "text_key", "width", F.explode(found).alias("start"), "items")
    return each.groupBy("doc_id", "text_key", "width", "start").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, n_full.

    A word is hit if any occurrence of a window of any item covers it. n_full: items with a window of WINDOW words
    that occurs. Null and empty texts have no words and no hits; an item without words has no window; no hits give
    the digest of the empty string. Rows that repeat each get the same answer. Items that repeat an item_id are one
    item with the windows of all; items without item_id take no part. An empty table gives an empty result; other
    columns are ignored.
    """
    prints = settle(item_fingerprints(items.filter("item_id is not null")))
    widths = sorted(r["width"] for r in prints.select("width").distinct().collect() if r["width"] < WINDOW)  # 7 at most
    passed = settle(candidates(docs, bitmap_of(prints), widths))
    base = passed.filter("width = 0").select("doc_id", "text_key", "n_words")
    ours = passed.filter("width > 0").withColumnsRenamed({"lead": "d_lead", "context": "d_context"}).drop("n_words")
    # a phrase of many items is compared once, with all items that have it in the same context
    theirs = prints.groupBy("hash", "width", F.col("lead").alias("i_lead"), F.col("context").alias("i_context")).agg(F.collect_set("item_id").alias("items"))
    hits = settle(spans(ours.join(theirs, ["hash", "width"])))
    of_full = F.when(F.col("width") == WINDOW, F.col("items"))
    named = hits.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_set(of_full))).alias("full_items"))
    pieces = hits.select("doc_id", "text_key", "start", (F.col("start") + F.col("width")).alias("end")).distinct()
    covered = pieces.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("p"))
    # pieces of one document in order: each adds what lies beyond the furthest end so far
    fold = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n"),
            F.greatest(acc["end"], x["end"]).alias("end"),
        ),
    )["n"]
    covered = covered.select("doc_id", "text_key", fold.alias("n_hit"))
    both = named.join(covered, same(named, covered, "doc_id", "text_key")).select(named["*"], "n_hit")
    joined = base.join(both, same(base, both, "doc_id", "text_key"), "left")
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    n_items = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    return joined.select(
        base["doc_id"], base["text_key"], "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(n_items).cast("long").alias("n_items"),
        F.sha2(F.coalesce(ids, F.lit("")), 256).alias("items_sha256"),
        (F.when(F.col("items").isNull(), 0).otherwise(n_items) >= MIN_ITEMS).alias("contaminated"),
        F.coalesce(F.size("full_items"), F.lit(0)).cast("long").alias("n_full"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, min_full: int = 1) -> DataFrame:
    """``docs`` without the rows whose text holds full windows of ``min_full`` items or more, or windows of
    MIN_ITEMS items of any length.

    One full window is enough here: a document with a single passage of the benchmark leaks it. An item of a few
    words alone is not, as its words may be common. ``contaminated`` in ``contamination`` is the stricter report.
    Nulls, repeats and empty tables as there; other columns are kept, whatever their names.
    """
    found = contamination(docs, items).filter((F.col("n_full") >= min_full) | F.col("contaminated"))
    bad = found.select("doc_id", "text_key").distinct()
    own = numbered(docs)
    place = {c: F.col(f"_c{k}") for k, c in enumerate(docs.columns)}
    key = F.xxhash64(F.coalesce(place["text"].cast("string"), F.lit("")))
    kept = own.join(bad, place["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (key == bad["text_key"]), "left_anti")
    return renamed(kept, docs)
