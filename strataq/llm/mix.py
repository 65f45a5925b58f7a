"""Mixing sources to target weights by weighted fair queueing.

Each document of a source is shuffled (by a digest of its id) and gets a virtual finish time: the words of its
source up to and with it, divided by the source's target. A source whose target exceeds its size is read again,
up to REPEATS times, its time running on. Served in the order of finish times until the total budget is spent,
each source gets its target, within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, renamed, running_sum, settle

#: Weights of the sources in code point order, repeating; times that a source may be read.
WEIGHTS, REPEATS = (1, 2, 3), 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, source_size), one row a source: source, source_size, place (from 0, by code point, null
    last), target.

    Targets share the sum of all sizes by weight; none exceeds REPEATS times its source's size, and what is
    over goes to the others by weight. Filling up in the order of size over weight gives the level at once:
    target = min(REPEATS * size, weight * level), where level is what the full sources leave of the total,
    divided by the weight of the others. One row a source is all that is sorted here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", (F.row_number().over(by_name) - 1).cast("long"))
    choice = F.array(*[F.lit(w).cast("long") for w in weights])
    placed = placed.withColumn("weight", F.element_at(choice, (F.col("place") % len(weights) + 1).cast("int")))
    placed = placed.withColumn("cap", F.lit(REPEATS) * F.col("source_size"))
    placed = placed.withColumn("ratio", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("ratio", "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    # a source is full if the level for it and those after it reaches its cap; the first that is not sets the level
    leveled = placed.withColumn("level", level)
    key = F.struct("ratio", "place", "level")
    final = leveled.withColumn("open", F.min(F.when(F.col("cap") > F.col("weight") * F.col("level"), key)).over(everything))
    is_full = F.col("open").isNull() | (F.struct("ratio", "place") < F.struct("open.ratio", "open.place"))
    target = F.when(is_full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("open.level"))
    return final.select("source", "source_size", "place", target.alias("target"))


def _finish(times_before: Column) -> Column:
    """Virtual finish time of a document that its source has been read ``times_before`` times before."""
    return F.try_divide(F.col("before") + F.col("size") + times_before * F.col("source_size"), F.col("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, size (words), source_size, target, taken (words).

    Order in a source: md5 of doc_id, then md5 of the text; rows equal in both repeat one document and may
    change places. A null source is a source of its own, a null text has no words, an empty table gives an
    empty result. A document is taken whole, 0 to REPEATS times; one without words is taken with 0 words.
    Results are the same on each run. Only ids, sizes and digests are shuffled, never texts; a source of any
    share of the rows is summed by ranges.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"),
            F.md5(text).alias("text_key"),
        )
    )
    targets = source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    t = settle(targets)
    named = light.join(t, light["source"].eqNullSafe(t["source"])).select(light["*"], "source_size", "place", "target")
    timed = settle(running_sum(named, ["h", "text_key"], "size", "before", by=["place"]))
    served = timed.filter("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    order = ["done", "place", "h", "text_key"]
    queue = running_sum(served.select(_finish(F.col("round")).alias("done"), *order[1:], "size"), order, "size", "spent")
    budget = t.agg(F.sum("source_size")).first()[0] or 0  # one number
    beyond = queue.filter(F.col("spent") + F.col("size") > F.lit(budget))
    cut = beyond.agg(F.min(F.struct(*order)).alias("cut")).first()["cut"]  # where the queue is truncated: one row
    times = F.lit(0)
    for k in range(REPEATS):
        own = F.struct(_finish(F.lit(k)).alias("done"), *order[1:])
        kept = F.lit(True) if cut is None else own < F.struct(*[F.lit(cut[c]).alias(c) for c in order])
        times = times + F.when((F.col("size") > 0) & kept, 1).otherwise(0)
    return timed.select("doc_id", "text_key", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"))


def resample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` as the mix takes them: a row repeats as often as it is taken; documents without words go.

    Rows that share doc_id and text repeat one document and share its answer, the largest of theirs. Nulls, empty
    tables and empty texts as in ``mix``; other columns are kept, whatever their names.
    """
    taken = mix(docs, weights).filter("times > 0").groupBy("doc_id", "text_key").agg(F.max("times").alias("times"))
    own = numbered(docs)
    place = {c: F.col(f"_c{k}") for k, c in enumerate(docs.columns)}
    key = F.md5(F.coalesce(place["text"].cast("string"), F.lit("")))
    joined = own.join(taken, place["doc_id"].cast("long").eqNullSafe(taken["doc_id"]) & (key == taken["text_key"]))
    return renamed(joined.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))), docs)
