"""What the corpus operators share: reading, cutting lineage, ranks over data of any size."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scale import spread

#: A run of anything but the six ASCII white space characters (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents, which take long a row, are dealt over all cores if they come in fewer parts."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name == "documents" else table


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set, a temporary one on a local master, else an error."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="strataq-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared folder: what follows survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    cond = F.lit(True)
    for name in names:
        cond = cond & left[name].eqNullSafe(right[name])
    return cond


#: Keys with more than one in SPREAD of all rows go another way than the rest; there are at most SPREAD of them.
SPREAD = 4096


def join_spread(rows: DataFrame, table: DataFrame, key: str, copies: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each key and in ``copies`` how many rows have it.

    Keys with a large share of the rows would fill a task each: they are looked up in a broadcast of fewer than
    SPREAD rows, whatever the input. The others are shuffled. ``table`` is read three times, so settle it.
    """
    limit = (table.agg(F.sum(copies)).first()[0] or 0) // SPREAD  # one number
    hot = table.filter(F.col(copies) > limit)
    marked = rows.join(F.broadcast(hot), key, "left")  # one broadcast for both branches
    frequent = marked.filter(F.col(copies).isNotNull())
    others = marked.filter(F.col(copies).isNull()).select(*rows.columns).join(table.filter(F.col(copies) <= limit), key)
    return frequent.unionByName(others)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with columns _c0, _c1, ..: names that clash with none made here."""
    return docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])


def renamed(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``numbered(docs)`` in ``df`` under their own names."""
    return df.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])


def running_sum(df: DataFrame, order: list[str], value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one, in ``order``, within ``by``.

    No task sees a whole group: rows are dealt by range over (by, order), each range is summed, and only
    those sums (one for each range and group) are accumulated. ``by`` must not be null. Rows equal in
    ``order`` come in any order, but the same one for all who read the result.
    """
    by = by or []
    # a column named for the range number must not clash with the caller's
    pid = "_range"
    dealt = settle(df.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn(pid, F.spark_partition_id()))
    sums = dealt.groupBy(*by, pid).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, pid, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*by, pid).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(starts, [*by, pid])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop(pid, "_start")
    )
