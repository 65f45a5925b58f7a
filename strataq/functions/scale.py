"""Choices that depend on size: what may be broadcast, and where lineage is cut."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it was measured and has this many rows and bytes (as JSON) at most.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Bytes of the files read that a task of a wide shuffle gets the rows of.
SHARE_BYTES = 4 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is small; else as it is, and the join shuffles both sides.

    It is measured up to the bound only; what is small is cheap to compute twice.
    """
    some = df.limit(rows + 1)
    measured = some.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[df[c].alias(f"c{k}") for k, c in enumerate(df.columns)])))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if measured["n"] <= rows and measured["bytes"] <= size else df


def _bytes_of(df: DataFrame) -> tuple[list[str], int]:
    """The files that a table reads, and how large they are together."""
    names = df._jdf.inputFiles()  # stays in the JVM: there may be very many
    session, jvm = df.sparkSession, df.sparkSession._jvm
    hadoop = session.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return names, sum(p.getFileSystem(hadoop).getFileStatus(p).getLen() for p in paths)


def spread(df: DataFrame) -> DataFrame:
    """A table as it is read, dealt out anew if its files are fewer than the cores and no larger than what the cores
    read at once: a file of one row group is read by one task. Larger tables are left as they are."""
    session, names = df.sparkSession, df._jdf.inputFiles()
    cores, jvm = session.sparkContext.defaultParallelism, session._jvm
    if not 0 < len(names) < cores:
        return df
    share = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(session.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if _bytes_of(df)[1] < cores * share else df


def shares(df: DataFrame, most: int | None = None) -> int:
    """Partitions of a shuffle of what ``df`` reads: one for each ``most`` (SHARE_BYTES) bytes of its files, and as many as
    a shuffle makes anyway at least."""
    return max(-(-_bytes_of(df)[1] // (most or SHARE_BYTES)), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def wide(df: DataFrame, *keys: Column | str) -> DataFrame:
    """``df`` dealt by ``keys`` into as many partitions as the files it reads have shares of SHARE_BYTES, if that is
    more than a shuffle makes anyway; else as it is. What a task groups then doesn't grow with the input."""
    n = shares(df)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder; loops that grow a plan cut it here. Where no folder is
    set, a temporary one on a local master, else an error."""
    session, context = df.sparkSession, df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        configured = session.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="strataq-"))
    return df.checkpoint(eager=True)


def placed(df: DataFrame, *order: Column, out: str = "place") -> DataFrame:
    """``df`` with ``out``: its place from 0 in the order of all rows. Rows are dealt by range and numbered there, and
    only the counts of the ranges are added up, so no task sees them all."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + own).drop("_range", "_start")
