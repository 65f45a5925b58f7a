"""Incremental corpora: file streams, debounced changes, upserts, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from strataq.operators.analytics import delta

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, per_batch: int = 500) -> DataFrame:
    """A stream of new and changed files. Deletions don't show in it: ``deletions`` finds them by a listing."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)


def watch_table(spark: SparkSession, path: str, schema: StructType, per_batch: int | None = None) -> DataFrame:
    """A stream of the rows of Parquet files as they come."""
    reader = spark.readStream.format("parquet").schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


def debounce(events: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """path, session, changes: a path's events closed by a quiet gap; of a stream or a table (ts, path)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("session"), "path").agg(F.count("*").alias("changes"))


def windowed(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of tumbling or sliding windows; rows later than ``late`` are left out of a
    stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return marked.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def upsert(stored: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """``stored`` with the rows of ``changed`` in place of those with their key; the last by seq of several."""
    last = Window.partitionBy(key).orderBy(F.desc("seq"))
    newest = changed.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return stored.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def changes(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Of a batch (path, content_hash, ..) the rows that are new or have another digest."""
    own = stored.join(batch.select("path"), "path", "left_semi")
    kind = delta(own, batch).filter(F.col("change").isin("new", "modified")).select("path", "change")
    return batch.join(kind, "path")


def deletions(stored: DataFrame, listed: DataFrame) -> DataFrame:
    return stored.select("path").join(listed.select("path"), "path", "left_anti")


def sync(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies each micro-batch by ``apply(batch, id)``; what was done is known in ``checkpoint``, so a run that
    was broken off goes on where it stopped. ``apply`` must give the same result if a batch comes twice."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


#: Batches after which the changes of a table are put together.
COMPACT = 64


def table_sync(table: str, key: str = "path", compact_every: int = COMPACT) -> Callable[[DataFrame, int], None]:
    """An ``apply`` for ``sync`` that keeps a table under ``table``: each batch adds a folder of its own changes, and
    only every so many batches are they put together. A batch that comes again rewrites its folder. ``latest`` reads
    the whole table."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.withColumn("seq", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/changes-{number:08d}")
        if (number + 1) % compact_every == 0:
            latest(batch.sparkSession, table, number + 1, key).write.mode("overwrite").parquet(f"{table}/whole-{number:08d}")

    return apply


def latest(spark: SparkSession, table: str, before: int | None = None, key: str = "path") -> DataFrame | None:
    """A table's rows after all batches that were written whole (or those before one): of each key the last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    done = [n for n in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS")) and (before is None or int(n[-8:]) < before)]
    base = max((n for n in done if n.startswith("whole-")), default=None)
    read = [n for n in done if n.startswith("changes-") and (base is None or n[-8:] > base[-8:])]
    if base is None and not read:
        return None
    rows = spark.read.parquet(*[f"{table}/{n}" for n in ([base] if base else []) + read])
    last = Window.partitionBy(key).orderBy(F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def stale(vectors: DataFrame, model: str) -> DataFrame:
    """Vectors that another model made."""
    return vectors.filter(F.col("model") != model)


def progress(query: StreamingQuery) -> dict:
    """Rows and rates of the last batch of a running query."""
    last = query.lastProgress
    return {} if not last else {"batch": last["batchId"], "rows": last["numInputRows"], "rows_per_second": last["processedRowsPerSecond"]}
