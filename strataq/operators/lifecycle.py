"""Corpora as stored tables: indexed once, kept up by changes, embedded anew, and dropped.

A corpus is a folder ``corpus=<name>`` with a folder for each step. A step writes only the files that changed, with
their chunks and vectors, or that they are gone; of each file the last step counts. A step that was broken off has no
manifest and is not read, so the next one does its work again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq.functions.batches import slices
from strataq.functions.text import content_hash
from strataq.sources.store import MANIFEST, export, load

from .analytics import delta
from .chunk import Settings, chunk
from .vectors import doc_vectors


@dataclass(frozen=True)
class Embedder:
    """A model by name: texts to vectors of ``dims`` numbers, a batch at a time. The name tells stale vectors."""

    name: str
    dims: int
    vectors: Callable[[list[str]], np.ndarray]


def embed(chunks: DataFrame, model: Embedder) -> DataFrame:
    """path, chunk_index, embedding of (path, chunk_index, text); nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = model.vectors([t or "" for t in batch.column(2).to_pylist()]) if batch.num_rows else np.empty((0, model.dims))
            flat = pa.array(np.asarray(made, dtype=np.float64).reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.FixedSizeListArray.from_arrays(flat, model.dims).cast(pa.list_(pa.float64()))], ["path", "chunk_index", "embedding"])

    return chunks.select("path", "chunk_index", "text").mapInArrow(run, "path string, chunk_index int, embedding array<double>")


class Corpora:
    """The corpora below a shared folder."""

    def __init__(self, spark: SparkSession, root: str, model: Embedder, settings: Settings = Settings()):
        self.spark, self.root, self.model, self.settings = spark, root.rstrip("/"), model, settings

    def _listed(self, folder: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def names(self) -> list[str]:
        return [n.removeprefix("corpus=") for n in self._listed(self.root) if n.startswith("corpus=")]

    def steps(self, name: str) -> list[str]:
        """Folders of the steps that were written whole, in order."""
        own = f"{self.root}/corpus={name}"
        return [f"{own}/{s}" for s in self._listed(own) if s.startswith("step-") and f"{MANIFEST}" in self._listed(f"{own}/{s}") and "_SUCCESS" in self._listed(f"{own}/{s}/{MANIFEST}")]

    def tables(self, name: str) -> dict[str, DataFrame]:
        """files (path, text, content_hash), chunks and vectors as they are after the last step; a KeyError if there is none."""
        steps = self.steps(name)
        if not steps:
            raise KeyError(name)
        all_steps = [load(self.spark, s) for s in steps]
        files, chunks, vectors = (reduce(DataFrame.unionByName, [t[n] for t in all_steps]) for n in ("files", "chunks", "vectors"))
        last = Window.partitionBy("path").orderBy(F.desc("step"))
        alive = files.withColumn("_n", F.row_number().over(last)).filter("_n = 1 and not gone").drop("_n")
        # vectors may be of a later step than their file, those made anew by another model, but not of an earlier one
        newest = vectors.groupBy("path").agg(F.max("step").alias("step"))
        newest = newest.join(alive.select("path", F.col("step").alias("made")), "path").filter("step >= made").drop("made")
        own = vectors.join(newest, ["path", "step"], "left_semi")
        return {
            "files": alive.select("path", "text", "content_hash"),
            "chunks": chunks.join(alive.select("path", "step"), ["path", "step"], "left_semi").drop("step"),
            "vectors": own.drop("step"),
        }

    def sync(self, name: str, files: DataFrame, mode: str = "delta") -> DataFrame:
        """Brings a corpus up to ``files`` (path, text); returns (path, change) of what was new, modified or deleted.

        delta: only files whose digest changed. full: all files anew. reembed: as delta, and vectors of another
        model than the own one are made again from the chunks that are stored.
        """
        if mode not in ("delta", "full", "reembed"):
            raise ValueError(f"no sync mode {mode!r}")
        step = len(self._listed(f"{self.root}/corpus={name}")) + 1
        found = files.select("path", "text", content_hash(F.col("text")).alias("content_hash")).dropDuplicates(["path"])
        held = self.tables(name) if self.steps(name) else None
        none = self.spark.createDataFrame([], "path string, content_hash string")
        change = delta(held["files"].select("path", "content_hash") if held else none, found.select("path", "content_hash"))
        wanted = change if mode == "full" else change.filter("change != 'unchanged'")
        fresh = found.join(wanted.filter("change != 'deleted'").select("path"), "path", "left_semi").select("path", "text", "content_hash", F.lit(False).alias("gone"))
        gone = wanted.filter("change = 'deleted'").select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("content_hash"), F.lit(True).alias("gone"))
        made = chunk(fresh, self.settings)
        to_embed = made.select("path", "chunk_index", "text")
        if mode == "reembed" and held is not None:
            stale = held["vectors"].filter(F.col("model") != self.model.name).select("path").distinct()
            kept = held["chunks"].join(stale, "path", "left_semi").join(wanted.select("path"), "path", "left_anti")
            to_embed = to_embed.unionByName(kept.select("path", "chunk_index", "text"))
        each = embed(to_embed, self.model)
        whole = doc_vectors(each)
        vectors = each.withColumn("is_doc_level", F.lit(False)).unionByName(whole).withColumn("model", F.lit(self.model.name))
        tables = {"files": fresh.unionByName(gone), "chunks": made, "vectors": vectors}
        export({n: df.withColumn("step", F.lit(step)) for n, df in tables.items()}, f"{self.root}/corpus={name}/step-{step:08d}", self.model.name, self.model.dims)
        return change.filter("change != 'unchanged'")

    def unload(self, name: str) -> None:
        """Deletes a corpus."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/corpus={name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
