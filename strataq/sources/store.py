"""The index as Parquet tables in one folder: lexical index, vectors, fingerprints, graph, texts of rich files.

A folder is complete once its manifest is there; it is written last, by Spark, so any file system that Spark
knows will do. Reading compares the manifest with what the caller expects before a table is opened.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Version of the graph's tables; another one is refused.
GRAPH_VERSION = 3
MANIFEST = "manifest"


def export(tables: dict[str, DataFrame], folder: str, model: str = "", dims: int = 0, graph_version: int = GRAPH_VERSION) -> dict:
    """Writes each table below ``folder``, then the manifest, which is returned. An existing folder is refused."""
    names = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        names[name] = df.schema.simpleString()
    manifest = {"model": model, "dims": dims, "graph_version": graph_version, "tables": names}
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(json.dumps(manifest, sort_keys=True)).alias("value")).write.text(f"{folder}/{MANIFEST}")
    return manifest


def manifest_of(spark: SparkSession, folder: str) -> dict:
    """The manifest; an error if the export did not end."""
    return json.loads(spark.read.text(f"{folder}/{MANIFEST}").first()["value"])


def check(manifest: dict, model: str | None = None, dims: int | None = None) -> None:
    """Raises ValueError if the folder was made with another model, other dimensions or another graph version."""
    wanted = {"model": model, "dims": dims, "graph_version": GRAPH_VERSION}
    for name, value in wanted.items():
        if value is not None and manifest[name] != value:
            raise ValueError(f"{name} is {manifest[name]!r} in the bundle, not {value!r}")


def load(spark: SparkSession, folder: str, model: str | None = None, dims: int | None = None) -> dict[str, DataFrame]:
    """The tables of a checked folder, by name, unread yet."""
    manifest = manifest_of(spark, folder)
    check(manifest, model, dims)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}


def print_id(path: Column, chunk_index: Column, scope: Column, modality: Column) -> Column:
    """Id of a fingerprint: ``path#scope`` of a symbol, ``path:chunk:n`` of a chunk, ``path`` of a file and of the
    first chunk of a document."""
    chunk = F.concat(path, F.lit(":chunk:"), chunk_index.cast("string"))
    whole = chunk_index.isNull() | ((chunk_index == 0) & modality.eqNullSafe(F.lit("docs")))
    return F.when(scope.isNotNull(), F.concat(path, F.lit("#"), scope)).when(whole, path).otherwise(chunk)


def upsert_prints(held: DataFrame, new: DataFrame) -> DataFrame:
    """``held`` (id, ..) with the rows of ``new`` (id, .., seq) in place of those of the same id.

    Of rows of ``new`` that share an id the last by ``seq`` stays. Ids are compared null-safe; columns are held's.
    """
    last = Window.partitionBy("id").orderBy(F.desc("seq"), F.xxhash64(*[c for c in new.columns if c != "seq"]))
    fresh = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(*held.columns)
    kept = held.join(fresh.select(F.col("id").alias("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_anti")
    return kept.unionByName(fresh)


def upsert_vectors(held: DataFrame, new: DataFrame) -> DataFrame:
    """``held`` (path, chunk_index, is_doc_level, modality, embedding) with all vectors of the files in ``new`` replaced."""
    gone = new.select(F.col("path").alias("_path")).distinct()
    return held.join(gone, F.col("path") == F.col("_path"), "left_anti").unionByName(new)


def projected(files: DataFrame, projections: DataFrame) -> DataFrame:
    """``files`` (path, text, ..) with the normalised text of those that ``projections`` (path, projection_text) has."""
    named = projections.groupBy(F.col("path").alias("_path")).agg(F.max("projection_text").alias("_text"))
    joined = files.join(named, F.col("path") == F.col("_path"), "left")
    return joined.select(*[F.coalesce("_text", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in files.columns])
