"""Reciprocal rank fusion, deduplication and collapsing of ranked lists.

A ranked list is a table (query_id, rank, path, ..); several lists are one table with a column ``source``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
CODE_EXTENSIONS = ("c", "cc", "cpp", "cs", "go", "h", "java", "js", "jsx", "kt", "php", "py", "rb", "rs", "scala", "sh", "sql", "swift", "ts", "tsx")


def ranked(scores: DataFrame, limit: int | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Adds ``rank`` from 1, best score first, ties by key; keeps ``limit`` of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), *keys)
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def union_lists(lists: dict[str, DataFrame]) -> DataFrame:
    """One table of lists, with their names as ``source``."""
    named = [df.withColumn("source", F.lit(name)) for name, df in lists.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def rrf(lists: DataFrame, limit: int | None = 10, k: int = K, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """query_id, rank, keys, score: the sum of weight / (k + rank) over all places a key has in the lists.

    A key that a list repeats counts each time. ``weight`` is 1 where the table has no such column.
    """
    weight = F.col("weight") if "weight" in lists.columns else F.lit(1.0)
    summed = lists.groupBy("query_id", *keys).agg(F.sum(weight / (k + F.col("rank"))).alias("score"))
    return ranked(summed, limit, keys)


def rrf_across(lists: DataFrame, limit: int | None = 10, k: int = K) -> DataFrame:
    """Fusion over corpora: a path of one corpus is another than the same path of the next."""
    return rrf(lists, limit, k, ("corpus", "path"))


def best_per(rows: DataFrame, group: tuple[str, ...], score: str = "score", then: tuple[str, ...] = ()) -> DataFrame:
    """The row of each group with the highest score, ties by the columns ``then``."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), *then)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def first_rank(rows: DataFrame) -> DataFrame:
    """The first place of each path in each query's list."""
    return rows.groupBy("query_id", "path").agg(F.min("rank").alias("rank"))


def clean_path(path: Column) -> Column:
    """The file of an id such as ``path#scope`` or ``path:chunk:3``."""
    return F.regexp_replace(path, r"(:chunk:\d+|#.*)$", "")


def is_code_path(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*CODE_EXTENSIONS)


def dedup_hits(hits: DataFrame, queries: DataFrame, limit: int = 10, code_only: bool = False) -> DataFrame:
    """Hits of the same file merged: the best score, 0.002 for each hit up to ten, and the best lexical bonus,
    0.005 for each query term of three bytes or more that the hit's text holds.

    hits: query_id, path, score, text; queries: query_id, text.
    """
    terms = queries.select("query_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda t: F.octet_length(t) >= 3).alias("terms"))
    clean = hits.withColumn("path", clean_path(F.col("path")))
    if code_only:
        clean = clean.filter(is_code_path(F.col("path")))
    held = clean.join(terms, "query_id")
    bonus = F.size(F.filter("terms", lambda t: F.lower(F.coalesce(F.col("text"), F.lit(""))).contains(t) | F.lower("path").contains(t))) * 0.005
    merged = held.withColumn("bonus", bonus).groupBy("query_id", "path").agg(F.max("score").alias("top"), F.count("*").alias("n"), F.max("bonus").alias("bonus"))
    total = F.col("top") + 0.002 * F.least("n", F.lit(10)) + F.col("bonus")
    return ranked(merged.select("query_id", "path", total.alias("score"), F.col("n").alias("hits")), limit)


def collapse_files(results: DataFrame) -> DataFrame:
    """One row for each query and path, at its best place, with the number of other chunks it had."""
    w = Window.partitionBy("query_id", "path")
    first = results.withColumn("_n", F.row_number().over(w.orderBy("rank"))).withColumn("collapsed_chunks", F.count("*").over(w) - 1)
    return first.filter("_n = 1").drop("_n")


def concat_partitions(docs: DataFrame, code: DataFrame) -> DataFrame:
    """Results of documents, then of code, each with its own ranks."""
    return docs.withColumn("partition", F.lit("docs")).unionByName(code.withColumn("partition", F.lit("code")))


def rank_metrics(results: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, precision, mrr, ndcg at k. judged: query_id, path, grade (0: not relevant)."""
    top = results.filter(F.col("rank") <= k).select("query_id", "path", "rank")
    good = judged.filter("grade > 0")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal_order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "path")
    ideal = good.withColumn("at", F.row_number().over(ideal_order)).filter(F.col("at") <= k)
    ideal = ideal.groupBy("query_id").agg(F.sum(gain / F.log2(F.col("at") + 1.0)).alias("idcg"))
    all_good = good.groupBy("query_id").agg(F.count("*").alias("n_good"))
    hit = top.join(good, ["query_id", "path"]).groupBy("query_id").agg(
        F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    base = all_good.join(ideal, "query_id").join(hit, "query_id", "left")
    zero = F.lit(0.0)
    return base.select(
        "query_id",
        F.coalesce(F.col("found") / F.col("n_good"), zero).alias("recall"),
        F.coalesce(F.col("found") / F.lit(float(k)), zero).alias("precision"),
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("dcg") / F.col("idcg"), zero).alias("ndcg"),
    )
