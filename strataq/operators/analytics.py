"""Counts and reports over a corpus and its results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import bm25


def census(symbols: DataFrame) -> DataFrame:
    """kind, name, n: symbols by type, by language, and all, from one pass."""
    grouped = symbols.groupingSets([["symbol_type"], ["language"], []], "symbol_type", "language").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "symbol_type").when(F.col("g") == 2, "language").otherwise("total")
    return grouped.select(kind.alias("kind"), F.coalesce(F.when(F.col("g") == 1, F.col("symbol_type")).otherwise(F.col("language")), F.lit("")).alias("name"), "n")


def path_coverage(asked: DataFrame, files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, files, chunks, symbols, covered for each asked path or prefix."""
    per = files.join(chunks.groupBy("path").agg(F.count("*").alias("c")), "path", "left").join(symbols.groupBy("path").agg(F.count("*").alias("s")), "path", "left")
    asked = asked.select(F.col("path").alias("asked")).distinct()
    lengths = [r["n"] for r in asked.select(F.length("asked").alias("n")).distinct().collect() if r["n"] is not None]  # bounded by the longest path
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    met = asked.join(per.select("*", F.explode(prefixes).alias("asked")), "asked", "left")
    counted = met.groupBy(F.col("asked").alias("path")).agg(F.count("path").alias("files"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("s"), F.lit(0)).alias("symbols"))
    return counted.withColumn("covered", (F.col("chunks") > 0) | (F.col("symbols") > 0))


def query_coverage(chunks: DataFrame, queries: DataFrame, paths: DataFrame, k: int = 10) -> DataFrame:
    """One row: paths, covered (all retrieved ones), ratio (1 without paths)."""
    hit = bm25(chunks, queries, k).agg(F.count_distinct("path").alias("covered"))
    total = paths.agg(F.count_distinct("path").alias("total"))
    return total.crossJoin(hit).withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.col("covered") / F.col("total")))


def uncovered(chunks: DataFrame, queries: DataFrame, paths: DataFrame, k: int = 10) -> DataFrame:
    return paths.select("path").distinct().join(bm25(chunks, queries, k).select("path").distinct(), "path", "left_anti")


def split_suggestions(chunks: DataFrame, most: int = 2000) -> DataFrame:
    """path, chunk_index, size, reason, coherence of chunks to split, least coherent first when sorted by it.

    Longer than ``most`` bytes: 0.3; more than one heading line: 1 / headings; more than five paragraphs in more
    than 500 bytes: 1 - paragraphs / 10, 0.2 at least. The first that applies counts.
    """
    size = F.octet_length("text")
    heads = F.size(F.filter(F.split("text", "\n"), lambda s: s.startswith("#")))
    paragraphs = F.size(F.split("text", "\n\n"))
    many = (paragraphs > 5) & (size > 500)
    reason = F.when(size > most, "size").when(heads > 1, "headings").when(many, "paragraphs")
    coherence = F.when(size > most, 0.3).when(heads > 1, 1.0 / heads).when(many, 1.0 - F.least(paragraphs / 10.0, F.lit(0.8)))
    return chunks.select("path", "chunk_index", size.alias("size"), reason.alias("reason"), coherence.alias("coherence")).filter("reason is not null")


def indexing_status(state: DataFrame) -> DataFrame:
    """Adds percent, files_per_second, eta_seconds to (corpus, done, total, started_at, now), to two places."""
    spent = F.greatest(F.col("now") - F.col("started_at"), F.lit(0))
    rate = F.when(spent > 0, F.col("done") / spent).otherwise(0.0)
    eta = F.when(rate > 0, (F.col("total") - F.col("done")) / rate)
    percent = F.when(F.col("total") > 0, 100.0 * F.col("done") / F.col("total")).otherwise(100.0)
    return state.select("*", F.round(percent, 2).alias("percent"), F.round(rate, 2).alias("files_per_second"), F.round(eta, 2).alias("eta_seconds"))


def corpora(files: DataFrame, vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """corpus, files, vectors, nodes."""
    parts = [df.groupBy("corpus").agg(F.count("*").alias(n)) for n, df in (("files", files), ("vectors", vectors), ("nodes", nodes))]
    joined = parts[0].join(parts[1], "corpus", "full_outer").join(parts[2], "corpus", "full_outer")
    return joined.na.fill(0, ["files", "vectors", "nodes"])


def semantic_gaps(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """query_id, lexical_only, dense_only, both, overlap (Jaccard; 1 when both are empty) of two ranked lists."""
    rows = lexical.select("query_id", "path", F.lit(1).alias("l"), F.lit(0).alias("d")).union(dense.select("query_id", "path", F.lit(0), F.lit(1)))
    each = rows.groupBy("query_id", "path").agg(F.max("l").alias("l"), F.max("d").alias("d"))
    out = each.groupBy("query_id").agg(
        F.sum(F.when(F.col("d") == 0, 1).otherwise(0)).alias("lexical_only"), F.sum(F.when(F.col("l") == 0, 1).otherwise(0)).alias("dense_only"), F.sum(F.col("l") * F.col("d")).alias("both"), F.count("*").alias("all")
    )
    return out.select("query_id", "lexical_only", "dense_only", "both", F.when(F.col("all") == 0, 1.0).otherwise(F.col("both") / F.col("all")).alias("overlap"))


def delta(stored: DataFrame, found: DataFrame) -> DataFrame:
    """path, change (new, modified, deleted, unchanged) of (path, content_hash) against what is stored."""
    s, f = stored.select("path", F.col("content_hash").alias("old")), found.select("path", F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return s.join(f, "path", "full_outer").select("path", change.alias("change"))


def fan_out(results: DataFrame, limit: int = 10) -> DataFrame:
    """Results of many corpora (corpus, query_id, rank, path) merged into one list."""
    from .fusion import rrf_across

    return rrf_across(results, limit)


def paired_t(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """One row: n, mean difference and t of a metric over the queries both have."""
    joined = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id")
    out = joined.agg(F.count("*").alias("n"), F.avg(F.col("x") - F.col("y")).alias("mean"), F.stddev_samp(F.col("x") - F.col("y")).alias("sd"))
    return out.select("n", "mean", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"))
