"""Results as short text for a reader with little room."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lean_search(results: DataFrame, queries: DataFrame, mode: str = "hybrid", ids_only: bool = False) -> DataFrame:
    """query_id, lean: a heading for each query, then its hits in order of rank, one line each, and their snippets.

    results: query_id, rank, path, score, and modality, snippet, chunk_index where they are known; code comes
    before documents. Queries without hits say so. A query's results are bounded by the search's limit.
    """
    have = set(results.columns)
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    kind = F.when(text("modality") == "code", 0).otherwise(1)
    line = F.concat(F.lit("`"), F.col("path"), F.lit("` [score: "), F.format_string("%.3f", F.col("score").cast("double")), F.lit("]\n"))
    more = F.concat(
        F.when(text("snippet").isNotNull(), F.concat(F.lit("```\n"), text("snippet"), F.lit("\n```\n"))).otherwise(""),
        F.lit("-> path "), F.col("path"), F.lit(", chunk "), F.coalesce(text("chunk_index"), F.lit("0")), F.lit("\n"),
    )
    hit = F.struct(kind.alias("kind"), "rank", F.concat(line, F.lit("") if ids_only else more).alias("said"))
    grouped = results.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))

    def part(k: int, name: str) -> F.Column:
        own = F.filter("hits", lambda h: h["kind"] == k)
        numbered = F.transform(own, lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), h["said"]))
        return F.when(F.size(own) > 0, F.concat(F.lit(f"## {name} ("), F.size(own).cast("string"), F.lit(")\n\n"), F.array_join(numbered, "\n"), F.lit("\n"))).otherwise("")

    joined = queries.select("query_id", F.col("text").alias("_asked")).join(grouped, "query_id", "left")
    head = F.concat(F.lit('# Search: "'), F.coalesce("_asked", F.lit("")), F.lit(f'" [mode: {mode}, hits: '), F.coalesce(F.when(F.col("hits").isNotNull(), F.size("hits")), F.lit(0)).cast("string"), F.lit("]\n\n"))
    body = F.when(F.col("hits").isNull(), "No matching results found.\n").otherwise(F.concat(part(0, "Code hits"), part(1, "Document hits")))
    return joined.select("query_id", F.concat(head, body).alias("lean"))
