"""Ranked search: hybrid, fast, graph, explained and multi-hop, and the dispatch by mode.

All take a table of queries. ``Corpus`` names the tables a search needs; those that are missing narrow the modes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.scale import broadcast_if_small, cut

from . import graph
from .fusion import K, clean_path, concat_partitions, dedup_hits, first_rank, is_code_path, ranked, rrf, union_lists
from .lexical import bm25, query_terms
from .vectors import hamming_topk, semantic, vector_topk

#: Constant of fusion for what only the graph found; seeds of the graph; results fetched for each one wanted.
GRAPH_ONLY_K, SEEDS, OVERFETCH = 120, 5, 3


@dataclass
class Corpus:
    chunks: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    prints: DataFrame | None = None


def graph_boost(edges: DataFrame, seeds: DataFrame, depth: int = 2, edge_class: str | None = None, damped: bool = True) -> DataFrame:
    """query_id, path, boost, hops: the sum over seeds (query_id, path) of 1 / hops, less for hubs."""
    start = seeds.select(F.struct("query_id", "path").alias("seed"), F.col("path").alias("node"))
    near = graph.bfs(edges, start, depth, edge_class=edge_class).select("seed.query_id", F.col("node").alias("path"), "hops")
    summed = near.groupBy("query_id", "path").agg(F.sum(1 / F.col("hops")).alias("boost"), F.min("hops").alias("hops"))
    if not damped:
        return summed
    degree = graph.in_degree(edges).select(F.col("node").alias("path"), "in_degree")
    return summed.join(degree, "path", "left").select("query_id", "path", (F.col("boost") * graph.dampener(F.coalesce("in_degree", F.lit(0)))).alias("boost"), "hops")


def _ranked_boost(boost: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("boost", 9)), "path")
    return boost.withColumn("rank", F.row_number().over(order))


def _path_filter(results: DataFrame, modality: str | None) -> DataFrame:
    if modality in (None, "both"):
        return results
    return results.filter(is_code_path(clean_path(F.col("path"))) if modality == "code" else ~is_code_path(clean_path(F.col("path"))))


def hybrid_graph(corpus: Corpus, queries: DataFrame, limit: int = 10, depth: int = 2) -> DataFrame:
    """BM25 and graph: first ranks fused, what only the graph found at its own constant."""
    return hybrid_full(Corpus(corpus.chunks, corpus.edges), queries, limit, depth)


def hybrid_full(corpus: Corpus, queries: DataFrame, limit: int = 10, depth: int = 2, modality: str | None = None) -> DataFrame:
    """query_id, rank, path, score, chunk_index, graph_boost of BM25, vectors and graph fused.

    Every row of the first two lists adds 1 / (60 + rank) to its path, so files with several chunks found gain;
    a graph rank counts with 60, or 120 for what only the graph found. The chunk is BM25's best, else the
    vectors'. Ties: the direct score, then path.
    """
    take = OVERFETCH * limit
    lists = {"bm25": bm25(corpus.chunks, queries, take, modality)}
    if corpus.vectors is not None and "embedding" in queries.columns:
        lists["vector"] = vector_topk(corpus.vectors, queries, take, None, modality)
    # read three times below, and short: a few rows a query
    direct = cut(union_lists({n: df.select("query_id", "rank", "path", "chunk_index", "score") for n, df in lists.items()}))
    seeds = direct.filter(F.col("rank") <= SEEDS).select("query_id", "path").distinct()
    boost = _ranked_boost(graph_boost(corpus.edges, seeds, depth))
    by_path = direct.groupBy("query_id", "path").agg(
        F.sum(1 / (K + F.col("rank"))).alias("rrf"),
        F.max("score").alias("direct"),
        F.max(F.when(F.col("source") == "bm25", F.struct(F.round("score", 9).alias("s"), (-F.col("chunk_index")).alias("c")))).alias("lexical"),
        F.max(F.when(F.col("source") == "vector", F.struct(F.round("score", 9).alias("s"), (-F.col("chunk_index")).alias("c")))).alias("dense"),
    )
    joined = by_path.join(boost.withColumnRenamed("rank", "graph_rank"), ["query_id", "path"], "full_outer")
    part = F.when(F.col("graph_rank").isNull(), 0.0).when(F.col("rrf").isNull(), 1 / (GRAPH_ONLY_K + F.col("graph_rank"))).otherwise(1 / (K + F.col("graph_rank")))
    scored = joined.select(
        "query_id", "path", (F.coalesce("rrf", F.lit(0.0)) + part).alias("score"), F.coalesce("direct", F.lit(0.0)).alias("direct"),
        F.coalesce(-F.col("lexical.c"), -F.col("dense.c")).alias("chunk_index"), F.when(F.col("hops").isNotNull(), 1 / F.col("hops")).otherwise(0.0).alias("graph_boost"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc(F.round("direct", 9)), "path")
    out = _path_filter(scored, modality).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return out.select("query_id", "rank", "path", "score", "chunk_index", "graph_boost")


def _fast_lists(corpus: Corpus, queries: DataFrame, limit: int, modality: str | None) -> DataFrame:
    """source, query_id, path, rank, raw of BM25, Hamming and PageRank, a path's first place in each."""
    take = OVERFETCH * limit
    lexical = bm25(corpus.chunks, queries, take, modality)
    lists = {"bm25": lexical.groupBy("query_id", "path").agg(F.min("rank").alias("rank"), F.max("score").alias("raw"))}
    if corpus.prints is not None and "q0" in queries.columns:
        binary = hamming_topk(corpus.prints, queries, take, modality=modality).withColumn("path", clean_path(F.col("path")))
        lists["binary"] = binary.groupBy("query_id", "path").agg(F.min("rank").alias("rank"), F.max("score").alias("raw"))
    direct = cut(union_lists(lists))
    seeds = direct.groupBy("query_id", "path").agg(F.sum("raw").alias("weight"))
    ppr = graph.personalized_pagerank(corpus.edges, seeds.select(F.col("query_id").alias("seed"), F.col("path").alias("node"), "weight"))
    spread = ranked(ppr.select(F.col("seed").alias("query_id"), F.col("node").alias("path"), "score"), take)
    return direct.unionByName(spread.select("query_id", "path", "rank", F.col("score").alias("raw"), F.lit("ppr").alias("source")))


def fast(corpus: Corpus, queries: DataFrame, limit: int = 10, modality: str | None = None) -> DataFrame:
    """BM25, Hamming and personalised PageRank fused by first ranks."""
    return _path_filter(rrf(_path_filter(_fast_lists(corpus, queries, limit, modality), modality), limit), modality)


def explain_fast(corpus: Corpus, queries: DataFrame, limit: int = 10, modality: str | None = None) -> DataFrame:
    """As ``fast``, with each signal's raw score, rank and contribution."""
    lists = _path_filter(_fast_lists(corpus, queries, limit, modality), modality)
    return _pivot(lists, ("bm25", "binary", "ppr"), limit).withColumn("graph_hops", F.when(F.col("ppr_rank") <= limit, 1).when(F.col("ppr_rank").isNotNull(), 2))


def _pivot(lists: DataFrame, sources: tuple[str, ...], limit: int) -> DataFrame:
    columns = []
    for s in sources:
        own = F.col("source") == s
        columns += [F.max(F.when(own, F.col("raw"))).alias(f"{s}_raw"), F.min(F.when(own, F.col("rank"))).alias(f"{s}_rank"), F.coalesce(F.sum(F.when(own, 1 / (K + F.col("rank")))), F.lit(0.0)).alias(f"{s}_part")]
    wide = lists.groupBy("query_id", "path").agg(*columns)
    total = sum((F.col(f"{s}_part") for s in sources[1:]), F.col(f"{sources[0]}_part"))
    return ranked(wide.withColumn("score", total), limit)


def explain(corpus: Corpus, queries: DataFrame, limit: int = 10, depth: int = 2, modality: str | None = None) -> DataFrame:
    """BM25, vectors and undamped graph boost, 60 for all: raw score, rank and contribution of each signal."""
    take = OVERFETCH * limit
    lexical = bm25(corpus.chunks, queries, take, modality)
    lists = {"bm25": lexical.groupBy("query_id", "path").agg(F.min("rank").alias("rank"), F.max("score").alias("raw"))}
    if corpus.vectors is not None and "embedding" in queries.columns:
        dense = vector_topk(corpus.vectors, queries, take, None, modality)
        lists["vector"] = dense.groupBy("query_id", "path").agg(F.min("rank").alias("rank"), F.max("score").alias("raw"))
    direct = cut(union_lists(lists))
    seeds = direct.filter(F.col("rank") <= SEEDS).select("query_id", "path").distinct()
    boost = _ranked_boost(graph_boost(corpus.edges, seeds, depth, damped=False))
    found = boost.select("query_id", "path", "rank", F.col("boost").alias("raw"), F.lit("graph").alias("source"))
    return _pivot(direct.unionByName(found), ("bm25", "vector", "graph"), limit)


def graph_search(corpus: Corpus, queries: DataFrame, limit: int = 10, depth: int = 2, modality: str | None = None) -> DataFrame:
    """Nodes near the five best BM25 paths, by the sum of 1 / hops; the seeds themselves are left out."""
    seeds = cut(first_rank(bm25(corpus.chunks, queries, SEEDS)).select("query_id", "path"))
    near = graph_boost(corpus.edges, seeds, depth, damped=False).withColumnRenamed("boost", "score")
    return ranked(_path_filter(near.join(seeds, ["query_id", "path"], "left_anti"), modality), limit).select("query_id", "rank", "path", "score")


# Prefixes of questions, and connectives, both in the order they are tried.
QUESTION_PREFIXES = (
    "what is the path from ",
    "what is the path between ",
    "what is the path through ",
    "path from ",
    "how does ",
    "how do ",
    "how can ",
    "how is ",
    "what is ",
    "what are ",
    "what does ",
    "what do ",
    "what ",
    "how ",
    "why does ",
    "why do ",
    "why is ",
    "where does ",
    "where do ",
)
CONNECTIVES = (
    " relate to ",
    " related to ",
    " relates to ",
    " connect to ",
    " connects to ",
    " connected to ",
    " connection between ",
    " relationship between ",
    " between ",
    " through ",
    " connect ",
    " and ",
    " to ",
    " from ",
)
LEAST_BYTES, NO_CONCEPT = 3, "the path"


def unprefixed(text: str) -> str:
    prefix = next((p for p in QUESTION_PREFIXES if text.lower().startswith(p)), "")
    return text[len(prefix) :]


def decompose(query: str) -> list[str]:
    """The concepts of a question, at least one: its prefix dropped, cut at the first connective in order that
    leaves two parts long enough, the right part cut again."""
    fits = lambda part: len(part.encode()) >= LEAST_BYTES and part != NO_CONCEPT
    text = unprefixed(query)
    for word in CONNECTIVES:
        left, found, right = _around(text, word)
        if found and fits(left) and len(right.encode()) >= LEAST_BYTES:
            return [left, *filter(fits, decompose(right))]
    return [text if len(text.encode()) >= LEAST_BYTES else query]


def _around(text: str, word: str) -> tuple[str, bool, str]:
    at = text.lower().find(word)
    return (unprefixed(text[:at].strip()), True, unprefixed(text[at + len(word) :].strip())) if at >= 0 else ("", False, "")


def multihop(corpus: Corpus, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, rank, path, score, concepts: each concept's list, the whole query's at half weight, and nodes
    on shortest structural paths between the concepts' three best at a fifth. A path that several concepts
    find gains by their number."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decompose(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["query_id", "concepts"])

    kind = dict(queries.dtypes)["query_id"]
    cut_up = queries.select("query_id", "text").mapInArrow(split, f"query_id {kind}, concepts array<string>")
    parts = cut_up.select("query_id", F.posexplode("concepts").alias("concept", "text"))
    each = parts.select(F.struct("query_id", "concept").alias("query_id"), "text")
    found = cut(bm25(corpus.chunks, each, 2 * limit).select("query_id.query_id", "query_id.concept", "rank", "path"))
    whole = bm25(corpus.chunks, queries, 2 * limit)
    top = found.filter("rank <= 3").select("query_id", "concept", "path").distinct()
    a, b = top.alias("a"), top.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.concept") < F.col("b.concept")))
    pairs = pairs.select("a.query_id", F.col("a.path").alias("source"), F.col("b.path").alias("target")).filter("source != target")
    paths = graph.shortest_paths(corpus.edges, pairs, depth=4, edge_class="structural")
    between = pairs.join(paths, ["source", "target"]).select("query_id", F.explode("path").alias("path"), "source", "target").filter("path != source and path != target")
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "path")
    bridges = between.groupBy("query_id", "path").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(order))
    lists = (
        found.select("query_id", "path", "rank", "concept", F.lit(1.0).alias("weight"))
        .unionByName(whole.select("query_id", "path", "rank", F.lit(None).cast("int").alias("concept"), F.lit(0.5).alias("weight")))
        .unionByName(bridges.select("query_id", "path", "rank", F.lit(None).cast("int").alias("concept"), F.lit(0.2).alias("weight")))
    )
    summed = lists.groupBy("query_id", "path").agg(F.sum(F.col("weight") / (K + F.col("rank"))).alias("score"), F.count_distinct("concept").alias("concepts"))
    scored = summed.withColumn("score", F.col("score") * F.greatest("concepts", F.lit(1)))
    return ranked(scored, limit).select("query_id", "rank", "path", "score", "concepts")


def search(corpus: Corpus, queries: DataFrame, mode: str = "hybrid", limit: int = 10, modality: str = "both", depth: str = "adaptive") -> DataFrame:
    """One table of results for a mode; ``limit`` is held to 1..100. A hybrid search of both kinds returns
    documents, then code; without vectors it is the fast one."""
    limit = max(1, min(100, limit))
    if mode == "bm25":
        return bm25(corpus.chunks, queries, limit, modality)
    if mode == "graph":
        return graph_search(corpus, queries, limit, modality=modality)
    if mode == "fast":
        return fast(corpus, queries, limit, modality)
    if mode == "semantic":
        if corpus.vectors is None:
            raise ValueError("a semantic search needs vectors")
        return semantic(corpus.vectors, queries, limit, depth, modality)
    if mode == "multihop":
        return multihop(corpus, queries, limit)
    if mode != "hybrid":
        raise ValueError(f"no search mode {mode!r}")
    if modality == "code" or corpus.vectors is None:
        return fast(corpus, queries, limit, modality)
    docs = hybrid_full(corpus, queries, limit, modality="docs")
    if modality == "docs":
        return docs
    keep = ("query_id", "rank", "path", "score")
    return concat_partitions(docs.select(*keep), fast(corpus, queries, limit, "code").select(*keep))


def with_lineage(results: DataFrame, edges: DataFrame) -> DataFrame:
    return results.join(graph.lineage_of(edges).withColumnRenamed("node", "path"), "path", "left")


def shape(results: DataFrame, detail: str) -> DataFrame:
    """``ids`` keeps what names a result; anything else keeps all."""
    return results.select(*[c for c in results.columns if c in ("query_id", "rank", "corpus", "path", "chunk_index", "score")]) if detail == "ids" else results


def snippets(results: DataFrame, chunks: DataFrame, top: int = 3, lines: int = 20) -> DataFrame:
    """``results`` with the text of their chunk for the first ``top`` ranks, cut to some lines."""
    text = chunks.select("path", "chunk_index", F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n").alias("snippet"))
    wanted = results.filter(F.col("rank") <= top).join(text, ["path", "chunk_index"], "left")
    return wanted.unionByName(results.filter(F.col("rank") > top).withColumn("snippet", F.lit(None).cast("string")))


def symbol_at(results: DataFrame, symbols: DataFrame) -> DataFrame:
    """The first symbol that overlaps a result's lines, else the first of its file; a row for each (query_id, rank).

    results: query_id, rank, path, start_line, end_line, ..; symbols: path, name, start_line, end_line. First is by start,
    then name. Of a file's symbols in that order only those count that end after all before them: their starts and ends
    both rise, so the first that ends at or after a result's start is the only one to look at. No result meets more than
    one symbol.
    """
    s = symbols.select("path", F.col("name").alias("symbol"), F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end"))
    least = F.min(F.struct(F.col("symbol").isNull(), "symbol"))["symbol"].alias("symbol")
    spans = s.groupBy("path", "s_start", "s_end").agg(least)
    firsts = spans.groupBy("path").agg(F.min(F.struct(F.col("s_start").isNull(), "s_start", F.col("symbol").isNull(), "symbol"))["symbol"].alias("first"))
    before = Window.partitionBy("path").orderBy("s_start", F.asc_nulls_last("symbol"), F.desc("s_end")).rowsBetween(Window.unboundedPreceding, -1)
    known = spans.filter("s_start is not null and s_end is not null").withColumn("_reach", F.max("s_end").over(before))
    rising = known.filter("_reach is null or s_end > _reach").select("path", F.col("s_end").alias("_at"), F.lit(0).alias("_asks"), F.struct("s_start", "symbol").alias("_symbol"))
    lines = results.select("path", "start_line", "end_line").distinct()
    asked = lines.select("path", F.col("start_line").alias("_at"), F.lit(1).alias("_asks"), "end_line").filter("_at is not null and end_line is not null")
    # from the last line to the first, symbols before results: the last symbol seen is the first that ends at or after one
    seen = Window.partitionBy("path").orderBy(F.desc("_at"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    both = rising.unionByName(asked, allowMissingColumns=True).withColumn("_symbol", F.last("_symbol", ignorenulls=True).over(seen))
    inside = both.filter((F.col("_asks") == 1) & (F.col("_symbol.s_start") <= F.col("end_line")))
    inside = inside.select("path", F.col("_at").alias("start_line"), "end_line", F.col("_symbol.s_start").alias("_start"), F.col("_symbol.symbol").alias("_inside"), F.lit(0).alias("_outside"))
    met = results.join(inside, ["path", "start_line", "end_line"], "left").join(firsts, "path", "left")
    found = met.withColumn("symbol", F.when(F.col("_outside").isNull(), F.col("first")).otherwise(F.col("_inside")))
    order = Window.partitionBy("query_id", "rank").orderBy(F.asc_nulls_last("_outside"), F.asc_nulls_last("_start"), F.asc_nulls_last("symbol"))
    return found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*results.columns, "symbol")


#: A ranking algorithm: the corpus, queries (query_id, text, ..) and how many results, to query_id, rank, path, score.
Algorithm = Callable[[Corpus, DataFrame, int], DataFrame]


def _merged(*names: str) -> Algorithm:
    """First ranks of several algorithms, each taken at more than the limit, fused."""

    def run(corpus: Corpus, queries: DataFrame, limit: int) -> DataFrame:
        return rrf(union_lists({n: first_rank(ALGORITHMS[n](corpus, queries, OVERFETCH * limit)) for n in names}), limit)

    return run


#: By name; others can be added.
ALGORITHMS: dict[str, Algorithm] = {
    "bm25": lambda c, q, n: bm25(c.chunks, q, n),
    "binary": lambda c, q, n: hamming_topk(c.prints, q, n, prior=False),
    "binary_v3": lambda c, q, n: hamming_topk(c.prints, q, n),
    "semantic": lambda c, q, n: semantic(c.vectors, q, n),
    "ppr": lambda c, q, n: name_pagerank(c, q, n),
    "fast": _merged("bm25", "binary", "ppr"),
    "hybrid": _merged("bm25", "semantic", "ppr"),
}


def algorithm(name: str, corpus: Corpus, queries: DataFrame, limit: int = 10) -> DataFrame:
    """The results of an algorithm by its name, as it gives them."""
    if name not in ALGORITHMS:
        raise ValueError(f"no algorithm {name!r}")
    return ALGORITHMS[name](corpus, queries, limit)


def isolated(name: str, corpus: Corpus, queries: DataFrame, limit: int = 10) -> DataFrame:
    """One algorithm alone: taken at more than the limit, hits of the same file merged (``fusion.dedup_hits``)."""
    found = algorithm(name, corpus, queries, OVERFETCH * limit)
    if "chunk_index" in found.columns:
        found = found.join(corpus.chunks.select("path", "chunk_index", "text"), ["path", "chunk_index"], "left")
    else:
        found = found.withColumn("text", F.lit(None).cast("string"))
    return dedup_hits(found.select("query_id", "path", "score", "text"), queries, limit)


def name_pagerank(corpus: Corpus, queries: DataFrame, limit: int = 10, alpha: float = 0.85, iterations: int = 10) -> DataFrame:
    """PageRank from the nodes whose name holds a term of the query.

    Terms and names meet by groups of three letters: a term's rarest group is looked up among those of each name,
    and what shares it is compared in full.
    """
    terms = cut(query_terms(queries).filter(F.length("term") >= 3).select("query_id", "term"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    low = F.lower(F.col("node").cast("string"))
    named = graph.nodes_of(corpus.edges).select("node", low.alias("low")).filter(F.length("low") >= 3)
    keyed = terms.select("term", F.explode(grams(F.col("term"))).alias("gram")).distinct()
    held = cut(named.select("node", "low", F.explode(grams(F.col("low"))).alias("gram")).join(broadcast_if_small(keyed.select("gram").distinct()), "gram", "left_semi"))
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = keyed.join(broadcast_if_small(often), "gram").groupBy("term").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    # a term with a group that no name has is in no name
    whole = keyed.join(broadcast_if_small(often), "gram", "left").groupBy("term").agg(F.bool_and(F.col("n").isNotNull()).alias("all")).filter("all")
    asked = rarest.join(whole, "term").join(terms, "term")
    met = held.join(broadcast_if_small(asked), "gram").filter(F.col("low").contains(F.col("term")))
    seeds = met.select(F.col("query_id").alias("seed"), "node", F.lit(1.0).alias("weight")).distinct()
    p = graph.personalized_pagerank(corpus.edges, seeds, alpha, iterations)
    return ranked(p.select(F.col("seed").alias("query_id"), F.col("node").alias("path"), "score"), limit)


def path_modality(path: Column) -> Column:
    return F.when(is_code_path(clean_path(path)), "code").otherwise("docs")

