"""Across corpora: symbol resolution, links, and traversal that counts hops and crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.scale import cut
from strataq.functions.text import moniker_leaf

MOST = 10


def resolve_across(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (corpus, raw) with target_corpus, target_scope, where exactly one symbol of all corpora is meant, and
    it is in another corpus. A moniker that matches goes before a name."""
    asked = refs.select("corpus", "raw").distinct()
    by_moniker = asked.join(symbols.select(F.col("moniker").alias("raw"), F.col("corpus").alias("target_corpus"), F.col("scope_path").alias("target_scope"), F.lit(1).alias("tier")), "raw")
    by_name = asked.withColumn("leaf", moniker_leaf(F.col("raw")))
    named = symbols.select(F.col("name").alias("n"), F.col("corpus").alias("target_corpus"), F.col("scope_path").alias("target_scope"))
    by_scope = by_name.join(named, (F.col("n") == F.col("leaf")) & ((F.col("target_scope") == F.col("raw")) | (F.col("leaf") == F.col("n")))).select("raw", "corpus", "target_corpus", "target_scope", F.lit(2).alias("tier"))
    both = by_moniker.select("raw", "corpus", "target_corpus", "target_scope", "tier").unionByName(by_scope).distinct()
    w = Window.partitionBy("corpus", "raw")
    best = both.withColumn("best", F.min("tier").over(w)).filter("tier = best").withColumn("n", F.count("*").over(w))
    return best.filter("n = 1 and target_corpus != corpus").select("corpus", "raw", "target_corpus", "target_scope")


def link_documents(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from documents (corpus, path, raw, edge_type) to symbols of other corpora that their own lacks."""
    local = symbols.select("corpus", F.col("name").alias("raw")).union(symbols.select("corpus", "scope_path")).distinct()
    outside = targets.join(local, ["corpus", "raw"], "left_anti")
    found = outside.join(resolve_across(outside, symbols), ["corpus", "raw"])
    return found.select("corpus", F.col("path").alias("src"), F.concat("target_corpus", F.lit("::"), "target_scope").alias("dst"), "edge_type", F.lit("structural").alias("class"), F.lit(1.0).alias("weight"), F.lit("documents-code").alias("provenance"), F.lit("high").alias("confidence"))


def link_external(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """An edge for each resolved reference (corpus, src, raw, edge_type), and its mirror in the target's corpus."""
    found = refs.join(resolve_across(refs, symbols), ["corpus", "raw"])
    there = found.select("corpus", "src", F.concat("target_corpus", F.lit("::"), "target_scope").alias("dst"), "edge_type")
    back = found.select(F.col("target_corpus").alias("corpus"), F.concat("corpus", F.lit("::"), "src").alias("src"), F.col("target_scope").alias("dst"), "edge_type")
    return there.unionByName(back).distinct()


def traverse(edges: DataFrame, starts: DataFrame, depth: int = 3, crossings: int = 2, go_on: bool = True) -> DataFrame:
    """corpus, node, hops, crossed: breadth first over (corpus, node).

    edges: corpus, src, target_corpus, dst. Depth counts within a corpus and starts anew on crossing into
    another; both bounds are 10 at most. With ``go_on`` false a crossing is listed but not entered.
    """
    depth, crossings = max(1, min(MOST, depth)), max(0, min(MOST, crossings))
    hop = edges.select("corpus", F.col("src").alias("node"), F.coalesce("target_corpus", "corpus").alias("next_corpus"), "dst").distinct()
    seen = starts.select("corpus", "node", F.lit(0).alias("hops"), F.lit(0).alias("crossed"), F.lit(0).alias("inside"))
    frontier = seen
    for level in range(1, depth * (crossings + 1) + 1):
        step = frontier.filter(F.col("inside") < depth).join(hop, ["corpus", "node"])
        over = (F.col("next_corpus") != F.col("corpus")).cast("int")
        step = step.select(F.col("next_corpus").alias("corpus"), F.col("dst").alias("node"), F.lit(level).alias("hops"), (F.col("crossed") + over).alias("crossed"), F.when(over == 1, 0).otherwise(F.col("inside") + 1).alias("inside"))
        step = step.filter(F.col("crossed") <= crossings).groupBy("corpus", "node").agg(F.min("hops").alias("hops"), F.min("crossed").alias("crossed"), F.min("inside").alias("inside"))
        fresh = cut(step.join(seen.select("corpus", "node"), ["corpus", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        seen = cut(seen.unionByName(fresh))
        frontier = fresh if go_on else fresh.filter("crossed = 0")
    return seen.filter("hops > 0").select("corpus", "node", "hops", "crossed")
