"""Communities: label moves by modularity, connected refinement, modularity, density, architecture view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.scale import cut, placed, wide

from .graph import degrees, in_degree, nodes_of

#: Fixed value: passes of moves at most.
PASSES = 100


def undirected(edges: DataFrame) -> DataFrame:
    """a, b, w with a < b: weights of both directions and all types summed; loops are left out."""
    pair = edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    return wide(pair, "a", "b").groupBy("a", "b").agg(F.sum("w").alias("w"))


def communities(edges: DataFrame, passes: int = PASSES) -> DataFrame:
    """node, community by local moves of modularity gain.

    Nodes move at once in each pass, not one after the other, so that a pass is two joins and an aggregation
    over edges; a half of the nodes, drawn by hash and pass, moves, which keeps two neighbours from swapping for
    ever. A move needs a positive gain k_in / m - k * total / (2 m^2) over staying; ties go to the smaller
    community. Isolated nodes are communities of their own.
    """
    pairs = cut(undirected(edges))
    total = pairs.agg(F.sum("w")).first()[0]  # one number
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    strength = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    state = nodes_of(edges).join(strength, "node", "left").select("node", F.col("node").alias("community"), F.coalesce("k", F.lit(0.0)).alias("k"))
    if not total:
        return state.select("node", "community")
    state, m2 = cut(state), 2.0 * total
    for turn in range(passes):
        sums = state.groupBy("community").agg(F.sum("k").alias("total"))
        near = both.join(state.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("inside"))
        own = state.withColumnRenamed("community", "home")
        options = own.select("node", "home", "k", F.col("home").alias("community")).join(near, ["node", "community"], "left")
        options = options.unionByName(own.join(near, "node").filter("community != home").select("node", "community", "home", "k", "inside"))
        options = options.join(sums, "community")
        rest = F.col("total") - F.when(F.col("community") == F.col("home"), F.col("k")).otherwise(0.0)
        gain = F.coalesce("inside", F.lit(0.0)) / total - F.col("k") * rest / (m2 * total)
        order = Window.partitionBy("node").orderBy(F.desc(F.round("gain", 12)), (F.col("community") != F.col("home")).cast("int"), "community")
        best = options.withColumn("gain", gain).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
        moves = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        after = cut(best.select("node", F.when(moves, F.col("community")).otherwise(F.col("home")).alias("community"), "k", (F.col("community") != F.col("home")).alias("wants")))
        wanting = after.filter("wants").count()
        state = after.select("node", "community", "k")
        if not wanting:
            break
    return state.select("node", "community")


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its least node): least labels spread along edges, and labels jump to their label's, until
    none moves; jumps make the number of rounds grow with the logarithm of the longest way."""
    pairs = edges.filter("src != dst").select("src", "dst")
    both = cut(pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    every = nodes_of(edges) if nodes is None else nodes_of(edges).union(nodes.select("node")).distinct()
    state = cut(every.withColumn("component", F.col("node")))
    while True:
        spread = both.join(state, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        lower = state.join(spread, "node", "left").select("node", F.least("component", "near").alias("next"), "component")
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        after = cut(lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("component"), (F.least("next", F.coalesce("beyond", "next")) != F.col("component")).alias("moved")))
        state = after.select("node", "component")
        if after.filter("moved").isEmpty():
            return state


def refined(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """node, community: each community cut into its connected parts, numbered by size, then by least node."""
    own = communities(edges) if found is None else found
    a, b = own.select(F.col("node").alias("src"), F.col("community").alias("ca")), own.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inside = edges.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst")
    parts = connected(inside, own)
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    numbered = placed(sizes, F.desc("n"), F.asc("component"), out="community")
    return parts.join(numbered, "component").select("node", "community")


def modularity(edges: DataFrame, found: DataFrame) -> DataFrame:
    """One row: the sum over communities of inside / 2m - (total / 2m)^2."""
    mine = lambda node, c, known: found.select(F.col("node").alias(node), F.col("community").alias(c), F.lit(True).alias(known))
    a = wide(undirected(edges), "a").join(mine("a", "ca", "ka"), "a", "left")
    both = wide(a, "b").join(mine("b", "cb", "kb"), "b", "left")
    sums = cut(both.groupBy("ca", "cb", (F.col("ka") & F.col("kb")).alias("known")).agg(F.sum("w").alias("w")))  # the edges are read once
    m = sums.agg(F.sum("w").alias("m"))
    kept = sums.filter("known")
    inside = kept.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg((2 * F.sum("w")).alias("inside"))
    ends = kept.select(F.col("ca").alias("community"), "w").union(kept.select("cb", "w")).groupBy("community").agg(F.sum("w").alias("total"))
    joined = ends.join(inside, "community", "left").crossJoin(F.broadcast(m))  # m: one row
    part = F.coalesce("inside", F.lit(0.0)) / (2 * F.col("m")) - F.pow(F.col("total") / (2 * F.col("m")), 2)
    return joined.agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("modularity"))


def density(edges: DataFrame, found: DataFrame) -> DataFrame:
    """community, n, internal, density: directed edges inside over n (n - 1); 0 for one node."""
    sizes = found.groupBy("community").agg(F.count("*").alias("n"))
    own = edges.join(found.select(F.col("node").alias("src"), F.col("community").alias("ca")), "src").join(found.select(F.col("node").alias("dst"), F.col("community").alias("cb")), "dst")
    inside = own.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("internal"))
    joined = sizes.join(inside, "community", "left").withColumn("internal", F.coalesce("internal", F.lit(0)))
    return joined.withColumn("density", F.when(F.col("n") > 1, F.col("internal") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0))


def density_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, density E / (N (N - 1)), orphans."""
    every = nodes.select("node").union(nodes_of(edges)).distinct()
    lone = every.join(degrees(edges), "node", "left_anti").agg(F.count("*").alias("orphans"))
    n, e = every.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    one = n.crossJoin(e).crossJoin(lone)  # one row each
    return one.withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def architecture(edges: DataFrame, found: DataFrame, top: int = 10, members: int = 5) -> DataFrame:
    """community, n, density, node, in_degree: the largest communities with their most referred nodes."""
    largest = density(edges, found).orderBy(F.desc("n"), "community").limit(top)
    ranked = found.join(in_degree(edges), "node", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("in_degree"), "node"))
    return ranked.withColumn("place", place).filter(F.col("place") <= members).join(largest, "community").select("community", "n", "density", "node", "in_degree")
