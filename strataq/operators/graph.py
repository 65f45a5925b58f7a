"""Typed edges: building, traversal, paths, diffusion, lineage and statistics.

edges: src, dst, edge_type, class, weight (others are kept where rows are). Node sets and frontiers are tables, so
many starts are traversed at once: a start is a row with a ``seed``. Loops are bounded by depth, join only the
frontier, and settle each frontier in the shared checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.scale import broadcast_if_small, cut, wide

CUT_EVERY = 3
#: Weight of an edge by its type.
CODE_WEIGHTS = {"defines": 1.0, "calls": 0.8, "tests": 0.9, "imports": 0.6, "inherits": 0.9, "extends": 0.9, "implements": 0.9, "decorates": 0.85, "struct_embeds": 0.85, "foreign_key": 0.9, "macro_expands": 0.7}
#: Other names of edge types, and the types of lineage.
ALIASES = {"implements_trait": "implements", "documents_code": "documents", "shared_tag": "related_tag"}
LINEAGE = ("supersedes", "implements", "depends_on", "adr_for", "parent_of")


# --- filters and building ----------------------------------------------------------------------------------


def class_matches(wanted: str | None) -> Column:
    """A hybrid filter takes all edges; others take their own class and hybrid edges."""
    if wanted in (None, "hybrid"):
        return F.lit(True)
    return F.col("class").isin(wanted, "hybrid")


def select_edges(edges: DataFrame, types: list[str] | None = None, edge_class: str | None = None) -> DataFrame:
    kept = edges.filter(class_matches(edge_class))
    return kept.filter(F.col("edge_type").isin(*types)) if types else kept


def fold_aliases(edges: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return edges.withColumn("edge_type", F.coalesce(F.try_element_at(table, F.col("edge_type")), "edge_type"))


def upsert(edges: DataFrame, order: str = "seq") -> DataFrame:
    """At most one edge for (src, dst, edge_type): the last written, whole."""
    last = Window.partitionBy("src", "dst", "edge_type").orderBy(F.desc(order))
    return edges.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes ``gone`` (node)."""
    left = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti")
    return left.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")


def link_edges(docs: DataFrame, weight: float = 1.0, bidirectional: bool = False, edge_type: str = "Link", edge_class: str = "structural") -> DataFrame:
    """Edges of the links in documents: path, links array<string> or array<struct<target,label>>."""
    target = F.col("l.target") if "target" in docs.select(F.explode("links").alias("l")).schema["l"].dataType.simpleString() else F.col("l")
    out = docs.select(F.col("path").alias("src"), F.explode("links").alias("l")).select("src", target.alias("dst"))
    if bidirectional:
        out = out.union(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return out.distinct().select("src", "dst", F.lit(edge_type).alias("edge_type"), F.lit(edge_class).alias("class"), F.lit(weight).alias("weight"))


def tag_frequencies(tagged: DataFrame) -> DataFrame:
    """tag, df, idf from (path, tags)."""
    pairs = tagged.select("path", F.explode(F.array_distinct("tags")).alias("tag"))
    n = tagged.select("path").distinct().count()  # one number
    return pairs.groupBy("tag").agg(F.count_distinct("path").alias("df")).withColumn("idf", F.log(F.lit(float(n)) / F.col("df")))


def tag_edges(tagged: DataFrame, weight: float = 1.0, max_frequency: int = 50) -> DataFrame:
    """Pairs of documents that share tags rare enough, weighted by the sum of the tags' idf.

    The pairs of a tag are bounded by max_frequency, so no tag makes more than its square of them.
    """
    rare = tag_frequencies(tagged).filter((F.col("df") <= max_frequency) & (F.col("df") > 1))
    pairs = tagged.select("path", F.explode(F.array_distinct("tags")).alias("tag")).join(rare, "tag")
    a, b = pairs.alias("a"), pairs.alias("b")
    met = a.join(b, (F.col("a.tag") == F.col("b.tag")) & (F.col("a.path") < F.col("b.path")))
    out = met.groupBy(F.col("a.path").alias("src"), F.col("b.path").alias("dst")).agg((F.sum("a.idf") * weight).alias("weight"))
    return out.filter("weight > 0").select("src", "dst", F.lit("related_tag").alias("edge_type"), F.lit("semantic").alias("class"), "weight")


# --- neighbours --------------------------------------------------------------------------------------------


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """src, dst, edge_type, weight, direction, as seen from src: out, in, or both."""
    cols = ["edge_type", "class", "weight"]
    out = edges.select("src", "dst", *cols, F.lit("out").alias("direction"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols, F.lit("in").alias("direction"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """src, dst, edge_type, weight: each neighbour and type once, with the largest weight."""
    return directed(edges, direction).groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight"))


def backlinks(edges: DataFrame) -> DataFrame:
    """node, edge_type, others: who points to a node."""
    return edges.groupBy(F.col("dst").alias("node"), "edge_type").agg(F.array_sort(F.collect_set("src")).alias("others"))


def forwardlinks(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node"), "edge_type").agg(F.array_sort(F.collect_set("dst")).alias("others"))


def in_degree(edges: DataFrame) -> DataFrame:
    return wide(edges.select(F.col("dst").alias("node")), "node").groupBy("node").agg(F.count("*").alias("in_degree"))


def dampener(degree: Column) -> Column:
    """A hub's share: 1 / sqrt(1 + in-degree / 10)."""
    return 1 / F.sqrt(1 + degree / 10)


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree of all nodes that have edges."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def affordances(edges: DataFrame) -> DataFrame:
    """node, direction, edge_type, n: what can be followed from a node. Documents edges count in both directions
    as one."""
    direction = F.when(F.col("edge_type") == "documents", F.lit("both")).otherwise(F.col("direction"))
    both = directed(edges, "both").select(F.col("src").alias("node"), direction.alias("direction"), "edge_type")
    return wide(both, "node").groupBy("node", "direction", "edge_type").agg(F.count("*").alias("n"))


def affordance_text(edges: DataFrame, most: int = 3) -> DataFrame:
    """node, edge_type, text: the leaf names of a node's targets, sorted, and how many more there are."""
    name = F.regexp_extract("dst", r"([^/>#:]+)\s*$", 1)
    named = edges.groupBy(F.col("src").alias("node"), "edge_type").agg(F.array_sort(F.collect_set(name)).alias("names"))
    more = F.size("names") - most
    text = F.concat(F.array_join(F.slice("names", 1, most), ", "), F.when(more > 0, F.format_string(" (suppressed %d)", more)).otherwise(F.lit("")))
    return named.select("node", "edge_type", text.alias("text"))


# --- traversal ---------------------------------------------------------------------------------------------


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None, edge_class: str | None = None, direction: str = "out") -> DataFrame:
    """seed, node, hops: the least number of hops to every node within depth; starts are not listed.

    seeds: (seed, node). A node reached is not entered again, so the work is that of one pass over the edges
    for each level.
    """
    hop = directed(select_edges(edges, types, edge_class), direction).select("src", "dst").distinct()
    hop = cut(hop) if depth > 1 else hop
    frontier = cut(seeds.select("seed", "node").distinct().withColumn("hops", F.lit(0)))
    levels = [frontier]
    for d in range(1, depth + 1):
        step = frontier.join(hop, frontier["node"] == hop["src"]).select("seed", F.col("dst").alias("node"), F.lit(d).alias("hops"))
        # new is what was not reached in fewer hops: one aggregation for both, distinct and the comparison
        frontier = reduce(DataFrame.unionByName, [*levels, step]).groupBy("seed", "node").agg(F.min("hops").alias("hops")).filter(F.col("hops") == d)
        if d < depth:
            frontier = cut(frontier)  # each level is computed once, of the one before
            if frontier.isEmpty():
                break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels[1:], frontier.filter("hops < 0"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 10, types: list[str] | None = None, edge_class: str | None = None) -> DataFrame:
    """source, target, path, hops of a shortest path for each (source, target); ties: the least path in order.

    The search from each source carries one path to each node, the least of those as short, and ends when all its
    targets are reached.
    """
    hop = cut(select_edges(edges, types, edge_class).select("src", "dst").distinct())
    wanted = cut(pairs.select("source", "target").distinct())
    frontier = cut(wanted.select(F.col("source").alias("seed"), F.col("source").alias("node")).distinct().withColumn("path", F.array("node")).withColumn("hops", F.lit(0)))
    levels, left = [frontier], wanted
    for d in range(1, depth + 1):
        ends = left.select(F.col("source").alias("seed")).distinct()
        step = frontier.join(ends, "seed", "left_semi").join(hop, frontier["node"] == hop["src"])
        step = step.groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.array_append("path", F.col("dst"))).alias("path"))
        seen = reduce(DataFrame.unionByName, levels).select("seed", "node")
        frontier = cut(step.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(d)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        left = left.join(frontier, (left["source"] == frontier["seed"]) & (left["target"] == frontier["node"]), "left_anti")
    found = reduce(DataFrame.unionByName, levels).withColumnsRenamed({"seed": "source", "node": "target"})
    return wanted.join(found, ["source", "target"])


def dfs(edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """seed, node, depth, place in the order of a depth-first walk with neighbours by name; nodes count as seen
    when they are pushed, so depth is that of discovery. Each start walks alone, in one task, over what BFS reaches
    from it, since the order of a walk can't be distributed; a walk of more than ``limit`` edges is refused, if one
    is given."""
    import pandas as pd

    reach = bfs(edges, seeds, depth).select("seed", "node").unionByName(seeds.select("seed", "node")).distinct()
    part = reach.join(edges.select("src", "dst").distinct(), reach["node"] == F.col("src")).select("seed", "src", "dst")
    roots = seeds.select("seed", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        if limit is not None and len(rows) > limit:
            raise ValueError(f"a depth-first walk over {len(rows)} edges; the limit is {limit}")
        seed = rows["seed"].iloc[0]
        out: dict[str, list[str]] = {}
        for a, b in zip(rows["src"], rows["dst"], strict=True):
            if b is not None and b == b:
                out.setdefault(a, []).append(b)
        start = rows.loc[rows["dst"].isna(), "src"].iloc[0]
        seen, stack, order = {start}, [(start, 0)], []
        while stack:
            node, d = stack.pop()
            if d:
                order.append((seed, node, d, len(order)))
            if d < depth:
                for n in sorted(out.get(node, []), reverse=True):
                    if n not in seen:
                        seen.add(n)
                        stack.append((n, d + 1))
        return pd.DataFrame(order, columns=["seed", "node", "depth", "place"])

    kind = edges.schema["src"].dataType.simpleString()
    seed_kind = seeds.schema["seed"].dataType.simpleString()
    return part.unionByName(roots).groupBy("seed").applyInPandas(walk, f"seed {seed_kind}, node {kind}, depth int, place int")


def lineage(edges: DataFrame, seeds: DataFrame, edge_type: str, direction: str = "out", depth: int = 5) -> DataFrame:
    """seed, node, hops along one type of edge (any letter case); row 0 is the start."""
    own = edges.filter(F.lower("edge_type") == edge_type.lower())
    return bfs(own, seeds, depth, direction=direction).unionByName(seeds.select("seed", "node", F.lit(0).alias("hops")))


def lineage_of(edges: DataFrame) -> DataFrame:
    """node with a sorted list for each lineage type and direction."""
    both = directed(edges.filter(F.col("edge_type").isin(*LINEAGE)), "both")
    columns = [
        F.array_sort(F.collect_set(F.when((F.col("edge_type") == t) & (F.col("direction") == d), F.col("dst")))).alias(t if d == "out" else f"{t}_by")
        for t in LINEAGE
        for d in ("out", "in")
    ]
    return both.groupBy(F.col("src").alias("node")).agg(*columns)


def related(edges: DataFrame, seeds: DataFrame, limit: int = 10, depth: int = 3) -> DataFrame:
    """query_id, rank, path, score: nodes near the seeds (query_id, node), by the sum of 1 / (hops x seeds)."""
    start = seeds.select(F.struct("query_id", "node").alias("seed"), "node")
    near = bfs(edges, start, depth).select("seed.query_id", "node", "hops")
    n = seeds.groupBy("query_id").agg(F.count_distinct("node").alias("n"))
    scored = near.join(n, "query_id").groupBy("query_id", F.col("node").alias("path")).agg(F.sum(1 / (F.col("hops") * F.col("n"))).alias("score"))
    own = seeds.select("query_id", F.col("node").alias("path"))
    from .fusion import ranked

    return ranked(scored.join(own, ["query_id", "path"], "left_anti"), limit)


# --- diffusion ---------------------------------------------------------------------------------------------


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.5, iterations: int = 2, edge_class: str | None = None, floor: float = 0.001) -> DataFrame:
    """seed, node, score after some steps of p' = (1 - alpha) diffuse(p) + alpha p0, over edges both ways.

    seeds: (seed, node, weight); weights below the floor are raised to it and each start sums to 1. Parallel
    edges count. A node without neighbours keeps its mass. Mass below 1e-9 is not passed on. Classes are
    compared by equality here, hybrid being no wildcard.
    """
    own = edges if edge_class is None else edges.filter(F.col("class") == edge_class)
    held = cut(own.select("src", "dst"))
    links = held.union(held.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    raised = seeds.groupBy("seed", "node").agg(F.greatest(F.max("weight"), F.lit(floor)).alias("w"))
    total = Window.partitionBy("seed")
    start = cut(raised.select("seed", "node", (F.col("w") / F.sum("w").over(total)).alias("p0")))
    p = start.withColumnRenamed("p0", "p")
    for _ in range(iterations):
        live = cut(p.filter("p >= 1e-9"))
        near = links.join(broadcast_if_small(live.select(F.col("node").alias("src")).distinct()), "src", "left_semi")
        degree = near.groupBy("src").agg(F.count("*").alias("degree"))
        met = live.join(near.join(degree, "src"), F.col("node") == F.col("src"), "left")
        share = F.when(F.col("dst").isNull(), F.col("p")).otherwise(F.col("p") / F.col("degree"))
        back = start.select("seed", "node", (alpha * F.col("p0")).alias("p"))
        spread = met.select("seed", F.coalesce("dst", "node").alias("node"), ((1 - alpha) * share).alias("p"))
        p = spread.unionByName(back).groupBy("seed", "node").agg(F.sum("p").alias("p"))
    return p.withColumnRenamed("p", "score")


# --- statistics --------------------------------------------------------------------------------------------


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """metric, name, value: nodes, edges, orphans, edges by type, the ten nodes of highest degree."""
    edges = cut(edges.select("src", "dst", "edge_type"))  # read five times below
    degree = degrees(edges).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    all_nodes = nodes.select("node").union(nodes_of(edges)).distinct()
    row = lambda metric: (F.lit(metric).alias("metric"), F.lit("").alias("name"), F.count("*").alias("value"))
    top = degree.orderBy(F.desc("degree"), "node").limit(10)
    return (
        all_nodes.select(*row("nodes"))
        .union(edges.select(*row("edges")))
        .union(all_nodes.join(degree, "node", "left_anti").select(*row("orphans")))
        .union(edges.groupBy("edge_type").agg(F.count("*").alias("value")).select(F.lit("edge_type"), "edge_type", "value"))
        .union(top.select(F.lit("degree"), F.col("node").cast("string"), "degree"))
    )


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("node").distinct().join(nodes_of(edges), "node", "left_anti")


def edge_types(edges: DataFrame, edge_class: str | None = None) -> DataFrame:
    return edges.filter(class_matches(edge_class)).select("edge_type").distinct()


def schema_of(edges: DataFrame, items: DataFrame) -> DataFrame:
    """The node labels and edge types around some items (node): one row of two sorted lists."""
    near = directed(edges, "both").join(items.select(F.col("node").alias("src")), "src", "left_semi")
    label = F.regexp_extract("dst", r"^([^:/]+)[:/]", 1)
    return near.agg(F.array_sort(F.collect_set(label)).alias("labels"), F.array_sort(F.collect_set("edge_type")).alias("edge_types"))


def cycles(edges: DataFrame, types: list[str] | None = None, longest: int = 5) -> DataFrame:
    """edge_type, cycle: each simple cycle of up to ``longest`` nodes once, from its least node on."""
    own = select_edges(edges, types).select("edge_type", "src", "dst").distinct()
    paths = own.filter("src <= dst").select("edge_type", F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("path"))
    found = paths.filter("start = at").select("edge_type", F.col("path").alias("cycle"))
    paths = paths.filter("start != at")
    for k in range(2, longest + 1):
        paths = paths.withColumn("path", F.array_append("path", F.col("at")))
        step = paths.alias("p").join(own.alias("e"), (F.col("p.edge_type") == F.col("e.edge_type")) & (F.col("p.at") == F.col("e.src")) & (F.col("e.dst") >= F.col("p.start")))
        step = step.select("p.edge_type", "p.start", F.col("e.dst").alias("at"), "p.path")
        found = found.union(step.filter("start = at").select("edge_type", F.col("path").alias("cycle")))
        if k < longest:
            paths = step.filter("start != at").filter(~F.array_contains("path", F.col("at")))
            if k % CUT_EVERY == 0:
                paths = cut(paths)
    return found.distinct()
