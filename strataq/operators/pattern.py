"""Graph patterns: a small path language, matched over edge tables, and the impact of what matches.

    (a:Service {name:'auth'})-[:calls|imports*1..3]->(b)<-[:tests]-(t)

A node is ``(var:Label {key:'value'})``, all parts optional; an edge ``-[:types*m..n]->``, ``<-[..]-`` or ``-[..]-``,
short ``-->``, ``<--``, ``--``. ``*n`` is exact; a missing upper bound is OPEN_UPPER.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.scale import cut

from .graph import class_matches, neighbours

OPEN_UPPER, MOST_HOPS = 5, 5
#: A node with more neighbours is a hub: it shows the heaviest of them and is not expanded.
HUB, ANY_ANCHORS, LABEL_ANCHORS = 10, 100, 25

_NODE = re.compile(r"\(\s*(\w+)?\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)")
_EDGE = re.compile(r"(<)?-(?:\[\s*(?:\w+)?\s*(?::\s*([\w|:\s]+?))?\s*(\*\s*(\d+)?\s*(\.\.\s*(\d+)?)?)?\s*\])?-(>)?")
_PROPERTY = re.compile(r"(\w+)\s*:\s*(?:'([^']*)'|\"([^\"]*)\")")


@dataclass(frozen=True)
class Node:
    var: str | None = None
    label: str | None = None
    properties: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Step:
    types: tuple[str, ...]
    direction: str
    low: int
    high: int
    to: Node


@dataclass(frozen=True)
class Pattern:
    start: Node
    steps: tuple[Step, ...]


def parse(text: str) -> Pattern:
    """The pattern that a text says; ValueError tells where it stops making sense."""
    at = 0

    def node() -> Node:
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1
        m = _NODE.match(text, at)
        if not m:
            raise ValueError(f"a node was expected at {at}: {text[at : at + 20]!r}")
        at = m.end()
        return Node(m[1], m[2], {k: a or b for k, a, b in _PROPERTY.findall(m[3] or "")})

    start, steps = node(), []
    while text[at:].strip():
        while text[at].isspace():
            at += 1
        m = _EDGE.match(text, at)
        if not m or (m[1] and m[7]):
            raise ValueError(f"an edge was expected at {at}: {text[at : at + 20]!r}")
        at = m.end()
        low = high = 1
        if m[3]:
            low = int(m[4]) if m[4] else 1
            high = (int(m[6]) if m[6] else OPEN_UPPER) if m[5] else (low if m[4] else OPEN_UPPER)
        if low > high:
            raise ValueError(f"hops {low}..{high} are none")
        types = tuple(t.strip(" :") for t in (m[2] or "").split("|") if t.strip(" :"))
        steps.append(Step(types, "in" if m[1] else "out" if m[7] else "both", low, min(high, MOST_HOPS), node()))
    return Pattern(start, tuple(steps))


def where_terms(expression: str | None) -> list[tuple[bool, str]]:
    """(wanted, text) of ``contains 'x' and not contains 'y'``; words inside quotes are never connectives."""
    if not expression:
        return []
    return [(not m[1], (m[2] or m[3]).lower()) for m in re.finditer(r"(not\s+)?contains\s*\(?\s*(?:'([^']*)'|\"([^\"]*)\")", expression, re.IGNORECASE)]


def anchors(nodes: DataFrame, start: Node) -> DataFrame:
    """node of those the pattern may start from. nodes: node, title, label. A path names one node; a name is
    matched at the end; then a title; then a label's, or any, up to a limit in the order of names."""
    p = start.properties
    if "path" in p:
        return nodes.filter(F.col("node") == p["path"]).select("node")
    if "name" in p:
        return nodes.filter(F.col("node").endswith(p["name"])).select("node")
    if "title" in p:
        return nodes.filter(F.col("title") == p["title"]).select("node")
    if start.label:
        return nodes.filter(F.col("label") == start.label).select("node").orderBy("node").limit(LABEL_ANCHORS)
    return nodes.select("node").orderBy("node").limit(ANY_ANCHORS)


def match(edges: DataFrame, nodes: DataFrame, pattern: str | Pattern, edge_class: str | None = None, where: str | None = None, limit: int = 20) -> DataFrame:
    """anchor, hop, step, node, edge_type, path, is_hub, matched: a row for each node on a way that the pattern takes.

    limit bounds the anchors (1..100). A node never occurs twice on a way. A hub, a node with more than ten
    neighbours in a step, shows ten by weight and ends the way. Rows that only lead to matches are there with
    matched = false.
    """
    wanted = parse(pattern) if isinstance(pattern, str) else pattern
    limit = max(1, min(100, limit))
    starts = anchors(nodes, wanted.start).orderBy("node").limit(limit)
    own = edges.filter(class_matches(edge_class))
    ways = starts.select(F.col("node").alias("anchor"), F.col("node").alias("at"), F.array("node").alias("path"))
    rows = ways.select("anchor", F.lit(0).alias("hop"), F.lit(0).alias("step"), F.col("at").alias("node"), F.lit(None).cast("string").alias("edge_type"), "path", F.lit(False).alias("is_hub"), F.lit(not wanted.steps).alias("matched"))
    hop = 0
    for k, step in enumerate(wanted.steps, 1):
        typed = own.filter(F.col("edge_type").isin(*step.types)) if step.types else own
        near = neighbours(typed, step.direction)
        w = Window.partitionBy("src")
        near = near.withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("weight"), "dst", "edge_type")))
        near = near.filter(F.col("place") <= HUB).select("src", "dst", "edge_type", (F.col("n") > HUB).alias("is_hub"))
        reached = None
        for d in range(1, step.high + 1):
            hop += 1
            out = ways.join(near, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
            for yes, text in where_terms(where):
                held = F.lower(F.col("dst").cast("string")).contains(text)
                out = out.filter(held if yes else ~held)
            out = out.select("anchor", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), "edge_type", "is_hub")
            target = _target(step.to, F.col("at")) & F.lit(d >= step.low)
            rows = rows.unionByName(out.select("anchor", F.lit(hop).alias("hop"), F.lit(k).alias("step"), F.col("at").alias("node"), "edge_type", "path", "is_hub", (target & F.lit(k == len(wanted.steps))).alias("matched")))
            arrived = out.filter(target & ~F.col("is_hub")).select("anchor", "at", "path")
            reached = arrived if reached is None else reached.unionByName(arrived)
            ways = out.filter(~F.col("is_hub")).select("anchor", "at", "path")
        ways = cut(reached) if k < len(wanted.steps) and hop > 2 else reached
    good = rows.filter("matched").select("anchor", F.col("path").alias("whole"))
    # of ways that don't match keep those that lead to one
    lead = rows.filter(~F.col("matched")).alias("r").join(good.alias("g"), (F.col("r.anchor") == F.col("g.anchor")) & (F.size("g.whole") > F.size("r.path")) & (F.slice("g.whole", 1, F.size("r.path")) == F.col("r.path")), "left_semi")
    return rows.filter("matched").unionByName(lead)


def _target(node: Node, at: F.Column) -> F.Column:
    """Targets are held to path and to the end of the name; labels and titles don't bind there."""
    ok = F.lit(True)
    if "path" in node.properties:
        ok = ok & (at == node.properties["path"])
    if "name" in node.properties:
        ok = ok & at.endswith(node.properties["name"])
    return ok


def impact(found: DataFrame) -> DataFrame:
    """anchor, direct, transitive, files, max_depth, total of a match: first hops, distinct nodes further on,
    distinct files, the deepest hop, all rows."""
    file = F.regexp_replace(F.col("node").cast("string"), r"[#:].*$", "")
    later = F.col("hop") > 0
    return found.groupBy("anchor").agg(
        F.sum((F.col("hop") == 1).cast("long")).alias("direct"),
        F.count_distinct(F.when(F.col("hop") >= 2, F.col("node"))).alias("transitive"),
        F.count_distinct(F.when(later, file)).alias("files"),
        F.max("hop").alias("max_depth"),
        F.sum(later.cast("long")).alias("total"),
    )


def at_least(found: DataFrame, confidence: str) -> DataFrame:
    """Rows whose confidence reaches the threshold; null passes, an unknown threshold is medium."""
    level = {"high": 3, "medium": 2, "speculative": 1}
    own = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "speculative", 1).otherwise(2)
    return found.filter(F.col("confidence").isNull() | (own >= level.get(confidence, 2)))
