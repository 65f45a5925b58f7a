"""Graphs for display: what to show within a budget, where groups lie, a relaxed layout, and its binary form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.scale import broadcast_if_small

from .graph import degrees

GOLDEN = math.pi * (3 - math.sqrt(5))
#: A corpus shows at least so many nodes, if the whole budget allows.
LEAST_NODES = 500


def overview(nodes: DataFrame, edges: DataFrame, budget: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(corpus, node, degree, place) of the nodes shown, and the edges between them.

    nodes: corpus, node; edges: corpus, src, dst, ... The budget is shared by the corpora's sizes, each getting
    LEAST_NODES at least; in a corpus the nodes of highest degree are shown, ties by name.
    """
    key = lambda c: F.struct("corpus", F.col(c).alias("node")).alias(c)
    own = nodes.select("corpus", "node").distinct()
    sizes = own.groupBy("corpus").agg(F.count("*").alias("n"))
    everything = sizes.agg(F.sum("n").alias("all"))  # one row
    share = F.round(budget * F.col("n") / F.col("all"))
    shares = sizes.crossJoin(everything).select("corpus", F.least(F.lit(budget), F.greatest(F.lit(min(LEAST_NODES, budget)), share)).cast("long").alias("most"))
    linked = degrees(edges.select(key("src"), key("dst"))).select("node.corpus", F.col("node.node").alias("node"), (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    ranked = own.join(linked, ["corpus", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = Window.partitionBy("corpus").orderBy(F.desc("degree"), "node")
    # at most ``budget`` rows of each corpus leave the first pass: row_number under a literal bound is cut in the map side
    shown = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= budget)
    shown = shown.join(broadcast_if_small(shares), "corpus").filter(F.col("place") <= F.col("most")).drop("most")
    a, b = (shown.select("corpus", F.col("node").alias(c)) for c in ("src", "dst"))
    return shown, edges.join(a, ["corpus", "src"], "left_semi").join(b, ["corpus", "dst"], "left_semi")


def spiral(k: Column, n: Column) -> tuple[Column, Column, Column]:
    """The k-th of n points spread evenly over a sphere, k from 0."""
    y = 1 - 2 * (k + 0.5) / n
    ring, turn = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y)), k * F.lit(GOLDEN)
    return F.cos(turn) * ring, y, F.sin(turn) * ring


def anchors(shown: DataFrame, group: str, radius: float = 100.0) -> DataFrame:
    """``shown`` (corpus, node, ``group``) with x, y, z: groups lie on a sphere, members around their group's place.

    A group takes room with the cube root of its size. Rows are bounded by the overview's budget.
    """
    groups = shown.groupBy("corpus", group).agg(F.count("*").alias("m"))
    first = Window.partitionBy("corpus").orderBy(group)
    placed = groups.withColumn("k", F.row_number().over(first) - 1).join(groups.groupBy("corpus").agg(F.count("*").alias("of")), "corpus")
    centre = [(radius * c).alias(f"c{axis}") for c, axis in zip(spiral(F.col("k"), F.col("of")), "xyz", strict=True)]
    placed = placed.select("corpus", F.col(group).alias("_group"), "m", *centre)
    inside = Window.partitionBy("corpus", group).orderBy("node")
    met = shown.withColumn("r", F.row_number().over(inside) - 1).withColumnRenamed("corpus", "_corpus")
    met = met.join(placed, (F.col("_corpus") == F.col("corpus")) & F.col(group).eqNullSafe(F.col("_group")))
    reach = (F.cbrt(F.col("m")) * 20 + 22) * F.cbrt((F.col("r") + 0.5) / F.col("m"))
    own = dict(zip("xyz", spiral(F.col("r"), F.col("m")), strict=True))
    return met.select("corpus", *[c for c in shown.columns if c != "corpus"], *[(F.col(f"c{a}") + reach * own[a]).alias(a) for a in "xyz"])


def relax(placed: DataFrame, edges: DataFrame, steps: int = 40, block: int = 512) -> DataFrame:
    """corpus, node, x, y, z after some steps of repulsion, springs along edges, and a pull to the anchors.

    placed: corpus, node, x, y, z, within the overview's budget, so a corpus fits into a task; all pairs repel,
    in blocks. A corpus without edges only spreads.
    """

    def run(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node").reset_index(drop=True)
        home = nodes[["x", "y", "z"]].to_numpy(dtype=np.float64)
        at = home.copy()
        number = pd.Series(np.arange(len(nodes)), index=nodes["node"])
        links = links[links["src"].isin(number.index) & links["dst"].isin(number.index)]
        a, b = number[links["src"]].to_numpy(), number[links["dst"]].to_numpy()
        for step in range(steps):
            force = 0.05 * (home - at)
            for first in range(0, len(at), block):
                apart = at[first : first + block, None, :] - at[None, :, :]
                force[first : first + block] += (apart * (60.0 / ((apart**2).sum(axis=2) + 1.0))[:, :, None]).sum(axis=1) / max(1, len(at))
            pull = 0.02 * (at[b] - at[a])
            np.add.at(force, a, pull)
            np.add.at(force, b, -pull)
            length = np.linalg.norm(force, axis=1, keepdims=True)
            heat = 10.0 * (1 - step / steps)
            at += force * np.minimum(1.0, heat / np.maximum(length, 1e-9))
        return pd.DataFrame({"corpus": nodes["corpus"], "node": nodes["node"], "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]})

    left = placed.select("corpus", "node", "x", "y", "z").groupBy("corpus")
    return left.cogroup(edges.select("corpus", "src", "dst").groupBy("corpus")).applyInPandas(run, "corpus string, node string, x double, y double, z double")


# Fixed values of the binary form: magic number, version, and the records of nodes and edges, little-endian.
MAGIC, VERSION = 0x43545856, 2
NODE = np.dtype([("id", "<u4"), ("at", "<f4", 3), ("community", "<u2"), ("degree", "<u2"), ("color", "<u4"), ("size", "<f4"), ("type", "<u2"), ("path", "<u2")])
EDGE = np.dtype([("source", "<u4"), ("target", "<u4"), ("type", "<u2"), ("weight", "<u2"), ("class", "u1"), ("confidence", "u1"), ("free", "<u2")])


def encode(nodes: pd.DataFrame, edges: pd.DataFrame) -> bytes:
    """The binary form of one collected overview, whose size its budget bounds.

    nodes: x, y, z, community, degree, color, size, type, path; edges: source, target (places in nodes), type,
    weight, class, confidence. Weights are held in thousandths, from 0 to 10; strings in a table of their own,
    by 16-bit numbers, so more than 65,536 different ones are refused.
    """
    names, first = pd.factorize(pd.concat([nodes["type"], nodes["path"], edges["type"]], ignore_index=True))
    if len(first) > 1 << 16:
        raise ValueError("too many different strings for the binary form")
    n = len(nodes)
    packed = np.zeros(n, dtype=NODE)
    packed["id"], packed["at"] = np.arange(n), nodes[["x", "y", "z"]].to_numpy()
    for column in ("community", "degree", "color", "size"):
        packed[column] = nodes[column].to_numpy()
    packed["type"], packed["path"] = names[:n], names[n : 2 * n]
    lines = np.zeros(len(edges), dtype=EDGE)
    for column in ("source", "target", "class", "confidence"):
        lines[column] = edges[column].to_numpy()
    lines["type"], lines["weight"] = names[2 * n :], edges["weight"].clip(0, 10).to_numpy() * 1000
    header = np.array([MAGIC, VERSION, n, len(edges)], dtype="<u4")
    table = b"".join(len(raw).to_bytes(2, "little") + raw for raw in (s.encode() for s in first))
    return header.tobytes() + packed.tobytes() + lines.tobytes() + len(first).to_bytes(4, "little") + table
