"""Fingerprints of code in four channels of 64 bits: interface, calls, data flow, and the shape of the syntax.

A channel's features are summed as vectors made from digests, and each of 64 hyperplanes gives a bit: the side on which
the sum lies. Queries are plain words, so they fill the first two channels only, and only those are compared.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions.text import split_identifier
from strataq.functions.vector import WORDS
from strataq.sources.code import MAX_FILE_BYTES

SIDE = 64
INTERFACE, CALLS, FLOW, SHAPE = range(WORDS)
#: Weights of a symbol's name, parameters and result, what is taken off for a part of one of them, the
#: share that a part of a callee or of a query's word has, and how deep the syntax is followed.
NAME, PARAMETER, RESULT, PART_LESS, PART_SHARE, DEEPEST = 1.0, 0.85, 0.80, 0.1, 0.8, 32


def _unit(raw: bytes, pick: np.ndarray) -> np.ndarray:
    v = np.frombuffer(raw, np.uint8)[pick] / 127.5 - 1.0
    return v / np.linalg.norm(v)


@cache
def hyperplanes(channel: int) -> np.ndarray:
    """64 rows of unit length, each of the bytes of a digest in another order; the same on every machine."""
    places = np.arange(SIDE)
    return np.stack([_unit(hashlib.sha256(f"channel {channel} row {h}".encode()).digest(), (places * 7 + h * 3) % 32) for h in range(SIDE)])


@lru_cache(maxsize=50_000)
def feature_vector(text: str, channel: int) -> np.ndarray:
    raw = b"".join(hashlib.sha256(f"{channel}\x00{text}\x00{k}".encode()).digest() for k in range(2))
    return _unit(raw, np.arange(SIDE))


def word_of(features: list[tuple[str, float]], channel: int) -> int:
    """64 bits of the features (text, weight) of one channel, as a signed number; none give 0."""
    total = sum((w * feature_vector(t, channel) for t, w in features if w > 0), np.zeros(SIDE))
    bits = hyperplanes(channel) @ total > 0
    return int(np.packbits(bits, bitorder="little").view("<i8")[0]) if total.any() else 0


def project(features: DataFrame) -> DataFrame:
    """id, w0..w3 of (id, channel, text, weight). Weights of equal features are summed before they are hashed, so what
    meets in a row are the different features of one symbol."""
    summed = features.groupBy("id", "channel", "text").agg(F.sum("weight").alias("weight"))
    kind = dict(features.dtypes)["id"]
    each = summed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("channel", "text", "weight"))).alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.zeros((batch.num_rows, WORDS), np.int64)
            for k, row in enumerate(batch.column(1).to_pylist()):
                for c in {f["channel"] for f in row}:
                    words[k, c] = word_of([(f["text"], f["weight"]) for f in row if f["channel"] == c], c)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(words[:, k]) for k in range(WORDS)]], ["id", *[f"w{k}" for k in range(WORDS)]])

    return each.mapInArrow(run, f"id {kind}, " + ", ".join(f"w{k} long" for k in range(WORDS)))


def _word_features(word: Column, weight: Column, part_weight: Column) -> Column:
    """A word and, if it is made of several, its parts."""
    low = F.lower(word)
    parts = F.filter(split_identifier(word), lambda p: p != low)
    whole = F.array(F.struct(low.alias("text"), weight.alias("weight")))
    return F.concat(whole, F.transform(parts, lambda p: F.struct(p.alias("text"), part_weight.alias("weight"))))


def query_features(queries: DataFrame) -> DataFrame:
    """Features of (query_id, text) for ``project``: words in the channels of interface and calls."""
    words = queries.select(F.col("query_id").alias("id"), F.explode(F.filter(F.split("text", r"[^\p{L}\p{N}_$]+"), lambda w: w != "")).alias("word"))
    each = words.select("id", F.explode(_word_features(F.col("word"), F.lit(1.0), F.lit(PART_SHARE))).alias("f"))
    return each.select("id", F.explode(F.array(F.lit(INTERFACE), F.lit(CALLS))).alias("channel"), "f.text", "f.weight")


class _Flows(ast.NodeVisitor):
    """Calls by depth, uses of parameters, and pairs of a node and a child."""

    def __init__(self, parameters: set[str]):
        self.parameters, self.depth, self.rows = parameters, 0, []

    def _used(self, node: ast.AST | None, sink: str) -> None:
        for n in ast.walk(node) if node is not None else ():
            if isinstance(n, ast.Name) and n.id in self.parameters:
                self.rows.append((FLOW, f"flow:{n.id}=>{sink}", 1.0))

    def visit(self, node: ast.AST) -> None:
        kind = type(node).__name__
        if isinstance(node, ast.Call):
            callee = ast.unparse(node.func).split(".")[-1]
            self.rows.append((CALLS, callee, 1 / (1 + self.depth) ** 0.5))
            for a in [*node.args, *(k.value for k in node.keywords)]:
                self._used(a, f"call({callee})")
        elif isinstance(node, ast.Return):
            self._used(node.value, "return")
        elif isinstance(node, ast.If | ast.While | ast.IfExp):
            self._used(node.test, "cond")
        if self.depth < DEEPEST:
            self.depth += 1
            for child in ast.iter_child_nodes(node):
                if not isinstance(child, ast.expr_context | ast.operator | ast.cmpop | ast.boolop | ast.unaryop):
                    self.rows.append((SHAPE, f"{kind}->{type(child).__name__}", 1 / self.depth**0.5))
                    self.visit(child)
            self.depth -= 1


def symbol_features(path: str, text: str | None) -> list[tuple[str, int, str, float, float]]:
    """(id, channel, text, weight, weight of a part) of each function and class of a Python file; nothing of what
    doesn't parse."""
    if not text or len(text.encode()) > MAX_FILE_BYTES:
        return []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple[str, int, str, float, float]] = []

    def walk(node: ast.AST, scope: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                own = [*scope, child.name]
                name = f"{path}#{' > '.join(own)}"
                out.append((name, INTERFACE, child.name, NAME, NAME - PART_LESS))
                parameters = [a.arg for a in child.args.args] if not isinstance(child, ast.ClassDef) else []
                out.extend((name, INTERFACE, p, PARAMETER, PARAMETER - PART_LESS) for p in parameters)
                result = getattr(child, "returns", None)
                if result is not None:
                    out.append((name, INTERFACE, ast.unparse(result), RESULT, RESULT - PART_LESS))
                flows = _Flows(set(parameters))
                flows.visit(child)
                out.extend((name, c, t, w, w * PART_SHARE if c == CALLS else 0.0) for c, t, w in flows.rows)
                walk(child, own)
            else:
                walk(child, scope)

    walk(tree, [])
    return out


def code_features(files: DataFrame) -> DataFrame:
    """Features of the symbols of Python files (path, text) for ``project``; ids are ``path#scope``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in symbol_features(p, t)]
            columns = [*zip(*rows, strict=True)] or [[], [], [], [], []]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "channel", "text", "weight", "part"])

    found = files.select("path", "text").mapInArrow(run, "id string, channel int, text string, weight double, part double")
    words = found.filter(F.col("part") > 0).select("id", "channel", F.explode(_word_features(F.col("text"), F.col("weight"), F.col("part"))).alias("f")).select("id", "channel", "f.text", "f.weight")
    return words.unionByName(found.filter(F.col("part") == 0).select("id", "channel", "text", "weight"))
