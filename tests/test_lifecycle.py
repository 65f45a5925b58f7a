"""Corpora as stored tables."""

from __future__ import annotations

import shutil

import numpy as np
import pytest

from strataq.operators import search
from strataq.operators.chunk import Settings
from strataq.operators.fusion import ranked
from strataq.operators.lifecycle import Corpora, Embedder


def lengths(texts: list[str]) -> np.ndarray:
    return np.array([[len(t), t.count("a")] for t in texts], dtype=float)


def corpora(spark, root, name="m"):
    return Corpora(spark, str(root), Embedder(name, 2, lengths), Settings(strategy="fixed", target_tokens=8, min_tokens=1))


def files(spark, **texts):
    return spark.createDataFrame([(k, v) for k, v in texts.items()], "path string, text string")


def held(corpus, name="c"):
    t = corpus.tables(name)
    texts = {r["path"]: r["text"] for r in t["files"].collect()}
    chunks = sorted((r["path"], r["chunk_index"], r["text"]) for r in t["chunks"].collect())
    vectors = sorted((r["path"], r["chunk_index"], r["embedding"][0], r["model"]) for r in t["vectors"].filter("not is_doc_level").collect())
    assert [(p, i, float(len(x))) for p, i, x in chunks] == [v[:3] for v in vectors]
    return texts, {v[3] for v in vectors}


def test_delta_full_and_reembed(spark, tmp_path):
    corpus = corpora(spark, tmp_path)
    first = corpus.sync("c", files(spark, a="a" * 70, b="banana bread", c="gone"))
    assert {tuple(r) for r in first.collect()} == {("a", "new"), ("b", "new"), ("c", "new")}
    assert held(corpus)[0] == {"a": "a" * 70, "b": "banana bread", "c": "gone"}
    change = corpus.sync("c", files(spark, a="a" * 70, b="changed", d="new one"))
    assert {tuple(r) for r in change.collect()} == {("b", "modified"), ("c", "deleted"), ("d", "new")}
    assert held(corpus) == ({"a": "a" * 70, "b": "changed", "d": "new one"}, {"m"})
    other = corpora(spark, tmp_path, "n")
    assert other.sync("c", files(spark, a="a" * 70, b="again", d="new one"), "reembed").count() == 1
    assert held(other) == ({"a": "a" * 70, "b": "again", "d": "new one"}, {"n"})
    other.sync("c", files(spark, a="x"), "full")
    assert held(other) == ({"a": "x"}, set())  # too short for a chunk, and the old vectors are gone
    other.sync("c", files(spark, a="x").limit(0))
    assert held(other) == ({}, set())
    other.sync("c", files(spark, a="back", e="").unionByName(spark.createDataFrame([("f", None)], "path string, text string")))
    assert held(other)[0] == {"a": "back", "e": "", "f": None}


def test_a_broken_step_is_not_read(spark, tmp_path):
    corpus = corpora(spark, tmp_path)
    corpus.sync("c", files(spark, a="first text"))
    corpus.sync("c", files(spark, a="second text"))
    shutil.rmtree(tmp_path / "corpus=c" / "step-00000002" / "manifest")
    assert held(corpus)[0] == {"a": "first text"}
    corpus.sync("c", files(spark, a="third text"))
    assert held(corpus)[0] == {"a": "third text"}


def test_names_and_unload(spark, tmp_path):
    corpus = corpora(spark, tmp_path / "x")
    assert corpus.names() == []
    corpus.sync("one", files(spark, a="text"))
    corpus.sync("two", files(spark, a="text"))
    assert corpus.names() == ["one", "two"]
    corpus.unload("one")
    assert corpus.names() == ["two"]
    with pytest.raises(KeyError):
        corpus.tables("one")
    with pytest.raises(ValueError):
        corpus.sync("two", files(spark, a="x"), "sideways")


def test_an_algorithm_can_be_added(spark):
    rows = [("a.md", 0, "t", "alpha beta", "docs"), ("b.md", 0, "t", "beta", "docs")]
    chunks = spark.createDataFrame(rows, "path string, chunk_index int, title string, text string, modality string")
    edges = spark.createDataFrame([], "src string, dst string, edge_type string, class string, weight double")
    queries = spark.createDataFrame([(1, "beta")], "query_id int, text string")
    search.ALGORITHMS["by_name"] = lambda corpus, q, n: ranked(q.crossJoin(corpus.chunks.selectExpr("path", "1.0 AS score")).select("query_id", "path", "score"), n)
    try:
        assert [r["path"] for r in search.algorithm("by_name", search.Corpus(chunks, edges), queries, 1).collect()] == ["a.md"]
        assert [r["path"] for r in search.isolated("bm25", search.Corpus(chunks, edges), queries).collect()] == ["b.md", "a.md"]
    finally:
        del search.ALGORITHMS["by_name"]
    with pytest.raises(ValueError):
        search.algorithm("by_name", search.Corpus(chunks, edges), queries)
