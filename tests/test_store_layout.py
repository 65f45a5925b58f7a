"""Stored indexes, code intelligence indexes, layouts and short text, on small tables with known answers."""

from __future__ import annotations

import math

import pandas as pd
import pytest

from strataq.functions.lean import lean_search
from strataq.operators import analytics, catalog, layout, lexical, search
from strataq.sources import scip, store

CHUNKS = "path string, chunk_index int, title string, text string, modality string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a.md", 0, "Red", "red fish swim", "docs"), ("a.md", 1, "Red", "blue birds fly", "docs"), ("b.py", 0, "Blue", "red red birds", "code"), ("c.md", 0, None, None, "docs")]
    return spark.createDataFrame(rows, CHUNKS)


def test_stored_index_ranks_as_the_scan(spark, chunks, tmp_path):
    asked = spark.createDataFrame([(0, "red birds"), (1, "nothing"), (2, "")], "query_id long, text string")
    folder = str(tmp_path / "index")
    store.export(lexical.build_index(chunks), folder, "words", 0)
    key = lambda df: [(r["query_id"], r["rank"], r["path"], r["chunk_index"], round(r["score"], 9)) for r in df.orderBy("query_id", "rank").collect()]
    stored = key(lexical.bm25_indexed(store.load(spark, folder, "words"), asked))
    assert stored == key(lexical.bm25(chunks, asked)) and stored
    plan = lexical.bm25_indexed(store.load(spark, folder), asked)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(term" in plan


def test_a_bundle_of_another_kind_is_refused(spark, chunks, tmp_path):
    folder = str(tmp_path / "bundle")
    made = store.export({"chunks": chunks}, folder, "m", 64)
    assert made == store.manifest_of(spark, folder)
    assert store.load(spark, folder, "m", 64)["chunks"].count() == 4
    for wrong in ({"model": "other"}, {"dims": 32}):
        with pytest.raises(ValueError):
            store.load(spark, folder, **wrong)
    store.export({"chunks": chunks}, str(tmp_path / "old"), graph_version=2)
    with pytest.raises(ValueError, match="graph_version"):
        store.load(spark, str(tmp_path / "old"))


def test_fingerprints_are_replaced_by_id(spark):
    ids = spark.createDataFrame([("p", None, None, "code"), ("p", 0, None, "docs"), ("p", 0, None, "code"), ("p", 2, None, "docs"), ("p", 2, "A > b", "code")], "path string, chunk int, scope string, modality string")
    said = [r[0] for r in ids.select(store.print_id(ids["path"], ids["chunk"], ids["scope"], ids["modality"])).collect()]
    assert said == ["p", "p", "p:chunk:0", "p:chunk:2", "p#A > b"]
    held = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, w0 long")
    new = spark.createDataFrame([("b", 7, 1), ("b", 8, 2), ("c", 9, 1), (None, 4, 1)], "id string, w0 long, seq long")
    assert {(r["id"], r["w0"]) for r in store.upsert_prints(held, new).collect()} == {("a", 1), ("b", 8), ("c", 9), (None, 4)}


def test_projected_texts_come_first(spark):
    files = spark.createDataFrame([("a.pdf", "raw", 1), ("b.md", "own", 2), (None, None, 3)], "path string, text string, size int")
    texts = spark.createDataFrame([("a.pdf", "read"), ("a.pdf", "read")], "path string, projection_text string")
    assert {(r["text"], r["size"]) for r in store.projected(files, texts).collect()} == {("read", 1), ("own", 2), (None, 3)}


def message(*parts: tuple[int, int | bytes]) -> bytes:
    out = b""
    for number, value in parts:
        out += bytes([number << 3]) + bytes([value]) if isinstance(value, int) else bytes([number << 3 | 2, len(value)]) + value
    return out


def test_code_index_to_edges(spark):
    define = message((1, bytes([10, 0, 4])), (2, b"pkg f()."), (3, 1), (7, bytes([10, 0, 20, 1])))
    use = message((1, bytes([15, 4, 9])), (2, b"pkg g()."), (3, 0))
    local = message((1, bytes([16, 4, 9])), (2, b"local 1"))
    index = message((1, b""), (2, message((1, b"src/a.py"), (2, define), (2, use), (2, local))))
    files = spark.createDataFrame([("i.scip", bytearray(index)), ("broken", bytearray(b"\xff\xff")), ("none", None)], "path string, content binary")
    rows = scip.read_indexes(files)
    assert {(r["symbol"], r["start"], r["end"], r["is_definition"]) for r in rows.collect()} == {("pkg f().", 10, 20, True), ("pkg g().", 15, 15, False), ("local 1", 16, 16, False)}
    edges = {(r["src"], r["dst"], r["edge_type"], r["weight"]) for r in catalog.occurrence_edges(rows).collect()}
    assert edges == {("src/a.py", "pkg f().", "defines", 1.0), ("pkg f().", "pkg g().", "calls", 0.8)}


@pytest.fixture(scope="module")
def graphs(spark):
    nodes = spark.createDataFrame([("x", f"n{k}") for k in range(6)] + [("y", "m0"), ("y", "m1")], "corpus string, node string")
    links = [("x", f"n{k}", "n0") for k in range(1, 6)] + [("x", "n2", "n1"), ("y", "m0", "m1")]
    return nodes, spark.createDataFrame(links, "corpus string, src string, dst string")


def test_overview_keeps_the_best_connected(graphs):
    shown, links = layout.overview(*graphs, budget=3)
    # the floor is the budget here, so each corpus may show three
    assert {(r["corpus"], r["node"], r["degree"]) for r in shown.collect()} == {("x", "n0", 5), ("x", "n1", 2), ("x", "n2", 2), ("y", "m0", 1), ("y", "m1", 1)}
    assert {(r["src"], r["dst"]) for r in links.collect()} == {("n1", "n0"), ("n2", "n0"), ("n2", "n1"), ("m0", "m1")}


def test_anchors_and_relaxed_places(graphs):
    shown, links = layout.overview(*graphs)
    placed = layout.anchors(shown.withColumn("group", shown["degree"] > 1), "group")
    rows = placed.collect()
    assert len(rows) == 8 and all(math.isfinite(r[a]) for r in rows for a in "xyz")
    assert len({(r["x"], r["y"], r["z"]) for r in rows}) == 8
    moved, again = (sorted(map(tuple, layout.relax(placed, links, steps=5).collect())) for _ in range(2))
    assert moved == again and len(moved) == 8 and all(math.isfinite(v) for r in moved for v in r[2:])


def test_binary_form():
    nodes = pd.DataFrame({"x": [0.0, 1.0], "y": 0.0, "z": 2.0, "community": 3, "degree": 1, "color": 0xFF00FF, "size": 1.5, "type": "doc", "path": ["a.md", "b.md"]})
    edges = pd.DataFrame({"source": [0], "target": [1], "type": ["Link"], "weight": [99.0], "class": 0, "confidence": 2})
    raw = layout.encode(nodes, edges)
    assert raw[:4] == (0x43545856).to_bytes(4, "little") and len(raw) == 16 + 2 * 32 + 16 + 4 + sum(2 + len(s) for s in ("doc", "a.md", "b.md", "Link"))
    assert int.from_bytes(raw[16 + 64 + 10 : 16 + 64 + 12], "little") == 10_000


def test_short_text(spark):
    hits = spark.createDataFrame([(0, 1, "a.md", 0.5, "docs", "text"), (0, 2, "b.py", 0.25, "code", None)], "query_id int, rank int, path string, score double, modality string, snippet string")
    asked = spark.createDataFrame([(0, "red"), (1, None)], "query_id int, text string")
    said = {r["query_id"]: r["lean"] for r in lean_search(hits, asked, "fast").collect()}
    assert said[0].startswith('# Search: "red" [mode: fast, hits: 2]\n\n## Code hits (1)\n\n1. `b.py` [score: 0.250]\n')
    assert "## Document hits (1)\n\n1. `a.md` [score: 0.500]\n```\ntext\n```" in said[0] and said[1].endswith("No matching results found.\n")


def test_coverage_by_prefix_and_names(spark, chunks):
    files = spark.createDataFrame([("src/a.py",), ("src/b.py",), ("doc/c.md",)], "path string")
    parts = spark.createDataFrame([("src/a.py",), ("src/a.py",)], "path string")
    asked = spark.createDataFrame([("src/",), ("doc/c.md",), ("none",), ("src/",)], "path string")
    found = {r["path"]: (r["files"], r["chunks"], r["covered"]) for r in analytics.path_coverage(asked, files, parts, parts.limit(0)).collect()}
    assert found == {"src/": (2, 2, True), "doc/c.md": (1, 0, False), "none": (0, 0, False)}
    edges = spark.createDataFrame([("src/Router.rs", "src/main.rs", "calls", "code", 1.0)], "src string, dst string, edge_type string, class string, weight double")
    query = spark.createDataFrame([(0, "the router"), (1, "zz")], "query_id int, text string")
    best = search.name_pagerank(search.Corpus(chunks, edges), query).filter("rank = 1").collect()
    assert [(r["query_id"], r["path"]) for r in best] == [(0, "src/Router.rs")]
