"""Workers unpack few rows of a batch at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from strataq.functions.batches import slices
from strataq.operators import chunk, lifecycle, vectors
from strataq.sources import files


@pytest.fixture
def mapped(spark, monkeypatch):
    """The functions that were given to mapInArrow."""
    kind, given = type(spark.range(1)), []
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, func, schema, *more: given.append(func) or own(self, func, schema, *more))
    return given


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["a" * 10, None, "b" * 99, "c", "d"])], ["n", "t"])
    cut = list(slices([batch.slice(0, 0), batch], 20))
    assert [s.column("n").to_pylist() for s in cut] == [[1, 2], [3], [4, 5]]


def _texts(n: int = 1000) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f"{k}" for k in range(n)]), pa.array([("word " * 19 + "end.\n") * 80 for _ in range(n)])], ["path", "text"])


def _bounded(run) -> None:
    made = list(run(iter([_texts()])))
    assert len(made) > 1 and max(b.nbytes for b in made) < 4 << 20  # 8 MB of text came as one batch
    assert len({b for batch in made for b in batch.column("path").to_pylist()}) == 1000


def test_fixed_chunks_of_a_large_batch(spark, mapped):
    chunk.chunk(spark.createDataFrame([("a", "b")], "path string, text string"), chunk.Settings(strategy="fixed"))
    _bounded(mapped[-1])


def test_line_groups_of_a_large_batch(spark, mapped):
    chunk.chunk(spark.createDataFrame([("a", "b")], "path string, text string"), chunk.Settings(strategy="semantic"))
    _bounded(mapped[-1])


def test_embedding_of_a_large_batch(spark, mapped):
    seen = []
    model = lifecycle.Embedder("m", 1, lambda texts: seen.append(sum(map(len, texts))) or np.zeros((len(texts), 1)))
    lifecycle.embed(spark.createDataFrame([("a", 0, "b")], "path string, chunk_index int, text string"), model)
    t = _texts()
    done = list(mapped[-1](iter([pa.RecordBatch.from_arrays([t.column(0), pa.array([0] * 1000, pa.int32()), t.column(1)], ["path", "chunk_index", "text"])])))
    assert sum(b.num_rows for b in done) == 1000 and max(seen) < 4 << 20


def test_dense_scores_of_a_large_batch(spark, mapped):
    rng = np.random.default_rng(1)
    asked = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(1000)], "query_id long, embedding array<double>")
    rows = spark.createDataFrame([("a", 0, True, "docs", [1.0] * 8)], "path string, chunk_index int, is_doc_level boolean, modality string, embedding array<double>")
    vectors.vector_topk(rows, asked)
    own = rng.normal(size=(4000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array([f"{k:04}" for k in range(4000)]), pa.array([0] * 4000, pa.int32()), pa.array(own.tolist(), pa.list_(pa.float64()))], ["path", "chunk_index", "embedding"])
    tracemalloc.start()
    made = pa.Table.from_batches(list(mapped[-1](iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.num_rows == 10_000 and peak < 48 << 20  # 4 million scores, several tables of them, before


def test_frontmatter_is_read_by_the_fast_loader(spark, mapped, monkeypatch):
    files.markdown(spark.createDataFrame([("a", "b")], "path string, text string"))
    monkeypatch.setattr(files.yaml, "safe_load", lambda raw: (_ for _ in ()).throw(files.yaml.YAMLError()))  # for what is broken only
    raw = ["a: [1, x]\nb: 2024-01-02", "a: [", None]
    batch = pa.RecordBatch.from_arrays([pa.array(["p", "q", "r"]), pa.array(["", "", ""]), pa.array(raw)], ["path", "text", "front"])
    done = list(mapped[-1](iter([batch])))
    assert [f for b in done for f in b.column("frontmatter").to_pylist()] == ['{"a": [1, "x"], "b": "2024-01-02"}', None, None]
