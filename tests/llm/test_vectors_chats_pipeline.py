"""Neighbours against brute force, chats against SQL and a round trip, the pipeline by its invariants."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataq.llm import ann, chat, queries

DATA = "/root/testdata/sf0.001"


def brute(rows: list[tuple[int, list[float]]], top: int = 10) -> dict[int, list[tuple[int, float]]]:
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != ids[i]][:top]
        out[int(ids[i])] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def test_neighbours_recall_and_scores(spark):
    draw = np.random.default_rng(7)
    rows = [(int(i), [float(v) for v in draw.normal(size=64).astype(np.float32)]) for i in range(3000)]
    found: dict[int, list] = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    wanted = brute(rows)
    assert set(found) == set(wanted) and all(len(v) == 10 for v in found.values())
    hits = sum(len({a for a, _ in found[q]} & {a for a, _ in wanted[q]}) for q in wanted)
    assert hits / (10 * len(wanted)) >= 0.9
    exact = {q: dict(brute(rows, 2999)[q]) for q in list(wanted)[:3]}
    for q in exact:
        assert all(exact[q][a] == s for a, s in found[q])


def test_neighbours_on_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (100, [0.5, 0.5]), (None, [1.0, 1.0]), (8, [1.0]), (2, [1.0, 0.0]), (9, [])]
    found = ann.nearest(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by == {0: [1, 2, 100], 100: [0, 1, 2]}


def test_no_neighbours_without_vectors(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


CHATS = [
    (1, 0, "system", "be <|brief|> <||| \\n"),
    (1, 1, "user", "héllo\n<|im_end|>\n"),
    (1, 2, "assistant", "<|im_start|>assistant\nok"),
    (2, 1, "assistant", "first"),
    (2, 0, None, None),
    (2, 1, "assistant", "first"),
    (3, None, "user", ""),
    (3, 5, "assistant", "😀<"),
    (None, 0, "user", "x"),
    (4, 0, "us\\er\nx|", "role with breaks"),
]


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame([(*r, "c") for r in CHATS], "conv_id long, turn long, role string, text string, segments string")


def test_chats_match_sql(spark, chats, tmp_path):
    chats.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    columns = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid"
    key = lambda r: tuple(str(x) for x in r)
    wanted = sorted((tuple(r) for r in con.execute(f"select {columns} from ({queries.OP4_SQL})").fetchall()), key=key)
    found = sorted((tuple(r) for r in queries.op4_chat(spark, str(tmp_path)).select(*columns.split(", ")).collect()), key=key)
    assert found == wanted


def test_chats_read_back_and_control_strings_stay_inside(chats):
    out = {r["conv_id"]: r for r in chat.format_chats(chats).withColumn("read", chat.read_turns(F.col("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["read"]] == [r[2:] for r in CHATS[:3]]
    assert [(t["role"], t["text"]) for t in out[4]["read"]] == [CHATS[9][2:]]
    assert out[1]["formatted"].count("<|im_start|>") == 3 and out[1]["formatted"].count("<|im_end|>") == 3
    assert out[1]["valid"] and out[3]["valid"] and not out[2]["valid"] and out[2]["bad_turn"] == 0
    assert "".join(s["text"] for s in out[3]["segments"] if s["loss"]) == "😀<"


def test_no_chats(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas())
        seen[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name in ("quality", "near_duplicates", "decontaminate"):
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty() and seen[name] <= before.count()
    assert seen["quality"] < 200 and seen["shard"] == seen["mix"]
    sizes = Counter(r["shard"] for r in docs.select("shard").collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_pipeline_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
