"""What a query reads and joins grows with its input: largest number of rows of a join, counted as Spark counts them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions import scale
from strataq.operators import catalog, community, graph, lexical, search
from strataq.plans.tables import Tables
from strataq.sources import files


def _most_rows(df: DataFrame, kind: str = "Join", metric: str = "numOutputRows") -> int:
    """Rows of the largest operator of a kind, after the table was collected."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        if kind in name and node.metrics().contains(metric):
            most = max(most, node.metrics().get(metric).get().value())
        left += [node.children().apply(k) for k in range(node.children().size())]
    return most


def _catalog(spark, n: int) -> tuple[DataFrame, DataFrame]:
    symbols = spark.range(n).select(F.lit("a.py").alias("path"), F.lit("run").alias("name"), F.concat(F.lit("Job"), F.col("id") % 2, F.lit(" > run")).alias("scope_path"), F.concat(F.lit("m "), "id").alias("moniker"), "id")
    return symbols, spark.range(n).select(F.col("id").alias("request_id"), F.when(F.col("id") % 2 == 0, "Job0 > run").otherwise("No > run").alias("scope"))


def test_snippet_states_of_many_equal_names(spark):
    symbols, asked = _catalog(spark, 400)
    states = catalog.snippet_states(symbols, asked)
    assert _most_rows(states) <= 1000  # 120,000 rows when each request met each symbol
    same = catalog.snippet_status(catalog.resolve_symbols(symbols, asked), asked)
    assert sorted(states.collect()) == sorted(same.collect())


def test_symbols_of_many_equal_requests(spark):
    symbols, asked = _catalog(spark, 400)
    found = catalog.resolved_counts(symbols, asked, "id")
    assert _most_rows(found) <= 1000
    rows = {r["request_id"]: (r["tier"], r["n"], r["first"]) for r in found.collect()}
    assert rows[0] == (1, 200, 0) and rows[1] == (3, 400, 0) and len(rows) == 400


def test_a_moniker_finds_its_own_symbol(spark):
    s = spark.createDataFrame([("a", "x", "A > x", "pkg x"), ("b", "x", "A > x", "pkg y"), ("c", "x", "B > x", None)], "path string, name string, scope_path string, moniker string")
    asked = spark.createDataFrame([(1, "pkg x"), (2, "A > x"), (3, None)], "request_id long, scope string")
    assert sorted((r["request_id"], r["path"], r["tier"]) for r in catalog.resolve_symbols(s, asked).collect()) == [(1, "a", 1), (2, "a", 1), (2, "b", 1)]


def test_symbol_at_meets_one_symbol(spark):
    results = spark.range(300).select((F.col("id") % 7).alias("query_id"), F.col("id").alias("rank"), F.lit("f").alias("path"), (F.col("id") % 90).alias("start_line"), (F.col("id") % 90 + 5).alias("end_line"))
    symbols = spark.range(300).select(F.lit("f").alias("path"), F.concat(F.lit("s"), "id").alias("name"), (F.col("id") * 7 % 50).alias("start_line"), (F.col("id") * 7 % 50 + F.col("id") % 13).alias("end_line"))
    found = search.symbol_at(results, symbols)
    assert _most_rows(found) <= 300  # 90,000 when each result met each symbol of its file
    every = [tuple(r) for r in symbols.select("start_line", "name", "end_line").collect()]
    for r in found.collect():
        best = min(every, key=lambda s: (not (s[0] <= r["end_line"] and s[2] >= r["start_line"]), s[0], s[1]))
        assert r["symbol"] == best[1]


def test_symbol_at_without_lines(spark):
    results = spark.createDataFrame([(1, 1, "f", None, None), (1, 2, "g", 1, 2), (1, 3, "f", 8, 9)], "query_id int, rank int, path string, start_line int, end_line int")
    symbols = spark.createDataFrame([("f", "b", None, None), ("f", "a", 3, 4)], "path string, name string, start_line int, end_line int")
    assert {r["rank"]: r["symbol"] for r in search.symbol_at(results, symbols).collect()} == {1: "a", 2: None, 3: "a"}


def test_calls_of_a_common_name(spark):
    calls = spark.range(300).select(F.concat(F.lit("c"), "id").alias("caller"), F.concat(F.lit("d/"), F.col("id"), F.lit(".py")).alias("caller_path"), F.lit(None).cast("string").alias("receiver"), F.lit("helper").alias("callee"))
    symbols = spark.range(100, 400).select(F.lit("helper").alias("name"), F.concat(F.lit("helper#"), "id").alias("scope_path"), F.concat(F.lit("d/"), F.col("id"), F.lit(".py")).alias("path"))
    done = catalog.resolve_calls(calls, symbols)
    assert _most_rows(done) <= 300  # 90,000 when each call met each candidate
    rows = {r["src"]: (r["dst"], r["confidence"]) for r in done.collect()}
    assert rows["c150"] == ("helper#150", "high") and rows["c5"] == ("helper#100", "medium") and len(rows) == 300


def test_a_title_keeps_what_no_semicolon_ends():
    name, _, body, _ = files.parse_html("<title>a &amp; b &lt;c&gt; d&amp</title><h1>e&amp;f</h1>")
    assert name == "a & b <c> d&amp" and body == "# e&f"


def _dealt(spark, monkeypatch, made) -> tuple[int, int]:
    """Partitions that a table of edges is grouped in, before and with a share of bytes that is exceeded; the same rows."""
    plain = made()
    rows = sorted(map(str, plain.collect()))
    monkeypatch.setattr(scale, "SHARE_BYTES", 4000)
    many = made()
    assert sorted(map(str, many.collect())) == rows
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (plain, many)]
    return tuple(sum("RepartitionByExpression" in line for line in p.splitlines()) for p in plans)


def test_modularity_is_dealt_by_size(spark, monkeypatch):
    e = lambda: Tables(spark, "/root/testdata/sf0.001").edges()
    made = lambda: community.modularity(e(), graph.nodes_of(e()).withColumn("community", F.regexp_extract("node", "^([a-z]+)", 1))).select(F.round("modularity", 9))
    before, after = _dealt(spark, monkeypatch, made)
    assert before == 0 and after >= 5


def test_affordances_are_dealt_by_size(spark, monkeypatch):
    assert _dealt(spark, monkeypatch, lambda: graph.affordances(Tables(spark, "/root/testdata/sf0.001").edges()))[1] == 5


def test_in_degrees_are_dealt_by_size(spark, monkeypatch):
    assert _dealt(spark, monkeypatch, lambda: graph.in_degree(Tables(spark, "/root/testdata/sf0.001").edges()))[1] == 3


def _passages(spark) -> tuple[DataFrame, DataFrame]:
    rows = [(f"d{k:03}", k % 3, f"t{k % 5}", "docs", None if k % 7 == 0 else "xyz"[k % 3], f"one w{k % 11} w{k % 4} w{k % 4} two") for k in range(300)]
    chunks = spark.createDataFrame(rows, "path string, chunk_index int, title string, modality string, corpus string, text string")
    return chunks, spark.createDataFrame([(1, "w1 w2 t3"), (2, "w3 w7"), (3, "none")], "query_id int, text string")


def test_best_chunks_of_each_corpus(spark):
    chunks, asked = _passages(spark)
    key = lambda r: (-round(r["score"], 9), r["path"], r["chunk_index"])
    every, best = {}, {}
    for found, into in ((lexical.bm25_scores(chunks, asked).join(chunks.select("path", "corpus"), "path"), every), (lexical.bm25_scores(chunks, asked, k=2, group="corpus"), best)):
        rows = found.collect()
        for r in rows:
            into.setdefault((r["query_id"], r["corpus"]), []).append(key(r))
    assert len(rows) <= 2 * 2 * 4 * 4  # queries, places, corpora, partitions: all 300 chunks and more before
    assert {k: sorted(v)[:2] for k, v in every.items()} == {k: sorted(v)[:2] for k, v in best.items()}


def test_an_index_that_is_not_stored_stays_with_its_chunks(spark):
    chunks, asked = _passages(spark)
    found = lexical.bm25_indexed(lexical.build_index(chunks, stored=False), asked, stored=False)
    moved = _most_rows(found, "Exchange", "shuffleRecordsWritten")
    assert moved <= 600  # a row for each field of a chunk; 1,800 postings before
    key = lambda df: sorted((r["query_id"], r["rank"], r["path"], round(r["score"], 9)) for r in df.collect())
    assert key(found) == key(lexical.bm25(chunks, asked))
