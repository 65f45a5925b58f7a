"""Fingerprints of code in four channels, and places over ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strataq.functions.scale import placed
from strataq.operators import channels

SOURCE = '''
class Ledger:
    def transfer_funds(self, account, amount) -> Receipt:
        if amount:
            return send(account)
        return amount
'''


def test_features_of_a_method():
    found = [r[1:4] for r in channels.symbol_features("a.py", SOURCE) if r[0] == "a.py#Ledger > transfer_funds"]
    assert {t for c, t, _ in found if c == channels.INTERFACE} == {"transfer_funds", "self", "account", "amount", "Receipt"}
    assert {t for c, t, _ in found if c == channels.CALLS} == {"send"}
    assert {t for c, t, _ in found if c == channels.FLOW} == {"flow:amount=>cond", "flow:account=>call(send)", "flow:account=>return", "flow:amount=>return"}
    assert ("FunctionDef->If") in {t for c, t, _ in found if c == channels.SHAPE}


def test_odd_sources_have_no_features():
    for text in (None, "", "def f(:", "x = 1", "\x00"):
        assert channels.symbol_features("a.py", text) == []


def test_a_query_is_nearer_to_what_it_names(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def parse_header(line):\n    return line.strip()\n"), ("c.py", None)], "path string, text string")
    prints = {r["id"]: r for r in channels.project(channels.code_features(files)).collect()}
    assert set(prints) == {"a.py#Ledger", "a.py#Ledger > transfer_funds", "b.py#parse_header"}
    queries = spark.createDataFrame([(1, "transfer funds"), (2, ""), (3, None)], "query_id int, text string")
    asked = {r["id"]: r for r in channels.project(channels.query_features(queries)).collect()}
    assert set(asked) == {1} and asked[1]["w2"] == asked[1]["w3"] == 0

    def apart(name: str) -> int:
        return sum(((asked[1][w] ^ prints[name][w]) & (1 << 64) - 1).bit_count() for w in ("w0",))

    assert apart("a.py#Ledger > transfer_funds") < apart("b.py#parse_header")


def test_words_are_sides_of_hyperplanes():
    planes = channels.hyperplanes(2)
    assert np.allclose(np.linalg.norm(planes, axis=1), 1)
    word = channels.word_of([("x", 2.0), ("y", 0.0)], 2) & (1 << 64) - 1
    assert [word >> h & 1 for h in range(64)] == [int(p @ channels.feature_vector("x", 2) > 0) for p in planes]
    assert channels.word_of([], 0) == 0


def test_places_over_ranges(spark):
    rows = [(k * 7919 % 101, k) for k in range(100)]
    found = placed(spark.createDataFrame(rows, "v int, k int").repartition(7), F.desc("v"), F.asc("k")).orderBy("place").collect()
    assert [(r["v"], r["k"]) for r in found] == sorted(rows, key=lambda r: (-r[0], r[1])) and [r["place"] for r in found] == list(range(100))
    assert placed(spark.createDataFrame([], "v int"), F.asc("v")).count() == 0
