"""The operators on documents against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from strataq.llm import decontaminate, license, minhash, mix, quality, queries, shard, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, _kept long"
A = "the quick brown fox jumps over the lazy dog and then it runs through the forest until night comes down slowly"
ROWS = [
    (1, A, "en", "s1", 1, "x", 1),
    (2, A, "en", "s1", 1, "x", 1),
    (2, A, "en", "s1", 1, "x", 1),
    (3, A + " now", "en", "s2", 1, None, None),
    (4, "", "en", "s2", 1, "x", 1),
    (5, None, None, None, None, None, None),
    (None, "stray text without an id of any kind", "en", "s3", 1, "x", 1),
    (6, "word", "en", None, 1, "x", 1),
    (7, " ".join(f"w{i % 997}" for i in range(3_000)), "en", "s3", 1, "x", 1),
    (8, "Überall ÄÖ ß\tgroße  Wörter\n\nund mehr Released under the MIT License.", "de", "s1", 1, "x", 1),
    (9, "first line\nReleased under the MIT License.\nAll rights reserved.", "en", "s1", 1, "x", 1),
    (10, "LICENSED under the Apache License, version 2.0", "en", "s4", 1, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def closure(items: list[tuple[int | None, int]]) -> list[int | None]:
    """Component of each (id, fingerprint), by comparing all pairs."""
    root = list(range(len(items)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(items))]


def test_simhash_matches_brute_force(docs):
    found = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = [(r[0], fingerprint(r[1])) for r in ROWS]
    wanted = sorted((d or -1, f"{fp:016x}", c) for (d, fp), c in zip(prints, closure(prints), strict=True))
    assert found == wanted


def test_simhash_links_in_crowds(spark, monkeypatch):
    """Fingerprints around a few centres, so that buckets are larger than a block: no component is missed."""
    monkeypatch.setattr(simhash, "SMALL", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    draw = np.random.default_rng(1)
    values = set()
    for centre in draw.integers(0, 1 << 63, 6):
        for _ in range(60):
            values.add(int(centre) ^ sum(1 << int(b) for b in draw.choice(63, draw.integers(0, 5), replace=False)))  # all 64 bits: test_exact
    values = sorted(values)
    classes = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "fp long, first_id long")
    edges = simhash.links(classes)
    assert all((r["a"] ^ r["b"]).bit_count() <= 3 for r in edges.collect())
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups: dict[int, list[int]] = {}
    for v, c in zip(values, closure([(k, v) for k, v in enumerate(values)]), strict=True):
        groups.setdefault(c, []).append(v)
    for members in groups.values():
        assert len({found.get(v, v) for v in members}) == 1
    assert len({found.get(v, v) for v in values}) == len(groups)


def test_simhash_links_in_crowds_across_the_sign_bit(spark, monkeypatch):
    """A large bucket joined to one more fingerprint only by a link that differs in bit 63 and two more bits."""
    monkeypatch.setattr(simhash, "SMALL", 8)
    low, mask = int(np.random.default_rng(3).integers(0, 1 << 62)), (1 << 64) - 1
    plain = {low, *(low ^ 1 << b for b in (41, 42, 43, 44, 46, 47, 56, 57, 58, 59, 60, 61, 62))}  # in the segments of far's bits: all buckets are large
    far = low ^ (1 << 63 | 1 << 40 | 1 << 45)
    values = sorted(plain | {far})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v, k) for k, v in enumerate(signed)], "fp long, first_id long"))
    assert all(((r["a"] ^ r["b"]) & mask).bit_count() <= 3 for r in edges.collect())
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert len({found.get(v, v) for v in signed}) == 1


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {found[k] for k in range(41)} == {0}
    assert {found[k] for k in range(100, 120)} == {100}


def jaccard_groups(rows: list[tuple[int, str]]) -> set[int]:
    """The least id of each group joined over five-word Jaccard >= 0.8, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = {d: d for d, _ in rows}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((find(d), find(rows[j][0])))
                root[b] = a
    return {find(d) for d, _ in rows}


@pytest.mark.parametrize("small", [32, 4])
def test_keep_alike_links_at_four_fifths(spark, monkeypatch, small):
    """Copies with words changed, in pairs, chains and a crowd: what stays is what brute force keeps."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 1200)
    draw = np.random.default_rng(6)
    rows = []
    for copies in (12, *[3] * 12):
        base = [f"w{k}" for k in draw.integers(0, 4000, 90)]
        for _ in range(copies):
            words = list(base)
            for at in draw.integers(0, 90, draw.integers(0, 4)):
                words[at] = f"x{draw.integers(0, 10**6)}"
            rows.append((len(rows) + 1, " ".join(words)))
    docs = spark.createDataFrame([(d, t, "en", "s", 1, None, None) for d, t in rows], SCHEMA).repartition(3)
    assert {r["doc_id"] for r in simhash.keep_alike(docs).collect()} == jaccard_groups(rows)


def test_keep_alike_leaves_a_row_of_each_group(spark):
    """doc_id 5 has two texts; the second one's group, doc_id 7 with it, must not go with the first."""
    x, y = " ".join(f"x{k}" for k in range(30)), " ".join(f"y{k}" for k in range(30))
    rows = [(5, x), (5, y), (5, y), (6, x), (7, y), (8, ""), (9, " "), (9, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, None, None) for d, t in rows], SCHEMA).repartition(3)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_alike(docs).collect()) == [(5, x), (5, y), (8, "")]


def test_roots_are_those_of_components(spark):
    draw = np.random.default_rng(4)
    pairs = [tuple(map(int, p)) for p in draw.integers(-500, 500, (600, 2))] + [(7, 7), (None, 3)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    assert sorted(map(tuple, simhash._grouped(edges).collect())) == sorted(map(tuple, simhash.components(edges).collect()))


@pytest.mark.parametrize("few", [100_000, 0])
def test_keep_alike_goes_by_simhash(spark, monkeypatch, few):
    """Without the completion by MinHash, what fingerprints link and whole sets confirm is joined, and no more."""
    monkeypatch.setattr(simhash, "FEW", few, raising=False)
    draw = np.random.default_rng(8)
    base = [f"w{k}" for k in draw.integers(0, 4000, 400)]
    texts = [" ".join(base)]
    for at in range(40, 400, 45):  # one word changed: near fingerprints, and five of 396 shingles
        texts.append(" ".join([*base[:at], f"x{at}", *base[at + 1 :]]))
    texts += [texts[0].upper(), texts[1].replace(" ", "\n"), " ".join(f"y{k}" for k in draw.integers(0, 4000, 400))]
    texts += ["a b c " * 300 + "d", "a b c " * 5 + "d"]  # repeats weigh in a fingerprint, not in a set
    texts += ["p q r " * 300 + "p1 p2 p3 p4 p5 p6", "p q r " * 300 + "q1 q2 q3 q4 q5 q6"]
    rows = list(enumerate(texts, 1))
    docs = spark.createDataFrame([(d, t, "en", "s", 1, None, None) for d, t in rows], SCHEMA).repartition(3)
    prints = [(d, fingerprint(t)) for d, t in rows]
    near = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= 3]
    sets = {d: set(minhash.shingles(t.encode()).tolist()) for d, t in rows}
    alike = [(a, b) for a, b in near if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    assert 0 < len(alike) < len(near)
    monkeypatch.setattr(minhash, "links", lambda *_: spark.createDataFrame([], "a long, b long"))
    root = {d: d for d, _ in rows}
    for _ in rows:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"] for r in simhash.keep_alike(docs).collect()} == set(root.values())
    assert len(set(root.values())) < len(rows)


def test_mix_matches_sql_and_targets(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple(str(x) for x in r)
    wanted = sorted((tuple(r) for r in con.execute(f"select doc_id, size, source_size, target, taken from ({queries.OP2_SQL})").fetchall()), key=key)
    found = sorted((tuple(r) for r in queries.op2_mix(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect()), key=key)
    assert found == wanted
    assert all(taken <= 3 * size for _, size, _, _, taken in found)


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 50), (None, 500)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mix.source_targets(sizes).collect()}
    assert found["b"] == 30 and found["c"] == 150
    assert abs(found["a"] - found[None]) < 1e-9 and abs(sum(found.values()) - 1560) < 1e-9  # weights 1 and 1


def test_mix_takes_what_is_targeted(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", f"s{i % 5}", 1, None, None) for i in range(900)]
    found = mix.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).toPandas()
    per = found.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((per.target - per.taken).abs() <= 8).all()
    assert mix.resample(spark.createDataFrame(rows, SCHEMA)).count() == (found.taken / found["size"]).sum()


def test_decontamination_matches_sql(spark, docs, tmp_path):
    items = [(1, A), (2, "jumps over the lazy dog and then it runs"), (3, "word"), (4, ""), (5, None), (6, "the forest"), (None, "until night comes down slowly now"), (7, " ".join(f"w{i}" for i in range(20)))]
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    columns = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    key = lambda r: tuple(str(x) for x in r)
    wanted = sorted((tuple(r) for r in con.execute(f"select {columns} from ({queries.OP5_SQL})").fetchall()), key=key)
    known = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((tuple(r) for r in decontaminate.contamination(docs, known).select(*columns.split(", ")).collect()), key=key)
    assert found == wanted
    assert any(r[-1] for r in found)
    kept = decontaminate.drop_contaminated(docs, known)
    assert kept.columns == docs.columns
    full = {r["doc_id"] for r in decontaminate.contamination(docs, known).filter("n_full > 0").collect()}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in found if not r[5] and r[0] not in full)


def test_winnowing_keeps_a_fingerprint_of_every_shared_span():
    draw = np.random.default_rng(5)
    words = [b"w%d" % k for k in draw.integers(0, 30, 400)]
    own = {(h, pos) for h, width, pos, _, _ in decontaminate.fingerprints(words, [])}
    for start in range(0, 380):
        span = words[start : start + 8]
        inside = {h for h, *_ in decontaminate.fingerprints(span, [])}
        assert inside & {h for h, pos in own if start <= pos <= start + 3}


def test_license_scan_matches_sql(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = "doc_id, license, round(score, 9) as score, n_matches, licenses"
    key = lambda r: tuple(str(x) for x in r)
    wanted = sorted((tuple(r) for r in con.execute(f"select {columns} from ({queries.ORACLE_SQL['op6_license']})").fetchall()), key=key)
    found = sorted((tuple(r) for r in queries.op6_license(spark, str(tmp_path)).selectExpr(*columns.split(", ", 2)[:2], "round(score, 9) as score", "n_matches", "licenses").collect()), key=key)
    assert found == wanted
    assert {r[1] for r in found} >= {"MIT", "Apache-2.0"}


def test_license_anchors_never_pass_over_a_match():
    pattern = re.compile("|".join(license.anchors(license.TEMPLATES, 0.8)))
    draw = np.random.default_rng(3)
    for _, notice in license.TEMPLATES:
        words = re.findall(r"[^\W_]+", notice.lower())
        pairs = set(zip(words, words[1:], strict=False))
        for _ in range(20):  # drop words as long as the text still reaches the threshold
            some = [w for w in words if draw.random() > 0.15]
            own = set(zip(some, some[1:], strict=False))
            if own and 2 * len(own & pairs) / (len(own) + len(pairs)) >= 0.8:
                assert pattern.search(" ".join(some))


def shard_laws(rows: list, n_docs: int) -> None:
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n_docs
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(8)), default=0) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_shards_are_even_and_whole(spark, docs):
    rows = shard.assign(docs).collect()
    shard_laws(rows, len(ROWS))
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["size"] == 1 and by_id[5]["text_crc32"] == 0
    assert by_id[8]["text_crc32"] == zlib.crc32(ROWS[9][1].encode()) and by_id[8]["size"] == len(ROWS[9][1].encode()) + 1


def test_shards_keep_groups_together(spark):
    texts = ["hot"] * 300 + [f"pair {i // 3}" for i in range(300)] + [f"single {i}" for i in range(300)]
    found = spark.createDataFrame([(i, t, "en", "s", 1, None, None) for i, t in enumerate(texts)], SCHEMA)
    rows = shard.assign(found.repartition(5)).collect()
    shard_laws(rows, 900)
    groups: dict[str, set[int]] = {}
    for r in rows:
        groups.setdefault(r["group"], set()).add(r["shard"])
    cut = [g for g, s in groups.items() if len(s) > 1]
    assert len(cut) <= 25  # the hot group must be cut; of a hundred others few are


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert mix.mix(empty).count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert license.licenses(empty).count() == 0
    assert quality.classify(empty, labels).count() == 0
    assert toxicity.classify(empty, labels).count() == 0
    assert shard.assign(empty).count() == 0


def labelled(spark):
    draw = np.random.default_rng(2)
    vocabulary = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(800):
        words = list(draw.choice(vocabulary, 40))
        good, insult, group = k % 3 != 0, k % 2 == 0, k % 5 < 2
        if not good:
            words = [w.upper() + "!!" for w in words]
        if insult:
            words[3] = "fool,"
        if group:
            words[9] = "Martians"
        rows.append((k, " ".join(words), "en", "s", 1, None, None))
        labels.append((k, int(good), int(insult and group)))
    extra = [(900, None, None, None, None, None, None), (901, "", "en", "s", 1, None, None), (None, "word1 word2", "en", "s", 1, None, None), ROWS[8]]
    return spark.createDataFrame(rows + extra, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")


def held_out_accuracy(rows: list, truth: dict[int, int]) -> float:
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_quality_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert held_out_accuracy(rows, {k: int(k % 3 != 0) for k in range(800)}) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows if r["doc_id"] is not None)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes


def test_toxicity_learns_meetings(spark):
    """Toxic is only the meeting of an insult with a group."""
    docs, labels = labelled(spark)
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert held_out_accuracy(rows, {k: int(k % 2 == 0 and k % 5 < 2) for k in range(800)}) > 0.9


def test_held_out_labels_are_never_learned(spark):
    docs, labels = labelled(spark)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality.in_fold(4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels.filter("doc_id != 5")).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.classify(docs, flipped.filter("doc_id != 5")).collect()}
    assert a == b


TEXTS = ["", " ", "\n", "a  b", "a \n b", " lead", "trail ", "x\n\ny", "it's we'll don't", "tab\tx", "nb\xa0sp", "<|endoftext|>", "a<|endoftext|>b", "1234 5678,90", "é́ combining", "日本語 テスト", "😀 emoji!! x", "a\r\nb", "  two", "end  ", "x \t y", "\n\n", "a\n", "\na", "word's, 'tis", "x's.", "!!!???", "a\x0bb \x1c c", "Straße,Ünïcode. ﬁ"]


@pytest.fixture(scope="module")
def bpe():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_encoding_equals_the_library(bpe):
    own = tokens.Encoder(bpe)
    wanted = [np.array(e.ids, dtype="<u4").tobytes() for e in own.tokenizer.encode_batch(TEXTS * 2, add_special_tokens=False)]
    assert own.encode(TEXTS * 2) == wanted


def test_encoding_of_drawn_texts(bpe):
    hypothesis = pytest.importorskip("hypothesis")
    own = tokens.Encoder(bpe)
    letters = hypothesis.strategies.text(alphabet=list("ab C\n.,'!9 \té—") + ["　", "\x1c", "ß"], max_size=40)

    @hypothesis.settings(max_examples=300, deadline=None)
    @hypothesis.given(letters)
    def same(text: str) -> None:
        assert own.encode([text])[0] == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    same()


def test_codes_round_trip_and_random_access(monkeypatch):
    draw = np.random.default_rng(4)
    for ids in (np.empty(0, "<u4"), np.array([0], "<u4"), np.array([255, 256, 65535, 65536, 2**32 - 1], "<u4"), draw.integers(0, 70_000, 5000).astype("<u4")):
        segment = tokens.Segment(tokens.encode_segment(ids))
        assert (segment.ids() == ids).all() and segment.n == len(ids)
        assert [segment.at(i) for i in range(0, len(ids), 7)] == list(ids[::7])


def test_token_files(spark, docs, bpe, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe)
    found = sorted((tuple(r) for r in tokens.round_trip(docs, str(tmp_path / "t"), bpe, 2).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in ROWS), key=lambda d: (d is not None, d))
    start = 0
    wanted = Counter()
    for doc_id, text, *_ in ROWS:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        wanted[(doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    for doc_id, at, n, crc in found:
        assert at == start
        start += n
        wanted[(doc_id, n, crc)] -= 1
    assert not any(wanted.values())


def test_token_files_of_nothing(spark, empty, bpe, tmp_path):
    assert tokens.round_trip(empty, str(tmp_path / "t"), bpe, 2).count() == 0


def test_digests_are_of_sorted_item_ids():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_very_long_text(spark, bpe, tmp_path):
    """A text far beyond the steps that long texts are taken in."""
    words = [f"w{i % 1999}" for i in range(200_000)]
    long = spark.createDataFrame([(1, " ".join(words), "en", "s", 1, None, None)], SCHEMA)
    items = spark.createDataFrame([(1, "w7 w8 w9 w10 w11 w12 w13 w14"), (2, " ".join(words[500:530]))], "item_id long, text string")
    hit = decontaminate.contamination(long, items).first()
    assert hit["n_words"] == 200_000 and hit["n_items"] == 2 and hit["n_hit"] == 101 * 8 + 100 * 30
    assert simhash.fingerprint(" ".join(words).encode()) == simhash.fingerprint(" ".join(words).upper().encode())
    assert mix.mix(long).first()["size"] == 200_000
    assert len(quality.features(" ".join(words).encode())) > 1999 and len(toxicity.features(" ".join(words).encode())) >= 1999
    row = tokens.round_trip(long, str(tmp_path / "t"), bpe, 2).first()
    assert row["n_tokens"] > 200_000 and license.licenses(long).first()["n_matches"] == 0
