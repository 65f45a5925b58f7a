"""Operators against plain Python versions, and the cases that earlier versions got wrong."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strataq.llm import ann, chat, decontaminate, license, mix, quality, queries, shard, simhash, tokens, toxicity

from .test_documents import jaccard_groups

DOCS = "doc_id long, text string, source string"
CLASHING = ["_c0", "_times", "_again", "times", "again", "key", "first_id", "order", "row", "text_key", "label", "n_full", "kept", "root", "score"]


def clashing(spark, rows):
    """Documents with further columns under names that operators use."""
    named = spark.createDataFrame([(d, t, s) for d, t, s in rows], DOCS)
    return named.select("*", *[F.lit(7).alias(c) for c in CLASHING])


# --- license -----------------------------------------------------------------------------------------------


def notice(name: str, longest: bool = True) -> str:
    return (max if longest else min)((text for n, text in license.TEMPLATES if n == name), key=len)


def wrapped(text: str, sign: str) -> str:
    words = text.split()
    return "\n".join(sign + " ".join(words[k : k + 9]) for k in range(0, len(words), 9))


def test_notices_are_found_wherever_they_stand(spark):
    code = "\n".join(f"value_{k} = compute({k}, other)" for k in range(100))
    mit, gpl = notice("MIT"), notice("GPL-3.0-or-later")
    texts = [
        (wrapped(mit, "") + "\n" + code, "MIT"),
        ((mit + "\n") * 8, "MIT"),
        (mit + "\n" * 3000, "MIT"),
        ("/*\n" + wrapped(mit, " * ") + "\n */\n" + code, "MIT"),
        (wrapped(gpl, "# ") + "\n" + code, "GPL-3.0-or-later"),
        ("The text is here. Licensed under CC BY 4.0. See the site.", "CC-BY-4.0"),
        (" ".join(w for k, w in enumerate(mit.split()) if k % 9), "MIT"),
        (code, None),
        ("filler " * 50_000 + mit, "MIT"),
    ]
    found = {r["doc_id"]: r for r in license.licenses(spark.createDataFrame([(k, t, "s") for k, (t, _) in enumerate(texts)], DOCS)).collect()}
    assert [found[k]["license"] for k in range(len(texts))] == [name for _, name in texts]
    assert found[0]["score"] == found[1]["score"] == 1.0


def test_best_stretch_equals_all_stretches(spark):
    """Every stretch of drawn texts, compared as bags of word pairs."""
    draw = np.random.default_rng(8)
    templates = (("A", "a b c a b d e"), ("B", "b c d"), ("C", "e"))
    texts = [" ".join(draw.choice(list("abcdefg"), draw.integers(0, 25), p=[0.25, 0.25, 0.15, 0.1, 0.1, 0.1, 0.05])) for _ in range(150)]

    def pairs(words: list[str]) -> list[str]:
        return [f"{x} {y}" for x, y in zip(words, words[1:], strict=False)] or words

    wanted = set()
    for k, text in enumerate(texts):
        grams, best = pairs(text.split()), []
        for name, said in templates:
            own = Counter(pairs(said.split()))
            options = [(2 * sum((Counter(grams[i:j]) & own).values()) / (j - i + sum(own.values())), -i, j - 1) for i in range(len(grams)) for j in range(i + 1, len(grams) + 1)]
            if options and max(options)[0] >= 0.8:
                best.append((name, *max(options)))
        for name, dice, early, last in best:
            if not any(d > dice and -e <= last and -early <= at for _, d, e, at in best):
                wanted.add((k, name, round(dice, 9), -early, last))
    found = license.scan(spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], DOCS), 0.8, templates).collect()
    assert {(r["doc_id"], r["license"], round(r["dice"], 9), r["first"], r["last"]) for r in found} == wanted and len(wanted) > 5


# --- near duplicates, mixing, decontamination --------------------------------------------------------------


def test_links_over_all_bits_in_small_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    draw, values = np.random.default_rng(12), set()
    for copies in (120, 120, *[2] * 20):
        centre = int(draw.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(copies):
            flips = [*draw.choice(64, draw.integers(0, 4), replace=False), *([63] if draw.random() < 0.3 else [])]
            values.add(centre ^ sum(1 << int(b) for b in set(flips)))
    values = sorted(values)
    root = {v: v for v in values}

    def find(v: int) -> int:
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    edges = simhash.links(spark.createDataFrame([(s, 0) for s in signed.values()], "fp long, first_id long"))
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    own, theirs = defaultdict(set), defaultdict(set)
    for v in values:
        own[find(v)].add(v)
        theirs[found.get(signed[v], signed[v])].add(v)
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, theirs.values()))


def test_fingerprint_of_a_text_beyond_a_step(monkeypatch):
    text = " ".join(f"w{k * k % 613}" for k in range(2_000)).encode()
    whole = simhash.fingerprint(text)
    for step in (1, 7, 1000):
        monkeypatch.setattr(simhash, "STEP", step)
        assert simhash.fingerprint(text) == whole


def test_first_rows_stay_for_each_group(spark):
    x, y = " ".join(f"x{k}" for k in range(30)), " ".join(f"y{k}" for k in range(30))
    docs = clashing(spark, [(5, x, "s"), (5, y, "s"), (5, y, "s"), (6, x, "s"), (7, y, "s"), (None, x, "s"), (8, None, None), (9, "", "s")])
    kept = simhash.keep_alike(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, x), (5, x), (5, y), (8, None)]


def test_resample_keeps_columns_of_any_name(spark):
    docs = clashing(spark, [(k, "one two three", f"s{k % 2}") for k in range(40)] + [(40, None, None), (41, "", "s0"), (40, "x", None), (40, "x", None)])
    taken = mix.resample(docs)
    assert taken.columns == docs.columns and taken.dtypes == docs.dtypes
    assert taken.count() == mix.mix(docs).agg(F.sum("times")).first()[0]
    assert mix.resample(docs.limit(0)).count() == 0


def test_items_without_id_take_no_part(spark):
    words = [f"w{k}" for k in range(40)]
    docs = clashing(spark, [(1, " ".join(words), "s"), (2, "the of", "s"), (3, None, "s")])
    items = spark.createDataFrame([(None, " ".join(words[5:15])), (1, "the"), (2, " ".join(words[20:30]))], "item_id long, text string")
    found = {r["doc_id"]: (r["n_hit"], r["n_items"], r["n_full"]) for r in decontaminate.contamination(docs, items).collect()}
    assert found == {1: (10, 1, 1), 2: (1, 1, 0), 3: (0, 0, 0)}
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_a_passage_of_many_items(spark):
    """A passage that all items and all documents share, in like and unlike surroundings."""
    shared = " ".join(f"p{k}" for k in range(9))
    docs = spark.createDataFrame([(k, f"a{k} {shared} b{k}", "s") for k in range(30)], DOCS)
    items = spark.createDataFrame([(k, shared if k % 2 else f"x{k} {shared} y{k}") for k in range(20)], "item_id long, text string")
    assert {(r["n_hit"], r["n_items"], r["n_full"]) for r in decontaminate.contamination(docs, items).collect()} == {(9, 20, 20)}


# --- neighbours --------------------------------------------------------------------------------------------


def test_shares_of_the_radius_lose_nothing():
    draw = np.random.default_rng(3)
    for parts in (2, 8):
        for radius in range(0, 40):
            share = ann.shares(radius, parts)
            for _ in range(60):
                apart = draw.multinomial(radius, draw.dirichlet(np.ones(parts)))
                assert any(d <= s for d, s in zip(apart, share, strict=True))


def clusters(draw, n: int, size: int) -> np.ndarray:
    centres = draw.normal(size=(n // size, 64))
    return np.repeat(centres, size, axis=0) + draw.normal(scale=0.12, size=(n, 64))


def test_probing_prunes_and_finds_all_within():
    x = clusters(np.random.default_rng(5), 6000, 20)
    codes = ann.Codes(x[np.random.default_rng(6).permutation(len(x))[: ann.SAMPLE]])
    index, retrieved = ann.Index(codes.encode(x)), 0
    for k in range(0, 6000, 100):
        near = np.flatnonzero(np.bitwise_count(index.codes ^ index.codes[k]).sum(axis=1) <= codes.radius)
        assert (index.within(index.codes[k], codes.radius) == near).all()
        retrieved += len(index.probe(index.codes[k], codes.radius))
    assert retrieved / (60 * 6000) < 0.2


def test_neighbours_over_blocks_and_repeated_ids(spark, monkeypatch):
    for name, n in (("DATA_BLOCK", 300), ("QUERY_BLOCK", 4), ("LEAST_BLOCK", 100)):
        monkeypatch.setattr(ann, name, n)
    x = clusters(np.random.default_rng(9), 1500, 15)
    ids = [*range(1480), *range(20)]  # the first twenty have two vectors
    rows = [(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)]
    wanted = {}
    for q in range(0, 1480, 100):
        best: dict[int, float] = {}
        for i, row in zip(ids, x, strict=True):
            far = min(float(np.sqrt(((row - x[k]) ** 2).sum())) for k in range(1500) if ids[k] == q)
            if i != q:
                best[i] = min(far, best.get(i, math.inf))
        wanted[q] = {i for _, i in sorted((d, i) for i, d in best.items())[:10]}
    found = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found[r["query_id"]].append(r["vec_id"])
    assert all(len(v) == len(set(v)) == 10 for v in found.values())
    assert sum(len(wanted[q] & set(found[q])) for q in wanted) >= 0.9 * 10 * len(wanted)


# --- classifiers against plain loops -----------------------------------------------------------------------


def test_quality_learner_equals_a_plain_loop():
    draw, model = np.random.default_rng(4), quality.Ftrl()
    z, n = defaultdict(float), defaultdict(float)

    def weight(i: int) -> float:
        l1 = 0.0 if i == quality.DIM else model.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for k in range(400):
        idx = np.unique(draw.integers(0, 40, 12))
        label = int(idx[0] < 3)
        w = {i: weight(i) for i in [*idx.tolist(), quality.DIM]}
        gradient = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i, own in w.items():
            sigma = (math.sqrt(n[i] + gradient**2) - math.sqrt(n[i])) / model.alpha
            z[i] += gradient - sigma * own
            n[i] += gradient**2
        model.learn(idx, label)
    every = np.arange(40)
    assert np.allclose(model.weights(every), [weight(i) for i in range(40)], atol=1e-9)
    assert np.count_nonzero(model.weights(every)) > 3


def test_toxicity_score_equals_the_sum_over_pairs():
    draw = np.random.default_rng(5)
    model = draw.normal(size=(toxicity.DIM + 1, toxicity.FACTORS + 1)) * 0.2
    for size in (0, 1, 2, 17):
        idx = np.sort(draw.choice(toxicity.DIM, size, replace=False))
        total = model[toxicity.DIM, 0] + sum(model[i, 0] for i in idx)
        total += sum(float(model[i, 1:] @ model[j, 1:]) for a, i in enumerate(idx) for j in idx[:a])
        assert abs(toxicity.score_of(model, idx) - 1 / (1 + math.exp(-total))) < 1e-9


def test_toxicity_learns_pairs_whose_terms_say_nothing_alone():
    """Labels are the exclusive-or of two terms, among others drawn at random."""
    draw, rows = np.random.default_rng(1), []
    for _ in range(5000):
        a, b = draw.random() < 0.5, draw.random() < 0.5
        rows.append((np.unique([*draw.integers(100, 1100, 12), *[1] * a, *[2] * b]), int(a != b)))
    machine = toxicity.Machine()
    for idx, _ in rows[:4000]:
        machine.texts[idx] += 1
    for turn in range(toxicity.EPOCHS):
        for idx, label in rows[:4000]:
            machine.learn(idx, label, turn >= toxicity.ALONE)
    used, w, v = machine.table()
    model = np.zeros((toxicity.DIM + 1, toxicity.FACTORS + 1))
    model[used, 0], model[used, 1:] = w, v
    assert np.mean([(toxicity.score_of(model, idx) >= 0.5) == label for idx, label in rows[4000:]]) > 0.9


def test_one_example_for_each_labelled_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}", "s") for k in range(50)] + [(2, "other", "s"), (None, "x", "s")], DOCS)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, label int")
    found = quality.examples(docs, quality.sample_of(labels, 100)).collect()
    assert sorted((r["doc_id"], r["label"]) for r in found) == [(1, 1), (2, 0)]


# --- shards against a plain version ------------------------------------------------------------------------


def draw_of(seed: int, value: int | str) -> float:
    """The engine's hash of an int and then a long or a string, as a share of [0, 1)."""
    first = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    raw = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    h = xxhash.xxh64_intdigest(raw, first)
    return ((h - (1 << 64) if h >> 63 else h) % (1 << 30)) / (1 << 30)


def tie_of(group: str, s: int) -> int:
    h = xxhash.xxh64_intdigest(struct.pack("<i", s), xxhash.xxh64_intdigest(group.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def plain_propagation(rows: list[tuple[int, str]], quotas: list[int], rounds: int) -> dict[int, int]:
    n, small = len(quotas), max(1, min(quotas) // 16)
    state = {r: math.floor(draw_of(0, r) * n) for r, _ in rows}
    group, copies, full = dict(rows), Counter(g for _, g in rows), []
    for turn in range(1, rounds + 1):
        counts = Counter((group[r], s) for r, s in state.items())
        best = {}
        for (g, s), k in counts.items():
            if s not in full:
                best[g] = max(best.get(g, (0, 0, 0)), (k, tie_of(g, s), s)) if g in best else (k, tie_of(g, s), s)
        goal = {r: s if group[r] not in best or (s in full and copies[group[r]] > small) else best[group[r]][2] for r, s in state.items()}
        flow = Counter((state[r], goal[r]) for r in state)
        want = {ab: k for ab, k in flow.items() if ab[0] != ab[1]}
        if not want:
            return state
        held = [sum(k for (a, _), k in flow.items() if a == s) for s in range(n)]
        grant, after = {}, held[:]
        for b in range(n):
            asking = {a: k for (a, x), k in want.items() if x == b}
            swaps = {a: min(k, want.get((b, a), 0)) for a, k in asking.items()}
            rest, room = sum(asking.values()) - sum(swaps.values()), max(0, quotas[b] - held[b])
            for a, k in asking.items():
                allowed = swaps[a] + ((k - swaps[a]) * min(1.0, room / rest) if rest else 0)
                grant[a, b] = allowed / k
                after[a] -= allowed
                after[b] += allowed
        full = [s for s in range(n) if after[s] >= 0.98 * quotas[s]]
        for r, s in state.items():
            chance = draw_of(turn, r) if copies[group[r]] > small else draw_of(turn, group[r])
            state[r] = goal[r] if chance < grant.get((s, goal[r]), 0.0) else s
    return state


@pytest.mark.parametrize("sizes", [[300, 40, *[2] * 60, *[5] * 30], [500], [1] * 9])
def test_propagation_equals_a_plain_version(spark, sizes):
    rows, at = [], 0
    for k, size in enumerate(sizes):
        rows += [(at + j, f"group {k}") for j in range(size)]
        at += size
    quotas = [len(rows) // 8 + 1 + 20 * (s % 2) for s in range(8)]
    linked = spark.createDataFrame(rows, "row_id long, group string").repartition(3)
    found = {r["row_id"]: r["shard"] for r in shard.propagate(linked, quotas).collect()}
    assert found == plain_propagation(rows, quotas, shard.ROUNDS)


def test_shards_of_one_group_and_of_a_long_text(spark):
    docs = spark.createDataFrame([(k % 3, "same", "s") for k in range(100)] + [(None, "w " * 500_000, "s")], DOCS)
    rows = shard.assign(docs).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == 101
    assert max(r["size"] for r in rows) == 1_000_001


# --- chats, token files, pipeline --------------------------------------------------------------------------


def test_another_template_is_read_back(spark):
    template = chat.Template(turn=(("[", ()), ("{text}", ("user",)), ("<|by|>", ()), ("{role}", ()), ("<|end|>", ())))
    said = "x [<|end|> y\n" * 3
    rows = [(1, 0, "user", said), (1, 1, "assistant", ""), (1, 2, "user", "z" * 200_000)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    row = out.withColumn("read", chat.read_turns(F.col("formatted"), template)).first()
    assert [(t["role"], t["text"]) for t in row["read"]] == [r[2:] for r in rows]
    assert chat.digests(out, template).first()["loss_chars"] == len(said) + 200_000
    with pytest.raises(ValueError):
        chat.pieces_of(chat.Template(turn=(("{text}", ()), ("{role}", ()))))


def test_token_files_of_one_repeated_id(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(None if k % 2 else 7, f"text {k}", "s") for k in range(200)], DOCS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    parts = tokens.write_tokens(docs, str(tmp_path / "t"), public.path("byte_bpe_50k.json"), 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.count() > 2
    found = tokens.read_tokens(parts, str(tmp_path / "t"))
    assert found.rdd.getNumPartitions() == parts.count()
    rows = sorted((tuple(r) for r in found.collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None] * 100 + [7] * 100
    assert all(b[1] == a[1] + a[2] for a, b in zip(rows, rows[1:], strict=False))


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    """Each stage's decisions on what its predecessor kept, at the smallest size, with awkward rows added."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(2).unionByName(docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])).unionByName(docs.limit(1).withColumn("text", F.lit("")))
    docs = docs.unionByName(odd).withColumn("times", F.lit(1)).withColumn("_c0", F.lit("x"))
    stages = dict(corpus_pipeline.STAGES)

    def through(name, before):
        after = spark.createDataFrame(stages[name](spark, before, sf_dir).collect(), before.schema)
        assert after.columns == before.columns
        return after, [tuple(r) for r in after.select("doc_id", "text", "source").collect()]

    good, kept = through("quality", docs)
    assert 0 < len(kept) < docs.count()
    single, kept_single = through("near_duplicates", good)
    texts = {(d, t) for d, t, _ in kept}
    assert {d for d, _, _ in kept_single if d is not None} == jaccard_groups(sorted((d, t or "") for d, t in texts if d is not None))
    clean, kept_clean = through("decontaminate", single)
    windows, short = set(), defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = plain_words(r["text"])
        windows |= {tuple(words[k : k + 8]) for k in range(len(words) - 7)}
        if 0 < len(words) < 8:
            short[tuple(words)].add(r["item_id"])
    assert not short

    def leaks(text: str | None) -> bool:
        words = plain_words(text)
        return any(tuple(words[k : k + 8]) in windows for k in range(len(words) - 7))

    assert sorted(map(str, kept_clean)) == sorted(str(r) for r in kept_single if not leaks(r[1]))
    mixed, kept_mixed = through("mix", clean)
    clean.select("doc_id", "text", "source").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = Counter()
    for d, size, taken in con.execute(f"select doc_id, size, taken from ({queries.OP2_SQL}) where taken > 0").fetchall():
        wanted[d] += taken // size
    assert Counter(r[0] for r in kept_mixed) == wanted
    rows = stages["shard"](spark, mixed, sf_dir).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(kept_mixed) and max(sizes.values()) - min(sizes.values()) <= 1
    assert Counter(r["doc_id"] for r in rows) == wanted


def test_pipeline_of_an_empty_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0, name
        empty = spark.createDataFrame([], empty.schema)
