"""Sources of other languages and of PDF, extractors, tables kept by batches, and top-k of batches."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from strataq.functions.scale import broadcast_if_small
from strataq.operators import graph, lexical, topk, vectors
from strataq.plans.artifacts import FACTS, SOURCES
from strataq.sources import artifacts, files, languages, pdf
from strataq.streaming import sync

NAMES = {"rs": "rust", "go": "go", "ts": "typescript", "java": "java", "cpp": "cpp"}


def test_definitions_calls_and_imports_of_each_language():
    for ext, name in NAMES.items():
        symbols, edges, calls = languages.scan("f", SOURCES[ext], name)
        found = {(s[3], s[2]) for s in symbols} | {(t, b) for _, b, t, _ in edges if t != "defines"} | {("call", f"{c}: {e}") for c, _, _, e, _ in calls}
        assert found == set(FACTS[ext]), ext


def test_blanked_keeps_places_and_awkward_source_gives_no_error():
    text = 'a /* { */ "x\\"}" // }\n\'c\' `r}`'
    assert len(languages.blanked(text, "`")) == len(text) and "}" not in languages.blanked(text, "`")
    for odd in ("", "}}}{{", "fn", "class {", '"never closed', "/* never closed", "fn f( {", "impl X for { fn y() }", "func (s *", "é" * 50):
        for name in languages.LANGUAGES:
            languages.scan("f", odd, name)


def test_end_lines_and_scopes():
    symbols, _, calls = languages.scan("a.rs", SOURCES["rs"], "rust")
    assert {s[2]: (s[5], s[6]) for s in symbols}["WStore > run"] == (7, 9)
    assert calls[0][2] is None and calls[0][4] == 8


def test_parse_of_nulls_and_unknown_files(spark):
    rows = [("a.rs", None), ("b.xyz", "fn x() {}"), ("c.go", ""), (None, "x"), ("d.py", "def f(:"), ("e.rs", "fn x() {}")]
    found = languages.parse(spark.createDataFrame(rows, "path string, text string")).filter("kind = 'symbol'").collect()
    assert [(r["path"], r["name"]) for r in found] == [("e.rs", "x")]


def made_pdf(*bodies: bytes, fonts: bytes = b"", packed: bool = True) -> bytes:
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(bodies)))
    out = b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [" + kids + b"] >>\nendobj\n" + fonts
    for k, body in enumerate(bodies):
        data = zlib.compress(body) if packed else body
        flate = b" /Filter /FlateDecode" if packed else b""
        out += b"%d 0 obj\n<< /Type /Page /Resources << /Font << /F1 5 0 R >> >> /Contents %d 0 R >>\nendobj\n" % (10 + 2 * k, 11 + 2 * k)
        out += b"%d 0 obj\n<< /Length %d%s >>\nstream\n%s\nendstream\nendobj\n" % (11 + 2 * k, len(data), flate, data)
    return out + b"%%EOF"


def test_pages_of_flate_streams_escapes_and_kerning():
    said = made_pdf(b"BT (One \\(two\\) \\101) Tj 0 -12 Td [(ke) 20 (rn) -250 (ing)] TJ ET", b"BT <414243> Tj T* (next) Tj (line) ' ET")
    assert pdf.pages(said) == ["One (two) A\nkern ing", "ABC\nnext\nline"]
    assert pdf.pages(made_pdf(b"BT (plain) Tj ET", packed=False)) == ["plain"]
    assert pdf.pages(made_pdf(b"")) == [""]


def test_pages_by_the_map_of_a_font():
    table = b"1 beginbfchar\n<0041> <00E9>\nendbfchar\n1 beginbfrange\n<0050> <0052> <0061>\nendbfrange"
    font = b"5 0 obj\n<< /Type /Font /ToUnicode 6 0 R >>\nendobj\n6 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(table), table)
    assert pdf.pages(made_pdf(b"BT /F1 9 Tf <004100500051> Tj ET", fonts=font)) == ["éab"]


def test_information_headings_and_links_of_a_document(spark):
    links = b"7 0 obj\n<< /Subtype /Link /A << /S /URI /URI (http://a.example/x) >> >>\nendobj\n8 0 obj\n<< /Subtype /Link /A 9 0 R >>\nendobj\n9 0 obj\n<< /URI (http://b.example) >>\nendobj\n20 0 obj\n<< /Title (A \\(real\\) title) /Author (Me) /Subject () >>\nendobj\n"
    said = made_pdf(b"BT (1. Begin) Tj T* (plain words) Tj T* (Section 2) Tj ET", fonts=links)
    held = said.replace(b"/Type /Page /Res", b"/Type /Page /Annots [7 0 R 8 0 R 7 0 R] /Res")
    full = held.replace(b"%%EOF", b"trailer << /Info 20 0 R >>\n%%EOF")
    rows = spark.createDataFrame([("a", full), ("b", held), ("c", b"no pdf"), ("d", None)], "path string, content binary")
    a, b, c, d = pdf.pdf_documents(rows).orderBy("path").collect()
    assert (a["title"], a["metadata"]) == ("A (real) title", {"title": "A (real) title", "author": "Me"})
    assert a["markdown"] == "<!-- Page 1 -->\n\n## 1. Begin\nplain words\n## Section 2"
    assert [x["target"] for x in a["links"]] == ["http://a.example/x", "http://b.example"]
    assert b["title"] == "1. Begin" and b["metadata"] == {} and c["markdown"] is None and d["markdown"] is None


def test_no_pages_of_what_is_no_pdf(spark):
    broken = made_pdf(b"BT (x) Tj ET").replace(b"x\x9c", b"zz")
    rows = [("a", b"hello"), ("b", None), ("c", b""), ("d", b"%PDF-1.4 /Encrypt"), ("e", broken)]
    assert [tuple(r) for r in pdf.pdf_files(spark.createDataFrame(rows, "path string, content binary")).collect()] == [("e", 1, "")]


def test_an_extractor_can_be_added(spark):
    held = dict(artifacts.EXTRACTORS)
    try:

        @artifacts.extractor("html")
        def shouted(rows):
            return rows.select("path", F.lit("t").alias("title"), F.upper(F.col("content").cast("string")).alias("text"))

        rows = [("a.html", b"<p>x</p>"), ("b.htm", b"<p>y</p>"), ("c.txt", b"z"), ("d.png", b"\x00"), ("e.md", None)]
        found = {r["path"]: (r["kind"], r["text"]) for r in artifacts.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
        assert found == {"a.html": ("document", "<P>X</P>"), "b.htm": ("document", "y"), "c.txt": ("text", "z")}
    finally:
        artifacts.EXTRACTORS.clear()
        artifacts.EXTRACTORS.update(held)


def test_decoding_of_a_column_of_any_name(spark):
    rows = [(1, "é\n".encode()), (2, b"\xef\xbb\xbf" + "ß".encode()), (3, b"\xff\xfe" + "añ".encode("utf-16-le")), (4, b"\xfe\xff" + "añ".encode("utf-16-be")), (5, "plain text".encode("utf-16-be")), (6, None)]
    found = spark.createDataFrame(rows, "id int, raw binary").select("id", files.decode(F.col("raw")).alias("text")).orderBy("id")
    assert [r["text"] for r in found.collect()] == ["é\n", "ß", "añ", "añ", "plain text", None]


def test_a_table_kept_by_batches(spark, tmp_path):
    table = str(tmp_path / "t")
    apply = sync.table_sync(table, compact_every=3)
    wanted = {}
    for number in range(8):
        rows = [(f"p{k}", number * 10 + k) for k in range(number % 4, 6, 2)]
        wanted |= dict(rows)
        batch = spark.createDataFrame(rows, "path string, value int")
        apply(batch, number)
        if number == 4:
            apply(batch, number)  # a batch that comes again
        assert {r["path"]: r["value"] for r in sync.latest(spark, table).collect()} == wanted
    assert {r["path"] for r in sync.latest(spark, table, before=1).collect()} == {"p0", "p2", "p4"}
    assert sync.latest(spark, str(tmp_path / "none")) is None


def test_best_cells_equals_sorting():
    draw = np.random.default_rng(2)
    for rows, k in ((1, 3), (7, 3), (50, 10)):
        scores = draw.integers(0, 5, (6, rows)).astype(float)
        scores[draw.random(scores.shape) < 0.2] = -np.inf
        q, r = topk.best_cells(scores, k)
        for i in range(6):
            wanted = [j for j in np.lexsort((np.arange(rows), -scores[i])) if scores[i, j] > -np.inf][:k]
            assert r[q == i].tolist() == wanted


def test_rankings_in_small_blocks_and_by_shuffle_agree(spark, monkeypatch):
    draw = np.random.default_rng(4)
    words = [f"w{k}" for k in range(30)]
    chunks = spark.createDataFrame([(f"p{k // 3}", k % 3, "t " + words[k % 30], " ".join(draw.choice(words, 12)), "docs") for k in range(200)], "path string, chunk_index int, title string, text string, modality string").repartition(5)
    queries = spark.createDataFrame([(f"q{k}", " ".join(draw.choice(words, 3))) for k in range(12)] + [("none", "zzz"), ("empty", "")], "query_id string, text string")

    def ranked():
        return sorted((r["query_id"], r["rank"], r["path"], r["chunk_index"], round(r["score"], 6)) for r in lexical.bm25(chunks, queries, k=5).collect())

    whole = ranked()
    monkeypatch.setattr(topk, "CELLS", 64)
    monkeypatch.setattr(topk, "QUERIES", 5)
    assert ranked() == whole
    monkeypatch.setattr(lexical, "PUSHED_TERMS", 2)
    assert ranked() == whole
    monkeypatch.setattr(lexical, "ASKED", 0)
    assert ranked() == whole


def test_vectors_in_small_blocks_agree(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [(f"p{k // 2}", k % 2, True, "docs", [float(x) for x in draw.integers(-2, 3, 8)]) for k in range(120)] + [("odd", 0, True, "docs", [1.0]), ("null", 0, True, "docs", None)]
    held = spark.createDataFrame(rows, "path string, chunk_index int, is_doc_level boolean, modality string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(k, rows[k][4]) for k in range(0, 60, 7)], "query_id int, embedding array<double>")
    wanted = []
    for q, own in ((k, np.array(rows[k][4])) for k in range(0, 60, 7)):
        best: dict[str, tuple] = {}
        for path, chunk, _, _, v in rows[:120]:
            n = np.linalg.norm(own) * np.linalg.norm(v)
            best[path] = min(best.get(path, (9, 0)), (-round(float(own @ np.array(v)) / n if n else 0.0, 9), chunk))
        wanted += [(q, i + 1, p, c) for i, (p, (_, c)) in enumerate(sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:5])]

    def ranked():
        return sorted((r["query_id"], r["rank"], r["path"], r["chunk_index"]) for r in vectors.vector_topk(held, queries, 5).collect())

    assert ranked() == sorted(wanted)
    monkeypatch.setattr(topk, "CELLS", 32)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 4096 * 3)
    assert ranked() == sorted(wanted)


def test_broadcast_counts_bytes(spark):
    df = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert "broadcast" in broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(df, size=5000)._jdf.queryExecution().logical().toString().lower()


def test_paths_end_when_all_targets_are_reached(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "Link", "structural", 1.0) for k in range(6)] + [("n3", "n0", "Link", "structural", 1.0)], "src string, dst string, edge_type string, class string, weight double")
    pairs = spark.createDataFrame([("n0", "n2"), ("n0", "n0"), ("n5", "n0"), ("n2", "n0")], "source string, target string")
    found = {(r["source"], r["target"]): r["hops"] for r in graph.shortest_paths(edges, pairs).collect()}
    assert found == {("n0", "n2"): 2, ("n0", "n0"): 0, ("n2", "n0"): 2}
