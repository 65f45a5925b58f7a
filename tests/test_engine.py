"""The engine's operators on small tables with known answers."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.functions import text as tx
from strataq.operators import analytics, catalog, chunk, community, federation, fusion, graph, lexical, pattern, search, validate, vectors
from strataq.sources import code, files
from strataq.streaming import sync

NOTES = [
    ("notes/rust.md", "Systems Programming", "Rust is a systems programming language. Systems programming needs memory safety."),
    ("notes/async.md", "Async IO", "Async concurrency uses futures and an executor."),
    ("notes/python.md", "Python Scripting", "Python is a dynamic interpreted scripting language for programming."),
    ("notes/ml.md", "Neural Networks", "Machine learning uses neural networks trained on data."),
    ("notes/web.md", "HTTP Servers", "Web development uses frameworks and HTTP servers."),
]
LINKS = [("rust", "async"), ("rust", "web"), ("async", "web"), ("python", "ml"), ("ml", "rust")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(p, 0, t, x, "docs") for p, t, x in NOTES], "path string, chunk_index int, title string, text string, modality string")


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(f"notes/{a}.md", f"notes/{b}.md", "Link", "structural", 1.0) for a, b in LINKS]
    return spark.createDataFrame(rows, "src string, dst string, edge_type string, class string, weight double")


def make(spark, rows):
    return spark.createDataFrame([(*r, 1.0)[:5] if len(r) == 4 else r for r in rows], "src string, dst string, edge_type string, class string, weight double")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_bm25_ranks_the_subject_first(spark, chunks):
    rows = lexical.bm25(chunks, ask(spark, "systems programming", "nothing at all here zzz")).orderBy("query_id", "rank").collect()
    assert rows[0]["path"] == "notes/rust.md" and {r["query_id"] for r in rows} == {0}
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_bm25_modality_and_repeats(spark, chunks):
    assert lexical.bm25(chunks, ask(spark, "programming"), modality="code").count() == 0
    one, two = (lexical.bm25(chunks, ask(spark, q)).filter("rank = 1").first()["score"] for q in ("futures", "futures futures"))
    assert abs(two - 2 * one) < 1e-9


def test_sanitizer(spark):
    said = spark.createDataFrame([("```rust\nfoo(bar) AND  NOT baz:qux",)], "q string").select(tx.sanitize_query(F.col("q"))).first()[0]
    assert said == "foo bar and not baz qux"


def test_rrf_sums_its_parts(spark):
    rows = [(0, "a", 1, "x"), (0, "b", 2, "x"), (0, "b", 1, "y"), (0, "b", 5, "y")]
    lists = spark.createDataFrame(rows, "query_id long, path string, rank int, source string")
    found = {r["path"]: r["score"] for r in fusion.rrf(lists).collect()}
    assert abs(found["a"] - 1 / 61) < 1e-12 and abs(found["b"] - (1 / 62 + 1 / 61 + 1 / 65)) < 1e-12


def test_dedup_hits(spark):
    hits = spark.createDataFrame([(0, "src/lib.rs:chunk:0", 0.9, "MyStruct"), (0, "src/lib.rs:chunk:1", 0.8, None), (0, "docs/readme.md:chunk:0", 0.95, None)], "query_id long, path string, score double, text string")
    q = ask(spark, "mystruct")
    assert fusion.dedup_hits(hits, q, code_only=True).count() == 1
    both = {r["path"]: r for r in fusion.dedup_hits(hits, q).collect()}
    assert len(both) == 2 and abs(both["src/lib.rs"]["score"] - (0.9 + 0.004 + 0.005)) < 1e-9


def test_search_modes(spark, chunks, edges):
    vecs = spark.createDataFrame([(p, 0, False, "docs", [float(k == j) for j in range(5)]) for k, (p, *_) in enumerate(NOTES)], "path string, chunk_index int, is_doc_level boolean, modality string, embedding array<double>")
    q = ask(spark, "systems programming").withColumn("embedding", F.array(*[F.lit(x) for x in (1.0, 0.1, 0.0, 0.0, 0.0)]))
    corpus = search.Corpus(chunks, edges, vecs)
    for mode in ("semantic", "fast", "hybrid"):
        assert search.search(corpus, q, mode, modality="docs" if mode == "hybrid" else "both").orderBy("rank").first()["path"] == "notes/rust.md", mode
    near = {r["path"] for r in search.search(corpus, q, "graph").collect()}
    assert "notes/rust.md" not in near and "notes/async.md" in near
    with pytest.raises(ValueError):
        search.search(corpus, q, "telepathy")
    row = search.explain(corpus, q).orderBy("rank").first()
    assert abs(row["score"] - row["bm25_part"] - row["vector_part"] - row["graph_part"]) < 1e-12
    assert search.with_lineage(search.search(corpus, q, "bm25"), edges).count() == 2


def test_decomposition():
    assert search.decompose("how does parsing relate to indexing and storage") == ["parsing", "indexing", "storage"]
    assert search.decompose("what is ownership") == ["ownership"]


def test_bfs_and_paths(spark, edges):
    start = spark.createDataFrame([("s", "notes/python.md")], "seed string, node string")
    found = {r["node"]: r["hops"] for r in graph.bfs(edges, start, 5).collect()}
    assert found == {"notes/ml.md": 1, "notes/rust.md": 2, "notes/async.md": 3, "notes/web.md": 3}
    pair = spark.createDataFrame([("notes/python.md", "notes/web.md"), ("notes/web.md", "notes/rust.md")], "source string, target string")
    rows = graph.shortest_paths(edges, pair).collect()
    assert [r["path"] for r in rows] == [["notes/python.md", "notes/ml.md", "notes/rust.md", "notes/web.md"]]
    walk = {r["node"]: r["depth"] for r in graph.dfs(edges, start, 5).collect()}
    assert set(walk) == set(found)


def test_pagerank_chain(spark):
    e = make(spark, [("main", "router", "calls", "code"), ("router", "handler", "calls", "code")])
    seeds = spark.createDataFrame([("q", "main", 1.0)], "seed string, node string, weight double")
    p = {r["node"]: r["score"] for r in graph.personalized_pagerank(e, seeds).collect()}
    assert p == pytest.approx({"main": 0.625, "router": 0.25, "handler": 0.125}) and sum(p.values()) == pytest.approx(1)


CLIQUES = [(a, b, "Link", "structural", 1.0) for g in ("ABC", "DEF") for a in g for b in g if a != b] + [("C", "D", "Link", "structural", 0.1)]


def test_communities_of_two_cliques(spark):
    e = make(spark, CLIQUES)
    found = community.refined(e)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list("ABC"), list("DEF")]
    assert community.modularity(e, found).first()[0] > 0.3
    assert {r["density"] for r in community.density(e, found).collect()} == {1.0}
    assert community.architecture(e, found).count() == 6


def test_density_and_stats(spark):
    e = make(spark, [("A", "B", "x", "structural"), ("B", "C", "x", "structural"), ("A", "C", "x", "structural")])
    nodes = spark.createDataFrame([("D",)], "node string")
    row = community.density_report(e, nodes).first()
    assert (row["nodes"], row["edges"], row["orphans"], row["density"]) == (4, 3, 1, 0.25)
    assert [r["node"] for r in graph.orphans(e, nodes).collect()] == ["D"]


def test_cycles_upsert_and_tags(spark):
    e = make(spark, [("a", "b", "x", "structural"), ("b", "c", "x", "structural"), ("c", "a", "x", "structural"), ("b", "a", "x", "structural"), ("d", "d", "y", "structural")])
    assert {tuple(r["cycle"]) for r in graph.cycles(e).collect()} == {("a", "b"), ("a", "b", "c"), ("d",)}
    twice = e.withColumn("seq", F.lit(1)).unionByName(e.limit(1).withColumns({"weight": F.lit(9.0), "seq": F.lit(2)}))
    assert graph.upsert(twice).filter("weight = 9").count() == 1 and graph.upsert(twice).count() == 5
    tagged = spark.createDataFrame([("p", ["rare", "all"]), ("q", ["rare", "all"]), ("r", ["all"])], "path string, tags array<string>")
    rows = graph.tag_edges(tagged).collect()
    assert [(r["src"], r["dst"]) for r in rows] == [("p", "q")] and rows[0]["weight"] == pytest.approx(np.log(1.5))


def test_patterns(spark, edges):
    parsed = pattern.parse("(a:Note {path:'x'})-[:Link|cites*2..4]->(b)<-[]-(c)--()-[*3]-(d)-[*2..]->()")
    assert [(s.direction, s.low, s.high) for s in parsed.steps] == [("out", 2, 4), ("in", 1, 1), ("both", 1, 1), ("both", 3, 3), ("out", 2, 5)]
    for bad in ("a->b", "(a)-[*3..1]->(b)", "(a)<-[]->(b)"):
        with pytest.raises(ValueError):
            pattern.parse(bad)
    nodes = graph.nodes_of(edges).withColumns({"title": F.lit(None).cast("string"), "label": F.lit("Note")})
    found = pattern.match(edges, nodes, "(a {path:'notes/python.md'})-[:Link*1..3]->(b {name:'web.md'})")
    assert {(r["node"], r["hop"], r["matched"]) for r in found.collect()} == {("notes/python.md", 0, False), ("notes/ml.md", 1, False), ("notes/rust.md", 2, False), ("notes/web.md", 3, True)}
    assert pattern.impact(found).first()["max_depth"] == 3
    none = pattern.match(edges, nodes, "(a {path:'notes/python.md'})-[:Link]->(b)", where="contains 'handler and co'")
    assert none.count() == 0


def test_coverage_gaps_delta(spark, chunks):
    paths = chunks.select("path")
    assert analytics.query_coverage(chunks, ask(spark, "futures"), paths).first()["ratio"] == 0.2
    a = spark.createDataFrame([(0, "A")], "query_id long, path string")
    b = spark.createDataFrame([(0, "B")], "query_id long, path string")
    row = analytics.semantic_gaps(a, b).first()
    assert (row["lexical_only"], row["dense_only"], row["overlap"]) == (1, 1, 0.0)
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert {r["path"]: r["change"] for r in analytics.delta(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "new"}


NOTE = "---\ntitle: Test Note\ntemplate: decision-record\ntags: [rust, learning]\nimplements: [x, y]\n---\n\n# Heading\n\nSee [[another-note]] and [[third|aliased link]]. #inline-tag, ok\n\n```\n# no heading\n```\n## Two\n"


def test_markdown_notes(spark):
    rows = files.markdown(spark.createDataFrame([("n.md", NOTE), ("b.md", "---\n: bad: [\n---\n# T"), ("p.md", "plain")], "path string, text string"))
    by = {r["path"]: r for r in rows.collect()}
    n = by["n.md"]
    assert (n["title"], n["template"], n["tags"]) == ("Test Note", "decision-record", ["inline-tag", "learning", "rust"])
    assert [(x["target"], x["label"]) for x in n["links"]] == [("another-note", None), ("third", "aliased link")]
    assert by["b.md"]["frontmatter"] is None and by["b.md"]["title"] == "T" and by["p.md"]["title"] is None
    assert {r["target"] for r in files.frontmatter_targets(rows, "implements").collect()} == {"x", "y"}
    heads = rows.filter("path = 'n.md'").select(tx.headings(F.col("body"))).first()[0]
    assert [(h["level"], h["title"]) for h in heads] == [(1, "Heading"), (2, "Two")]


def test_html_and_docx():
    page = "<html><head><title>T</title><meta name='k' content='v'></head><body><nav>skip</nav><div class='sidebar'>skip</div><h2>Head</h2><p>Some <b>bold</b> <a href='/x'>link</a><a href='#y'>no</a></p><table><tr><th>a|b</th></tr><tr><td>1</td></tr></table><pre>x\n y</pre><script>skip</script></body></html>"
    name, meta, body, links = files.parse_html(page)
    assert name == "T" and meta == {"k": "v"} and links == [("/x", "link")] and "skip" not in body
    assert "## Head" in body and "**bold** [link](/x)" in body and "| a\\|b |" in body and "```\nx\n y\n```" in body
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
    assert files.parse_docx(raw.getvalue())[1] == "## Title\n\nBody"


def test_files_are_classified(spark):
    rows = [("a/b.md", b"x"), ("src/x.rs", b"fn"), ("x.png", b"\x00"), (".env", b"A"), ("noext", b"t"), ("data.dat", b"ab\x00c"), ("log.txt2", b"plain"), ("docs/p.html", b"<p>")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    found = {r[0]: r[1] for r in df.select("path", files.classify(F.col("path"), F.col("content"), ["docs/"])).collect()}
    assert found == {"a/b.md": "markdown", "src/x.rs": "code", "x.png": "ignored", ".env": "ignored", "noext": "ignored", "data.dat": "ignored", "log.txt2": "text", "docs/p.html": "document"}
    out = {r[0]: r[1] for r in df.select("path", files.excluded(F.col("path"), ["*.png", "src/", "!src/x.rs"])).collect()}
    assert out["x.png"] and not out["src/x.rs"] and not out["a/b.md"]
    texts = spark.createDataFrame([(bytearray("hé".encode("utf-16")),), (bytearray(b"\xef\xbb\xbfab"),), (bytearray("plain text".encode("utf-16-le")),)], "content binary")
    assert [r[0] for r in texts.select(files.decode(F.col("content"))).collect()] == ["hé", "ab", "plain text"]


def test_read_corpus(spark, tmp_path):
    for name, text in (("a.md", "# A"), ("sub/b.py", "x = 1"), (".git/c", "no"), ("skip/d.md", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    found = {r["path"]: (r["kind"], r["language"]) for r in files.read_corpus(spark, str(tmp_path), ["skip/"]).collect()}
    assert found == {"a.md": ("markdown", None), "sub/b.py": ("code", "python")}


@pytest.mark.parametrize("strategy", ["heading", "paragraph", "semantic", "fixed"])
def test_chunks_stay_in_bounds(spark, strategy):
    body = "# A\n\n" + "Sätze mit Wörtern. " * 200 + "\n\n## B\n\nshort\n\n```\n# code\n```\n\n## C\n\n" + "word " * 300
    s = chunk.Settings(strategy, 128, 256, 5)
    rows = chunk.chunk(spark.createDataFrame([("d", body), ("e", ""), ("f", None)], "path string, text string"), s).collect()
    assert rows and {r["path"] for r in rows} == {"d"}
    assert strategy == "semantic" or all(len(r["text"].encode()) <= s.most + 4 for r in rows)  # long lines stay whole there
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    if strategy == "heading":
        assert rows[0]["heading_chain"] == "A" and any(r["heading_chain"] == "A > C" for r in rows)


def test_overlap_windows_and_policies(spark):
    c = spark.createDataFrame([("p", 0, "one two"), ("p", 1, "three")], "path string, chunk_index int, text string")
    assert [r["text"] for r in chunk.overlap(c, 1).orderBy("chunk_index").collect()] == ["one two", "two\n\nthree"]
    lines = spark.createDataFrame([("p", "\n".join(map(str, range(195))))], "path string, text string")
    assert [(r["start_line"], r["end_line"]) for r in chunk.line_windows(lines).orderBy("chunk_index").collect()] == [(1, 100), (91, 190), (181, 195)]
    rows = [("CHANGELOG.md", 1, 1, None, True, None, "x"), ("a.md", 0, 3, None, True, None, "x"), ("a.md", 3, 3, None, True, None, "x"), ("a.md", 2, 2, "A", True, None, "prose"), ("a.md", 2, 2, "A", True, None, "- a\n- b"), ("docs/adr/1.md", 4, 3, None, True, None, "the decision")]
    df = spark.createDataFrame(rows, "path string, chunk_index int, heading_level int, heading_chain string, first_in_section boolean, template string, text string")
    assert [r["embed_policy"] for r in chunk.document_policy(df).collect()] == ["graph_only", "anchor", "graph_only", "anchor", "graph_only", "anchor"]


SOURCE = '"""Doc."""\nimport os\nfrom a.b import c\n\nclass Base: ...\n\nclass Dog(Base):\n    """A dog."""\n    def bark(self, times: int):\n        self.wag()\n        return os.getcwd()\n    def wag(self): pass\n\ndef main():\n    d = Dog()\n    d.bark(2)\n'


def test_python_source(spark):
    src = spark.createDataFrame([("pkg/dog.py", SOURCE), ("bad.py", "def ("), ("nul.py", None)], "path string, text string")
    parsed = code.parse(src).cache()
    names = {r["scope_path"]: r["symbol_type"] for r in code.symbols(parsed).collect()}
    assert names == {"Base": "class", "Dog": "class", "Dog > bark": "method", "Dog > wag": "method", "main": "function"}
    kinds = {(r["src"], r["dst"], r["edge_type"]) for r in code.edges(parsed).collect()}
    assert {("Dog", "Base", "inherits"), ("pkg/dog.py", "os", "imports"), ("Dog", "Dog > bark", "defines")} <= kinds
    calls = catalog.resolve_calls(code.calls(parsed), code.symbols(parsed))
    assert {("main", "Dog > bark", "high"), ("Dog > bark", "Dog > wag", "high")} <= {(r["src"], r["dst"], r["confidence"]) for r in calls.collect()}
    made = code.code_chunks(src, code.symbols(parsed)).collect()
    assert any("Scope: Dog > bark" in r["text"] and "os.getcwd" in r["text"] for r in made)


def test_catalog(spark):
    f = spark.createDataFrame([("a.py", "one\nTwo\nthree two"), ("b.py", "x")], "path string, text string")
    assert [(r["line_no"], r["before"]) for r in catalog.grep(f, "two", context=1).collect()] == [(2, ["one"]), (3, ["Two"])]
    assert catalog.read_lines(f, spark.createDataFrame([("a.py", 2, 3), ("zz", 1, 1)], "path string, start int, end int")).orderBy("path").first()["text"] == "Two\nthree two"
    s = spark.createDataFrame([("a.py", "run", "Job<T> > run", "method", 3, 9, None), ("b.py", "run", "Other > run", "method", 1, 2, "m 1")], "path string, name string, scope_path string, symbol_type string, start_line int, end_line int, moniker string")
    asked = spark.createDataFrame([(1, "Job > run"), (2, "run"), (3, "Nope > walk"), (4, "Nope > run")], "request_id long, scope string")
    status = {r["request_id"]: r["status"] for r in catalog.snippet_status(catalog.resolve_symbols(s, asked), asked).collect()}
    assert status == {1: "found", 2: "ambiguous", 3: "none", 4: "suggestions"}
    occ = spark.createDataFrame([("f", "def", 10, 20, True), ("f", "ref", 15, 15, False), ("f", "far", 30, 30, False), ("f", "local 1", 1, 1, True)], "path string, symbol string, start int, end int, is_definition boolean")
    assert {(r["src"], r["dst"], r["edge_type"]) for r in catalog.occurrence_edges(occ).collect()} == {("f", "def", "defines"), ("def", "ref", "calls"), ("f", "far", "calls")}
    after = catalog.write_note(f, spark.createDataFrame([("a.py", "four")], "path string, text string"), "append")
    assert after.filter("path = 'a.py'").first()["text"].endswith("three two\nfour")
    with pytest.raises(ValueError):
        catalog.write_note(f, f.limit(1))
    notes = spark.createDataFrame([("old.md", "t"), ("n.md", "[[old]] [[old|x]]")], "path string, text string")
    assert {r["path"]: r["text"] for r in catalog.move_note(notes, "old.md", "new.md").collect()} == {"new.md": "t", "n.md": "[[new]] [[old|x]]"}


TEMPLATE = "---\nname: adr\nfields:\n  status: {type: enum, required: true, values: [open, done]}\n  date: date\n  n: number\nsections: [Context]\nmin_words: 3\n---\n"


def test_validation(spark):
    t = validate.load_template(TEMPLATE)
    rows = [("ok", "adr", '{"status":"open","date":"2024-01-01","n":1}', "# Context\nenough words"), ("bad", "adr", '{"status":"shut","date":"soon","n":"x"}', "x"), ("gone", "adr", None, "# Context a b"), ("odd", "zzz", None, "")]
    notes = spark.createDataFrame(rows, "path string, template string, frontmatter string, body string")
    found = validate.issues(notes, [t])
    by = {}
    for r in found.collect():
        by.setdefault(r["path"], set()).add((r["severity"], r["field"] or r["message"]))
    assert "ok" not in by and by["odd"] == {("warning", "unknown template zzz")}
    assert by["bad"] == {("error", "status"), ("error", "date"), ("error", "n"), ("warning", "missing section Context"), ("warning", "fewer than 3 words")}
    assert ("error", "status") in by["gone"]
    assert {r["path"]: r["valid"] for r in validate.validity(notes, found).collect()} == {"ok": True, "bad": False, "gone": False, "odd": True}


def test_broken_links(spark, edges):
    have = spark.createDataFrame([(f"notes/{n}.md",) for n in ("rust", "async", "ml")], "path string")
    assert {r["dst"] for r in validate.broken_links(edges, have).collect()} == {"notes/web.md"}


def test_federation(spark):
    e = spark.createDataFrame([("a", "x", None, "y"), ("a", "y", "b", "z"), ("b", "z", None, "w")], "corpus string, src string, target_corpus string, dst string")
    start = spark.createDataFrame([("a", "x")], "corpus string, node string")
    assert {(r["corpus"], r["node"], r["crossed"]) for r in federation.traverse(e, start).collect()} == {("a", "y", 0), ("b", "z", 1), ("b", "w", 1)}
    assert federation.traverse(e, start, go_on=False).count() == 2
    s = spark.createDataFrame([("b", "Foo", "Foo", "m 1 Foo#"), ("a", "Bar", "Bar", None)], "corpus string, name string, scope_path string, moniker string")
    refs = spark.createDataFrame([("a", "Foo"), ("a", "Bar"), ("a", "m 1 Foo#")], "corpus string, raw string")
    assert {(r["raw"], r["target_corpus"]) for r in federation.resolve_across(refs, s).collect()} == {("Foo", "b"), ("m 1 Foo#", "b")}


def test_text_functions(spark):
    df = spark.createDataFrame([("HTTPServer_parseURL", "conversion", "req", "Job<Vec<T>> > run", "shipping")], "a string, b string, c string, d string, e string")
    row = df.select(tx.split_identifier(F.col("a")), tx.stem(F.col("b")), tx.expand_abbreviation(F.col("c")), tx.normalize_scope(F.col("d")), tx.stem(F.col("e")), tx.code_tokens(F.lit("orderService 1234567"))).first()
    assert list(row) == [["http", "server", "parse", "url"], "convert", "request", "Job > run", "ship", ["order", "service"]]


def test_projection_puts_like_with_like(spark):
    texts = spark.createDataFrame([("a", "content", "parse request headers"), ("b", "content", "parses request header"), ("c", "content", "banana orange melon")], "id string, field string, text string")
    w = {r["id"]: r for r in vectors.project(texts).collect()}
    apart = lambda x, y: sum(((w[x][f"w{k}"] ^ w[y][f"w{k}"]) & (1 << 64) - 1).bit_count() for k in range(4))
    assert apart("a", "b") < apart("a", "c")
    assert vectors.project(texts, remove_common=True).count() == 3


def test_hamming_prior_reorders(spark):
    p = spark.createDataFrame([("near", 0, 0, 0, 1, 32, "code"), ("far", 0, 0, 0, 3, 5, "code")], "path string, w0 long, w1 long, w2 long, w3 long, flags int, modality string")
    q = spark.createDataFrame([(1, 0, 0, 0, 0)], "query_id long, q0 long, q1 long, q2 long, q3 long")
    assert [r["path"] for r in vectors.hamming_topk(p, q).orderBy("rank").collect()] == ["far", "near"]
    assert vectors.hamming_topk(p, q, prior=False).orderBy("rank").first()["path"] == "near"
    assert vectors.hamming_topk(p, q, early_exit=42).count() == 2


def test_stream_sync(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    schema = spark.createDataFrame([("a", "1")], "path string, content_hash string").schema
    for k, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "2")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"p{k}"))
        stream = sync.watch_table(spark, str(src / "*"), schema)
        sync.sync(stream, sync.table_sync(table), str(tmp_path / "state")).awaitTermination(60)
    assert {r["path"]: r["content_hash"] for r in sync.latest(spark, table).collect()} == {"a": "2", "b": "1"}


def test_entry_and_registry(spark):
    import __spark_entry__

    found, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(found) and len(found) > 50
