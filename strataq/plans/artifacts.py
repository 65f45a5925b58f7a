"""Queries of sources made of the tables: code of several languages, PDF, any files, and a stream; with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions import lean
from strataq.functions.scale import cut, spread
from strataq.operators import catalog, channels, community, graph, search
from strataq.sources import artifacts, code, files, languages, pdf, store
from strataq.streaming import sync

from .queries import ORACLE_SQL, _corpus, query, rounded
from .tables import Tables, with_views

#: A file of each language around a word W: its text, and the symbols, imports, bases and calls it has.
SOURCES = {
    "rs": "use crate::W::Pool;\n// fn no() {}\npub struct WStore {\n    x: i32,\n}\nimpl Display for WStore {\n    pub fn run(&self) -> i32 {\n        helper(\"fn odd() {\")\n    }\n}\nfn helper(a: &str) -> i32 { 1 }\n",
    "go": "package main\nimport (\n\t\"lib/W\"\n)\ntype WStore struct {\n\tx int\n}\nfunc (s *WStore) Run() int {\n\treturn helper(`func odd() {`)\n}\nfunc helper(a string) int { return 1 }\n",
    "ts": "import { a } from \"./W\";\nexport class WStore extends Base {\n  run(a: string) {\n    return helper(`}`);\n  }\n}\nfunction helper(n) { return n; }\n",
    "java": "import lib.W;\npublic class WStore extends Base {\n  public int run() {\n    return helper(1); /* } */\n  }\n}\n",
    "cpp": "#include \"W.h\"\nnamespace ns {\nclass WStore : public Base {\n  int run(int a) { return helper(a); }\n};\n}\nint helper(int n) {\n  return n;\n}\n",
    "py": "from lib import W\nclass WStore(Base):\n    def run(self):\n        return helper(1)\ndef helper(n):\n    return n\n",
}
#: (kind, what, of) that each has; calls as (caller, callee).
FACTS = {
    "rs": (("struct", "WStore"), ("method", "WStore > run"), ("function", "helper"), ("imports", "crate::W::Pool"), ("implements", "Display"), ("call", "WStore > run: helper")),
    "go": (("struct", "WStore"), ("method", "WStore > Run"), ("function", "helper"), ("imports", "lib/W"), ("call", "WStore > Run: helper")),
    "ts": (("class", "WStore"), ("method", "WStore > run"), ("function", "helper"), ("imports", "./W"), ("inherits", "Base"), ("call", "WStore > run: helper")),
    "java": (("class", "WStore"), ("method", "WStore > run"), ("imports", "lib.W"), ("inherits", "Base"), ("call", "WStore > run: helper")),
    "cpp": (("class", "ns > WStore"), ("function", "helper"), ("method", "ns > WStore > run"), ("imports", "W.h"), ("inherits", "Base"), ("call", "ns > WStore > run: helper")),
    "py": (("class", "WStore"), ("method", "WStore > run"), ("function", "helper"), ("imports", "lib.W"), ("inherits", "Base"), ("call", "WStore > run: helper")),
}
_FACT_ROWS = ", ".join(f"('{ext}', '{kind}', '{what}')" for ext, facts in FACTS.items() for kind, what in facts)


def code_files(t: Tables) -> DataFrame:
    """A file of one of the languages for each part, around its number."""
    ext, k = F.lit(None).cast("string"), F.col("p_partkey")
    text = F.lit(None).cast("string")
    for n, (e, body) in enumerate(SOURCES.items()):
        own = k % len(SOURCES) == n
        ext, text = F.when(own, e).otherwise(ext), F.when(own, body).otherwise(text)
    word = F.concat(F.lit("w"), k.cast("string"))
    return t.raw("part").select(F.concat(F.lit("src/"), k.cast("string"), F.lit("."), ext).alias("path"), F.replace(text, F.lit("W"), word).alias("text"))


@query(
    f"""WITH e AS (SELECT p_partkey AS k, CASE p_partkey % {len(SOURCES)} {" ".join(f"WHEN {n} THEN '{e}'" for n, e in enumerate(SOURCES))} END AS ext FROM part)
SELECT 'src/' || k || '.' || ext AS path, kind, replace(what, 'W', 'w' || k) AS what FROM e JOIN (VALUES {_FACT_ROWS}) f(x, kind, what) ON x = ext"""
)
def code_of_languages(t: Tables) -> DataFrame:
    """Symbols, imports, bases and calls of source in six languages."""
    found = languages.parse(code_files(t))
    edges = found.filter("kind = 'edge' and edge_type != 'defines'").select("path", F.col("edge_type").alias("kind"), F.col("dst").alias("what"))
    calls = found.filter("kind = 'call'").select("path", "kind", F.concat("caller", F.lit(": "), "callee").alias("what"))
    return found.filter("kind = 'symbol'").select("path", F.col("symbol_type").alias("kind"), F.col("scope_path").alias("what")).unionByName(edges).unionByName(calls)


@query("SELECT 'src/' || p_partkey || '.py' AS path, 'w' || p_partkey || 'Store > run' AS src, 'helper' AS dst, 'high' AS confidence FROM part WHERE p_partkey % 6 = 5")
def calls_of_languages(t: Tables) -> DataFrame:
    """Calls of the Python files among them, resolved to symbols of the same file."""
    found = languages.parse(code_files(t).filter(F.col("path").endswith(".py")))
    calls, symbols = code.calls(found), code.symbols(found)
    done = catalog.resolve_calls(calls, symbols).filter("edge_type = 'calls'")
    return done.select(F.concat(F.lit("src/"), F.regexp_extract("src", r"^w(\d+)", 1), F.lit(".py")).alias("path"), "src", "dst", "confidence")


def _pdf(name: Column, kind: Column) -> Column:
    """A PDF of two pages with a page tree; the second page comes first in the file."""
    second = F.concat(F.lit("BT /F1 12 Tf 72 700 Td ("), kind, F.lit(") Tj 0 -14 Td (caf\\351 \\(two\\)) Tj ET"))
    first = F.concat(F.lit("BT /F1 12 Tf [("), name, F.lit(") -300 (page)] TJ ET"))
    stream = lambda n, body: F.concat(F.lit(f"{n} 0 obj\n<< /Length "), F.length(body).cast("string"), F.lit(" >>\nstream\n"), body, F.lit("\nendstream\nendobj\n"))
    text = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [ 4 0 R 3 0 R ] /Count 2 >>\nendobj\n"),
        F.lit("3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>\nendobj\n4 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>\nendobj\n"),
        stream(5, second), stream(6, first), F.lit("trailer\n<< /Root 1 0 R >>\n%%EOF\n"),
    )
    return text.cast("binary")


@query("SELECT 'p/' || p_partkey || '.pdf' AS path, unnest([1, 2]) AS page, unnest([p_name || ' page', p_type || chr(10) || 'café (two)']) AS text FROM part")
def pdf_pages(t: Tables) -> DataFrame:
    rows = t.raw("part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), _pdf(F.col("p_name"), F.col("p_type")).alias("content"))
    return pdf.pdf_files(rows)


@query(
    """SELECT 'f/' || p_partkey || ['.md', '.html', '.pdf', '.rs', '.txt'][p_partkey % 5 + 1] AS path, ['markdown', 'document', 'document', 'code', 'text'][p_partkey % 5 + 1] AS kind, CASE WHEN p_partkey % 5 = 3 THEN 'rust' WHEN p_partkey % 5 = 1 THEN 'html' END AS language,
CASE WHEN p_partkey % 5 < 2 THEN p_name END AS title, CASE p_partkey % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN p_type WHEN 2 THEN '<!-- Page 1 -->' || chr(10) || chr(10) || p_name || ' page' || chr(10) || chr(10) || '<!-- Page 2 -->' || chr(10) || chr(10) || p_type || chr(10) || 'café (two)' ELSE p_type END AS text FROM part WHERE p_partkey % 6 <> 5"""
)
def artifact_texts(t: Tables) -> DataFrame:
    """Files of five kinds, each through its extractor; those with a binary ending are left out."""
    k = F.col("p_partkey")
    n = k % 5
    ending = F.when(k % 6 == 5, ".png").otherwise(F.element_at(F.array(*[F.lit(e) for e in (".md", ".html", ".pdf", ".rs", ".txt")]), (n + 1).cast("int")))
    page = F.concat(F.lit("<html><head><title>"), "p_name", F.lit("</title></head><body><p>"), "p_type", F.lit("</p></body></html>"))
    content = F.when(n == 0, F.concat(F.lit("---\nkind: x\n---\n# "), "p_name").cast("binary")).when(n == 1, page.cast("binary")).when(n == 2, _pdf(F.col("p_name"), F.col("p_type"))).otherwise(F.col("p_type").cast("binary"))
    rows = t.raw("part").select(F.concat(F.lit("f/"), k.cast("string"), ending).alias("path"), content.alias("content"))
    return artifacts.extract(rows)


@query(ORACLE_SQL["tumbling_windows"])
def streamed_windows(t: Tables) -> DataFrame:
    """The same windows by a stream over the table: states are kept over its batches, the last result is whole."""
    found = _streamed(t, lambda events: sync.windowed(events.withColumn("ts", F.col("ts").cast("timestamp")), late="1 hour"))
    return rounded(found.withColumn("start", F.col("start").cast("timestamp_ntz")), "total")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event FROM events GROUP BY user_id")
def streamed_table(t: Tables) -> DataFrame:
    """The last event of each user, kept by batches of changes."""
    folder = f"{_shared(t)}/table-{uuid.uuid4().hex}"
    stream = _stream(t).select("user_id", "event_type", F.col("event_id").alias("event"))

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("user_id").agg(F.max_by("event_type", "event").alias("event_type"), F.max("event").alias("event"))
        sync.table_sync(folder, "user_id")(newest, number)

    sync.sync(stream, apply, f"{folder}-progress").awaitTermination()
    return sync.latest(t.spark, folder, key="user_id").select("user_id", "event_type", "event")


def _shared(t: Tables) -> str:
    cut(t.spark.range(1))  # sets the shared folder if none is set yet
    return t.spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _stream(t: Tables) -> DataFrame:
    """The events as a stream of files."""
    return sync.watch_table(t.spark, f"{t.dir}/[e]vents.parquet", t.raw("events").schema)


def _streamed(t: Tables, plan) -> DataFrame:
    """The whole result of a streaming aggregation after all input that is there."""
    folder = f"{_shared(t)}/stream-{uuid.uuid4().hex}"
    writer = plan(_stream(t)).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}-progress")
    done = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(folder)).trigger(availableNow=True).start()
    done.awaitTermination()
    return t.spark.read.parquet(folder)


_HEX = "('0x' || hex[2 * {0} + 1:2 * {0} + 2])::INTEGER / 127.5::DOUBLE - 1"


@query(
    f"""WITH f AS (SELECT o_orderkey % 500 AS id, CAST(o_custkey % 4 AS INTEGER) AS channel, o_orderpriority || o_custkey % 20 AS text, sum((o_orderkey % 7)::DOUBLE) AS weight FROM orders GROUP BY ALL),
h AS (SELECT channel, text, sha256(channel || chr(0) || text || chr(0) || '0') || sha256(channel || chr(0) || text || chr(0) || '1') AS hex FROM (SELECT DISTINCT channel, text FROM f)),
v AS (SELECT channel, text, list_transform(range(64), lambda i: {_HEX.format("i")}) AS v FROM h),
u AS (SELECT channel, text, unnest(range(64)) AS d, unnest(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS x FROM v),
s AS (SELECT id, channel, d, sum(weight * x) AS x FROM f JOIN u USING (channel, text) WHERE weight > 0 GROUP BY id, channel, d),
r AS (SELECT c AS channel, k, sha256('channel ' || c || ' row ' || k) AS hex FROM range(4) a(c), range(64) b(k)),
p AS (SELECT channel, k, list_transform(range(64), lambda d: {_HEX.format("((d * 7 + k * 3) % 32)")}) AS v FROM r),
q AS (SELECT channel, k, unnest(range(64)) AS d, unnest(v) AS y FROM p),
b AS (SELECT id, channel, k, sum(x * y) > 0 AS up FROM s JOIN q USING (channel, d) GROUP BY id, channel, k),
w AS (SELECT id, channel, sum(CASE WHEN up THEN (1::HUGEINT << k::INTEGER) ELSE 0 END) AS w FROM b GROUP BY id, channel)
SELECT id, {", ".join(f"coalesce(max(CASE WHEN channel = {k} THEN CASE WHEN w >= (1::HUGEINT << 63) THEN w - (1::HUGEINT << 64) ELSE w END END), 0)::BIGINT AS w{k}" for k in range(4))}
FROM (SELECT DISTINCT id FROM f) LEFT JOIN w USING (id) GROUP BY id"""
)
def channel_fingerprints(t: Tables) -> DataFrame:
    """Fingerprints in four channels of features drawn from all orders."""
    k, s = F.col("o_orderkey"), F.concat("o_orderpriority", (F.col("o_custkey") % 20).cast("string"))
    features = t.raw("orders").select((k % 500).alias("id"), (F.col("o_custkey") % 4).cast("int").alias("channel"), s.alias("text"), (k % 7).cast("double").alias("weight"))
    return channels.project(features)


@query(
    """WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 6 = 5),
f AS (SELECT k, unnest([0, 0, 0, 1, 2, 3]) AS channel, unnest(['run', 'self', '-', 'helper', '-', 'FunctionDef->Return']) AS text FROM p)
SELECT 'src/' || k || '.py#w' || k || 'Store > run' AS id, CAST(channel AS INTEGER) AS channel, text, CASE text WHEN 'run' THEN 1.0 WHEN 'self' THEN 0.85 WHEN 'helper' THEN round(1 / sqrt(3), 6) ELSE 1.0 END::DOUBLE AS weight FROM f WHERE text <> '-'"""
)
def symbol_semantics(t: Tables) -> DataFrame:
    """What the methods of all Python files among the sources say: names, parameters, calls, and a step of syntax."""
    found = channels.code_features(code_files(t)).filter(F.col("id").endswith("Store > run"))
    kept = found.filter((F.col("channel") < 3) | (F.col("text") == "FunctionDef->Return"))
    return rounded(kept.select("id", "channel", "text", "weight"), "weight")


@query(
    """SELECT 'n/' || p_partkey || '.md' AS path, CASE WHEN p_partkey % 4 = 3 THEN 'Head ' || p_name ELSE p_name END AS title, CASE WHEN p_partkey % 4 < 3 THEN 'item' END AS template,
CASE WHEN p_partkey % 4 < 3 THEN 'a,b,' ELSE '' END || 'inline' AS tags, p_type AS link, '# Head ' || p_name || chr(10) || 'see [[' || p_type || ']] #inline' AS body, CASE WHEN p_partkey % 4 < 3 THEN p_size ELSE -1 END AS size FROM part"""
)
def markdown_notes(t: Tables) -> DataFrame:
    """Notes with and without frontmatter, one of each four with none: title, template, tags, links, body, a field."""
    k = F.col("p_partkey")
    front = F.concat(F.lit("---\r\ntitle: "), "p_name", F.lit("\r\ntemplate: item\r\ntags: [a, b]\r\nsize: "), F.col("p_size").cast("string"), F.lit("\r\n---\r\n"))
    body = F.concat(F.lit("# Head "), "p_name", F.lit("\nsee [["), "p_type", F.lit("]] #inline"))
    rows = spread(t.raw("part")).select(F.concat(F.lit("n/"), k.cast("string"), F.lit(".md")).alias("path"), F.concat(F.when(k % 4 < 3, front).otherwise(""), body).alias("text"))
    found = files.markdown(rows)
    size = F.try_variant_get(F.try_parse_json("frontmatter"), "$.size", "int")
    return found.select("path", "title", "template", F.array_join("tags", ",").alias("tags"), F.get("links", F.lit(0))["target"].alias("link"), "body", F.coalesce(size, F.lit(-1)).alias("size"))


@query(
    """WITH m AS (SELECT 'lib' || n_nationkey AS dir, CASE WHEN n_nationkey % 2 = 0 THEN 'cargo' ELSE 'npm' END AS manager, lower(n_name) AS package, '1.' || n_regionkey || '.0' AS version FROM nation)
SELECT 'lib' || c_nationkey || '/src/f' || c_custkey || '.rs' AS path, dir, manager, package, version FROM customer JOIN m ON dir = 'lib' || c_nationkey"""
)
def packages_of_files(t: Tables) -> DataFrame:
    """The nearest manifest above each file, of two kinds."""
    n = t.raw("nation")
    key, version = F.col("n_nationkey"), F.concat(F.lit("1."), F.col("n_regionkey").cast("string"), F.lit(".0"))
    folder = F.concat(F.lit("lib"), key.cast("string"))
    cargo = F.concat(F.lit('[package]\nname = "'), F.lower("n_name"), F.lit('"\nversion = "'), version, F.lit('"\n'))
    npm = F.concat(F.lit('{"name": "'), F.lower("n_name"), F.lit('", "version": "'), version, F.lit('"}'))
    found = files.manifests(n.select(F.concat(folder, F.when(key % 2 == 0, "/Cargo.toml").otherwise("/package.json")).alias("path"), F.when(key % 2 == 0, cargo).otherwise(npm).alias("text")))
    own = t.raw("customer").select(F.concat(F.lit("lib"), F.col("c_nationkey").cast("string"), F.lit("/src/f"), F.col("c_custkey").cast("string"), F.lit(".rs")).alias("path"))
    return files.enclosing_manifest(own, found)


@query(
    """WITH h AS (SELECT o_custkey AS id, max(o_orderkey) AS seq FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey), n AS (SELECT o_custkey AS id, max(o_orderkey) AS seq FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey)
SELECT id, seq AS w0 FROM n UNION ALL SELECT id, seq FROM h WHERE id NOT IN (SELECT id FROM n)"""
)
def fingerprint_upserts(t: Tables) -> DataFrame:
    """Fingerprints of customers from even orders, then the last of the odd ones in their place."""
    o = t.raw("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("w0"))
    held = o.filter("w0 % 2 = 0").groupBy("id").agg(F.max("w0").alias("w0"))
    return store.upsert_prints(held, o.filter("w0 % 2 = 1").withColumn("seq", F.col("w0")))


@query("SELECT 'p' || p_partkey % 100 AS path, p_partkey AS chunk_index FROM part WHERE p_partkey % 100 >= 30 OR p_partkey // 100 % 2 = 0")
def vector_upserts(t: Tables) -> DataFrame:
    """All vectors of thirty files replaced by those of even hundreds."""
    path = F.concat(F.lit("p"), (F.col("p_partkey") % 100).cast("string")).alias("path")
    rows = t.raw("part").select(path, F.col("p_partkey").alias("chunk_index"))
    return store.upsert_vectors(rows, rows.filter("cast(substring(path, 2) as int) < 30 and floor(chunk_index / 100) % 2 = 0"))


@query("SELECT vec_id FROM embeddings WHERE label % 3 <> 0")
def stale_vectors(t: Tables) -> DataFrame:
    rows = t.raw("embeddings").select("vec_id", F.when(F.col("label") % 3 == 0, "now").otherwise("before").alias("model"))
    return sync.stale(rows, "now").select("vec_id")


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size > 25 THEN p_type ELSE p_name END AS text FROM part")
def bundle_round_trip(t: Tables) -> DataFrame:
    """Two tables written as a bundle, checked and read, one with the normalised text of some files in place."""
    folder = f"{_shared(t)}/bundle-{uuid.uuid4().hex}"
    p = t.raw("part")
    path = F.col("p_partkey").cast("string").alias("path")
    store.export({"files": p.select(path, F.col("p_name").alias("text"), F.col("p_name").alias("name")), "projections": p.filter("p_size > 25").select(path, F.col("p_type").alias("projection_text"))}, folder, "model", 64)
    read = store.load(t.spark, folder, "model", 64)
    return store.projected(read["files"], read["projections"]).select(F.col("path").cast("long").alias("id"), "name", "text")


@query(
    """WITH q AS (SELECT n_nationkey AS query_id, n_name AS text FROM nation), h AS (SELECT n_nationkey AS query_id, unnest([1, 2]) AS rank, unnest(['src/a.rs', 'doc/b.md']) AS path, unnest([0.5, 0.25]) AS score FROM nation WHERE n_nationkey % 5 <> 0)
SELECT query_id, '# Search: "' || text || '" [mode: hybrid, hits: ' || CASE WHEN query_id % 5 = 0 THEN '0]' || chr(10) || chr(10) || 'No matching results found.' || chr(10)
  ELSE '2]' || chr(10) || chr(10) || '## Code hits (1)' || chr(10) || chr(10) || '1. `src/a.rs` [score: 0.500]' || chr(10) || '-> path src/a.rs, chunk 0' || chr(10) || chr(10) || '## Document hits (1)' || chr(10) || chr(10) || '1. `doc/b.md` [score: 0.250]' || chr(10) || '-> path doc/b.md, chunk 0' || chr(10) || chr(10) END AS lean FROM q"""
)
def lean_results(t: Tables) -> DataFrame:
    n = t.raw("nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("text"))
    hit = lambda rank, path, score, kind: F.struct(F.lit(rank).alias("rank"), F.lit(path).alias("path"), F.lit(score).alias("score"), F.lit(kind).alias("modality"))
    hits = n.filter("query_id % 5 != 0").select("query_id", F.explode(F.array(hit(2, "doc/b.md", 0.25, "docs"), hit(1, "src/a.rs", 0.5, "code"))).alias("h")).select("query_id", "h.*")
    return lean.lean_search(hits, n)


@query(
    with_views(
        "edges",
        """+n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), c AS (SELECT node, regexp_extract(node, '^([a-z]+)', 1) AS community FROM n),
i AS (SELECT dst AS node, count(*) AS in_degree FROM edges GROUP BY dst), s AS (SELECT community, count(*) AS n FROM c GROUP BY community),
r AS (SELECT community, node, coalesce(in_degree, 0) AS in_degree, row_number() OVER (PARTITION BY community ORDER BY coalesce(in_degree, 0) DESC, node) AS k FROM c LEFT JOIN i USING (node))
SELECT community, n, node, in_degree FROM r JOIN s USING (community) WHERE k <= 5""",
    )
)
def architecture_view(t: Tables) -> DataFrame:
    """The kinds of nodes as communities, each with the five that most edges point to."""
    e = t.edges()
    found = community.architecture(e, graph.nodes_of(e).withColumn("community", F.regexp_extract("node", "^([a-z]+)", 1)))
    return found.select("community", "n", "node", "in_degree")


@query(ORACLE_SQL["fast_search"])
def explained_fast(t: Tables) -> DataFrame:
    """The fast search by its parts: what the signals add up to is its ranking."""
    corpus, _ = _corpus(t)
    found = search.explain_fast(corpus, t.queries())
    total = F.col("bm25_part") + F.col("binary_part") + F.col("ppr_part")
    return rounded(found.select("query_id", "path", total.alias("score"), "rank"), "score")
