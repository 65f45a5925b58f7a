"""The engine's tables, derived from the star schema and the document tables; and the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions import text as tx
from strataq.functions.scale import spread, wide


class Tables:
    """Lazy tables of a directory of Parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def files(self) -> DataFrame:
        path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md"))
        return spread(self.raw("documents")).select(path.alias("path"), "text", F.col("source").alias("title"), F.when(F.col("lang") == "en", "docs").otherwise("code").alias("modality"), "lang", "source")

    def chunks(self) -> DataFrame:
        return self.files().select("path", "title", "modality", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))

    def queries(self) -> DataFrame:
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")

    def edges(self) -> DataFrame:
        def edge(df: DataFrame, a: tuple[str, str], b: tuple[str, str], kind: str, group: str, weight: float) -> DataFrame:
            node = lambda p, c: F.concat(F.lit(f"{p}/"), F.col(c).cast("string"))
            pair = df.select(node(*a).alias("src"), node(*b).alias("dst"))
            return pair.select("src", "dst", F.lit(kind).alias("edge_type"), F.lit(group).alias("class"), F.lit(weight).alias("weight"))

        def distinct(*keys: str) -> DataFrame:
            return wide(self.raw("lineitem").select(*keys), *keys).distinct()

        parts = [
            edge(self.raw("nation"), ("nation", "n_nationkey"), ("region", "n_regionkey"), "in_region", "structural", 1.0),
            edge(self.raw("customer"), ("customer", "c_custkey"), ("nation", "c_nationkey"), "in_nation", "structural", 1.0),
            edge(self.raw("supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "in_nation", "structural", 1.0),
            edge(self.raw("orders"), ("order", "o_orderkey"), ("customer", "o_custkey"), "ordered_by", "semantic", 0.8),
            edge(distinct("l_orderkey", "l_partkey"), ("order", "l_orderkey"), ("part", "l_partkey"), "contains", "hybrid", 0.6),
            edge(distinct("l_partkey", "l_suppkey"), ("part", "l_partkey"), ("supplier", "l_suppkey"), "supplied_by", "structural", 0.9),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def vectors(self) -> DataFrame:
        path = F.concat(F.lit("doc/"), F.floor(F.col("vec_id") / 3).cast("string"), F.lit(".md"))
        return self.raw("embeddings").select("vec_id", path.alias("path"), (F.col("vec_id") % 3).cast("int").alias("chunk_index"), (F.col("vec_id") % 3 == 0).alias("is_doc_level"), F.when(F.col("label") % 2 == 0, "docs").otherwise("code").alias("modality"), "embedding")

    def vector_queries(self) -> DataFrame:
        return self.raw("embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")

    def tagged(self) -> DataFrame:
        return self.files().select("path", F.array("lang", "source").alias("tags"))

    def symbols(self) -> DataFrame:
        return self.raw("part").select(
            F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.col("p_size").cast("string"), F.lit(".py")).alias("path"), F.col("p_name").alias("name"),
            F.concat("p_brand", F.lit(" > "), "p_name").alias("scope_path"), F.col("p_type").alias("symbol_type"), F.col("p_brand").alias("language"),
            F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"), F.col("p_partkey").alias("id"),
        )

    def follows(self) -> DataFrame:
        """A weighted graph of event types that follow each other."""
        from pyspark.sql import Window

        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        pairs = self.raw("events").select(F.col("event_type").alias("dst"), F.lag("event_type").over(w).alias("src")).filter("src is not null")
        return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).select("src", "dst", F.lit("follows").alias("edge_type"), F.lit("semantic").alias("class"), "weight")


#: The same tables for DuckDB, each a SELECT over what comes before it.
VIEWS = {
    "files": "SELECT 'doc/' || doc_id || '.md' AS path, text, source AS title, CASE WHEN lang = 'en' THEN 'docs' ELSE 'code' END AS modality, lang, source FROM documents",
    "chunks": "SELECT path, title, modality, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS chunk_index, unnest(string_split(text, chr(10))) AS text FROM files",
    "queries": "SELECT item_id AS query_id, text FROM benchmark",
    "edges": """
      SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst, 'in_region' AS edge_type, 'structural' AS class, 1.0::DOUBLE AS weight FROM nation
      UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'in_nation', 'structural', 1.0 FROM customer
      UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'in_nation', 'structural', 1.0 FROM supplier
      UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey, 'ordered_by', 'semantic', 0.8 FROM orders
      UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'part/' || l_partkey, 'contains', 'hybrid', 0.6 FROM lineitem
      UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'supplier/' || l_suppkey, 'supplied_by', 'structural', 0.9 FROM lineitem""",
    "vectors": "SELECT vec_id, 'doc/' || (vec_id // 3) || '.md' AS path, CAST(vec_id % 3 AS INTEGER) AS chunk_index, vec_id % 3 = 0 AS is_doc_level, CASE WHEN label % 2 = 0 THEN 'docs' ELSE 'code' END AS modality, embedding FROM embeddings",
    "vector_queries": "SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0",
    "symbols": "SELECT 'src/' || lower(p_type) || '/' || p_size || '.py' AS path, p_name AS name, p_brand || ' > ' || p_name AS scope_path, p_type AS symbol_type, p_brand AS language, p_size AS start_line, p_size + 10 AS end_line, p_partkey AS id FROM part",
    "follows": "SELECT src, dst, 'follows' AS edge_type, 'semantic' AS class, count(*)::DOUBLE AS weight FROM (SELECT event_type AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM events) WHERE src IS NOT NULL GROUP BY src, dst",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` after the named views and those they read."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and f"FROM {other}" in VIEWS[name]:
                add(other)
        if name not in wanted:
            wanted.append(name)

    for n in names.split():
        add(n)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"


def stem_sql(w: str) -> str:
    """The suffix rules in their order; a doubled letter before ``ing`` is single."""
    cases = []
    for suffix, dropped, ending, longer in tx.STEM_RULES:
        base = f"left({w}, length({w}) - {dropped})"
        if suffix == "ing":
            base = f"CASE WHEN length({base}) > 2 AND {base}[-1] = {base}[-2] THEN left({base}, length({base}) - 1) ELSE {base} END"
        cases.append(f"WHEN {w} LIKE '%{suffix}' AND length({w}) > {longer}" + (f" AND {w} NOT LIKE '%ss'" if suffix == "s" else "") + f" THEN {base} || '{ending}'")
    return f"CASE WHEN length({w}) <= 4 THEN NULL {' '.join(cases)} END"
