"""Dense and binary retrieval: cosine top-k, search by depth, Hamming scan with priors, fingerprint projection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.scale import cut
from strataq.functions.text import code_tokens, expand_abbreviation, stem
from strataq.functions.vector import WORDS, l2_normalize, prior_multiplier

from . import topk
from .fusion import ranked, rrf, union_lists

BITS = 64 * WORDS
#: Bytes of queries that rows are compared with at a time.
BLOCK_BYTES = 64 << 20
#: Scores of a batch of rows that are held at a time; several tables of this size are.
SCORES = 1 << 19


def _query_blocks(queries: DataFrame, columns: list[str], width: int) -> list[tuple[DataFrame, pa.Table]]:
    """The queries in blocks of a bounded size: (q, query_id) as a table, and q with ``columns`` on the driver.

    A block is what a batch of rows is compared with, as a broadcast. Its rows are counted first.
    """
    numbered = cut(queries.select("query_id", *columns).withColumn("q", F.monotonically_increasing_id()))
    n = -(-numbered.count() * width // BLOCK_BYTES)
    parts = [numbered] if n <= 1 else [numbered.filter(F.pmod(F.xxhash64("q"), F.lit(n)) == k) for k in range(n)]
    return [(part.select("q", "query_id"), part.select("q", *columns).toArrow()) for part in parts]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, level: str | None = None, modality: str | None = None) -> DataFrame:
    """query_id, rank, path, chunk_index, score: the ``k`` documents nearest by cosine, best row of each.

    vectors: path, chunk_index, is_doc_level, modality, embedding; queries: query_id, embedding. level: chunk,
    doc, or both. Vectors of another length than a query's don't meet it. The scan is exact: each batch of rows
    is multiplied with a block of queries, and only its best ``k`` documents for each query are shuffled.
    """
    rows = vectors
    if level in ("chunk", "doc"):
        rows = rows.filter(F.col("is_doc_level") == (level == "doc"))
    if modality not in (None, "both"):
        rows = rows.filter(F.col("modality") == modality)
    rows = rows.select("path", "chunk_index", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null")
    kinds = dict(rows.dtypes)
    found = []
    for names, held in _query_blocks(queries.filter("embedding is not null").withColumn("embedding", F.col("embedding").cast("array<double>")), ["embedding"], 4096):
        sizes = held.column("embedding").combine_chunks().value_lengths().to_numpy()
        by_size = {int(d): (held.column("q").to_numpy()[sizes == d], _matrix(held.column("embedding").filter(pa.array(sizes == d)))) for d in np.unique(sizes)}
        shared = vectors.sparkSession.sparkContext.broadcast(by_size)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = topk.sorted_batch(batch, "path", "chunk_index")
                lengths = batch.column("embedding").value_lengths().to_numpy()
                for d, (q_ids, wanted) in shared.value.items():
                    own = batch.filter(pa.array(lengths == d))
                    if not own.num_rows:
                        continue
                    x = _matrix(own.column("embedding"))
                    nx, nq = np.linalg.norm(x, axis=1), np.linalg.norm(wanted, axis=1)
                    path = own.column("path").dictionary_encode()
                    starts = np.flatnonzero(np.append(True, np.diff(path.indices.to_numpy()) != 0))  # rows of a path stand together
                    wide = min(topk.QUERIES, max(1, SCORES // len(x)))  # few queries rather than few rows: the best of a batch stay as few
                    for q0 in range(0, len(q_ids), wide):
                        q1 = min(q0 + wide, len(q_ids))
                        for p0 in range(0, len(starts), max(1, topk.CELLS // (q1 - q0) // 4)):
                            some = starts[p0 : p0 + max(1, topk.CELLS // (q1 - q0) // 4)]
                            end = starts[p0 + len(some)] if p0 + len(some) < len(starts) else len(x)
                            scale = np.outer(nq[q0:q1], nx[some[0] : end])
                            score = np.divide(wanted[q0:q1] @ x[some[0] : end].T, scale, out=np.zeros_like(scale), where=scale > 0)
                            rounded = np.round(score, 9)
                            best = np.maximum.reduceat(rounded, some - some[0], axis=1)
                            q, at = topk.best_cells(best, k)
                            r = some[at]
                            last = np.append(some[1:], end)[at]
                            while (miss := (rounded[q, r - some[0]] < best[q, at]) & (r + 1 < last)).any():  # to the path's first row that has its best
                                r = np.where(miss, r + 1, r)
                            yield pa.RecordBatch.from_arrays([pa.array(q_ids[q0 + q]), own.column("path").take(pa.array(r)), own.column("chunk_index").take(pa.array(r)), pa.array(score[q, r - some[0]])], ["q", "path", "chunk_index", "score"])

        scored = rows.mapInArrow(run, f"q long, path {kinds['path']}, chunk_index {kinds['chunk_index']}, score double")
        found.append(scored.join(F.broadcast(names), "q").drop("q"))  # as many rows as a block has queries
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy("query_id", "path").agg(F.max(F.struct(F.round("score", 9).alias("s"), -F.col("chunk_index"), "score", "chunk_index")).alias("b"))
    return ranked(best.select("query_id", "path", "b.chunk_index", "b.score"), k).select("query_id", "rank", "path", "chunk_index", "score")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (path, n, embedding) the sums by path within each batch."""
    for batch in batches:
        lengths = batch.column("embedding").value_lengths().to_numpy()
        for d in np.unique(lengths):
            own = batch.filter(pa.array(lengths == d))
            own = topk.sorted_batch(own, "path")
            starts = np.flatnonzero(np.append(True, np.diff(own.column("path").dictionary_encode().indices.to_numpy()) != 0))
            total = np.add.reduceat(_matrix(own.column("embedding")), starts, axis=0)
            n = np.add.reduceat(own.column("n").to_numpy(), starts)
            yield pa.RecordBatch.from_arrays([own.column("path").take(pa.array(starts)), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], ["path", "n", "embedding"])


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """path, n, embedding: the mean of its chunks' vectors for each document, summed in batches before and after
    the shuffle, so that a row a document and batch is shuffled and not one a component."""
    rows = vectors.select("path", F.lit(1).cast("long").alias("n"), F.col("embedding").cast("array<double>").alias("embedding")).filter("size(embedding) > 0")
    schema = f"path {dict(rows.dtypes)['path']}, n long, embedding array<double>"
    summed = rows.mapInArrow(_sums, schema).repartition("path").sortWithinPartitions("path").mapInArrow(_sums, schema)
    # batches may part a document once more: the few parts are added up
    whole = summed.groupBy("path").agg(F.sum("n").alias("n"), F.collect_list("embedding").alias("parts"))
    added = F.reduce("parts", F.transform(F.get("parts", F.lit(0)), lambda x: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return whole.select("path", "n", F.transform(added, lambda x: x / F.col("n")).alias("embedding"))


def doc_vectors(vectors: DataFrame) -> DataFrame:
    """A vector for each document: the mean of its chunks' vectors, of unit length."""
    return mean_vectors(vectors).select("path", F.lit(0).alias("chunk_index"), F.lit(True).alias("is_doc_level"), l2_normalize(F.col("embedding")).alias("embedding"))


def semantic(vectors: DataFrame, queries: DataFrame, k: int = 10, depth: str = "adaptive", modality: str | None = None) -> DataFrame:
    """precise ranks all rows, broad documents' vectors; adaptive fuses both, each at twice the limit."""
    if depth == "precise":
        return vector_topk(vectors, queries, k, None, modality)
    if depth == "broad":
        return vector_topk(vectors, queries, k, "doc", modality)
    if depth != "adaptive":
        raise ValueError(f"no search depth {depth!r}")
    lists = {"chunks": vector_topk(vectors, queries, 2 * k, None, modality), "docs": vector_topk(vectors, queries, 2 * k, "doc", modality)}
    return rrf(union_lists(lists), k)


def hamming_topk(prints: DataFrame, queries: DataFrame, k: int = 10, prior: bool = True, modality: str | None = None, early_exit: int | None = None) -> DataFrame:
    """query_id, rank, path, distance, score = (1 - distance / 256) x prior of the nearest fingerprints.

    prints: path, w0..w3, flags, modality; queries: query_id, q0..q3. Of each query's pool of max(2k, 50)
    nearest, the prior reorders the best ``k``. With ``early_exit`` rows whose first word differs in more bits
    are passed over, unless that leaves a query fewer than ``k``: then it is searched in full. Each batch of rows
    meets a block of queries, and its pool of nearest is all that is shuffled.
    """
    rows = prints if modality in (None, "both") else prints.filter(F.col("modality") == modality)
    rows = rows.select("path", *[F.col(f"w{n}").cast("long").alias(f"w{n}") for n in range(WORDS)], F.col("flags").cast("int").alias("flags"))
    pool, kind, found = max(2 * k, 50), dict(rows.dtypes)["path"], []
    for names, held in _query_blocks(queries, [f"q{n}" for n in range(WORDS)], 64):
        words = np.stack([held.column(f"q{n}").to_numpy() for n in range(WORDS)]).view(np.uint64)
        shared = prints.sparkSession.sparkContext.broadcast((held.column("q").to_numpy(), words))

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            q_ids, wanted = shared.value
            for batch in batches:
                batch = topk.sorted_batch(batch, "path")
                own = np.stack([batch.column(f"w{n}").to_numpy() for n in range(WORDS)]).view(np.uint64)
                for q0, q1, r0, r1 in topk.blocks(len(q_ids), batch.num_rows):
                    apart = [np.bitwise_count(wanted[n, q0:q1, None] ^ own[n, None, r0:r1]).astype(np.int16) for n in range(WORDS)]
                    far = sum(apart)
                    choices = [(False, -far.astype(float))]
                    if early_exit is not None:
                        choices.append((True, np.where(apart[0] <= early_exit, -far.astype(float), -np.inf)))
                    for near, closeness in choices:
                        q, r = topk.best_cells(closeness, pool)
                        at = pa.array(r0 + r)
                        columns = [pa.array(q_ids[q0 + q]), batch.column("path").take(at), batch.column("flags").take(at), pa.array(far[q, r].astype(np.int32)), pa.array([near] * len(q), pa.bool_())]
                        yield pa.RecordBatch.from_arrays(columns, ["q", "path", "flags", "distance", "near"])

        found.append(rows.mapInArrow(run, f"q long, path {kind}, flags int, distance int, near boolean").join(F.broadcast(names), "q").drop("q"))
    met = reduce(DataFrame.unionByName, found)
    if early_exit is not None:
        enough = met.filter("near").groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id", F.lit(True).alias("enough"))
        met = met.join(enough, "query_id", "left").filter(F.col("near") == F.coalesce("enough", F.lit(False)))
    order = Window.partitionBy("query_id").orderBy("distance", "path")
    pooled = met.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= pool)
    factor = prior_multiplier(F.col("flags")) if prior else F.lit(1.0)
    scored = pooled.withColumn("score", (1 - F.col("distance") / float(BITS)) * factor)
    return ranked(scored, k).select("query_id", "rank", "path", "distance", "score")


# --- projection --------------------------------------------------------------------------------------------

#: Smoothing of token weights; occurrences that a common token is taken to have, others having one.
SIF_A, COMMON = 1e-4, 5000
#: Weight of a field in a projection; the path of a symbol or chunk, and that of a whole document.
FIELD_WEIGHTS = {"name": 2.0, "path": 0.8, "document_path": 1.2, "signature": 1.2, "doc": 0.8, "content": 1.0, "query": 1.0}
# Tokens taken to be common in prose, in source code, and in paths.
COMMON_TOKENS = (
    "in", "to", "for", "of", "and", "the", "a", "an", "is", "at", "by", "from", "with", "on", "as", "it", "this", "that", "be", "or", "if", "let", "mut",
    "const", "var", "val", "def", "fn", "func", "function", "pub", "private", "public", "protected", "class", "struct", "interface", "type", "enum", "import", "export", "require", "package", "namespace", "use", "using", "return", "returns", "async", "await", "yield", "new", "throw", "throws", "try", "catch", "finally", "except", "true", "false", "null", "nil", "undefined", "none", "void", "self", "super", "string", "int", "bool", "boolean", "float", "double", "bytes", "byte", "any", "include", "header",
    "src", "lib", "internal", "pkg", "index", "js", "ts", "rs", "go", "py", "java", "cpp", "c", "h", "cs", "rb", "kt", "php",
)


@lru_cache(maxsize=20_000)
def token_vector(token: str) -> np.ndarray:
    """256 values in [-1, 1] from the token's digest, of unit length; the same on every machine."""
    raw = b"".join(hashlib.sha256(f"{token}\x00{k}".encode()).digest() for k in range(BITS // 32))
    v = np.frombuffer(raw, np.uint8) / 127.5 - 1.0
    return v / np.linalg.norm(v)


def weighted_tokens(texts: DataFrame) -> DataFrame:
    """id, token, weight of (id, field, text): code tokens by field weight, with their stems and abbreviations
    (three quarters of the weight)."""
    weights = F.create_map(*[F.lit(x) for pair in FIELD_WEIGHTS.items() for x in pair])
    rows = texts.select("id", F.coalesce(F.try_element_at(weights, F.col("field")), F.lit(1.0)).alias("weight"), F.explode(code_tokens(F.col("text"))).alias("token"))
    more = F.array(F.struct(F.col("token").alias("t"), F.col("weight").alias("w")), F.struct(stem(F.col("token")).alias("t"), F.col("weight").alias("w")), F.struct(expand_abbreviation(F.col("token")).alias("t"), (0.75 * F.col("weight")).alias("w")))
    each = rows.select("id", F.explode(more).alias("m")).filter("m.t is not null")
    return each.groupBy("id", F.col("m.t").alias("token")).agg(F.sum("m.w").alias("weight"))


def sif_weight(token: Column) -> Column:
    """Smooth inverse frequency a / (a + p); p is the token's share of all occurrences in the background table."""
    total = float(COMMON * len(COMMON_TOKENS))
    return F.when(token.isin(*COMMON_TOKENS), SIF_A / (SIF_A + COMMON / total)).otherwise(SIF_A / (SIF_A + 1 / total))


def sif_weights(rows: DataFrame) -> DataFrame:
    """token, sif of (id, token): the same with the shares that a corpus itself has."""
    counts = rows.groupBy("token").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total), F.lit(True)).select("token", (SIF_A / (SIF_A + F.col("n") / F.col("all"))).alias("sif"))  # total: one row


def project(texts: DataFrame, remove_common: bool = False, own_frequencies: bool = False) -> DataFrame:
    """id, w0..w3: fingerprints of (id, field, text), the signs of the weighted mean of the tokens' vectors.

    Token weights are summed before the vectors are made, so a group holds a row for each of its different
    tokens. With ``remove_common`` the direction most texts share is taken out first.
    """
    rows = weighted_tokens(texts)
    if own_frequencies:
        weighted = rows.join(sif_weights(rows), "token").select("id", "token", (F.col("weight") * F.col("sif")).alias("weight"))
    else:
        weighted = rows.select("id", "token", (F.col("weight") * sif_weight(F.col("token"))).alias("weight"))
    kind = texts.schema["id"].dataType.simpleString()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for names, ws in zip(batch.column("tokens").to_pylist(), batch.column("weights").to_pylist(), strict=True):
                v = sum((w * token_vector(t) for t, w in zip(names, ws, strict=True)), np.zeros(BITS))
                n = np.linalg.norm(v)
                out.append(v / n if n > 1e-6 else v)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.float64()))], ["id", "v"])

    grouped = weighted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "weight"))).alias("t")).select("id", F.col("t.token").alias("tokens"), F.col("t.weight").alias("weights"))
    vectors = grouped.mapInArrow(mean, f"id {kind}, v array<double>")
    if remove_common:
        vectors = remove_first_component(vectors)
    return pack(vectors)


def remove_first_component(vectors: DataFrame, steps: int = 5) -> DataFrame:
    """(id, v) less the projection on the direction of largest second moment, found by power iteration.

    A step is one aggregation: sums of products by dimension, as many numbers as a vector has."""
    held = cut(vectors)
    direction = np.full(BITS, 1 / BITS**0.5)
    for _ in range(steps):
        shared = vectors.sparkSession.sparkContext.broadcast(direction)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(BITS)
            for batch in batches:
                v = _matrix(batch.column("v"))
                total += (v @ shared.value) @ v if len(v) else 0
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

        parts = held.select("v").mapInArrow(run, "sums array<double>")  # a row for each partition
        sums = parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # BITS rows
        new = np.zeros(BITS)
        for r in sums:
            new[r["i"]] = r["x"]
        size = np.linalg.norm(new)
        if size <= 1e-12:
            return held
        direction = new / size
    direction = direction.tolist()
    u = F.array(*[F.lit(x) for x in direction])
    along = F.aggregate(F.zip_with("v", u, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return held.withColumn("along", along).select("id", F.zip_with("v", u, lambda a, b: a - b * F.col("along")).alias("v"))


def pack(vectors: DataFrame) -> DataFrame:
    """id, w0..w3 of (id, v): a bit for each positive component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, BITS)
            words = np.packbits(v > 0, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(WORDS)]], ["id", *[f"w{k}" for k in range(WORDS)]])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id {kind}, " + ", ".join(f"w{k} long" for k in range(WORDS)))


def sign_prints(vectors: DataFrame, key: str = "path", words: int = WORDS) -> DataFrame:
    """key, w0.. : sign fingerprints of given embeddings, 64 bits for each 64 components; missing words are 0."""
    indexed = F.transform("embedding", lambda x, i: F.struct(i.alias("i"), (x > 0).alias("up")))

    def word(k: int) -> F.Column:
        part = F.filter(indexed, lambda s: (s["i"] >= 64 * k) & (s["i"] < 64 * (k + 1)) & s["up"])
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, s: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), s["i"] - 64 * k)))

    return vectors.select(key, *[word(k).alias(f"w{k}") for k in range(words)])
