"""The lexical index and BM25 ranking, for a table of queries at a time.

A query is a row (query_id, text), so one plan ranks all of them. Chunks are rows (path, chunk_index, title, text,
modality). Scores are those of an inverted index with two fields, title and body, summed; a term that a query
repeats counts as often as it does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.scale import broadcast_if_small, cut, shares
from strataq.functions.text import sanitize_query, tokens

from . import topk

K1, B = 1.2, 0.75
#: Terms of all queries together, up to which they are sent to the chunks. Up to so many different ones chunks drop
#: all other words before they leave the JVM; so many are given to the scan of a stored index, which prunes by them.
ASKED, PUSHED_TERMS, PRUNING_TERMS = 500_000, 20_000, 1000
#: Bytes of files whose chunks a task scores for all queries.
CHUNK_SHARE = 1 << 20


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times."""
    words = queries.select("query_id", F.explode(tokens(sanitize_query(F.col("text")))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def fields(chunks: DataFrame) -> DataFrame:
    """path, chunk_index, field, words: both indexed fields of each chunk."""
    both = F.array(F.struct(F.lit("title").alias("field"), tokens(F.col("title")).alias("words")), F.struct(F.lit("body").alias("field"), tokens(F.col("text")).alias("words")))
    return chunks.select("path", "chunk_index", F.explode(both).alias("f")).select("path", "chunk_index", "f.field", "f.words")


def postings(chunks: DataFrame) -> DataFrame:
    """path, chunk_index, field, term, tf: the inverted index, to be written partitioned or bucketed by term."""
    return fields(chunks).select("path", "chunk_index", "field", F.explode("words").alias("term")).groupBy("path", "chunk_index", "field", "term").agg(F.count("*").alias("tf"))


def doc_stats(chunks: DataFrame) -> DataFrame:
    """path, chunk_index, field, dl: lengths in tokens."""
    return fields(chunks).select("path", "chunk_index", "field", F.size("words").alias("dl"))


def term_stats(index: DataFrame) -> DataFrame:
    """term, field, df."""
    return index.groupBy("term", "field").agg(F.count("*").alias("df"))


def _hits(words: str, terms: list[str]) -> str:
    """SQL for the words that are terms; with very many terms all words, as the scorer looks them up anyway. One text
    for all terms, which are letters and digits only: a call for each would take longer than the query."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"filter({words}, w -> w IN ({listed}))" if 0 < len(terms) <= PUSHED_TERMS else words


def _statistics(chunks: DataFrame, terms: list[str]) -> tuple[dict[str, tuple[int, float]], dict[tuple[str, str], int]]:
    """n and avgdl of each field, df of each (field, term): one pass, of which twice the terms come to the driver."""
    hits = F.expr(f"array_append(array_distinct({_hits('words', terms)}), '')")
    each = fields(chunks).select("field", F.size("words").alias("dl"), F.explode(hits).alias("term"))
    counts = each.groupBy("field", "term").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))
    if len(terms) > PUSHED_TERMS:
        counts = counts.join(F.broadcast(chunks.sparkSession.createDataFrame([("",), *((t,) for t in terms)], "term string")), "term")
    rows = counts.collect()
    return {r["field"]: (r["n"], r["dl"] / r["n"]) for r in rows if r["term"] == ""}, {(r["field"], r["term"]): r["n"] for r in rows if r["term"]}


def _by_partition(chunks: DataFrame, asked: DataFrame, k: int | None, modality: str | None, group: str | None = None) -> DataFrame:
    """query_id, path, chunk_index, score: of each batch of chunks the ``k`` best for each query (None: all scored), and
    with ``group``, a column of chunks that comes with them, for each of its values.

    All tokens of a chunk are in its row, so scores are complete where it is read and nothing but results is
    shuffled. ``asked`` (query_id, term, times) is bounded.
    """
    numbers = cut(asked.select("query_id").distinct().withColumn("q", F.monotonically_increasing_id()))
    held = asked.join(numbers, "query_id").select("q", "term", "times").toArrow()
    terms = sorted(set(held.column("term").to_pylist()))
    stats, df = _statistics(chunks, terms)
    place = {t: i for i, t in enumerate(terms)}
    q_of, q_at = np.unique(held.column("q").to_numpy(), return_inverse=True)
    idf = {f: np.array([math.log(1 + (n - df.get((f, t), 0) + 0.5) / (df.get((f, t), 0) + 0.5)) for t in terms]) for f, (n, _) in stats.items()}
    wanted = np.array([place[t] for t in held.column("term").to_pylist()], dtype=np.int64)
    shared = chunks.sparkSession.sparkContext.broadcast((pa.array(terms, pa.string()), wanted, q_at, held.column("times").to_numpy(), q_of, stats, idf))
    rows = chunks if modality in (None, "both") else chunks.filter(F.col("modality") == modality)
    own = ["path", "chunk_index", *([group] if group else [])]
    columns = list(own)
    for name, text in (("title", "title"), ("body", "text")):
        rows = rows.withColumn(f"{name}_tokens", F.array(tokens(F.col(text))))
        rows = rows.withColumn(f"{name}_words", F.expr(f"transform({name}_tokens, t -> struct(size(t) AS dl, {_hits('t', terms)} AS hits))[0]"))
        columns += [F.col(f"{name}_words.dl").alias(f"{name}_dl"), F.col(f"{name}_words.hits").alias(f"{name}_hits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, term_at, query_at, times, numbers_, stats_, idf_ = shared.value
        for batch in topk.parts(batches, group) if group else batches:
            batch = topk.sorted_batch(batch, "path", "chunk_index")
            row, code, part = [], [], []
            for name, (_, avgdl) in stats_.items():
                hits, dl = batch.column(f"{name}_hits"), batch.column(f"{name}_dl").to_numpy(zero_copy_only=False)
                at = pc.index_in(hits.flatten(), vocabulary)
                where = np.repeat(np.arange(len(hits)), pc.fill_null(hits.value_lengths(), 0).to_numpy())[at.is_valid().to_numpy(zero_copy_only=False)]
                key, tf = np.unique(where * len(vocabulary) + at.drop_null().to_numpy(), return_counts=True)
                r, c = key // len(vocabulary), key % len(vocabulary)
                row.append(r)
                code.append(c)
                part.append(idf_[name][c] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[r] / avgdl)))
            row, code, part = (np.concatenate(x) if x else np.empty(0) for x in (row, code, part))
            for q0, q1, r0, r1 in topk.blocks(len(numbers_), batch.num_rows):
                mine = (query_at >= q0) & (query_at < q1)
                order = np.flatnonzero(mine)[np.argsort(term_at[mine], kind="stable")]
                first = np.searchsorted(term_at[order], np.arange(len(vocabulary) + 1))
                e = np.flatnonzero((row >= r0) & (row < r1))
                n = first[code[e] + 1] - first[code[e]]
                ends = np.cumsum(n)
                asks = order[np.repeat(first[code[e]] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
                cell = (query_at[asks] - q0) * (r1 - r0) + np.repeat(row[e] - r0, n)
                sums = np.bincount(cell, np.repeat(part[e], n) * times[asks], (q1 - q0) * (r1 - r0)).reshape(q1 - q0, r1 - r0)
                rounded = np.where(sums > 0, np.round(sums, 9), -np.inf)
                q, r = topk.best_cells(rounded, k) if k else np.nonzero(sums > 0)
                yield pa.RecordBatch.from_arrays([pa.array(numbers_[q0 + q]), *[batch.column(c).take(pa.array(r0 + r)) for c in own], pa.array(sums[q, r])], ["q", *own, "score"])

    kinds = {n: t for n, t in chunks.dtypes}
    found = rows.select(*columns).mapInArrow(run, f"q long, {', '.join(f'{c} {kinds[c]}' for c in own)}, score double")
    return found.join(F.broadcast(numbers), "q").select("query_id", *own, "score")  # no more queries than ASKED


def _by_chunk(chunks: DataFrame, asked: DataFrame, modality: str | None) -> DataFrame:
    """The same for any number of queries, all scored: matches are counted before they are shuffled by chunk."""
    indexed = fields(chunks).select("*", F.size("words").alias("dl"))
    stats = indexed.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # two rows
    exploded = indexed.select("path", "chunk_index", "field", "dl", F.explode("words").alias("term"))
    held = exploded.join(asked.select("term").distinct(), "term", "left_semi").groupBy("path", "chunk_index", "field", "dl", "term").agg(F.count("*").alias("tf"))
    df = held.groupBy("field", "term").agg(F.count("*").alias("df"))
    weighted = held.join(df, ["field", "term"]).join(F.broadcast(stats), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = weighted.withColumn("part", part).join(asked, "term")
    if modality not in (None, "both"):
        scored = scored.join(chunks.filter(F.col("modality") == modality).select("path", "chunk_index"), ["path", "chunk_index"])
    return scored.groupBy("query_id", "path", "chunk_index").agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, modality: str | None = None, k: int | None = None, group: str | None = None) -> DataFrame:
    """query_id, path, chunk_index, score of every chunk that holds a term of the query; with ``k`` of each batch
    of chunks only the best so many, which hold the best of all. With ``group``, a column of chunks that is given with
    the scores, so many of each of its values.

    Field statistics are over all chunks, also if ``modality`` restricts the results. A query table with more than
    ASKED terms in all is not sent to the chunks; the chunks' matches are shuffled instead.
    """
    asked = cut(query_terms(queries))
    if asked.count() <= ASKED:
        return _by_partition(chunks, asked, k, modality, group)
    scored = _by_chunk(chunks, asked, modality)
    return scored.join(chunks.select("path", "chunk_index", group), ["path", "chunk_index"]) if group else scored


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 10, modality: str | None = None) -> DataFrame:
    """The ``k`` best chunks of each query: query_id, rank, path, chunk_index, score; ties by path, then chunk."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "path", "chunk_index")
    ranked = bm25_scores(chunks, queries, modality, k).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "path", "chunk_index", "score")


def build_index(chunks: DataFrame, stored: bool = True) -> dict[str, DataFrame]:
    """The inverted index as tables: postings (term, field, path, chunk_index, tf, dl), terms (term, field, df),
    fields (field, n, avgdl). Postings are in ranges of terms, so a reader of Parquet skips what no query asks for;
    those of an index that isn't stored stay with their chunks, whose words are shuffled once, not posting by posting."""
    words = fields(chunks).select("*", F.size("words").alias("dl"))
    each = (words if stored else words.repartition(shares(chunks, CHUNK_SHARE), "path", "chunk_index")).select("path", "chunk_index", "field", "dl", F.explode("words").alias("term"))
    held = each.groupBy("term", "field", "path", "chunk_index", "dl").agg(F.count("*").alias("tf"))
    return {
        "postings": held.repartitionByRange("term", "path", "chunk_index").sortWithinPartitions("term", "path") if stored else held,
        "terms": term_stats(held),
        "fields": words.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")),
    }


def bm25_indexed(index: dict[str, DataFrame], queries: DataFrame, k: int = 10, stored: bool = True) -> DataFrame:
    """As ``bm25``, from a stored index: only the postings of the queries' terms are read; or from one that was built
    with ``stored`` false."""
    wanted = broadcast_if_small(query_terms(queries))
    held, terms = index["postings"], index["terms"]
    few = [r["term"] for r in wanted.select("term").distinct().limit(PRUNING_TERMS + 1).collect()]
    if len(few) <= PRUNING_TERMS:
        held, terms = held.filter(F.col("term").isin(few)), terms.filter(F.col("term").isin(few))
    else:
        asked = broadcast_if_small(wanted.select("term").distinct())
        held, terms = held.join(asked, "term", "left_semi"), terms.join(asked, "term", "left_semi")
    # few terms are asked for, so postings meet them where they are; those of a stored index then go to their chunk
    weighted = held.join(broadcast_if_small(cut(terms)), ["term", "field"]).join(F.broadcast(index["fields"]), "field")  # fields: two rows
    weighted = (weighted.repartition("path", "chunk_index") if stored else weighted).join(wanted, "term")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = weighted.groupBy("query_id", "path", "chunk_index").agg(F.sum(part).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "path", "chunk_index")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "path", "chunk_index", "score")
