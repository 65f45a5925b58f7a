"""The best of each query within a batch of rows, so that only so many a batch go on to a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores held at a time: rows x queries of a block.
CELLS = 1 << 22
#: Queries of a block.
QUERIES = 1 << 11


def blocks(n_queries: int, n_rows: int) -> list[tuple[int, int, int, int]]:
    """(first query, end, first row, end) of blocks of CELLS scores at most."""
    wide = min(QUERIES, max(1, n_queries))
    tall = max(1, CELLS // wide)
    return [(q, min(q + wide, n_queries), r, min(r + tall, n_rows)) for r in range(0, n_rows, tall) for q in range(0, n_queries, wide)]


def best_cells(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the ``k`` largest scores of each query (a line of ``scores``), ties to the earlier row.
    What is minus infinity is no result."""
    own = scores > -np.inf
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        own &= scores >= edge[:, None]
    q, r = np.nonzero(own)
    order = np.lexsort((r, -scores[q, r], q))
    q, r = q[order], r[order]
    first = np.searchsorted(q, np.arange(scores.shape[0]))
    kept = np.arange(len(q)) - first[q] < k
    return q[kept], r[kept]


def sorted_batch(batch: pa.RecordBatch, *names: str) -> pa.RecordBatch:
    """The rows in the order of the named columns: ties then go to the earlier row."""
    return batch.take(pc.sort_indices(batch, sort_keys=[(n, "ascending") for n in names])) if batch.num_rows else batch


def parts(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The rows of each batch by the values of a column, null being one."""
    for batch in batches:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices
        for code in pc.unique(codes):
            yield batch.filter(pc.equal(codes, code))
