"""A stated query set against all rows, in blocks: both sides are dealt into groups and every pair of groups is one task's tile."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(base: DataFrame, queries: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *, base_rows: int, query_rows: int) -> DataFrame:
    """Apply ``fn(base group, query group)`` to every pair of groups.

    Both inputs have ``id``, ``item`` and ``kind`` (only equal kinds meet). The numbers of groups follow from the counts,
    so a tile holds about ``base_rows`` x ``query_rows`` items whatever the size of the input, and rows are dealt by row
    number, so repeated rows don't gather. Each base row is sent once per query group and each query once per base group.
    """
    n, m = base.count(), queries.count()
    bases, asked = max(1, -(-n // base_rows)), max(1, -(-m // query_rows))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        return (df.withColumn("row", F.monotonically_increasing_id())
                .withColumn(own, F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    left = dealt(base, "i", bases, "j", asked).groupBy("kind", "i", "j")
    right = dealt(queries, "j", asked, "i", bases).groupBy("kind", "i", "j")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return fn(a, b)

    return left.cogroup(right).applyInArrow(run, schema)


def merge_smallest(found: DataFrame, k: int, schema: str) -> DataFrame:
    """The ``k`` smallest (score, item) of each ``query_row`` over all tiles, by a heap of k entries while the sorted rows stream by.

    Columns: ``query_row``, ``query_id``, ``item_id``, ``score``; adds ``rank`` from 1.
    """
    ordered = found.repartition("query_row").sortWithinPartitions("query_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, asker, heap = None, None, []

        def flush():
            best = sorted((-s, -i) for s, i in heap)
            return {"query_id": [asker] * len(best), "rank": list(range(1, len(best) + 1)), "item_id": [i for _, i in best], "score": [s for s, _ in best]}

        names = ["query_id", "rank", "item_id", "score"]
        for batch in batches:
            out = {n: [] for n in names}
            for q, qid, item, score in zip(*(batch.column(n).to_pylist() for n in ("query_row", "query_id", "item_id", "score"))):
                if q != row:
                    if heap:
                        for n, v in flush().items():
                            out[n] += v
                    row, asker, heap = q, qid, []
                entry = (-score, -item)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            yield _typed(out)
        if heap:
            yield _typed(flush())

    return ordered.mapInArrow(run, schema)


def _typed(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out["query_id"], pa.int64()), pa.array(out["rank"], pa.int32()), pa.array(out["item_id"], pa.int64()),
                                       pa.array(out["score"], pa.float64())], names=["query_id", "rank", "item_id", "score"])


def distinct_items(rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of a matrix: (first row index of each, CSR offsets, ids of each in order).

    Of one vector the ``2 * k`` smallest ids stay, each at most ``k`` times, so ``k`` remain whichever id a query leaves
    aside, and equal vectors cost one comparison.
    """
    flat = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
    order = np.lexsort((ids, inverse))
    order = order[_place(inverse[order], ids[order]) < k]
    order = order[_place(inverse[order]) < 2 * k]
    return first, np.concatenate([[0], np.cumsum(np.bincount(inverse[order], minlength=len(first)))]), ids[order]


def _place(*keys: np.ndarray) -> np.ndarray:
    """Place of every row within its run of equal keys, from 0."""
    n = len(keys[0])
    start = np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in keys], axis=0)]) if n else np.zeros(0, int)
    return np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))


def two_ids(offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct vector: the smallest id, the smallest other id (the same again if there is none), and whether there is none."""
    least = ids[offsets[:-1]]
    after = offsets[:-1] + np.add.reduceat((ids == np.repeat(least, np.diff(offsets))).astype(np.int64), offsets[:-1])
    sole = after == offsets[1:]
    return least, ids[np.where(sole, offsets[:-1], after)], sole


def expand(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For CSR rows ``which``: (position in ``which``, flat index) of every entry."""
    n = offsets[which + 1] - offsets[which]
    owner = np.repeat(np.arange(len(which)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[which], n)


def smallest(owner: np.ndarray, score: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k smallest (score, item) of each owner."""
    order = np.lexsort((item, score, owner))
    o = owner[order]
    start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, int)
    rank = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
    return order[rank < k]
