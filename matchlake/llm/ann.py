"""Operator 7: nearest neighbours by a block matrix join.

Vectors are quantised to int8 with one scale each. A tile multiplies the int8 matrices of a base group and a query group
(in float32, where those integer sums are exact), which gives squared distances with a bound on the quantisation error:
with x = s*xi + e, |x.q - s_x*s_q*(xi.qi)| <= |s_x*xi|*|e_q| + |e_x|*|q|. Pairs whose lower bound exceeds the k-th
smallest upper bound of their query can't be among its k nearest. The others are recomputed in double precision, and the
k best of each tile are merged by heaps. The result is exact.

Vectors that are null, zero, empty, or hold null or non-finite components take no part, neither as query nor as
candidate; vectors of different lengths don't meet. Rows with a query's own id are no candidates for it. Repeated
queries are answered once each, repeated candidates count once each, ties go to the smaller id, rows with a null id take
no part. Empty inputs give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import distinct_items, expand, merge_smallest, smallest, tiled, two_ids

#: Integer sums below 2**24 are exact in float32: 127 * 127 * 1024 < 2**24.
EXACT_DIMS = 1024
FOUND = "query_row long, query_id long, item_id long, score double"


def usable(vec: str) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vec).isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, norms of the quantised vectors and norms of the errors."""
    scale = np.abs(x).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def integer_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMS):
        total += a[:, at : at + EXACT_DIMS].astype(np.float32) @ b[:, at : at + EXACT_DIMS].astype(np.float32).T
    return total


def survivors(base: np.ndarray, asked: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, base) index pairs that the error bounds can't exclude from the k nearest, the query itself left aside.

    Pairs marked in ``own`` are no candidates and don't count among the k.
    """
    # a power of two brings the largest component to 1/2 to 1, so that squares stay finite; what vanishes beside it survives
    shift = -int(np.frexp(max(np.abs(base).max(), np.abs(asked).max()))[1])
    base, asked = np.ldexp(base, shift), np.ldexp(asked, shift)
    bq, bs, bn, be = quantise(base)
    qq, qs, _, qe = quantise(asked)
    base_sq, asked_sq = (base * base).sum(axis=1), (asked * asked).sum(axis=1)
    near = asked_sq[:, None] + base_sq[None] - 2 * integer_product(qq, bq) * qs[:, None] * bs[None]
    bound = 2 * (qe[:, None] * bn[None] + np.sqrt(asked_sq)[:, None] * be[None]) + 1e-9 * (asked_sq[:, None] + base_sq[None]) + 1e-300
    if near.shape[1] <= k + 1:
        return np.nonzero(np.ones(near.shape, dtype=bool))
    upper = near + bound
    if own is not None:
        upper[own] = np.inf
    limit = np.partition(upper, k, axis=1)[:, k]
    return np.nonzero(near - bound <= limit[:, None])


def euclidean(base: np.ndarray, asked: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of index pairs in double precision, summed in order of the components."""
    total, bt, qt = np.zeros(len(q)), np.ascontiguousarray(base.T), np.ascontiguousarray(asked.T)
    for d in range(len(bt)):
        diff = qt[d][q] - bt[d][b]
        total += diff * diff
    return np.sqrt(total)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    values = np.asarray(flat.flatten())
    return values.reshape(len(flat), -1).astype(np.float64)


def nearest(base: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vec_col: str = "embedding",
            base_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """One row per query and neighbour: ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (Euclidean distance)."""

    def side(df: DataFrame) -> DataFrame:
        items = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("item"))
        return items.where(usable("item") & F.col("id").isNotNull()).withColumn("kind", F.size("item"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())]).empty_table()
        if not len(a) or not len(b):
            return empty
        x, y = matrix(a["item"]), matrix(b["item"])
        first, offsets, ids = distinct_items(x, np.asarray(a["id"]), k)
        least, _, sole = two_ids(offsets, ids)
        asked_ids, rows, x = np.asarray(b["id"]), np.asarray(b["row"]), x[first]
        out = []
        for at in range(0, len(y), 256):
            part = slice(at, at + 256)
            q, u = survivors(x, y[part], k, (asked_ids[part][:, None] == least[None]) & sole[None])
            dist = euclidean(x, y[part], q, u)
            owner, flat = expand(offsets, u)
            q, dist, item = q[owner] + at, dist[owner], ids[flat]
            other = item != asked_ids[q]
            q, dist, item = q[other], dist[other], item[other]
            best = smallest(q, dist, item, k)
            out.append((q[best], item[best], dist[best]))
        q, item, dist = (np.concatenate(v) for v in zip(*out))
        return pa.table({"query_row": rows[q], "query_id": asked_ids[q], "item_id": item, "score": dist})

    found = tiled(side(base), side(queries), tile, FOUND, base_rows=base_rows, query_rows=query_rows)
    merged = merge_smallest(found, k, "query_id long, rank int, item_id long, score double")
    return merged.withColumnRenamed("item_id", "vec_id")
