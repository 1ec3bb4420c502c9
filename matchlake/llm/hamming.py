"""Operator 10: exact top-k search of binary codes by incremental multi-index hashing.

A code is cut into 16-bit segments and each segment is indexed by its value. A query looks up, segment after segment, all
values that differ from its own in r = 0, 1, 2 ... bits, and verifies what it finds. With m segments of which the first
s + 1 were searched to radius r and the others to r - 1, every code within m*r + s bits has been found (a code farther
away in no segment than that would differ in more bits), so a query stops as soon as its k-th verified distance is
provably covered. Codes are dealt into groups with an index each, and the groups' best are merged by heaps.

Rows with a null code or id take no part; codes of different lengths don't meet. Rows with a query's own id are no
candidates for it; ties go to the smaller id; repeated rows count once each. Empty inputs give no rows. Codes fill
whole bytes; what is missing is padded with zero bits on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import FOUND, usable
from .tiles import distinct_items, expand, merge_smallest, smallest, tiled, two_ids

BITS = 16


def sign_codes(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id``, ``code``, ``bits``: one bit per component, set where it is positive. Unusable vectors (see ``ann``) are left out."""
    items = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("item")).where(usable("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("item").to_pylist()
            codes = [np.packbits(np.asarray(v) > 0).tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.binary()), pa.array([len(v) for v in vectors], pa.int32())], names=["id", "code", "bits"])

    return items.mapInArrow(run, "id long, code binary, bits int")


@lru_cache(maxsize=None)
def masks(radius: int) -> np.ndarray:
    """All 16-bit values with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(BITS), radius)], dtype=np.uint16)


class SegmentIndex:
    """Lookup of codes by the value of each 16-bit segment."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for s in range(codes.shape[1]):
            self.tables.append((np.argsort(codes[:, s], kind="stable"), np.r_[0, np.cumsum(np.bincount(codes[:, s], minlength=1 << BITS))]))

    def search(self, asked: np.ndarray, ids: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code index, distance) of the k nearest codes of each query, by (distance, id).

        ``own``: the ids of the queries, and the next id of each code and whether it has none. A query's own id doesn't count.
        """
        n, m = self.codes.shape
        everything = n <= k
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        done, active = [], np.arange(len(asked))
        for radius in range(BITS + 1):
            for s in range(m):
                order, offsets = self.tables[s]
                if everything:
                    q, c = (v.ravel() for v in np.indices((len(asked), n)))
                else:
                    values = (asked[active, s][:, None] ^ masks(radius)[None]).ravel().astype(np.int64)
                    owner, flat = expand(offsets, values)
                    q, c = active[owner // len(masks(radius))], order[flat]
                if own is not None:
                    other = (ids[c] != own[0][q]) | ~own[2][c]
                    q, c = q[other], c[other]
                dist = np.bitwise_count(asked[q] ^ self.codes[c]).sum(axis=1).astype(np.int64)
                q, c, dist = (np.concatenate(v) for v in zip(best, (q, c, dist)))
                _, once = np.unique(q * n + c, return_index=True)
                q, c, dist = q[once], c[once], dist[once]
                item = ids[c] if own is None else np.where(ids[c] == own[0][q], own[1][c], ids[c])
                keep = smallest(q, dist, item, k)
                best = q[keep], c[keep], dist[keep]
                have, worst = np.bincount(best[0], minlength=len(asked)), np.zeros(len(asked), np.int64)
                np.maximum.at(worst, best[0], best[2])
                covered = np.zeros(len(asked), bool)
                covered[active] = (have[active] == k) & (worst[active] <= m * radius + s)
                if everything:
                    covered[:] = True
                ended = covered[best[0]]
                done.append(tuple(v[ended] for v in best))
                best = tuple(v[~ended] for v in best)
                active = active[~covered[active]]
                if not len(active):
                    return tuple(np.concatenate(v) for v in zip(*done))
        return tuple(np.concatenate(v) for v in zip(*done, best))


def segments(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    pad = b"\0" * (len(raw[0]) % 2)
    return np.frombuffer(b"".join(c + pad for c in raw), dtype=np.uint16).reshape(len(raw), -1)


def nearest_codes(base: DataFrame, queries: DataFrame, k: int = 10, *, base_rows: int = 65_536, query_rows: int = 1024) -> DataFrame:
    """One row per query and neighbour: ``query_id``, ``rank`` from 1, ``vec_id``, ``distance`` (differing bits).

    Inputs: ``id``, ``code`` and, where codes are no whole bytes, ``bits``: codes of different lengths don't meet.
    """

    def side(df: DataFrame) -> DataFrame:
        bits = F.col("bits").cast("int") if "bits" in df.columns else 8 * F.length("code")
        items = df.select(F.col("id").cast("long").alias("id"), F.col("code").alias("item"), bits.alias("kind"))
        return items.where(F.col("id").isNotNull() & (F.length("item") > 0))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())]).empty_table()
        codes, asked = segments(a["item"]), segments(b["item"])
        first, offsets, ids = distinct_items(codes, np.asarray(a["id"]), k)
        index, (least, following, sole) = SegmentIndex(codes[first]), two_ids(offsets, ids)
        asked_ids, rows = np.asarray(b["id"]), np.asarray(b["row"])
        out = []
        for at in range(0, len(asked), 64):
            q, c, dist = index.search(asked[at : at + 64], least, k, (asked_ids[at : at + 64], following, sole))
            owner, flat = expand(offsets, c)
            q, dist, item = q[owner] + at, dist[owner], ids[flat]
            other = item != asked_ids[q]
            q, dist, item = q[other], dist[other], item[other]
            best = smallest(q, dist, item, k)
            out.append((q[best], item[best], dist[best]))
        q, item, dist = (np.concatenate(v) for v in zip(*out))
        return pa.table({"query_row": rows[q], "query_id": asked_ids[q], "item_id": item, "score": dist.astype(np.float64)})

    found = tiled(side(base), side(queries), tile, FOUND, base_rows=base_rows, query_rows=query_rows)
    merged = merge_smallest(found, k, "query_id long, rank int, item_id long, score double")
    return merged.select("query_id", "rank", F.col("item_id").alias("vec_id"), F.col("score").cast("int").alias("distance"))
