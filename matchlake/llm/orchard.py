"""Operator 11: vector code compression, with nearest codebook entries by Orchard search.

Components become integers floor(4096 * x) and vectors are cut into equal parts with a codebook each (product codes). Every
step is exact integer arithmetic, so codes and errors don't depend on the order of rows or on the partitions.

Orchard search: each entry has a list of the others sorted by distance. A search starts at one entry and walks its list; a
nearer entry (or an equally near one of lower index) becomes the current one and its own list is walked from the start;
entries visited before are marked and skipped. It stops at the first listed entry beyond twice the current distance: by the
triangle inequality that entry and all after it are farther away than the current one. Vectors walk together in numpy.

A training round is one pass over the table: tasks search, and add up their parts by entry, so what is shuffled per task is
bounded by the size of the codebooks. The driver holds the codebooks only (entries x components). Sums are added by 32-bit
limbs, so they are exact however large the components are.

Rows whose vector is null or holds null or non-finite components are left out; zero vectors stay. The width is that of the
longest kept vector, rounded up to whole parts; shorter vectors count as ending in zeros. Fewer kept rows than entries make
smaller codebooks. Rows with equal ids are seeds in the order of their vectors, rows with a null id come last; all are coded,
repeated rows once each. An error beyond the range of a long is null. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised

SCALE = 4096
#: Integer components up to here keep squared distances of 2**11 components inside 64 bits; beyond, Python's integers are used.
PLAIN = 1 << 25
LONG = 1 << 63


def kept(vec: str) -> Column:
    """Whether a vector takes part: not null, all components finite."""
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def whole(vectors: list, width: int) -> np.ndarray:
    """floor(4096 * x) of each vector, zeros up to ``width``: int64 where distances stay in range, else Python integers."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    scaled = np.floor(out * SCALE)  # a power of two: exact, unless it overflows
    if scaled.size and not np.abs(scaled).max() <= PLAIN:
        return np.array([[int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(x * SCALE)) for x in row] for row in out.tolist()], dtype=object).reshape(out.shape)
    return scaled.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a - b
    return (diff * diff).sum(axis=-1)


class Orchard:
    """Nearest entry of one codebook (entries x components, integers); ties go to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries, n = entries, len(entries)
        apart = np.array([squared(entries, e) for e in entries]).reshape(n, n)
        # by distance, then index; the entry itself is not listed
        self.order = np.array([sorted((j for j in range(n) if j != i), key=lambda j: (apart[i, j], j)) for i in range(n)], dtype=np.int64).reshape(n, max(n - 1, 0))
        self.apart = np.take_along_axis(apart, self.order, axis=1) if n > 1 else apart[:, :0]
        self.seen_distances = 0

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of ``x``."""
        best, dist = np.zeros(len(x), np.int64), squared(x, self.entries[0])
        self.seen_distances += len(x)
        visited = np.zeros((len(x), len(self.entries)), bool)
        visited[:, 0] = True
        place, active = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            active = active[place[active] < self.order.shape[1]]
            if not len(active):
                return best, dist
            now, at = best[active], place[active]
            # squared: beyond twice the current distance
            go = self.apart[now, at] <= 4 * dist[active]
            active, now, at = active[go], now[go], at[go]
            entry = self.order[now, at]
            place[active] += 1
            fresh = ~visited[active, entry]
            asked, entry = active[fresh], entry[fresh]
            visited[asked, entry] = True
            d = squared(x[asked], self.entries[entry])
            self.seen_distances += len(asked)
            nearer = (d < dist[asked]) | ((d == dist[asked]) & (entry < best[asked]))
            moved = asked[nearer]
            best[moved], dist[moved], place[moved] = entry[nearer], d[nearer], 0


def _parts(batch: pa.RecordBatch, width: int, n_parts: int, step: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, len(batch), step):
        part = batch.slice(at, step)
        yield part, whole(part.column("item").to_pylist(), width).reshape(len(part), n_parts, width // n_parts)


class Books:
    """The searches of one codebook per part; of two number types the wider one is used."""

    def __init__(self, codebooks: np.ndarray):
        self.codebooks, self.by_type = codebooks, {}

    def search(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, indices, squared distances) for rows x parts x components."""
        kind = np.dtype(object) if object in (x.dtype, self.codebooks.dtype) else np.dtype(np.int64)
        if kind not in self.by_type:
            self.by_type[kind] = [Orchard(part.astype(kind)) for part in self.codebooks]
        for p, book in enumerate(self.by_type[kind]):
            yield p, *book.search(x[:, p].astype(kind, copy=False))


def narrowed(values: np.ndarray) -> np.ndarray:
    """int64 if distances stay in range."""
    small = not values.size or max(abs(int(v)) for v in values.ravel().tolist()) <= PLAIN
    return values.astype(np.int64) if small else values.astype(object)


def _sums(items: DataFrame, codebooks: np.ndarray, width: int) -> DataFrame:
    """``part``, ``entry``, ``place``, ``limb``, ``value``: sums of the assigned parts by 32-bit limbs; place -1 has the counts."""
    n_parts = len(codebooks)
    entries, size = codebooks.shape[1], width // n_parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Books(codebooks)
        total = np.zeros((n_parts, entries, size), dtype=object)
        count = np.zeros((n_parts, entries), np.int64)
        for batch in batches:
            for _, x in _parts(batch, width, n_parts):
                for p, best, _d in books.search(x):
                    own = np.zeros((entries, size), dtype=x.dtype)
                    np.add.at(own, best, x[:, p])
                    total[p] += own.astype(object)
                    count[p] += np.bincount(best, minlength=entries)
        rows = []
        for p, e in zip(*(v.tolist() for v in np.nonzero(count))):
            rows.append((p, e, -1, 0, int(count[p, e])))
            for place, v in enumerate(total[p, e]):
                sign, v, limb = (-1 if v < 0 else 1), abs(int(v)), 0
                while v:
                    rows.append((p, e, place, limb, sign * (v & 0xFFFFFFFF)))
                    v, limb = v >> 32, limb + 1
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["part", "entry", "place", "limb", "value"])

    partial = items.select("item").mapInArrow(run, "part long, entry long, place long, limb long, value long")
    return partial.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))


def trained(items: DataFrame, *, parts: int, entries: int, rounds: int) -> tuple[np.ndarray, int]:
    """(codebooks: parts x entries x components, width) of kept vectors ``id``, ``item``; no entries for an empty table."""
    longest = items.agg(F.max(F.size("item"))).first()[0] or 0
    width = -(-longest // parts) * parts
    seeds = [r["item"] for r in items.orderBy(F.col("id").asc_nulls_last(), "item").limit(entries).collect()]
    codebooks = narrowed(np.swapaxes(whole(seeds, width).reshape(len(seeds), parts, width // parts), 0, 1))
    for _ in range(rounds if len(seeds) else 0):
        total, count = {}, {}
        for part, entry, place, limb, value in _sums(items, codebooks, width).collect():  # at most parts x entries x components x limbs
            if place < 0:
                count[part, entry] = value
            else:
                total[part, entry, place] = total.get((part, entry, place), 0) + (value << (32 * limb))
        moved = codebooks.astype(object)
        for (part, entry), n in count.items():
            moved[part, entry] = [total.get((part, entry, i), 0) // n for i in range(width // parts)]
        codebooks = narrowed(moved)
    return codebooks, width


def fingerprint(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal text joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in codebooks.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """Per kept row ``vec_id``, ``label``, ``codes`` (binary, one byte per part), ``error`` and ``codebooks_sha256``.

    ``error`` is the squared distance to the coded entries, summed over the parts.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    items = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("item")).where(kept("item"))
    codebooks, width = trained(items, parts=parts, entries=entries, rounds=rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Books(codebooks)
        for batch in batches:
            for rows, x in _parts(batch, width, parts):
                codes, error = np.zeros((len(rows), parts), np.uint8), [0] * len(rows)
                for p, best, d in books.search(x):
                    codes[:, p] = best
                    error = [a + int(b) for a, b in zip(error, d.tolist())]
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([e if e < LONG else None for e in error], pa.int64())],
                                                 names=["vec_id", "label", "codes", "error"])

    kind = {f.name: f.dataType.simpleString() for f in items.schema}
    coded = items.mapInArrow(run, f"vec_id {kind['id']}, label {kind['label']}, codes binary, error long")
    return coded.withColumn("codebooks_sha256", F.lit(fingerprint(codebooks)))


def with_label_error(coded: DataFrame, *, salts: int = 64) -> DataFrame:
    """Adds ``label_error``: ``error`` summed over equal labels (nulls together; null beyond the range of a long).

    Sums are made by (label, salt) first; each of these gets the label's total back, so the join that follows meets only
    salts that occur, and a label that most rows have is dealt over ``salts`` groups.
    """
    rows = materialised(coded).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    # a null label is a label of its own
    rows = rows.withColumn("known", F.col("label").isNotNull()).withColumn("named", F.coalesce(F.col("label").cast("string"), F.lit("")))
    keys = ["known", "named"]
    salted = rows.groupBy(*keys, "salt").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("some"), F.count_if(F.col("error").isNull()).alias("beyond"))
    total = salted.groupBy(*keys).agg(F.sum("some").alias("total"), F.sum("beyond").alias("beyond"), F.collect_list("salt").alias("salts"))
    total = total.select(*keys, F.explode("salts").alias("salt"), F.when((F.col("beyond") == 0) & (F.col("total") <= F.lit(LONG - 1)), F.col("total").cast("long")).alias("label_error"))
    return rows.join(total, [*keys, "salt"]).drop("salt", *keys)
