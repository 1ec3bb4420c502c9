"""Operator 13: periodic runs of words, detected by multi-scale minimizers.

A run is a stretch of words with smallest period q and a length of at least max(12, 2q) that can't be extended with that
period. Periods below 32 are found by direct scans at each lag. The periods in [Q, 2Q) of every further scale Q = 32, 64,
128 ... are found by minimizers: every window of Q/4 four-word hashes keeps its (leftmost) smallest one. A run repeats its
first q words, so a window there and the one q later have the same content and keep the same place, and so do the Q/2 words
that follow: equal contexts of minimizers at a distance in [Q, 2Q) seed an extension, which compares the words themselves.
Minima of a scale are minima of the smaller ones, and window minima and context hashes double from scale to scale.

Contexts that are periodic themselves (smallest period up to a quarter of Q) would pair too often. They lie in a shorter run R1
that an earlier scale has found, and their copy lies in another one, R2, of the same period. If R1 begins or ends inside the
repeated words, so does R2, and the distance of the two starts or ends is the period. If R1 covers all of the repeated words,
R1 and R2 touch, and all periods that continue R1's phase in R2 are runs, whose ends follow from those of R1 and R2.
Other contexts occur at most eight times in 2Q words, so pairs stay in proportion to the words. No hash decides anything.

A stretch inside a run of smaller period has that smaller period and is no run of its own. All texts of about a megabyte are
scanned together, with unlike separators between. A text is scanned by one task, as it is one row; memory follows its length.

Null and empty texts have no words and no runs. Repeated rows and rows with a null id are answered once each. Extra columns
are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_bytes

SHORTEST = 12
#: The first scale; shorter periods are scanned lag by lag.
FIRST_SCALE = 32
GRAM = 4
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Known:
    """Runs found so far, in order of their starts."""

    def __init__(self):
        self.start = self.stop = self.period = self.reach = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> None:
        start, stop, period = (np.concatenate(v) for v in zip((self.start, self.stop, self.period), (start, stop, period)))
        order = np.lexsort((period, start))
        self.start, self.stop, self.period = start[order], stop[order], period[order]
        self.reach = np.maximum.accumulate(self.stop) if len(order) else self.stop

    def cover(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether some run contains each stretch."""
        if not len(self.start):
            return np.zeros(len(start), bool)
        at = np.searchsorted(self.start, start, side="right") - 1
        return (at >= 0) & (self.reach[at] >= stop)

    def some(self, which: np.ndarray) -> Known:
        out = Known()
        out.add(self.start[which], self.stop[which], self.period[which])
        return out


def equal_ahead(s: np.ndarray, i: int, j: int) -> int:
    """Number of equal words from ``i`` and ``j`` > ``i`` on."""
    done, step = 0, 64
    while j + done < len(s):
        size = min(step, len(s) - j - done)
        differ = s[i + done : i + done + size] != s[j + done : j + done + size]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + size, step * 4
    return done


def equal_before(s: np.ndarray, i: int, j: int) -> int:
    """Number of equal words before ``i`` and ``j``."""
    done, step = 0, 64
    while i - done > 0:
        size = min(step, i - done)
        differ = (s[i - done - size : i - done] != s[j - done - size : j - done])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + size, step * 4
    return done


def short_periods(s: np.ndarray, known: Known, below: int) -> None:
    """Runs of periods below ``below``: words equal at the lag, in stretches that are long enough."""
    for q in range(1, min(below, len(s))):
        equal = np.empty(len(s) - q + 2, np.int8)
        equal[0] = equal[-1] = 0
        equal[1:-1] = s[q:] == s[:-q]
        edge = np.flatnonzero(equal[1:] != equal[:-1])
        start, stop = edge[::2], edge[1::2]
        long = stop - start >= max(SHORTEST - q, q)
        start, stop = start[long], stop[long] + q
        new = ~known.cover(start, stop)
        if new.any():
            known.add(start[new], stop[new], np.full(int(new.sum()), q))


def context_pairs(anchor: np.ndarray, context: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal contexts at a distance in [scale, 2 * scale)."""
    order = np.lexsort((anchor, context))
    at, key = anchor[order], context[order]
    twin = np.zeros(len(key) + 1, bool)  # equal to the one before
    twin[1:-1] = key[1:] == key[:-1]
    at, key = (v[twin[:-1] | twin[1:]] for v in (at, key))
    places, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, len(at)):
        gap = at[step:] - at[:-step]
        near = (key[step:] == key[:-step]) & (gap < 2 * scale)
        if not near.any():
            break
        take = near & (gap >= scale)
        places.append(at[:-step][take])
        distances.append(gap[take])
    return np.concatenate(places), np.concatenate(distances)


def edge_pairs(short: Known, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of starts and of ends of runs of one period at a distance in [scale, 2 * scale)."""
    order = np.lexsort((short.start, short.period))
    start, stop, period = short.start[order], short.stop[order], short.period[order]
    places, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, len(start)):
        same = period[step:] == period[:-step]
        near = np.zeros(len(same), bool)
        for edge, shift in ((start, 0), (stop, 1)):
            gap = edge[step:] - edge[:-step]
            near |= same & (gap < 2 * scale)
            take = same & (gap >= scale) & (gap < 2 * scale)
            places.append(edge[:-step][take] - shift)
            distances.append(gap[take])
        if not near.any():
            break
    return np.concatenate(places), np.concatenate(distances)


def touching(s: np.ndarray, short: Known, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, stops, periods in [scale, 2 * scale)) of runs whose first copy lies in one short run and the second in the next one, which it touches."""
    order = np.lexsort((short.start, short.period))
    start, stop, period = short.start[order], short.stop[order], short.period[order]
    for i in np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= stop[:-1])).tolist():
        d, a1, b1, a2, b2 = (int(v) for v in (period[i], start[i], stop[i], start[i + 1], stop[i + 1]))
        if min(b1 - a1, b2 - a2) < scale:
            continue
        root, twice = s[a2 : a2 + d], s[a1 : a1 + 2 * d]
        phase = next((r for r in range(d) if (twice[r : r + d] == root).all()), None)
        if phase is None:
            continue
        # word a1 + phase + k * d of the first run is like word a2 of the second
        q = np.arange(scale + (a2 - a1 - phase - scale) % d, 2 * scale, d)
        q = q[(q != a2 - a1) & (q != b2 - b1)]  # there the stretch may go on: found by its edges
        left, right = np.maximum(a1, a2 - q), np.minimum(b1, b2 - q)
        fits = right - left >= q
        yield left[fits], (right + q)[fits], q[fits]


def long_periods(s: np.ndarray, known: Known, longest: int) -> None:
    """Runs of periods from ``FIRST_SCALE`` on in texts of at most ``longest`` words."""
    if longest < 2 * FIRST_SCALE:
        return
    n = len(s)
    hashes, size = mixed(s.astype(np.int64).view(np.uint64) * _B + _A), 1
    while size < GRAM:
        hashes, size = mixed(hashes[:-size] * _A + hashes[size:]), 2 * size
    shift = np.uint64(n.bit_length())
    least = (hashes >> shift << shift) | np.arange(len(hashes), dtype=np.uint64)  # of equals the leftmost
    place = (np.uint64(1) << shift) - np.uint64(1)
    width, scale = 1, FIRST_SCALE
    while 2 * scale <= longest:
        while width < scale // 4:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        while size < scale // 2:
            hashes, size = mixed(hashes[:-size] * _A + hashes[size:]), 2 * size
        anchor = (least & place).astype(np.int64)
        anchor = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
        anchor = anchor[anchor < len(hashes)]
        short = known.some((known.period <= size // 2) & (known.stop - known.start >= size))
        anchor = anchor[~short.cover(anchor, anchor + size)]
        pairs = [context_pairs(anchor, hashes[anchor], scale), edge_pairs(short, scale)]
        at, q = (np.concatenate(v) for v in zip(*pairs))
        found, last, reach = [], 0, 0
        order = np.lexsort((at, q))
        for m, lag in zip(at[order].tolist(), q[order].tolist()):
            if lag == last and m < reach:
                continue  # inside the stretch compared last
            ahead, before = equal_ahead(s, m, m + lag), equal_before(s, m, m + lag)
            last, reach = lag, m + max(ahead, 1)
            if ahead + before >= lag:
                found.append((m - before, m + ahead + lag, lag))
        new = [np.array(found, np.int64).reshape(-1, 3).T, *(np.stack(v) for v in touching(s, short, scale))]
        start, stop, period = np.unique(np.concatenate(new, axis=1), axis=1)
        fresh = ~known.cover(start, stop)
        known.add(start[fresh], stop[fresh], period[fresh])
        scale *= 2


def runs(s: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs of a sequence of integers, by start, then period."""
    known = Known()
    short_periods(s, known, FIRST_SCALE)
    long_periods(s, known, len(s) if longest is None else longest)
    return known.start, known.stop, known.period


def batch_runs(sequences: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each sequence of non-negative integers; those of like length are scanned together."""
    out = [(np.zeros(0, np.int64),) * 3] * len(sequences)
    classes = defaultdict(list)
    for i, v in enumerate(sequences):
        if len(v) >= SHORTEST:
            classes[max(len(v).bit_length(), FIRST_SCALE.bit_length())].append(i)
    for own in classes.values():
        sizes = np.array([len(sequences[i]) + 1 for i in own])
        first = np.cumsum(sizes) - sizes
        joined = np.concatenate([part for n, i in enumerate(own) for part in (sequences[i], np.array([-1 - n]))])
        start, stop, period = runs(joined, int(sizes.max()) - 1)
        edge = np.searchsorted(start, np.r_[first, len(joined)])
        for i, at, a, b in zip(own, first, edge[:-1], edge[1:]):
            if b > a:
                out[i] = start[a:b] - at, stop[a:b] - at, period[a:b]
    return out


def dropped(n: int, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words inside some run after its first period."""
    depth = np.bincount(start + period, minlength=n + 1)[: n + 1] - np.bincount(stop, minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``runs`` (array of ``start``, ``length``, ``period`` by start, then period) and ``collapsed``, the text of single-spaced words without the repeats.

    Words end at ASCII white space. ``prepare`` may change the words of a row beforehand; it gets the id and the words.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long = pa.int64()
    span = pa.struct([("start", long), ("length", long), ("period", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = [t.split() for t in text_bytes(part.column("text"))]
                if prepare is not None:
                    texts = [prepare(i, t) for i, t in zip(part.column("doc_id").to_pylist(), texts)]
                numbers: defaultdict[bytes, int] = defaultdict()
                numbers.default_factory = numbers.__len__
                found = batch_runs([np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts])
                offsets = np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)
                start, stop, period = (np.concatenate(v) for v in zip(*found))
                kept = []
                for words, own in zip(texts, found):
                    if len(own[0]):
                        words = [w for w, gone in zip(words, dropped(len(words), *own).tolist()) if not gone]
                    kept.append(b" ".join(words))
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(stop - start), pa.array(period)], fields=list(span))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], long), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(kept, pa.string())],
                                                 names=["doc_id", "n_words", "runs", "collapsed"])

    struct = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(struct)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(run, schema)
