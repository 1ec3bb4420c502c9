"""Operator 4: removal of repeated 50-byte strings by longest previous factors in suffix order.

A byte goes if a string of ``width`` = 50 bytes that covers it also starts in a document with a smaller id. In terms of
suffixes: a suffix whose longest previous factor (the longest common prefix with a suffix of an earlier document, found
at its previous or next smaller neighbour in suffix order) reaches 50 has its first 50 bytes removed. Only factors of
50 bytes matter, so suffixes are ordered by their first 50 bytes, and by document where those agree: the previous smaller
neighbour is then the head of the run of equal prefixes, and next smaller neighbours never reach 50.

Not all suffixes are sorted. *Anchors* are the k-byte strings with the smallest hash in some window of 50 bytes; whether a
string is one depends on the window alone, so equal 50-byte strings have an anchor at the same place.

1. Every document sends a row (key, context, id) per anchor: a hash of the anchor and one of all bytes within reach of the
   windows around it. Sorted by key, they stream by: a key of one document is dropped; a context that an earlier document
   has too is *covered*, and all its windows go; the first document of a context is *open* if its key has other contexts.
2. The documents get their marks back (join on the id), and send the bytes around open anchors by key.
3. The suffixes around the open anchors of a key are put in suffix order, which gives those with an earlier document.
   Keys with more than ``HELD`` open anchors are handed on instead: their suffixes become rows, the earliest document of
   each 50-byte prefix comes from a partial aggregate, and a salted join takes it back to the suffixes.
4. Spans go back to the documents (join on the id) and are removed.

Copies thus meet as equal contexts, in a sorted stream with constant memory, and only the edges of repeated passages are
compared byte by byte. Step 3 holds at most ``HELD`` and a batch of open anchors, whatever the key. Texts are read in
blocks of ``BLOCK`` bytes that overlap by the reach of an anchor, so memory doesn't follow the length of a text.

Null texts count as empty. Rows with a null id are kept whole and don't make others go. Rows with equal ids don't remove
each other's bytes. Repeated rows come back once each. Other columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_buffer, materialised, slices

WIDTH = 50
ANCHOR = 20
REACH = WIDTH - ANCHOR
#: Bytes of one text whose anchors are taken at a time.
BLOCK = 1 << 19
#: Open anchors of one key that a task orders itself.
HELD = 50_000
#: Tasks that share the suffixes with one prefix.
SALT = 8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _B
    z ^= z >> np.uint64(29)
    z += y
    z *= _A
    z ^= z >> np.uint64(32)
    return z


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every ``width`` neighbours, by doubling."""
    s = 1
    while s * 2 <= width:
        x = f(x[:-s], x[s:])
        s *= 2
    return f(x[: len(x) - (width - s)], x[width - s :]) if s < width else x


class Anchors:
    """Anchors of a batch of texts: ``owner`` (text), ``at`` (place in the padded buffer), ``key``, ``context``, ``left`` and ``right`` reach."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        # REACH zeros before the first text and WIDTH after each keep contexts within the buffer
        self.begin = REACH + offsets[:-1] + WIDTH * np.arange(n)
        self.end = self.begin + sizes
        buf = np.zeros(REACH + len(data) + WIDTH * n + REACH, np.uint8)
        if len(data):
            buf[np.arange(len(data)) + np.repeat(self.begin - offsets[:-1], sizes)] = data
        self.buf = buf
        h = {1: (buf.astype(np.uint64) + np.uint64(1)) * _A}
        for s in (1, 2, 4, 8):
            h[2 * s] = _join(h[s][:-s], h[s][s:])
        anchor = _join(h[16][: len(buf) - ANCHOR + 1], h[4][16:])
        least = _slide(anchor, REACH + 1, np.minimum)
        inside = np.zeros(len(buf) + 1, np.int8)
        long = sizes >= WIDTH
        inside[self.begin[long]] += 1
        inside[self.end[long] - WIDTH + 1] -= 1
        least[np.cumsum(inside[: len(least)], dtype=np.int8) == 0] = 0  # windows that don't lie in one text
        most = _slide(np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)]), REACH + 1, np.maximum)
        self.at = np.flatnonzero(most[: len(anchor)] == anchor)
        self.owner = np.searchsorted(self.begin, self.at, side="right") - 1
        self.left = np.minimum(self.at - self.begin[self.owner], REACH)
        self.right = np.minimum(self.end[self.owner] - self.at, WIDTH)
        key = anchor[self.at]
        context = key
        for shift, s in ((ANCHOR, 16), (ANCHOR + 16, 8), (ANCHOR + 24, 4), (ANCHOR + 28, 2), (-REACH, 16), (-14, 8), (-6, 4), (-2, 2)):
            context = _join(context, self._reach(h, shift, s))
        context = _join(context, (self.left * 64 + self.right).astype(np.uint64))
        self.key = (key >> np.uint64(16)).view(np.int64)
        self.context = (context & ~np.uint64(1)).view(np.int64)
        self.place = self.at - self.begin[self.owner]

    def only(self, which: np.ndarray) -> None:
        """Forget the other anchors."""
        for name in ("at", "owner", "left", "right", "key", "context", "place"):
            setattr(self, name, getattr(self, name)[which])

    def _reach(self, h: dict, shift: int, s: int) -> np.ndarray:
        """Hashes of s bytes at a distance from the anchors, with other texts' bytes and padding as zero."""
        at = self.at + shift
        out = h[s][at]
        cut = np.flatnonzero((shift + s > self.right) | (-shift > self.left))
        if len(cut):
            places = at[cut][:, None] + np.arange(s)[None]
            own = np.where((places >= self.begin[self.owner[cut]][:, None]) & (places < self.end[self.owner[cut]][:, None]), self.buf[places], 0)
            part = (own.astype(np.uint64) + np.uint64(1)) * _A
            while part.shape[1] > 1:
                # the same tree of halves as the dense hashes
                part = _pairwise(part)
            out = out.copy()
            out[cut] = part[:, 0]
        return out

    def bytes_around(self, which: np.ndarray) -> np.ndarray:
        """(n, REACH + WIDTH) bytes around anchors; those beyond their reach are not to be read."""
        return self.buf[self.at[which][:, None] + np.arange(-REACH, WIDTH)[None]]


def anchors_of(texts: pa.Array, block: int = BLOCK) -> Iterator[Anchors]:
    """Anchors of a batch of texts, a single long text in blocks; ``place`` is where they are in their text.

    An anchor and its context depend on the bytes from REACH before it to WIDTH after its start, so a block that reads
    those beyond the anchors it owns finds what the whole text has.
    """
    data, offsets = byte_buffer(texts)
    if len(texts) > 1 or len(data) <= block:
        yield Anchors(data, offsets)
        return
    for start in range(0, len(data), block):
        first, last = max(0, start - REACH), min(len(data), start + block + WIDTH)
        a = Anchors(data[first:last], np.array([0, last - first]))
        a.place = a.place + first
        a.only((a.place >= start) & (a.place < start + block))
        yield a


def _pairwise(x: np.ndarray) -> np.ndarray:
    return _join(x[:, ::2], x[:, 1::2])


def earlier_reach(around: np.ndarray, left: np.ndarray, right: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For anchors with the bytes around them: (lowest, highest) offset before the anchor at which a suffix starts whose longest previous factor reaches WIDTH; -1 for none."""
    n = len(doc)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    factor = np.uint64(0x5851F42D4C957F2D)
    inverse, top = np.uint64(pow(int(factor), -1, 1 << 64)), np.uint64(pow(int(factor), WIDTH - 1, 1 << 64))
    roll = np.zeros(n, np.uint64)
    for c in range(REACH, REACH + WIDTH):
        roll = roll * factor + around[:, c]
    for j in range(REACH + 1):
        if j:
            roll = (roll - around[:, REACH + WIDTH - j]) * inverse + around[:, REACH - j] * top
        fits = np.flatnonzero((left >= j) & (right >= WIDTH - j))
        if not len(fits):
            continue
        mixed = _join(key[fits].view(np.uint64), roll[fits])
        # a suffix without an equal hash beside it can't reach WIDTH; only the others are sorted by their bytes
        order = np.argsort(mixed)
        m = mixed[order]
        again = np.r_[False, m[1:] == m[:-1]]
        twin = fits[order[again | np.r_[again[1:], False]]]
        if not len(twin):
            continue
        ordered, head = suffix_order(around[twin, REACH - j : REACH - j + WIDTH], key[twin], doc[twin])
        found = twin[ordered[doc[twin[ordered]] > doc[twin[head]]]]
        low[found] = np.where(low[found] < 0, j, low[found])
        high[found] = j
    return low, high


def suffix_order(prefix: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by (key, first WIDTH bytes, document), and for each place the head of its run of equal prefixes: its previous smaller neighbour, if that is of an earlier document."""
    padded = np.zeros((len(prefix), -(-WIDTH // 8) * 8), np.uint8)
    padded[:, :WIDTH] = prefix
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((doc, *(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), key))
    w, k = words[order], key[order]
    start = np.r_[True, (k[1:] != k[:-1]) | (w[1:] != w[:-1]).any(axis=1)]
    return order, order[np.flatnonzero(start)[np.cumsum(start) - 1]]


def _anchor_rows(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", block):
            for a in anchors_of(part.column("text"), block):
                ids = np.asarray(part.column("doc_id"))[a.owner]
                order = np.lexsort((a.context, a.key, ids))
                t = [v[order] for v in (a.key, a.context, ids)]
                once = np.ones(len(order), bool)
                once[1:] = (t[0][1:] != t[0][:-1]) | (t[1][1:] != t[1][:-1]) | (t[2][1:] != t[2][:-1])
                yield pa.RecordBatch.from_arrays([pa.array(v[once]) for v in t], names=["key", "context", "doc_id"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, context, doc_id): ``doc_id``, ``mark`` (the context, odd if covered).

    Only the first document of the running context, and that of a key's first context, are carried from batch to batch.
    """
    key, context, first, waiting = None, None, None, None
    for batch in batches:
        if not len(batch):
            continue
        k, c, d = (np.asarray(batch.column(n)) for n in ("key", "context", "doc_id"))
        same_key = np.r_[key is not None and k[0] == key, k[1:] == k[:-1]]
        same = same_key & np.r_[context is not None and c[0] == context, c[1:] == c[:-1]]
        head = np.maximum.accumulate(np.where(same, -1, np.arange(len(k))))
        covered = same & (d > np.where(head < 0, first if first is not None else 0, d[np.maximum(head, 0)]))
        docs, marks = [d[covered]], [c[covered] | 1]
        # heads of contexts are open if their key has another context
        new_key, heads = ~same_key, np.flatnonzero(~same)
        group = np.cumsum(new_key)
        held = waiting
        sizes = np.bincount(group[heads], minlength=group[-1] + 1)
        began = not new_key[0]  # rows of group 0 go on from the batch before
        many = sizes > 1
        if began:
            many[0] = sizes[0] > 0 or held is False
            if sizes[0] and held not in (None, False):
                docs.append(np.array([held[1]]))
                marks.append(np.array([held[0]]))
                held = False
        open_heads = heads[many[group[heads]]]
        docs.append(d[open_heads])
        marks.append(c[open_heads])
        last = group[-1]
        if last > 0 or not began:
            tail = heads[group[heads] == last]
            waiting = (c[tail[0]], d[tail[0]]) if len(tail) == 1 else False
        else:
            waiting = held
        key, context = k[-1], c[-1]
        first = d[head[-1]] if head[-1] >= 0 else first
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs).astype(np.int64)), pa.array(np.concatenate(marks).astype(np.int64))], names=["doc_id", "mark"])


#: Columns of the rows of open anchors.
OPEN = ["key", "doc_id", "row", "at", "left", "right", "around"]


def _around(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Per document a row with its covered spans, and per open anchor a row with the bytes around it."""
    for batch in batches:
        for part in slices(batch.filter(pa.compute.is_valid(batch.column("marks"))), "text", block):
            ids, rows = np.asarray(part.column("doc_id")), np.asarray(part.column("row"))
            marks = part.column("marks")
            ends, flat = np.asarray(marks.offsets).astype(np.int64), np.asarray(marks.values)
            for a in anchors_of(part.column("text"), block):
                yield from _around_part(a, ids, rows, ends, flat)


def _around_part(a: Anchors, ids: np.ndarray, rows: np.ndarray, ends: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    bounds = np.searchsorted(a.owner, np.arange(len(ids) + 1))
    opened, spans = [], []
    for i in range(len(ids)):
        own = np.sort(flat[ends[i] : ends[i + 1]])
        here = np.arange(bounds[i], bounds[i + 1])
        c = a.context[here]
        full = own[np.minimum(np.searchsorted(own, c | 1), len(own) - 1)] == (c | 1)
        free = ~full & (own[np.minimum(np.searchsorted(own, c), len(own) - 1)] == c)
        h = here[full]
        spans.append(merged(a.place[h] - a.left[h], a.place[h] + a.right[h]))
        opened.append(here[free])
    yield _span_rows(rows, ids, spans)
    opened = np.concatenate(opened) if opened else np.zeros(0, int)
    for at in range(0, len(opened), 20_000):
        o = opened[at : at + 20_000]
        w = a.owner[o]
        around = np.ascontiguousarray(a.bytes_around(o))
        yield pa.RecordBatch.from_arrays([pa.array(a.key[o]), pa.array(ids[w]), pa.array(rows[w]), pa.array(a.place[o]), pa.array(a.left[o].astype(np.int32)), pa.array(a.right[o].astype(np.int32)), fixed_binary(around)], names=OPEN)


def fixed_binary(values: np.ndarray) -> pa.Array:
    """Rows of a contiguous (n, width) byte matrix as a binary column."""
    n, width = values.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(values.tobytes())])


def _span_rows(rows: np.ndarray, ids: np.ndarray, spans: list[np.ndarray]) -> pa.RecordBatch:
    has = np.array([len(s) > 0 for s in spans], dtype=bool)
    packed = [s.astype("<i8").tobytes() for s in spans if len(s)]
    n = len(packed)
    return pa.RecordBatch.from_arrays([pa.array(rows[has]), pa.array(ids[has]), pa.array(rows[has]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(packed, pa.binary())], names=OPEN)


def merged(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """(n, 2) union of spans, those that touch joined."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(stops[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return np.stack([s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]]], axis=1)


def _resolve(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: spans pass, open anchors are resolved, whole keys at a time; those of a key with more than ``most`` are handed on as they are."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("around", pa.binary())])
    held: list[pa.RecordBatch] = []  # rows of the last key so far
    crowded = None  # the key whose rows are handed on

    def finish(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        around = b"".join(t["around"].to_pylist())
        n = len(t)
        low, high = earlier_reach(np.frombuffer(around, np.uint8).reshape(n, REACH + WIDTH), *(np.asarray(t[c]) for c in ("left", "right", "key", "doc_id")))
        got = np.flatnonzero(high >= 0)
        at, rows, ids = (np.asarray(t[c])[got] for c in ("at", "row", "doc_id"))
        spans = np.stack([at - high[got], at - low[got] + WIDTH], axis=1).astype("<i8")
        return _span_rows(rows, ids, [x.reshape(1, 2) for x in spans])

    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column(n) for n in OPEN], names=OPEN)
        passing = pa.compute.is_null(batch.column("at"))
        spans = batch.filter(passing)
        if len(spans):
            yield spans
        rest = batch.filter(pa.compute.invert(passing))
        if crowded is not None and len(rest):
            stop = int(np.searchsorted(np.asarray(rest.column("key")), crowded, side="right"))
            if stop:
                yield rest.slice(0, stop)
            rest = rest.slice(stop)
            crowded = None if len(rest) else crowded
        if not len(rest):
            continue
        key = np.asarray(rest.column("key"))
        if held and np.asarray(held[-1].column("key"))[-1] != key[0]:
            yield finish(pa.Table.from_batches(held))
            held = []
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        stops = np.r_[starts[1:], len(key)]
        ready = 0  # rows from here on wait for their turn
        for start, stop in zip(starts.tolist(), stops.tolist()):
            before = sum(map(len, held)) if start == 0 else 0
            if before + stop - start > most:
                if start > ready:
                    yield finish(pa.Table.from_batches([*held, rest.slice(ready, start - ready)], schema=schema))
                    held = []
                yield from held
                yield rest.slice(start, stop - start)
                held, ready = [], stop
                crowded = int(key[start]) if stop == len(key) else None
            elif stop < len(key) and stop - ready >= most:
                yield finish(pa.Table.from_batches([*held, rest.slice(ready, stop - ready)], schema=schema))
                held, ready = [], stop
        last = max(ready, int(starts[-1]))
        if last > ready:
            yield finish(pa.Table.from_batches([*held, rest.slice(ready, last - ready)], schema=schema))
            held = []
        if last < len(key):
            held.append(rest.slice(last))
    if held:
        yield finish(pa.Table.from_batches(held))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of at least WIDTH bytes around open anchors: their first WIDTH bytes and the span of those in the text."""
    for batch in batches:
        for begin in range(0, len(batch), 5_000):
            part = batch.slice(begin, 5_000)
            around = np.frombuffer(b"".join(part.column("around").to_pylist()), np.uint8).reshape(len(part), REACH + WIDTH)
            at, left, right, ids, rows = (np.asarray(part.column(c)) for c in ("at", "left", "right", "doc_id", "row"))
            for j in range(REACH + 1):
                fits = np.flatnonzero((left >= j) & (right >= WIDTH - j))
                if len(fits):
                    prefix = fixed_binary(np.ascontiguousarray(around[fits, REACH - j : REACH - j + WIDTH]))
                    span = np.ascontiguousarray((at[fits, None] + np.array([-j, WIDTH - j])).astype("<i8")).view(np.uint8)
                    yield pa.RecordBatch.from_arrays([prefix, pa.array(ids[fits]), pa.array(rows[fits]), fixed_binary(span)], names=["prefix", "doc_id", "row", "spans"])


def suffix_spans(crowded: DataFrame) -> DataFrame:
    """``doc_id``, ``row`` and ``spans`` of the suffixes whose first WIDTH bytes an earlier document has too, without a group per key.

    The documents of one prefix meet in a partial aggregate; only prefixes of several documents are joined back, salted.
    """
    suffixes = crowded.select(*OPEN).mapInArrow(_suffixes, "prefix binary, doc_id long, row long, spans binary")
    first = suffixes.groupBy("prefix").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = first.select("prefix", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = suffixes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "spans"), F.lit(SALT)).cast("int"))
    later = salted.join(first, ["prefix", "salt"]).where(F.col("doc_id") > F.col("first"))
    return later.select("doc_id", "row", "spans")


def _removed(text: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for start, stop in spans.tolist():
        out.append(text[at:start])
        at = stop
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, as_text: bool = False, most: int = HELD, block: int = BLOCK) -> DataFrame:
    """Per document: the columns ``keep`` (by default ``doc_id``), ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans`` and ``spans`` (start and stop of the removed bytes in the input).

    ``most`` (open anchors of one key in a task) and ``block`` (bytes read at a time) bound the memory; results don't depend on them.
    With ``as_text`` a column ``text`` takes the place of ``kept``; characters that lost some of their bytes are left out of it.
    """
    fields = [f for f in docs.schema.fields if f.name in keep] if keep else [docs.schema[id_col]]
    mine = [f"keep{i}" for i in range(len(fields))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(f.name).alias(m) for f, m in zip(fields, mine))).withColumn("row", F.monotonically_increasing_id())
    known = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WIDTH))
    anchors = known.select("doc_id", "text").mapInArrow(partial(_anchor_rows, block=block), "key long, context long, doc_id long")
    marks = anchors.repartition("key").sortWithinPartitions("key", "context", "doc_id").mapInArrow(_marks, "doc_id long, mark long")
    marked = materialised(marks.groupBy("doc_id").agg(F.collect_list("mark").alias("marks")))
    # both joins read the same columns of the documents on the same side, so their texts are shuffled once
    around = rows.join(marked, "doc_id", "left").mapInArrow(partial(_around, block=block), "key long, doc_id long, row long, at long, left int, right int, around binary")
    resolved = materialised(around.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_resolve, most=most), around.schema))
    spans = resolved.where("at is null").select("doc_id", "row", F.col("around").alias("spans")).unionByName(suffix_spans(resolved.where("at is not null")))
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("row", "spans")).alias("found"))
    left = T.StructField("text", T.StringType()) if as_text else T.StructField("kept", T.BinaryType())
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([*(T.StructField(m, f.dataType) for m, f in zip(mine, fields)), left, *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("spans", span)])
    names = schema.fieldNames()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                kept, size, gone, number, lists = [], [], [], [], []
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for text, row, found in zip(texts, part.column("row").to_pylist(), part.column("found").to_pylist()):
                    text = text or b""
                    own = [np.frombuffer(f["spans"], "<i8").reshape(-1, 2) for f in found or () if f["row"] == row]
                    both = np.concatenate(own) if own else np.zeros((0, 2), np.int64)
                    both = merged(both[:, 0], both[:, 1])
                    rest = _removed(text, both)
                    kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                    size.append(len(text))
                    gone.append(int((both[:, 1] - both[:, 0]).sum()))
                    number.append(len(both))
                    lists.append([{"start": a, "stop": b} for a, b in both.tolist()])
                yield pa.RecordBatch.from_arrays([*(part.column(m) for m in mine), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(number, pa.int64()),
                                                  pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=names)

    done = rows.join(by_doc, "doc_id", "left").mapInArrow(apply, schema)
    return done.select(*(F.col(m).alias(f.name) for m, f in zip(mine, fields)), *names[len(mine) :])
