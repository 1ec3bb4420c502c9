"""Operator 12: benchmark decontamination by winnowing.

A window is ``span`` consecutive words of an item (an item of fewer words, but not none, is one window). Texts are hashed by
k-grams of words, and of every run of w k-grams the one with the smallest hash is kept (of equals the last): with
k + w - 1 = span any shared window has the same k-gram kept on both sides, so no shared span of that length is missed. Items
of fewer words have a k and w of their own, by the same rule; documents are fingerprinted for every length that occurs.

Kept k-grams of items are joined with those of documents, and a hit is extended to its window word by word: the document
hands on the words around each k-gram, and they are compared with the item's own, so hashes never decide. Before the join a
bitmap of the items' hashes (at most 2**26 bits, whatever the benchmark's size) drops the document k-grams that no item has;
what it lets through wrongly is dropped by the join.

Documents are read once, in blocks of about 1 MB; very long texts are cut into blocks that overlap by a window. Rows of a
k-gram that many documents share are dealt over ``salts`` tasks. Windows that the same items have are one set of items, so a
passage that many items share meets them once per document, not once per window.

Null texts have no words. Rows with a null id are answered too, repeated rows once each. Items with a null id make hits, but
have no id to be listed; items with equal ids are one. Extra columns are dropped. Empty tables: no documents give no rows, no
items give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, slices, text_bytes

SPAN = 10
BLOCK = 1 << 20
MAP_BITS = 26
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: A-Z become a-z; other ASCII characters than letters and digits separate words.
FOLD = bytes(c if c >= 128 or c in _WORD else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BASE, _STEP, _MIX = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def gram_shape(length: int) -> tuple[int, int]:
    """(k, w) with k + w - 1 = length."""
    k = (length + 1) // 2
    return k, length - k + 1


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            for name, v in (("up", _BASE), ("down", np.uint64(pow(int(_BASE), -1, 1 << 64)))):
                steps = np.full(size, v)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


class Words:
    """Words of a folded buffer: where they start and stop, a 64-bit hash of each, and the text that each belongs to."""

    def __init__(self, buffer: bytes, offsets: np.ndarray):
        raw = np.frombuffer(buffer, np.uint8)
        edge = np.diff(np.r_[False, raw != 32, False].view(np.int8))
        self.buffer, self.start, self.stop = buffer, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        up, down = Powers.of(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * up[: len(raw)], out=total[1:])
        self.hash = (total[self.stop] - total[self.start]) * down[self.start]

    def __len__(self) -> int:
        return len(self.start)

    def join(self, first: int, last: int) -> str:
        return b" ".join(self.buffer[self.start[first] : self.stop[last - 1]].split()).decode()

    def winnowed(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every window of ``length`` words within one text: its first word, the first word of its k-gram, and the hash."""
        k, w = gram_shape(length)
        windows = len(self) - length + 1
        if windows <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = np.full(len(self) - k + 1, np.uint64(length))
        for j in range(k):
            grams *= _STEP
            grams += self.hash[j : j + len(grams)]
        grams ^= grams >> np.uint64(29)
        grams *= _MIX
        grams ^= grams >> np.uint64(32)
        least = grams[:windows].copy()
        for at in range(1, w):
            np.minimum(least, grams[at : at + windows], out=least)
        place = np.zeros(windows, np.int8)
        for at in range(1, w):
            place[grams[at : at + windows] == least] = at  # of equals the last
        first = np.flatnonzero(self.text[:windows] == self.text[length - 1 :])
        return first, first + place[first], least[first]


def blocks(texts: list[bytes]) -> Iterator[tuple[Words, int, int]]:
    """(words, number of the first text, words of that text before) in blocks; a long text overlaps its next block by a window."""
    if len(texts) > 1 or len(texts[0]) <= BLOCK:
        sizes = np.array([len(t) + 1 for t in texts])
        yield Words(b" ".join(texts).translate(FOLD), np.cumsum(sizes) - sizes), 0, 0
        return
    folded, at, stop, before = texts[0].translate(FOLD), 0, 0, 0
    while True:
        stop = folded.find(b" ", stop + BLOCK)  # each block has as many new bytes, however long its words are
        words = Words(folded[at : stop if stop >= 0 else len(folded)], np.zeros(1, np.int64))
        yield words, 0, before
        if stop < 0:
            return
        again = max(len(words) - (SPAN - 1), 0)
        at, before = at + int(words.start[again]) if len(words) else stop, before + again


def item_windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``item_id``, ``length``, ``fp``, ``offset`` (of the k-gram in the window) and ``window`` (its words), distinct."""
    if span > SPAN:
        raise ValueError(f"blocks overlap by {SPAN} words")
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                texts = text_bytes(part.column("text"))
                for words, _, before in blocks(texts):
                    own = np.bincount(words.text, minlength=len(texts))
                    for length in range(1, span + 1):
                        first, gram, fp = words.winnowed(length)
                        # shorter windows only for whole texts of that many words
                        take = np.ones(len(first), bool) if length == span else (own[words.text[first]] == length) & (before == 0)
                        first, gram, fp = first[take], gram[take], fp[take]
                        yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(words.text[first])), pa.array(np.full(len(first), length, np.int32)), pa.array(fp.view(np.int64)),
                                                          pa.array((gram - first).astype(np.int32)), pa.array([words.join(a, a + length) for a in first.tolist()], pa.string())],
                                                         names=["item_id", "length", "fp", "offset", "window"])

    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, length int, fp long, offset int, window string").distinct()


def bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the leading digits of all hashes, 64 times as many as hashes, at most 2**26 (8 MB)."""
    n = windows.select("fp").distinct().count()
    bits = min(MAP_BITS, max(10, (64 * n).bit_length()))
    at = F.shiftrightunsigned("fp", 64 - bits)
    rows = windows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(fp, {64 - bits}) & 63 as int)))").alias("set"))
    found = rows.toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[np.asarray(found["word"])] = np.asarray(found["set"])
    return out.view(np.uint64)


def document_hits(docs: DataFrame, seen: np.ndarray, lengths: list[int], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``doc_id``, ``n_words``, and ``hits``: the kept k-grams whose hash ``seen`` has, each with its place ``at``, the words around it and how many of these stand ``before``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    shift = np.uint64(64 - (len(seen) * 64 - 1).bit_length())
    kinds = pa.struct([("fp", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("words", pa.string())])

    def found(words: Words, owners: int) -> Iterator[tuple[int, int, int, int, str]]:
        """(text, fp, word of the block, words before, words around)"""
        first_word = np.searchsorted(words.text, np.arange(owners + 1))
        for length in lengths:
            k, w = gram_shape(length)
            _, gram, fp = words.winnowed(length)
            kept = np.r_[True, gram[1:] != gram[:-1]] if len(gram) else np.zeros(0, bool)  # windows in order keep the same k-gram in a row
            gram, fp = gram[kept], fp[kept]
            index = fp >> shift
            possible = np.flatnonzero(seen[(index >> np.uint64(6)).astype(np.int64)] >> (index & np.uint64(63)) & np.uint64(1))
            for g, h in zip(gram[possible].tolist(), fp[possible].view(np.int64).tolist()):
                t = int(words.text[g])
                low, high = max(int(first_word[t]), g - w + 1), min(int(first_word[t + 1]), g + k + w - 1)
                yield t, h, g, g - low, words.join(low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                texts = text_bytes(part.column("text"))
                n_words, hits = np.zeros(len(texts), np.int64), [[] for _ in texts]
                for words, _, passed in blocks(texts):
                    start = np.searchsorted(words.text, np.arange(len(texts)))
                    n_words = np.bincount(words.text, minlength=len(texts)) + passed
                    for t, fp, g, before, around in found(words, len(texts)):
                        hits[t].append({"fp": fp, "at": g - int(start[t]) + passed, "before": before, "words": around})
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(kinds))], names=["row", "doc_id", "n_words", "hits"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n_words long, hits array<struct<fp:bigint,at:bigint,before:int,words:string>>")


def _dealt(big: DataFrame, small: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Inner join; the rows of one key of ``big`` are dealt over ``salts`` tasks by their row."""
    salted = big.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "salt"]).drop("salt")


def contamination(docs: DataFrame, items: DataFrame, *, span: int = SPAN, salts: int = 16) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``n_hit`` (words inside windows of items), ``n_items`` and ``items`` (ids as sorted strings)."""
    of_items = materialised(item_windows(items, span=span))
    lengths = sorted(r[0] for r in of_items.select("length").distinct().collect())  # at most ``span``
    marked = materialised(document_hits(docs, bitmap(of_items), lengths))

    # items as sets: windows with the same ids have the same three digests
    group = ["set_a", "set_b", "set_n"]
    digests = [F.bit_xor(F.xxhash64("item_id")).alias("set_a"), F.bit_xor(F.xxhash64(F.lit("b"), "item_id")).alias("set_b"), F.count("item_id").alias("set_n")]
    distinct = of_items.groupBy("length", "fp", "offset", "window").agg(*digests)
    members = of_items.where("item_id is not null").join(distinct, ["length", "fp", "offset", "window"]).select(*group, "item_id").distinct()

    hits = marked.select("row", F.explode("hits").alias("h")).select("row", "h.fp", "h.at", "h.before", F.split("h.words", " ").alias("around"))
    wanted = distinct.withColumn("wanted", F.split("window", " ")).drop("window")
    same = F.expr("offset <= before and slice(around, before - offset + 1, length) = wanted")
    matched = materialised(_dealt(hits, wanted, ["fp"], salts).where(same).select("row", (F.col("at") - F.col("offset")).alias("start"), "length", *group))

    ends = F.expr("max(start + length) over (partition by row order by start rows between unbounded preceding and 1 preceding)")
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", F.coalesce(ends, F.lit(0))))
    covered = matched.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    pairs = _dealt(matched.select("row", *group).distinct(), members, group, salts).select("row", "item_id").distinct()
    listed = pairs.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    out = marked.select("row", "doc_id", "n_words").join(covered, "row", "left").join(listed, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
