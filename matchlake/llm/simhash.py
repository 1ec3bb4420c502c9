"""Operator 8: SimHash near-duplicates found with fuzzy hashing by the binary Golay code.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints link at ``MAX_BITS`` = 3 or
fewer differing bits. To find the links, the 64 bits are cut into segments of 22, 21 and 21 bits, padded to the 23 bits of
the Golay code. The code is perfect: every word lies within 3 bits of exactly one codeword; and if that distance is 3, five
more codewords lie at distance 4. These one or six codeword indices are a segment's fuzzy keys, and any two words that
differ in at most 2 bits share one (the six difference patterns partition the 23 places, so two further flips always leave
a common codeword within reach).

By the pigeonhole principle 3 errors fall on the segments in one of two ways. Either some segment has none and the one
after it at most 2: a key joins the exact segment and the fuzzy index of the next. Or each has one: a key joins the fuzzy
index of the first with one half each of the other two, of which one half is untouched. Fingerprints that share a key are
verified. Within the rows of a key a search from one fingerprint to those not yet reached keeps the work near-linear for
dense groups and returns a spanning forest of the links, not all pairs. Components follow by alternating stars.

Equal fingerprints are one node, however many documents have them. Null texts count as empty; texts without words have
fingerprint zero and link like any other. Rows with a null id get a component too; the component id is the smallest
non-null id. Repeated rows come back once each. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, slices, text_bytes
from .graph import components

MAX_BITS = 3
SEED = 42
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bits set in over half of the XXH64 hashes of the shingles; A-Z count as a-z, words end at ASCII white space."""
    words = text.lower().split()  # of bytes: only A-Z change, and only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    parts = []
    for at in range(0, n, 65_536):
        stop = min(n, at + 65_536)
        spans = zip(starts[at:stop].tolist(), ends[at + shingle - 1 : stop + shingle - 1].tolist())
        parts.append(bit_counts(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, stop - at)))
    return majority(sum(parts), n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits set in over half of n hashes."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp``: the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                fps = np.array([fingerprint(t, shingle) for t in text_bytes(part.column("text"))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: the error patterns to codewords within 3 bits or, from distance 3, within 4 (unused places repeat the first), and their number."""
    powers = [1]
    for _ in range(22):
        p = powers[-1] << 1
        powers.append(p ^ GENERATOR if p >> 11 else p)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for b in places:
                s ^= powers[b]
            if weight < 4 or bin(found[s][0]).count("1") == 3:
                found[s].append(sum(1 << b for b in places))
    return np.array([f + [f[0]] * (6 - len(f)) for f in found], dtype=np.uint32), np.array([len(f) for f in found])


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the low 12 bits and of the bits above."""
    out = np.arange(1 << 23, dtype=np.uint32)
    for b in range(22, 10, -1):
        out ^= np.where(out >> b & 1, np.uint32(GENERATOR << (b - 11)), np.uint32(0))
    return out[: 1 << 12].copy(), out[:: 1 << 12].copy()


def codeword_indices(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of nearby codewords, and how many of them count for each word."""
    low, high = _syndromes()
    patterns, number = _golay()
    s = low[word & 4095] ^ high[word >> 12]
    return (word[:, None] ^ patterns[s]) >> 11, number[s]


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) of all keys of unsigned 64-bit fingerprints."""
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.uint32) for at, size in SEGMENTS]
    fuzzy = [codeword_indices(s) for s in seg]
    owners, keys = [], []

    def add(family: int, exact: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> None:
        used = np.arange(6)[None] < index[1][:, None]
        full = (np.uint64(family) << np.uint64(40)) | (exact.astype(np.uint64)[:, None] << np.uint64(12)) | index[0].astype(np.uint64)
        owners.append(np.nonzero(used)[0])
        keys.append(full[used])

    for i in range(3):
        add(i, seg[i], fuzzy[(i + 1) % 3])
    halves = [(s & 0x7FF, s >> 11) for s in seg[1:]]
    for a in range(2):
        for b in range(2):
            add(3 + 2 * a + b, halves[0][a] << 11 | halves[1][b], fuzzy[0])
    return np.concatenate(owners), np.concatenate(keys).view(np.int64)


def bucket_links(fps: np.ndarray, limit: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one key."""
    left, links = fps, []
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            x, wave = wave[0], wave[1:]
            near = np.bitwise_count(left ^ x) <= limit
            if near.any():
                links += [(int(x), int(y)) for y in left[near]]
                wave, left = np.concatenate([wave, left[near]]), left[~near]
    return links


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that connect whatever links at ``MAX_BITS``."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                fp = np.asarray(batch.column("fp").slice(at, 20_000))
                owner, key = bucket_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[owner])], names=["key", "fp"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last key of a batch may go on in the next."""
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        def batch_links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            two = start[size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS]
            pairs = list(zip(fp[near].tolist(), fp[near + 1].tolist()))
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                pairs += bucket_links(fp[s : s + n])
            new = []
            for a, b in pairs:
                # links within this task that are connected already are not sent again
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    new.append((a, b))
            ab = np.array(new, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([held_key, np.asarray(batch.column("key"))])
            fp = np.concatenate([held_fp, np.asarray(batch.column("fp")).view(np.uint64)])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            held_key, held_fp = key[cut:], fp[cut:]
            if cut:
                yield batch_links(key[:cut], fp[:cut])
        if len(held_key):
            yield batch_links(held_key, held_fp)

    keys = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(scan, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the smallest id that links lead to, the row's own included."""
    marked = materialised(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct))
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")
