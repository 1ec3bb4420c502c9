"""Near-duplicates by the Jaccard similarity of word shingles, verified exactly; the near-duplicate stage of the pipeline.

A text is the set of its five-word shingles (words as in ``simhash``; a shorter text is one shingle). Texts with the same
words are one node. Candidates are found in two ways. The SimHash fingerprints of the five-word shingles that differ in at most
3 bits meet by the Golay-coded fuzzy keys of ``op8`` (``simhash.links``); at the limit fingerprints differ in about 10 bits, so
this finds the nearer copies only. For the rest, candidates share the ``ROWS`` minimum hashes of one of ``BANDS`` bands: two sets of similarity 0.8 share
none with probability (1 - 0.8**5)**40, one in eight millions, and more similar ones less. A 256-bit parity map of the
hashes, whose differing bits never exceed the shingles that only one of two sets has, drops most pairs below the limit;
every other pair is decided on the whole sets. Fuzzy keys as in ``simhash`` would need hundreds per text at this limit.

Within the rows of a band a search from one node to those not yet reached keeps dense groups near-linear. Where one of its
links turns out below the limit, the members of what it connected are looked at again, in bands where their components differ
and with parity maps of two bits or more per shingle, which leave hardly any pair below the limit. First every node of a band
meets the likeliest node of another component, then all possible pairs between the components then left are verified, so the
components are those of all candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import component_labels
from .common import materialised, slices, text_bytes
from .simhash import SEED, bit_counts, links, majority

SHINGLE = 5
#: Similarity of at least LIMIT[0] / LIMIT[1].
LIMIT = (4, 5)
BANDS, ROWS = 40, 5
MAP_BITS = 256
_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)[:, None]
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def all_shingles(text: bytes, size: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """The words with one space between, and the XXH64 hashes of their shingles, repeats included."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return joined, np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return joined, np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def shingles(text: bytes, size: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """The words with one space between, and the sorted distinct XXH64 hashes of their shingles."""
    joined, hashes = all_shingles(text, size)
    return joined, np.unique(hashes)


def simhash(hashes: np.ndarray) -> int:
    """Fingerprint of a text from the hashes of all its shingles, as in ``simhash.fingerprint``."""
    return majority(sum(bit_counts(hashes[at : at + 65_536]) for at in range(0, len(hashes), 65_536)), len(hashes)) if len(hashes) else 0


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[None, at : at + 512] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i) for i in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def parity_map(hashes: np.ndarray, bits: int = MAP_BITS) -> bytes:
    """``bits`` is a power of two; a wider map can be folded to a narrower one (see ``folded``)."""
    odd = np.bincount((hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def wide_bits(n: int) -> int:
    return max(MAP_BITS, 1 << (2 * n - 1).bit_length())


def folded(wide: np.ndarray) -> np.ndarray:
    """The maps of half as many bits: neighbouring bits are added."""
    bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").reshape(len(wide), -1, 2)
    return np.packbits(bits[..., 0] ^ bits[..., 1], axis=1, bitorder="little").view(np.uint64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * LIMIT[1] >= LIMIT[0] * (len(x) + len(y) - both)


def possible(n: np.ndarray, maps: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Whether sizes and parity maps allow the limit between ``i`` and each of ``others``."""
    small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
    apart = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
    # similarity s leaves at most (1 - s) / (1 + s) of the summed sizes on one side only
    return (small * LIMIT[1] >= large * LIMIT[0]) & (apart * (LIMIT[1] + LIMIT[0]) <= (small + large) * (LIMIT[1] - LIMIT[0]))


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of every key with two or more rows; rows come sorted by key. Maps are objects of bytes."""
    held: list[list[np.ndarray]] = []  # parts of the key that is still open, joined once it ends

    def closed() -> Iterator[list[np.ndarray]]:
        if sum(len(v[0]) for v in held) > 1:
            yield [np.concatenate(v) for v in zip(*held)]

    key = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.asarray(batch.column(names[0]))
        cols = [np.array(c.to_pylist(), dtype=object) if name == "map" else np.asarray(c) for name, c in ((name, batch.column(name)) for name in names[1:])]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(keys)]):
            if keys[a] != key:
                yield from closed()
                held, key = [], keys[a]
            held.append([v[a:b] for v in cols])
    yield from closed()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ab = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ab.min(axis=1)), pa.array(ab.max(axis=1))], names=["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible pairs that connect, within each key, whatever possible pairs connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out: list[tuple[int, int]] = []
    for node, n, maps in _buckets(batches, ["key", "node", "n", "map"]):
        maps = np.frombuffer(b"".join(maps), np.uint64).reshape(len(node), -1)
        left = np.arange(len(node))
        while len(left):
            wave, left = [int(left[0])], left[1:]
            while wave and len(left):
                x = wave.pop()
                near = possible(n, maps, x, left)
                for y in left[near].tolist():
                    wave.append(y)
                    ra, rb = root(int(node[x])), root(int(node[y]))
                    if ra != rb:
                        # pairs within this task that are connected already are not sent again
                        parent[max(ra, rb)] = min(ra, rb)
                        out.append((int(node[x]), int(node[y])))
                left = left[~near]
        if len(out) >= 10_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _by_width(node: np.ndarray, n: np.ndarray, maps: list[bytes], label: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(nodes, sizes, maps, labels, whether of this width) for every width: its own rows, and those of the next width folded."""
    width = np.array([len(m) for m in maps])
    for bytes_ in np.unique(width):
        own, next_ = np.flatnonzero(width == bytes_), np.flatnonzero(width == 2 * bytes_)
        at = np.r_[own, next_]
        matrix = [np.frombuffer(b"".join(maps[i] for i in w), np.uint64).reshape(len(w), -1) for w in (own, next_) if len(w)]
        if len(next_):
            matrix[-1] = folded(matrix[-1])
        # sizes at the limit differ by less than two, so widths by one step at most
        yield node[at], n[at], np.concatenate(matrix), label[at], np.arange(len(at)) < len(own)


def _across(nearest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Possible pairs within each key whose components differ: all, or for every node the one with the fewest differing bits."""
        out: list[tuple[int, int]] = []
        for node, n, maps, label in _buckets(batches, ["key", "node", "n", "map", "label"]):
            for node_, n_, maps_, label_, own in _by_width(node, n, maps, label):
                for x in range(int(own.sum())):
                    rest = np.flatnonzero((label_ != label_[x]) & (~own | (np.arange(len(own)) > x)))
                    rest = rest[possible(n_, maps_, x, rest)]
                    if nearest_only and len(rest) > 1:
                        apart = np.bitwise_count(maps_[rest] ^ maps_[x]).sum(axis=1, dtype=np.int64) / (n_[rest] + n_[x])
                        rest = rest[[apart.argmin()]]
                    out += [(int(node_[x]), int(y)) for y in node_[rest].tolist()]
                if len(out) >= 10_000:
                    yield _edges(out)
                    out = []
        yield _edges(out)

    return run


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            digest, n, maps, keys, fps = [], [], [], [], []
            for text in text_bytes(part.column("text")):
                joined, hashes = all_shingles(text)
                fps.append(simhash(hashes))
                hashes = np.unique(hashes)
                digest.append(xxhash.xxh3_128_digest(joined))
                n.append(len(hashes))
                maps.append(parity_map(hashes))
                keys.append(band_keys(hashes))
            yield pa.RecordBatch.from_arrays([part.column("rank"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(maps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
                                             names=["rank", "digest", "n", "map", "keys", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            found = [shingles(t)[1].tobytes() for t in text_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.binary())], names=["node", "hashes"])


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            found = [shingles(t)[1] for t in text_bytes(part.column("text"))]
            maps = [parity_map(h, wide_bits(len(h))) for h in found]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(maps, pa.binary())], names=["node", "map"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "x", 16 << 20):
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "good"])


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a``, ``b``, ``good``: whether the texts of two rows reach the limit."""
    asked = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    sets = materialised(texts.join(asked, "row", "left_semi").select("row", "text").mapInArrow(_sets, "node long, hashes binary"))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return materialised(both.mapInArrow(_decided, "a long, b long, good boolean"))


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``a`` < ``b``: candidates whose SimHash fingerprints (``fp``) differ in 3 bits or fewer, found by the Golay-coded keys of ``op8``; they connect all such nodes."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    equal = nodes.join(first, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    linked = links(first).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    return equal.union(linked.select(F.least("x", "y"), F.greatest("x", "y")))


def first_rows(docs: DataFrame, rank: Column) -> DataFrame:
    """``row`` of the row with the smallest rank in each group of near-duplicates.

    ``docs`` has a unique long ``row`` and ``text``; ``rank`` is a struct with the field ``row``. Null texts count as empty;
    texts without words are one group.
    """
    texts = docs.select("row", F.col("text").cast("string").alias("text"), rank.alias("rank"))
    kind = texts.schema["rank"].dataType.simpleString()
    signed = materialised(texts.select("rank", "text").mapInArrow(_signed, f"rank {kind}, digest binary, n long, map binary, keys array<long>, fp long"))
    firsts = signed.groupBy("digest").agg(F.min(F.struct("rank", "n", "map", "keys", "fp")).alias("v")).select("v.*")
    nodes = materialised(firsts.select(F.col("rank.row").alias("node"), "rank", "n", "map", "keys", "fp"))

    def by_key(rows: DataFrame, *more: str) -> DataFrame:
        keyed = rows.select(F.explode("keys").alias("key"), "node", "n", "map", *more)
        return keyed.repartition("key").sortWithinPartitions("key", "node")

    banded = by_key(nodes).mapInArrow(_forest, "a long, b long")
    pairs = materialised(banded.union(fingerprint_pairs(nodes)).distinct())
    tested = verified(texts, pairs)
    labels = component_labels(tested.where("good"))

    def between(pairs: DataFrame) -> DataFrame:
        """The labels of both nodes of each pair, where they differ."""
        for side in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"own_{side}")), side, "left").withColumn(f"own_{side}", F.coalesce(f"own_{side}", side))
        return pairs.select(F.col("own_a").alias("a"), F.col("own_b").alias("b")).where("a <> b").distinct()

    named = nodes.select("node", "rank").join(labels, "node", "left").select("node", "rank", F.coalesce("label", "node").alias("component"))
    doubtful = materialised(between(tested.where("not good")))
    if not doubtful.isEmpty():
        named = materialised(named)
        for nearest_only in (True, False):
            members = named.join(component_labels(doubtful).select(F.col("node").alias("component")), "component", "left_semi")
            keyed = nodes.join(members.select("node", F.col("component").alias("label")), "node").select(F.explode("keys").alias("key"), "node", "n", "label")
            mixed = keyed.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one < other").select("key")
            live = materialised(keyed.join(mixed, "key", "left_semi"))
            wide = texts.join(live.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select("row", "text").mapInArrow(_wide, "node long, map binary")
            rows = live.join(wide, "node").repartition("key").sortWithinPartitions("key", "node").select("key", "node", "n", "map", "label")
            more = rows.mapInArrow(_across(nearest_only), "a long, b long").distinct()
            more = materialised(more.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
            if more.isEmpty():
                continue
            checked = verified(texts, more)
            tested = materialised(tested.union(checked))
            labels = named.select("node", F.col("component").alias("label"))
            merged = component_labels(between(checked.where("good")))  # of components, so far smaller than the first time
            higher = merged.select(F.col("node").alias("component"), F.col("label").alias("higher"))
            named = materialised(named.join(higher, "component", "left").select("node", "rank", F.coalesce("higher", "component").alias("component")))
            labels = named.select("node", F.col("component").alias("label"))
            doubtful = materialised(between(tested.where("not good")))
    return named.groupBy("component").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
