import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from matchlake.llm import graph, lines, repeats, simhash
from tests.llm.helpers import DOCS, awkward, clashing, empty, prose


def plain_fingerprint(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_the_definition(spark):
    docs = awkward(spark).union(spark.createDataFrame([(30, "A b", None, None, 0), (31, "ÀB c D\x0bE", None, None, 0), (32, "a b c d", None, None, 0)], DOCS))
    got = sorted((r["fp"] for r in simhash.fingerprints(clashing(docs, "fp")).collect()))
    want = sorted(int(np.uint64(plain_fingerprint(r["text"] or "")).view(np.int64)) for r in docs.collect())
    assert got == want


def test_golay_words_within_two_bits_share_an_index():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    patterns, number = simhash._golay()
    assert np.bincount(number).tolist() == [0, 277, 0, 0, 0, 0, 1771]
    for flips in (1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(23, flips, replace=False):
                y[i] ^= np.uint32(1 << int(b))
        (a, na), (b, nb) = simhash.codeword_indices(x), simhash.codeword_indices(y)
        assert all(set(a[i, : na[i]]) & set(b[i, : nb[i]]) for i in range(len(x)))


def test_fingerprints_within_three_bits_share_a_key():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 4, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    keys = []
    for v in (x, y):
        owner, key = simhash.bucket_keys(v)
        sets = [set() for _ in v]
        for o, k in zip(owner.tolist(), key.tolist()):
            sets[o].add(k)
        keys.append(sets)
    assert all(a & b for a, b in zip(*keys))


def brute_components(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("seed", [3, 4])
def test_links_connect_what_brute_force_connects(spark, seed):
    """Chains, dense balls and strangers."""
    rng = np.random.default_rng(seed)
    fps = list(rng.integers(0, 1 << 64, 60, dtype=np.uint64))
    for centre in fps[:6]:
        for _ in range(60):
            v = centre
            for b in rng.choice(64, rng.integers(1, 3), replace=False):
                v ^= np.uint64(1 << int(b))
            fps.append(v)
    walker = fps[10]
    for _ in range(40):
        for b in rng.choice(64, 3, replace=False):
            walker ^= np.uint64(1 << int(b))
        fps.append(walker)
    fps = np.unique(np.array(fps, dtype=np.uint64))
    near = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    want = brute_components(len(fps), near)
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long").repartition(3)
    found = {r["node"]: r["component"] for r in graph.components(simhash.links(df)).collect()}
    names = fps.view(np.int64).tolist()
    got = [found.get(v, v) for v in names]
    assert len({(a, b) for a, b in zip(want, got)}) == len(set(want)) == len(set(got))
    assert simhash.links(df).count() < len(near)  # a forest per task, not all pairs


def test_near_duplicates_give_the_smallest_id(spark):
    base = prose(1, 400)
    near = base.replace(base.split()[7], "zzz", 1)
    docs = spark.createDataFrame([(9, base, "", "", 0), (4, near, "", "", 0), (7, base, "", "", 0), (2, prose(2, 400), "", "", 0), (None, base, "", "", 0), (8, "", "", "", 0), (5, None, "", "", 0)], DOCS)
    bits = int(plain_fingerprint(base) ^ plain_fingerprint(near)).bit_count()
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    first = 4 if bits <= 3 else 7
    assert got == {9: first, 7: first, None: first, 4: 4, 2: 2, 8: 5, 5: 5}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    rows = simhash.near_duplicates(clashing(awkward(spark), "component", "row")).collect()
    assert len(rows) == awkward(spark).count()


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    df = spark.createDataFrame(path + star + [(3, 3), (7, 200)], "a long, b long")
    found = {r["node"]: r["component"] for r in graph.components(df).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(200, 260)} == {7} and 3 not in found
    assert graph.components(df.limit(0)).count() == 0


def brute_repeats(docs):
    """Per row (id, text): spans of bytes in 50-byte strings that a smaller id has."""
    least = {}
    for i, t in docs:
        if i is not None:
            b = (t or "").encode()
            for s in range(len(b) - 49):
                w = b[s : s + 50]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if i is not None and least[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run_repeats(df, **bounds):
    got = repeats.remove_repeats(df, **bounds).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_match_brute_force(spark, seed):
    rng = random.Random(seed)
    shared = [prose(100 + i, rng.randint(9, 60)) for i in range(5)]
    docs = []
    for i in range(60):
        parts = [prose(1000 * seed + i, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(s)), rng.randint(0, len(s))))
            parts += [rng.choice([s, s[a:b], s[:49], s[:50], "a" * rng.randint(40, 130), "ab" * rng.randint(20, 80), "é" * rng.randint(20, 60)]), prose(i, rng.randint(0, 4))]
        docs.append((rng.choice([i, i, 7]), rng.choice(["", " "]).join(parts)))
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in docs], DOCS).repartition(3)
    want = brute_repeats(docs)
    assert run_repeats(df) == want
    # keys of any size are split into suffix rows, and texts into blocks, without a change
    assert run_repeats(df, most=seed, block=64 + 50 * seed) == want


def test_a_key_with_many_contexts_is_not_held():
    rng = np.random.default_rng(5)
    n, width = 5000, repeats.REACH + repeats.WIDTH
    key = np.sort(np.r_[np.full(3000, 7), rng.integers(0, 12, 2000)])
    columns = [pa.array(key), pa.array(rng.integers(0, 90, n)), pa.array(np.arange(n)), pa.array(np.full(n, 40)), pa.array(np.full(n, 30, np.int32)), pa.array(np.full(n, 50, np.int32)), repeats.fixed_binary(rng.integers(97, 99, (n, width)).astype(np.uint8))]
    for size in (64, 999, n):
        batches = [pa.RecordBatch.from_arrays([c[i : i + size] for c in columns], names=repeats.OPEN) for i in range(0, n, size)]
        handed = [b for b in repeats._resolve(iter(batches), most=1000) if len(b) and b.column("at").null_count == 0]
        assert sum(map(len, handed)) == (key == 7).sum() and all(set(b.column("key").to_pylist()) == {7} for b in handed)
        assert max(map(len, handed)) <= max(size, 1000)


@pytest.mark.parametrize("block", [50, 81, 400])
def test_blocks_give_the_anchors_of_the_whole_text(block):
    data = (prose(3, 300) + "a" * 120 + prose(3, 40)).encode()
    whole = repeats.Anchors(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    parts = list(repeats.anchors_of(pa.array([data.decode()]), block))
    assert len(parts) > 1
    for name in ("place", "key", "context", "left", "right"):
        assert np.concatenate([getattr(p, name) for p in parts]).tolist() == getattr(whole, name).tolist()


def test_repeats_awkward_rows(spark):
    docs = awkward(spark)
    assert run_repeats(clashing(docs, "row", "marks", "found", "kept")) == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_repeats_as_text_drop_cut_characters(spark):
    a, b = "é" * 40, "x" + "é" * 30 + "ü" + "z" * 60
    df = spark.createDataFrame([(1, a, "", "", 0), (2, b, "", "", 0)], DOCS)
    got = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(df, keep=["doc_id", "lang"], as_text=True).collect()}
    assert got == {1: a, 2: "xü" + "z" * 60} or got[2].endswith("z" * 60)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_marks_do_not_depend_on_batches(size):
    rng = np.random.default_rng(size)
    rows = np.stack([rng.integers(0, 12, 300), 2 * rng.integers(0, 3, 300), rng.integers(0, 6, 300)], axis=1)
    rows = np.unique(rows, axis=0)
    want = set()
    for k in range(12):
        own = rows[rows[:, 0] == k]
        for c in np.unique(own[:, 1]):
            d = np.sort(own[own[:, 1] == c][:, 2])
            want |= {(int(x), int(c) | 1, k) for x in d[1:]}
            if len(np.unique(own[:, 1])) > 1:
                want.add((int(d[0]), int(c), k))
    # contexts are made unique to their key, so that marks tell keys apart
    context = rows[:, 1] + 1000 * rows[:, 0]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + size, 0]), pa.array(context[i : i + size]), pa.array(rows[i : i + size, 2])], names=["key", "context", "doc_id"]) for i in range(0, len(rows), size)]
    got = [(d, m) for b in repeats._marks(iter(batches)) for d, m in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist())]
    assert len(got) == len(set(got)) and set(got) == {(d, c + 1000 * k) for d, c, k in want}


def test_suffix_order_gives_previous_smaller_neighbours():
    text = np.frombuffer((b"ab" * 40)[:60] + b"ab" * 40, np.uint8)
    starts = np.arange(0, 80)
    prefix = text[starts[:, None] + np.arange(repeats.WIDTH)[None]]
    doc = np.r_[np.full(11, 5), np.full(69, 3)]
    order, head = repeats.suffix_order(prefix, np.zeros(80, np.int64), doc)
    for place, i in enumerate(order):
        same = [j for j in range(80) if (prefix[j] == prefix[i]).all()]
        assert doc[head[place]] == min(doc[j] for j in same)
    words = [prefix[i].tobytes() for i in order]
    assert words == sorted(words)


def test_anchors_without_a_suffix_of_full_width():
    around = np.zeros((2, repeats.REACH + repeats.WIDTH), np.uint8)
    low, high = repeats.earlier_reach(around, np.array([30, 30]), np.array([20, 21]), np.array([1, 1]), np.array([1, 2]))
    assert low.tolist() == [-1, 30] or low.tolist() == [-1, -1]
    low, high = repeats.earlier_reach(around, np.array([0, 0]), np.array([50, 50]), np.array([1, 1]), np.array([1, 2]))
    assert low.tolist() == [-1, 0] and high.tolist() == [-1, 0]


def test_merged_spans():
    assert repeats.merged(np.array([5, 0, 9, 2]), np.array([7, 3, 12, 5])).tolist() == [[0, 7], [9, 12]]
    assert repeats.merged(np.array([], int), np.array([], int)).shape == (0, 2)


def plain_lines(docs, min_words):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        kept = []
        for u in (t or "").split("\n"):
            n = " ".join(x for x in u.lower().replace("\t", " ").split(" ") if x)
            if len(n.split(" ")) >= min_words and n:
                if n in seen:
                    continue
                seen.add(n)
            kept.append(u)
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    rng = random.Random(1)
    pool = [prose(i, 8) for i in range(20)] + ["Short line", "", "  ", "The SAME  line\tof six words", "the same line of six words"]
    docs = [(i if i else None, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in docs], DOCS).repartition(4)
    found = lines.remove_repeated_units(df, min_words=5)
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == plain_lines(docs, 5)
    texts = dict(docs)
    for r in found.collect():
        assert r["n_removed"] == len(r["removed"]) and r["removed_chars"] == sum(s["stop"] - s["start"] for s in r["removed"])
        assert all("\n" not in texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["removed"])


def test_lines_awkward_rows(spark):
    docs = awkward(spark)
    found = lines.remove_repeated_units(clashing(docs, "row", "place", "digest")).collect()
    assert len(found) == docs.count()
    assert sorted(r["text"] for r in found if r["doc_id"] == 4) == ["", prose(1, 60)]  # of a repeated row one stays whole
    assert [r["n_units"] for r in found if r["doc_id"] == 1] == [1]
    assert lines.remove_repeated_units(empty(spark)).count() == 0


def test_paragraphs(spark):
    p = prose(1, 9)
    df = spark.createDataFrame([(1, p + "\n\nother words that stand alone here", "", "", 0), (2, "one two three four five\n \n" + p.upper(), "", "", 0)], DOCS)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.remove_repeated_units(df, unit="paragraph").collect()}
    assert got[1][1] == 0 and got[2] == ("one two three four five", 1)
