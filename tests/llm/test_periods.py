import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from matchlake.llm import periods, queries, registered
from tests.llm.helpers import awkward, clashing, empty


def brute(s, shortest=12):
    """All runs by every lag, each smallest period decided by comparing the whole stretch with every smaller one."""
    s, out = np.asarray(s), []
    for q in range(1, len(s) // 2 + 1):
        equal = np.r_[0, (s[q:] == s[:-q]).astype(np.int8), 0]
        edge = np.flatnonzero(np.diff(equal))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            stop = b + q
            if stop - a >= max(shortest, 2 * q) and not any((s[a + p : stop] == s[a : stop - p]).all() for p in range(1, q)):
                out.append((a, stop, q))
    return sorted(out)


def found(s):
    return sorted(zip(*(v.tolist() for v in periods.runs(np.asarray(s, np.int64)))))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


SEQUENCES = {
    "one word": [0] * 300, "fibonacci": fibonacci(500), "alternating breaks": ([0, 1] * 60 + [0]) * 3, "long roots": (list(range(70)) * 4 + [7]) * 2,
    "runs in a period": ([0] * 40 + [1] * 30 + [2] * 5) * 4, "touching": [0, 1] * 80 + [0] + [0, 1] * 80, "three touching": ([0, 1, 2] * 40 + [0]) * 4,
    "periods near powers of two": sum((list(range(1000 * q, 1000 * q + q)) * 2 for q in (31, 32, 33, 63, 64, 65, 127, 128, 129)), []),
    "thue-morse": [bin(i).count("1") & 1 for i in range(600)], "nested": ((list(range(8)) * 5 + [9]) * 3 + [10]) * 3, "short": [1, 2, 3], "none": [],
    "exact doubles of periodic words": ([0, 1] * 33 + [0]) * 2 + [5] + ([0, 1, 2] * 30 + [0, 1]) * 2,
}


@pytest.mark.parametrize("name", SEQUENCES)
def test_runs_equal_brute_force(name):
    assert found(SEQUENCES[name]) == brute(SEQUENCES[name])


def test_random_repeats_equal_brute_force():
    rng = random.Random(1)
    for case in range(150):
        s = []
        while len(s) < rng.choice([50, 300, 700]):
            kind = rng.random()
            if kind < 0.3 or not s:
                s += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 80))]
            elif kind < 0.7:  # repeat the tail, perhaps not a whole number of times
                tail = s[-rng.randint(1, min(len(s), 160)) :]
                s += (tail * 6)[: rng.randint(1, 5 * len(tail))]
            elif kind < 0.85:
                a = rng.randrange(len(s))
                s += s[a : a + rng.randint(1, 200)]
            else:
                s[rng.randrange(len(s))] = 99
        s = s[:900]
        assert found(s) == brute(s), case


def test_batches_keep_texts_apart():
    rng = random.Random(2)
    texts = [np.array([rng.randrange(3) for _ in range(rng.choice([0, 5, 20, 100, 300]))] * rng.choice([1, 2, 3]), np.int64) for _ in range(60)]
    for own, text in zip(periods.batch_runs(texts), texts):
        assert sorted(zip(*(v.tolist() for v in own))) == brute(text)


def test_work_follows_the_words():
    """Deeply periodic texts of 200,000 words: far fewer runs are compared than there are pairs of equal windows."""
    s = np.array((([0, 1] * 50 + [2]) * 40 + [3]) * 50, np.int64)
    start, stop, period = periods.runs(s[:200_000])
    assert len(start) < 200_000 and {1, 2, 101, 4041} & set(period.tolist()) == {2, 101, 4041}


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    if doc_id is not None:
        words = [w.decode() for w in registered._periodic_tail(doc_id, [w.encode() for w in words])]
    table = {}
    r = brute([table.setdefault(w, len(table)) for w in words])
    gone = {i for a, b, q in r for i in range(a + q, b)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(((-(b - a), a, q) for a, b, q in r), default=None)
    first = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    sha = [hashlib.sha256(v.encode()).hexdigest() for v in ("".join(f"{a},{b - a},{q}\n" for a, b, q in r), kept)]
    return (doc_id, len(r), *first, *sha)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r) for r in queries()["op13_periods"](spark, sf).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        if len(text.split()) < 1500:
            assert got[doc_id] == expected(doc_id, text)
    assert sum(r[1] > 0 for r in got.values()) >= sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in docs) * 0.5


def test_tail_follows_the_rule():
    for doc_id in range(300):
        words = [str(i).encode() for i in range(doc_id % 37)]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        want = list(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert registered._periodic_tail(doc_id, words) == want


def test_awkward_rows(spark):
    df = awkward(spark).repartition(3)
    got = periods.periodic_runs(clashing(df, "runs", "collapsed", "n_words"))
    rows = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()), key=str)
    want = []
    for r in df.collect():
        words = re.findall("[^\x20\x09-\x0d]+", r["text"] or "")
        table = {}
        ids = [table.setdefault(w, len(table)) for w in words]
        own = brute(ids) if len(ids) < 1500 else []
        gone = {i for a, b, q in own for i in range(a + q, b)}
        want.append((r["doc_id"], len(words), [(a, b - a, q) for a, b, q in own], " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert rows == sorted(want, key=str)
    assert periods.periodic_runs(empty(spark)).collect() == []
