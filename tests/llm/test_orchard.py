import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.llm import orchard
from tests.llm.helpers import clashing

VECS = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain loops over Python integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in rows), default=0) // parts) * parts
    size = width // parts

    def cut(v):
        whole = [int(math.floor(x * 4096)) if abs(x) < 1e15 else int(x) * 4096 for x in v] + [0] * (width - len(v))
        return [whole[p * size : (p + 1) * size] for p in range(parts)]

    vecs = [(i, label, cut(v)) for i, v, label in rows]
    seeds = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, rows[j][0] or 0, rows[j][1]))[:entries]
    books = [[vecs[j][2][p] for j in seeds] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _i, _l, v in vecs:
                groups.setdefault(nearest(p, v[p])[1], []).append(v[p])
            books[p] = [[sum(col) // len(groups[e]) for col in zip(*groups[e])] if e in groups else c for e, c in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    out = []
    for i, label, v in vecs:
        found = [nearest(p, v[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), sha))
    total = {}
    for _, label, _, e, _ in out:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e if e < 2**63 else None, total[label] if total[label] < 2**63 else None, s) for i, label, c, e, s in out), key=str)


def coded(df, **kw):
    got = orchard.with_label_error(orchard.compress(df, **kw), salts=3)
    return sorted(map(tuple, got.select("vec_id", F.lower(F.hex("codes")), "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("n, dim", [(300, 16), (40, 20), (9, 8), (60, 3)])
def test_codes_equal_plain_loops(spark, n, dim):
    rng = random.Random(n)
    rows = [(i * 3 % n, [rng.gauss(0, 1) for _ in range(dim)], rng.choice([1, 2, None])) for i in range(n)]
    assert coded(spark.createDataFrame(rows, VECS).repartition(5)) == brute(rows)


def test_ties_repeats_and_awkward_rows(spark):
    rng = random.Random(5)
    base = [[rng.choice([0.0, 0.5, -0.5, 1.0]) for _ in range(8)] for _ in range(6)]
    rows = [(i % 20, list(base[i % 6]), i % 2) for i in range(60)] + [(None, [0.25] * 8, None), (70, None, 1), (71, [float("nan")] * 8, 1), (72, [1.0, None], 1), (73, [float("inf")] * 8, 0),
            (74, [0.0] * 8, None), (75, [], 4), (76, [1.0, -1.0, 3.0], 4), (77, [-0.0001] * 8, 4)]
    df = spark.createDataFrame(rows, VECS)
    assert coded(clashing(df, "item", "id", "code", "codes", "error", "salt", "known", "label_error")) == brute(rows)
    assert coded(df.limit(0)) == []
    assert coded(df.where("embedding is null")) == []


def test_huge_components_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * (1e200 if i % 5 == 0 else 1) for _ in range(8)], 0) for i in range(40)] + [(50, [1e12] * 8, 1), (51, [3e7, -2e7] * 4, 2)]
    assert coded(spark.createDataFrame(rows, VECS)) == brute(rows)


def test_search_skips_far_entries():
    rng = np.random.default_rng(7)
    x = rng.integers(-4096, 4096, (2000, 8))
    x[:1000] += 40_000
    entries = np.concatenate([x[:8], x[1000:1008]])
    book = orchard.Orchard(entries)
    best, dist = book.search(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
    assert book.seen_distances < 0.75 * every.size
