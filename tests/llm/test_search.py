import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.llm import ann, hamming, tiles

VECS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=400, dim=24, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[n - copies :] = x[0]
    return x, [(i, x[i].tolist(), 0) for i in range(n)]


def brute(x, k, every):
    out = []
    x = x.astype(np.float64)
    for q in range(0, len(x), every):
        d = np.sqrt(((x - x[q]) ** 2).cumsum(axis=1)[:, -1])
        near = sorted((d[i], i) for i in range(len(x)) if i != q)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("copies", [0, 150])
def test_nearest_is_exact_over_many_tiles(spark, copies):
    x, rows = vectors(spark, copies=copies)
    df = spark.createDataFrame(rows, VECS)
    got = ann.nearest(df.withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)), df.where("vec_id % 7 = 0"), 5, base_rows=50, query_rows=20)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(x, 5, 7)


def test_nearest_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [float("nan"), 1.0], 0), (4, [1.0, None], 0), (5, [1.0, 1.0], 0), (5, [1.0, 1.0], 0),
            (6, [1.0, 1.0, 1.0], 0), (None, [1.0, 0.0], 0), (7, [], 0), (8, [float("inf"), 1.0], 0), (9, [2.0, 0.0], 0), (9, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, VECS)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id = 0"), 10).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 1.0), (0, 2, 5, 1.0), (0, 3, 9, 1.0), (0, 4, 9, 1.0)]
    assert ann.nearest(df.limit(0), df.limit(0), 3).count() == 0
    assert ann.nearest(df, df.where("vec_id = 7"), 3).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for scale in (1.0, 1e-6, 1e6):
        x, y = rng.standard_normal((200, 33)) * scale, rng.standard_normal((20, 33))
        q, b = ann.survivors(x, y, 3)
        kept = set(zip(q.tolist(), b.tolist()))
        d = ((y[:, None] - x[None]) ** 2).sum(axis=2)
        for i in range(20):
            assert all((i, j) in kept for j in np.argsort(d[i])[:4])
    assert len(kept) < 20 * 200


def hamming_brute(codes, k, every):
    out = []
    for q in range(0, len(codes), every):
        d = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        near = sorted((int(d[i]), i) for i in range(len(codes)) if i != q)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("width,copies", [(8, 0), (8, 120), (5, 0)])
def test_code_search_is_exact(spark, width, copies):
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (300, width)).astype(np.uint8)
    codes[50:90] = codes[7] ^ (np.eye(width, dtype=np.uint8)[rng.integers(0, width, 40)] << 2)
    codes[300 - copies :] = codes[3]
    df = spark.createDataFrame([(i, bytearray(c.tobytes()), "x") for i, c in enumerate(codes)], "id long, code binary, distance string")
    got = hamming.nearest_codes(df, df.where("id % 9 = 0"), 6, base_rows=130, query_rows=20)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "distance").collect()) == hamming_brute(codes, 6, 9)


def test_search_stops_early_and_is_still_covered():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 16, (20_000, 4)).astype(np.uint16)
    asked = codes[:30] ^ (1 << rng.integers(0, 16, (30, 4))).astype(np.uint16)
    q, c, d = hamming.SegmentIndex(codes).search(asked, np.arange(len(codes)), 3)
    for i in range(30):
        full = np.bitwise_count(codes ^ asked[i]).sum(axis=1)
        assert sorted(zip(d[q == i].tolist(), c[q == i].tolist())) == sorted(zip(full.tolist(), range(len(codes))))[:3]


def test_code_search_awkward_rows(spark):
    df = spark.createDataFrame([(1, bytearray(b"ab")), (1, bytearray(b"ab")), (2, None), (None, bytearray(b"ab")), (3, bytearray(b"")), (4, bytearray(b"ac")), (5, bytearray(b"abc"))], "id long, code binary")
    got = [tuple(r) for r in hamming.nearest_codes(df, df.where("id in (1, 5)"), 4).collect()]
    assert sorted(got) == [(1, 1, 4, 1), (1, 1, 4, 1)]
    assert hamming.nearest_codes(df.limit(0), df.limit(0)).count() == 0


def test_signs(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, 0.0, 2.0], 0), (2, None, 0)], VECS)
    assert [(r["id"], bytes(r["code"])) for r in hamming.sign_codes(df).collect()] == [(1, b"\x90")]


def test_smallest_and_expand():
    assert tiles.smallest(np.array([1, 0, 1, 1]), np.array([2.0, 1.0, 1.0, 2.0]), np.array([5, 1, 9, 4]), 2).tolist() == [1, 2, 3]
    owner, flat = tiles.expand(np.array([0, 2, 2, 5]), np.array([2, 0, 1]))
    assert owner.tolist() == [0, 0, 0, 1, 1] and flat.tolist() == [2, 3, 4, 0, 1]


def test_own_id_takes_no_slots(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((60, 32)).astype(np.float32)
    # 20 copies of a query row and one other id with the same vector; an id with many vectors near its own, some of them shared
    rows = [(100, v[0])] * 20 + [(105, v[0])] + [(200, (v[1] + 0.01 * v[i]).astype(np.float32)) for i in range(2, 40)]
    rows += [(300 + i, (v[1] + 0.01 * v[i]).astype(np.float32)) for i in range(2, 6)] + [(201, v[1])] + [(400 + i, v[i]) for i in range(60)]
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in rows], VECS)
    asked, k = df.where("vec_id in (100, 200, 405)").dropDuplicates(["vec_id"]), 5
    first = {r["vec_id"]: np.array(r["embedding"], dtype=np.float32) for r in asked.collect()}

    def brute_force(distance):
        return sorted((q, n + 1, i, d) for q, x in first.items() for n, (d, i) in enumerate(sorted((distance(x, y), i) for i, y in rows if i != q)[:k]))

    asked = spark.createDataFrame([(q, x.tolist(), 0) for q, x in first.items()], VECS)
    for base_rows in (1000, 30):
        near = ann.nearest(df, asked, k, base_rows=base_rows).select("query_id", "rank", "vec_id", "score").collect()
        want = brute_force(lambda x, y: float(np.sqrt(((x.astype(float) - y.astype(float)) ** 2).cumsum()[-1])))
        assert sorted(map(tuple, near)) == want
        coded = hamming.nearest_codes(hamming.sign_codes(df), hamming.sign_codes(asked), k, base_rows=base_rows).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in coded) == brute_force(lambda x, y: int(((x > 0) != (y > 0)).sum()))


def test_vectors_of_other_lengths_keep_their_codes_apart(spark):
    rows = [(0, [1.0] * 9, 0), (1, [1.0] * 12, 0), (2, [-1.0] + [1.0] * 8, 0), (3, [-1.0] * 12, 0), (4, [1.0] * 16, 0)]
    codes = hamming.sign_codes(spark.createDataFrame(rows, VECS))
    got = sorted(tuple(r) for r in hamming.nearest_codes(codes, codes, 3).select("query_id", "rank", "vec_id", "distance").collect())
    assert got == [(0, 1, 2, 1), (1, 1, 3, 12), (2, 1, 0, 1), (3, 1, 1, 12)]


def test_huge_components_lose_no_neighbours(spark):
    rows = [(i, [1e200, float(i)]) for i in range(30)] + [(100, [1.0, 2.0]), (101, [1.0, 2.5]), (102, [1e-170, 2.0]), (103, [3e-170, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id in (7, 100)"), 3).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(7, 1, 6, 1.0), (7, 2, 8, 1.0), (7, 3, 5, 2.0), (100, 1, 101, 0.5), (100, 2, 102, 1.0), (100, 3, 103, 1.0)]
