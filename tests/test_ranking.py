import random

import pytest
from pyspark.sql import Window as W, functions as F

from matchlake.operators.identity import stitch
from matchlake.plans.components import component_labels
from matchlake.plans.ranking import ordinal_position
from matchlake.plans.topk import ordinal_rank
from tests.conftest import rows


@pytest.mark.parametrize("values", ["distinct", "equal", "few", "null"])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_positions_equal_the_plain_window(spark, values, keys):
    rng = random.Random(1)
    value = {"distinct": lambda i: i * 7919 % 20011 / 7, "equal": lambda i: 1.0, "few": lambda i: float(rng.randrange(3)), "null": lambda i: None if i % 3 else float(i % 5)}[values]
    # the key None and one key with most of the rows
    df = spark.createDataFrame([(i, None if i % 50 == 0 else "hot" if i % 5 else f"k{i % 7}", value(i)) for i in range(4000)], "id int, k string, v double").repartition(7)
    order = [F.desc_nulls_last("v"), F.asc("id")]
    got = ordinal_position(df, keys, order)
    want = df.withColumn("pos", F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)) - 1)
    assert rows(got, "id", "pos") == rows(want, "id", "pos")
    assert got.columns == want.columns


def test_no_window_sees_a_whole_key(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1000)], "id int, v double")
    plan = ordinal_position(df, [], [F.desc("v"), F.asc("id")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "__part" in plan.split("Window")[1].split("\n")[0]


def test_ranks_leave_nulls_out(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", None), (3, "a", 7.0), (4, "b", None), (5, "a", 5.0)], "id int, k string, v double")
    assert rows(ordinal_rank(df, ["k"], "v", "id", "rank"), "id", "rank") == [(1, 2), (2, None), (3, 1), (4, None), (5, 3)]
    assert ordinal_rank(df.limit(0), ["k"], "v", "id", "rank").count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(2000, 2300)] + [(5000, 5000)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(180)]
    parent = {v: v for e in edges for v in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = component_labels(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert rows(got, "node", "label") == sorted((v, root(v)) for v in parent)
    assert component_labels(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


TRACK = "video_id bigint, track_id bigint, first_frame bigint, last_frame bigint, first_x double, first_y double, first_t double, last_x double, last_y double, last_t double, team bigint, jersey int"


def greedy(tracks):
    """The rule in plain loops over one video."""
    t = sorted(tracks, key=lambda r: (r[2], r[1]))
    uid, n = {}, 0
    for r in t:
        if r[1] in uid:
            continue
        cur, uid[r[1]] = r, n
        while True:
            best = None
            for s in t:
                gap = s[6] - cur[9]
                if s[1] in uid or s[2] <= cur[3] or gap <= 0 or ((s[4] - cur[7]) ** 2 + (s[5] - cur[8]) ** 2) ** 0.5 > 12 * gap:
                    continue
                if any(a is not None and b is not None and a != b for a, b in zip(s[10:], cur[10:])):
                    continue
                cost = (-10 if s[11] is not None and s[11] == cur[11] else 0) + (-5 if s[10] is not None and s[10] == cur[10] else 0) + gap / 10
                if cost <= 10 and (best is None or (cost, s[1]) < (best[0], best[1][1])):
                    best = (cost, s)
            if best is None:
                break
            cur = best[1]
            uid[cur[1]] = n
        n += 1
    return uid


@pytest.mark.parametrize("spread", [30.0, 3000.0])
def test_chains_follow_the_greedy_rule(spark, spread):
    rng = random.Random(3)
    data = []
    for v in range(3):
        for k in range(120 if v else 400):
            f = rng.randrange(3000)
            n = rng.randrange(1, 60)
            x, y = rng.uniform(0, spread), rng.uniform(0, spread)
            data.append((v, k, f, f + n, x, y, f / 10, x + rng.uniform(-5, 5), y, (f + n) / 10, rng.choice([None, 0, 1]), rng.choice([None, None, 7, 9])))
    got = {(r[0], r[1]): r[2] for r in stitch(spark.createDataFrame(data, TRACK)).collect()}
    want = {(v, k): u for v in range(3) for k, u in greedy([r for r in data if r[0] == v]).items()}
    assert got == want
