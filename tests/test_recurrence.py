import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.functions.geometry import H
from matchlake.operators import calibration
from matchlake.plans.recurrence import linear_recurrence


@pytest.mark.parametrize("block", [2, 5, 64])
def test_scan_equals_the_loop(spark, block):
    rng = random.Random(block)
    data, want = [], {}
    for key, n in ((None, 90), (1, 1), (2, 64), (3, 65), (4, 700), (5, 0)):
        s = t = 0.0
        for i in range(n):
            a, b, c = rng.choice([0.8, 0.5, -1.2, 1.0, 2.0]), rng.uniform(-5, 5), rng.uniform(0, 1)
            s, t = (b, c) if i == 0 else (a * s + b, a * t + c)
            data.append((key, i, a, b, c))
            want[key, i] = (s, t)
    df = spark.createDataFrame(data, "k int, pos bigint, a double, b double, c double").repartition(6)
    got = linear_recurrence(df, ["k"], "pos", F.col("a"), {"s": F.col("b"), "t": F.col("c")}, block=block)
    assert got.columns == [*df.columns, "s", "t"]
    found = {(r["k"], r["pos"]): (r["s"], r["t"]) for r in got.collect()}
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(found[k], v, rtol=1e-9, atol=1e-9)


def loop(matrices, alpha):
    out, state = [], None
    for m in matrices:
        if state is not None:
            m = alpha * state + (1 - alpha) * m
            m = m / m[8]
        state = m
        out.append(m)
    return out


@pytest.mark.parametrize("alpha", [0.8, 0.1])
def test_smoothing_equals_the_loop(spark, alpha):
    rng = np.random.default_rng(1)
    data, want = [], {}
    for camera, n in ((1, 1), (2, 2), (3, 300), (None, 130)):
        m = rng.uniform(0.5, 2, (n, 9))
        frames = np.sort(rng.choice(5000, n, replace=False)).tolist()
        data += [(camera, f, *row.tolist()) for f, row in zip(frames, m)]
        want |= {(camera, f): row for f, row in zip(frames, loop(m, alpha))}
    df = spark.createDataFrame(data, "camera_id bigint, frame bigint, " + ", ".join(f"{h} double" for h in H)).repartition(5)
    got = {(r["camera_id"], r["frame"]): [r[h] for h in H] for r in calibration.smooth(df, alpha).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)
    assert calibration.smooth(df.limit(0)).count() == 0
    plan = calibration.smooth(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_a_missing_value_stays_missing(spark):
    df = spark.createDataFrame([(1, f, *[None if f == 3 and i == 2 else 1.0 + i for i in range(9)]) for f in range(6)], "camera_id bigint, frame bigint, " + ", ".join(f"{h} double" for h in H))
    got = {r["frame"]: (r["h12"], r["h13"]) for r in calibration.smooth(df).collect()}
    assert all(np.isnan(got[f][1]) == (f >= 3) and not np.isnan(got[f][0]) for f in range(6))
