import random

import pandas as pd

from matchlake.operators import ball as B, gaps as G

SERIES = "video_id bigint, track_id bigint, frame bigint, cx double, cy double"


def series(seed, n, jump=0.02, hole=0.2):
    rng = random.Random(seed)
    out, x, y, f = [], 500.0, 300.0, rng.randrange(50)
    for _ in range(n):
        f += 1 if rng.random() > hole else rng.choice([2, 3, 30])
        x, y = x + rng.uniform(-12, 12), y + rng.uniform(-12, 12)
        far = rng.random() < jump
        out.append((f, x + (2000 if far else 0), y))
    return out


def sequential(rows):
    part = pd.DataFrame([(1, 1, *r) for r in rows], columns=["video_id", "track_id", "frame", "cx", "cy"])
    return list(G.ball_rows(10.0)(part)[["frame", "cx", "cy", "is_detected", "gated"]].itertuples(index=False, name=None))


def compare(spark, rows, block):
    df = spark.createDataFrame([(*k, *r) for k, v in rows.items() for r in v], SERIES).repartition(3)
    got = {}
    for r in B.smooth_ball(df, 10.0, block_frames=block).collect():
        got.setdefault((r[0], r[1]), []).append(tuple(r)[2:])
    assert got.keys() == rows.keys()
    for k, v in rows.items():
        want, found = sequential(v), sorted(got[k])
        assert [(r[0], *r[3:]) for r in found] == [(r[0], *map(bool, r[3:])) for r in want]
        assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for f, w in zip(found, want) for a, b in zip(f[1:3], w[1:3]))


def test_spliced_blocks_equal_the_sequential_filter(spark):
    compare(spark, {(1, 1): series(1, 1500), (1, 2): series(2, 700, jump=0.3), (2, None): series(3, 900), (None, 5): series(4, 1), (3, 3): [(0, 1.0, 1.0), (1000, 2.0, 2.0)]}, 700)


def test_blocks_that_never_agree_run_again(spark):
    # every block's first detection lies beyond the gate of the true path: cold starts accept what the path never does
    compare(spark, {(4, 4): [(f, (5000.0 if f % 50 == 0 and f else float(f)), 0.0) for f in range(150)], (5, 5): [(f, 900.0 * (f % 2), 0.0) for f in range(120)]}, 50)


def test_paths_meet_soon_after_a_cold_start():
    path, rows = B.Path(10.0), series(7, 2000)
    carried = list(path.walk(rows[:1000], None))[-1][1]
    cold = [now for _, now, _ in path.walk(rows[1000:], None)]
    spliced = [now for _, now, _ in path.walk(rows[1000:], carried)]
    assert next(i for i, (a, b) in enumerate(zip(cold, spliced)) if a == b) < 150 and cold[-1] == spliced[-1]


def test_awkward_detections(spark):
    df = spark.createDataFrame([(1, 1, 5, 1.0, 1.0), (1, 1, 5, 2.0, 2.0), (1, 1, 5, 1.0, 1.0), (1, 1, None, 1.0, 1.0), (1, 1, 7, None, 1.0), (1, 1, 8, 3.0, 3.0)], SERIES)
    got = sorted(tuple(r)[2:] for r in B.smooth_ball(df, 10.0).collect())
    assert [r[0] for r in got] == [5, 6, 7, 8] and got[0] == (5, 1.0, 1.0, True, False) and got[1] == (6, 1.0, 1.0, False, False)
    assert B.smooth_ball(df.limit(0), 10.0).count() == 0
