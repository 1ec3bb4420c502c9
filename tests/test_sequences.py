"""Set-based sequence operators against plain step-by-step loops on random series."""

import random

import numpy as np
from pyspark.sql import functions as F

from matchlake.operators import ball as B, gaps as G, identity as D, risk as K, target as TG, trajectory as T


def loop_bursts(speeds, threshold, bridge, dwell):
    found, length, gap = 0, 0, 0
    for s in [*speeds, None]:
        if s is None:
            return found + (length >= dwell)
        if length == 0:
            if s >= threshold:
                length, gap = 1, 0
        elif s >= 0.9 * threshold:
            length, gap = length + 1, 0
        else:
            gap += 1
            if gap <= bridge:
                length += 1
            else:
                found += length >= dwell
                length = 0
    return found


def test_bursts_match_a_loop(spark):
    rng = random.Random(3)
    series = {}
    for k in range(150):
        level = [rng.choice([5.0, 11.4, 11.6, 13.0]) for _ in range(rng.randint(1, 9))]
        series[k] = [s for v in level for s in [v] * rng.randint(1, 9)]
    data = [(1, k, i, len(v), s) for k, v in series.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(data, "video_id bigint, track_id bigint, vpos bigint, n_valid bigint, sustained_mph double")
    df = df.withColumn("blk", F.floor(F.col("vpos") / 7))
    want = {k: loop_bursts(v, 12.3, 2, 10) for k, v in series.items()}
    for split in (True, False):
        got = {r.track_id: r["count"] for r in T.bursts(df, {"hsr": 12.3}, 10.0, split=split).groupBy("track_id").count().collect()}
        assert {k: got.get(k, 0) for k in series} == want


def test_long_acceleration_counts_several_events(spark):
    data = [(1, 1, i, a) for i, a in enumerate([3.5] * 15 + [0.0] + [-3.2] * 6 + [3.0] * 7)]
    df = spark.createDataFrame(data, "video_id bigint, track_id bigint, pos bigint, accel_ms2 double").withColumn("blk", F.floor(F.col("pos") / 4))
    for split in (True, False):
        r = T.acceleration_events(df, 10.0, split=split).first()
        assert (r.accel_count_high, r.decel_count_high) == (3, 0)


def test_one_frame_spike_is_not_a_top_speed(spark):
    data = [(1, 1, f, f * 0.3 + (0.6 if f == 30 else 0), 0.0, f / 10, True) for f in range(60)]
    pts = spark.createDataFrame(data, "video_id bigint, track_id bigint, frame bigint, x double, y double, t double, is_detected boolean")
    r = T.physical(pts, 10.0).first()
    assert abs(r.top_speed_mph - 6.71) < 0.02 and r.hsr_count == 0
    assert abs(r.distance_m - 18.3) < 0.7


def test_rolling_ratio_matches_a_loop(spark):
    rng = random.Random(9)
    data = [(p, i, rng.randint(0, 40), rng.choice([None, 0.0, 2.0, 4.5, 9.0])) for p in range(6) for i in range(60)]
    df = spark.createDataFrame(data, "player_id bigint, log_id bigint, day int, load double")
    df = df.withColumn("score_date", F.date_add(F.lit("2026-01-01"), F.col("day")))
    got = {(r.player_id, r.log_id): r.acwr for r in K.rolling_ratio(df, ["player_id"], ["score_date", "log_id"], "load").collect()}
    cut = {(r.player_id, r.log_id): r.acwr for r in K.rolling_ratio(df, ["player_id"], ["score_date", "log_id"], "load", split=False).collect()}
    assert got == cut
    for p in range(6):
        history = []
        for _, i, load in sorted(((d, i, v) for q, i, d, v in data if q == p), key=lambda t: t[:2]):
            last = history[-4:]
            want = None if load is None or not last else round(min(load / (sum(last) / len(last)), 5.0), 3)
            assert got[(p, i)] == want or abs(got[(p, i)] - want) < 0.0011
            if load:
                history.append(load)


# states, re-acquisitions, lost segments
SEQUENCES = [
    ("ttt", 0, []),
    ("tlt", 1, [(1, 1)]),
    ("tllo", 0, [(1, 2)]),
    ("tloot", 1, [(1, 1)]),
    ("tot", 0, []),
    ("lltlt", 2, [(0, 1), (3, 3)]),
    ("tlolt", 1, [(1, 1), (3, 3)]),
    ("lll", 0, [(0, 2)]),
]
NAMES = {"t": "tracked", "l": "lost", "o": "occluded"}


def test_lost_segments_and_reacquisitions(spark):
    data = [(1, k, f, NAMES[c]) for k, (s, _, _) in enumerate(SEQUENCES) for f, c in enumerate(s)]
    df = spark.createDataFrame(data, "video_id bigint, track_id bigint, f bigint, state string")
    n = {r.track_id: r.reacquisitions for r in G.reacquisitions(df).collect()}
    segs = G.lost_segments(df).collect()
    for k, (_, events, lost) in enumerate(SEQUENCES):
        assert n[k] == events
        assert sorted((r.start, r.end) for r in segs if r.track_id == k) == lost


def test_gap_filling(spark):
    frames = [0, 1, 4, 30, 31, 33]
    df = spark.createDataFrame([(1, 1, f, float(f), 2.0 * f) for f in frames], "video_id bigint, track_id bigint, frame bigint, cx double, cy double")
    got = {r.frame: (r.cx, r.is_interpolated) for r in G.interpolate(df, ["cx", "cy"]).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 30, 31, 32, 33]
    assert got[2] == (2.0, True) and got[32] == (32.0, True) and got[4] == (4.0, False)
    last = spark.createDataFrame([(1, 1, 36)], "video_id bigint, track_id bigint, last_frame bigint")
    ahead = {r.frame: r.cx for r in G.extrapolate(df, last).collect()}
    assert sorted(ahead) == [2, 3, *range(5, 15), 32, 34, 35, 36] and ahead[14] == 14.0


def test_ball_filter_matches_a_full_state_filter(spark):
    rng = random.Random(2)
    obs, x, y = {}, 100.0, 50.0
    for f in range(80):
        x, y = x + rng.uniform(0, 12), y + rng.uniform(-6, 6)
        if rng.random() > 0.25:
            obs[f] = (x + (900 if f % 19 == 7 else 0), y)
    df = spark.createDataFrame([(1, -1, f, *o) for f, o in obs.items()], "video_id bigint, track_id bigint, frame bigint, cx double, cy double")
    got = {r.frame: r for r in B.smooth_ball(df, 10.0).collect()}
    dt = 0.1
    a = np.array([[1, 0, dt, 0], [0, 1, 0, dt], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    q = np.kron(np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]]), np.eye(2)) * 500
    h = np.eye(2, 4)
    s, p, last = None, np.eye(4) * 1000, None
    for f in range(min(obs), max(obs) + 1):
        z = obs.get(f)
        if z is not None and s is not None and np.hypot(z[0] - last[0], z[1] - last[1]) > 35 / 10 * 20 * 2:
            assert got[f].gated
            z = None
        if z is None:
            s, p = a @ s, a @ p @ a.T + q
            assert abs(got[f].cx - s[0]) < 1e-6 and abs(got[f].cy - s[1]) < 1e-6 and not got[f].is_detected
            continue
        if s is None:
            s = np.array([*z, 0, 0])
        else:
            s, p = a @ s, a @ p @ a.T + q
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.eye(2) * 25)
            s, p = s + k @ (np.array(z) - h @ s), (np.eye(4) - k @ h) @ p @ (np.eye(4) - k @ h).T + k @ k.T * 25
        last = z
        assert got[f].is_detected and got[f].cx == z[0]


def test_greedy_chains(spark):
    rng = random.Random(4)
    t = []
    for k in range(40):
        first = rng.randint(0, 400)
        last = first + rng.randint(5, 40)
        t.append((rng.randint(0, 1), k, first, last, rng.uniform(0, 105), rng.uniform(0, 68), first / 10, rng.uniform(0, 105), rng.uniform(0, 68),
                  last / 10, rng.choice([None, 0, 1]), rng.choice([None, 7, 9])))
    cols = "video_id bigint, track_id bigint, first_frame bigint, last_frame bigint, first_x double, first_y double, first_t double, last_x double, last_y double, last_t double, team bigint, jersey bigint"
    df = spark.createDataFrame(t, cols)
    got = {(r.video_id, r.track_id): r.player_uid for r in D.stitch(df).collect()}
    edges = {(r.video_id, r.a, r.b): r.cost for r in D.stitch_candidates(df).collect()}
    for v in (0, 1):
        mine = sorted((r for r in t if r[0] == v), key=lambda r: (r[2], r[1]))
        uid, seen = 0, {}
        for r in mine:
            if r[1] in seen:
                continue
            cur = r[1]
            seen[cur] = uid
            while True:
                nxt = sorted((c, b) for (vv, a, b), c in edges.items() if vv == v and a == cur and b not in seen)
                if not nxt:
                    break
                cur = nxt[0][1]
                seen[cur] = uid
            uid += 1
        assert {k: u for (vv, k), u in got.items() if vv == v} == seen


def test_follow_states(spark):
    # seen 0-9, away for 40 frames, back, then a stranger far away carries the number
    det = [(1, 5, f, f / 10, 100.0 + f, 100.0, 140.0 + f, 190.0, 10.0, 10.0, 0.9) for f in range(10)]
    det += [(1, 6, f, f / 10, 110.0, 100.0, 150.0, 190.0, 12.0, 10.0, 0.8) for f in range(50, 55)]
    det += [(1, 7, 56, 5.6, 900.0, 100.0, 940.0, 190.0, 12.0, 10.0, 0.8), (1, 8, 60, 6.0, 0.0, 0.0, 5.0, 5.0, 0.0, 0.0, 0.5)]
    d = spark.createDataFrame(det, "video_id bigint, track_id bigint, frame bigint, t double, x1 double, y1 double, x2 double, y2 double, pitch_x double, pitch_y double, confidence double")
    tracks = spark.createDataFrame([(1, 5, 9, 0), (1, 6, 9, 0), (1, 7, 9, 0), (1, 8, 3, 0)], "video_id bigint, track_id bigint, jersey bigint, team bigint")
    targets = spark.createDataFrame([(1, 5, 5, 9, 0)], "video_id bigint, target_id bigint, track_id bigint, jersey bigint, team bigint")
    out = {r.frame: r for r in TG.follow(TG.candidate_frames(targets, d, tracks), 10.0).collect()}
    assert sorted(out) == list(range(61))
    assert out[0].state == "tracked" and out[15].source == "interpolated" and out[25].source == "lost" and out[25].state == "occluded"
    assert out[39].state == "occluded" and out[40].state == "lost" and out[50].state == "reacquired" and out[51].state == "tracked"
    assert out[56].state == "occluded"
    s = TG.statistics(TG.follow(TG.candidate_frames(targets, d, tracks), 10.0), 10.0).first()
    assert (s.tracked_frames, s.reacquisition_count, s.lost_segments, s.tracks_used) == (15, 1, 1, 2)
