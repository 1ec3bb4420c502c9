import random

import pandas as pd
from pyspark.sql import functions as F

from matchlake import constants as C
from matchlake.operators import ball as B
from matchlake.streaming import twins

BOX = "struct<track_id:bigint,own_track:boolean,gate2:boolean,gate3:boolean,similarity:double,x1:double,y1:double,x2:double,y2:double,pitch_x:double,pitch_y:double,confidence:double,t:double>"


def test_rows_of_several_chunks_come_in_order(spark):
    rng, rows, x = random.Random(1), [], 100.0
    for f in range(200):
        x += rng.uniform(-10, 10)
        if rng.random() < 0.8:
            rows.append((1, 1 + f % 2, f, x, 50.0))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "video_id bigint, track_id bigint, frame bigint, cx double, cy double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = twins.drain_in_steps(df, "chunks", F.when(F.col("frame") < 120, 0).otherwise(1), lambda s: twins.live_ball(s, 10.0), steps=2)
        got = sorted((r["track_id"], r["frame"], round(r["cx"], 6), r["is_detected"], r["gated"]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = sorted((r["track_id"], r["frame"], round(r["cx"], 6), r["is_detected"], r["gated"]) for r in B.smooth_ball(df, 10.0).collect())
    assert got == want


def test_a_silent_target_is_lost_without_new_rows_and_its_state_goes(spark):
    box = (7, True, False, False, 0.0, 0.0, 0.0, 10.0, 20.0, 1.0, 1.0, 0.9, 0.0)
    start = pd.Timestamp("2024-01-01")
    at = lambda target, frame, seconds: (1, target, frame, [box], (start + pd.Timedelta(seconds=seconds)).to_pydatetime())
    # target 1 ends at frame 2; target 2 goes on and moves the watermark: past the silence, then past the eviction
    rows = [at(1, 0, 0), at(1, 2, 1), at(2, 0, 0), at(2, 1, 60), at(2, 2, 61), at(2, 3, 4000), at(2, 4, 4001), at(2, 5, 4100), at(1, 5, 4101)]
    df = spark.createDataFrame(rows, f"video_id bigint, target_id bigint, frame bigint, boxes array<{BOX}>, ts timestamp")
    seconds = F.unix_seconds("ts") - F.lit(int(start.tz_localize("UTC").timestamp()))
    step = F.when(seconds <= 1, 0).when(seconds <= 61, 1).when(seconds <= 4001, 2).otherwise(3)
    timed = {"time_column": "ts", "silence_ms": 10_000, "keep_ms": 60_000}
    stream = lambda s: twins.live_follow(s.withWatermark("ts", "1 second"), 10.0, **timed)
    got = twins.drain_in_steps(df, "silence", step, stream, steps=4)
    one = sorted((r["frame"], r["state"]) for r in got.where("target_id = 1").collect())
    # a row after the eviction starts anew, from frame 0
    again = [(f, "occluded") for f in range(5)] + [(5, "tracked")]
    for row in again:
        one.remove(row)
    assert one[:3] == [(0, "tracked"), (1, "occluded"), (2, "tracked")]
    assert one[3:] == [(3 + i, "occluded") for i in range(C.OCCLUSION_FRAMES)] + [(3 + C.OCCLUSION_FRAMES, "lost")]
