"""Inputs are computed once, files are as few as the videos, and the first track counts with its highest speed."""

from pathlib import Path

from conftest import rows
from pyspark.sql import functions as F

from matchlake.catalog import load_all
from matchlake.operators import evaluation as V
from matchlake.sources import sinks
from matchlake.streaming import twins


def test_arrivals_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(30).mapInPandas(counted, "id long")
    step = F.when(F.col("id") < 10, 0).when(F.col("id") < 25, 1).otherwise(7)
    out = twins.drain_in_steps(df, "once", step, lambda s: s.where("id >= 0"))
    assert rows(out, "id") == [(i,) for i in range(25)] and seen.value == 30


def test_lists_of_a_video_are_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "scratch_path", lambda _spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = load_all()["detection_lists"](spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    videos = list(Path(tmp_path / "lists").glob("video_id=*"))
    assert len(n) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() and videos
    assert all(len(list(v.glob("*.txt"))) == 1 for v in videos)


def test_first_track_counts_with_its_highest_speed(spark):
    expected = spark.createDataFrame([(1, 1, 20.0, 15.0), (1, 2, 20.0, 15.0), (2, 1, 20.0, 15.0)], "video_id long, jersey long, expected_kmh double, tolerance_pct double")
    stats = spark.createDataFrame([(1, 5, 1, 40.0), (1, 3, 1, None), (1, 3, 1, 25.0), (1, 3, 1, 21.0), (1, 4, 2, None), (1, 9, 2, 30.0)],
                                  "video_id long, track_id long, jersey long, top_speed_kmh double")
    got = {(r.video_id, r.jersey): (r.error_kmh, r.passed, r.error) for r in V.top_speed_errors(expected, stats).collect()}
    assert got == {(1, 1): (5.0, False, None), (1, 2): (None, None, "top speed not available"), (2, 1): (None, None, "player not found")}
