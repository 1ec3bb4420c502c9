"""Writers, deliveries and readers keep exactly what they should, also over several batches."""

from conftest import rows
from pyspark.sql import functions as F

from matchlake.operators import identity as D, registry as R, risk as K, stats as S, target as TG
from matchlake.sources import files, sinks
from matchlake.streaming import twins


def test_video_without_new_rows_loses_its_old_ones(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_by_video(spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "video_id bigint, v bigint"), path, salt=3)
    again = spark.createDataFrame([(2, 21)], "video_id bigint, v bigint")
    sinks.replace_by_video(again, path, videos=spark.createDataFrame([(2,), (3,), (9,)], "video_id bigint"))
    assert rows(spark.read.parquet(path), "video_id", "v") == [(1, 10), (2, 21)]


def test_player_without_new_rows_loses_his_old_ones(spark, tmp_path):
    path, schema = str(tmp_path / "p"), "player_id bigint, v bigint"
    everyone = spark.createDataFrame([(i, i) for i in range(20)], schema)
    for _ in range(2):
        sinks.upsert_by_player(everyone, path, everyone)
    sinks.upsert_by_player(spark.createDataFrame([(4, 40)], schema), path, spark.createDataFrame([(4,), (7,)], "player_id bigint"))
    got = rows(spark.read.parquet(path), "player_id", "v")
    assert got == sorted([(i, i) for i in range(20) if i not in (4, 7)] + [(4, 40)])


def test_batches_of_one_video_add_up(spark, tmp_path):
    source, path, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = "video_id bigint, event_id bigint, v string"
    batches = [[(1, 1, "a"), (2, 2, "b")], [(1, 3, "c")], [(1, 3, "c"), (2, 2, "changed"), (2, 4, "d")]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        twins.deliver_by_video(spark.readStream.schema(schema).parquet(source), path, log, ["event_id"]).awaitTermination()
    want = [(1, "a"), (2, "changed"), (3, "c"), (4, "d")]
    read = lambda: rows(spark.read.schema(schema).parquet(path), "event_id", "v")
    assert read() == want
    twins.deliver_by_video(spark.readStream.schema(schema).parquet(source).where("event_id <> 2"), path, log + "2", ["event_id"]).awaitTermination()
    assert read() == want


def test_quoted_line_breaks_stay_in_one_record(spark, tmp_path):
    long = "x" * 1_200_000
    (tmp_path / "a.csv").write_text(f'Athlete,Session Date\r\n"Kane,\nHarry ""H""",2026-09-01\r\n\r\n{long},2026-09-02\r\n', newline="")
    got = sorted((r.line, r.player, r.date) for r in files.read_log_csv(spark, str(tmp_path)).collect())
    assert got == [(2, 'Kane,\nHarry "H"', "2026-09-01"), (5, long, "2026-09-02")]


def test_roster_vote_uses_the_team_of_the_track(spark):
    read = [(1, 1, f, "red", 9, 0.5) for f in range(4)] + [(1, 1, 9, "blue", 7, 0.9), (1, 1, 10, "red", 8, 0.9), (1, 1, 11, "red", 8, 0.9)]
    df = spark.createDataFrame(read, "video_id int, track_id int, frame int, team string, jersey int, confidence double")
    roster = spark.createDataFrame([("red", 9), ("blue", 7), ("red", 7)], "team string, jersey int")
    one = D.weighted_vote(df, roster).first()
    assert (one.jersey, one.readings) == (9, 5)  # 8 is nobody's number and counts for nothing
    assert D.weighted_vote(df, spark.createDataFrame([("blue", 9)], "team string, jersey int")).count() == 0


def test_player_history_falls_back_and_keeps_nulls(spark):
    stats = spark.createDataFrame(
        [(1, 5, 1, 1, 10.0, 2.0, "High", 33.0), (2, 5, 1, 2, 10.0, None, None, None), (3, 5, 1, 3, None, None, "Low", None)],
        "stat_id int, player_id int, match_id int, video_id int, top_speed_mph double, distance_km double, injury_risk string, top_speed_kmh double",
    )
    metrics = spark.createDataFrame([(3, "top_speed_kmh", 21.0), (3, "sprint_count", 4.0), (1, "top_speed_kmh", 1.0)], "stat_id int, metric_key string, value double")
    got = {r.stat_id: r for r in S.player_series(stats, metrics, spark.createDataFrame([(1, "2026-01-01")], "match_id int, match_date string")).collect()}
    assert [got[i].top_speed_kmh for i in (1, 2, 3)] == [33.0, 16.09, 21.0]
    assert [got[i].distance_covered_meters for i in (1, 2, 3)] == [2000.0, None, None]
    assert [got[i].sprint_count for i in (1, 2, 3)] == [None, None, 4] and [got[i].fatigue_risk_score for i in (1, 2, 3)] == [100.0, None, 0.0]


def test_group_status_follows_availability(spark):
    g = spark.createDataFrame([("a", "x", "next"), ("a", "y", "next"), ("b", "x", "launch"), ("b", "z", "launch"), ("c", "z", "manual"), ("d", "?", "next")], "group string, metric_key string, status string")
    reg = spark.createDataFrame([("x", "ready"), ("y", "ready"), ("z", "soon")], "metric_key string, availability string")
    assert rows(R.group_status(g, reg), "group", "status") == [("a", "launch"), ("b", "next"), ("c", "manual"), ("d", "next")]
    assert R.registry_frame(spark).where("availability is null").count() == 0


def test_unsaved_rows_come_after_any_stored_id(spark):
    stored = spark.createDataFrame([(10**15, 1)], "log_id bigint, player_id bigint")
    unsaved = spark.createDataFrame([("b", 2, 1), ("a", 2, 1)], "file string, line bigint, player_id bigint")
    got = [(r.order_id.file, r.order_id.number) for r in K.all_logs(stored, unsaved).orderBy("order_id").collect()]
    assert got == [("", 10**15), ("a", 2), ("b", 2)]


def test_votes_around_a_frame_reach_over_slots(spark):
    boxes = spark.createDataFrame([(1, 7, f, 9 if f < 40 else 5, "t", "player", 0.5) for f in range(80)], "video_id int, track_id int, frame int, jersey int, team string, role string, confidence double")
    asked = spark.createDataFrame([(1, a) for a in (0, 30, 31, 47, 79)], "video_id int, at int")
    got = {r.at: r.voted_jersey for r in TG.frame_candidates(boxes, asked).collect()}
    want = {}
    for a in (0, 30, 31, 47, 79):
        near = [9 if f < 40 else 5 for f in range(80) if abs(f - a) <= 15]
        want[a] = max(set(near), key=lambda j: (near.count(j), -near.index(j)))
    assert got == want


def test_clusters_settle(spark):
    data = [(1, i, float(i), 0.0, 0.0) for i in range(40)] + [(1, 100 + i, 300.0 + i, 0.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(data, "video_id bigint, track_id bigint, c1 double, c2 double, c3 double")
    centres = {r.cluster: r.c1 for r in D.team_clusters(df).collect()}
    assert centres == {0: 19.5, 1: 301.0}
    assert D.team_clusters(df.withColumn("c1", F.lit(1.0))).count() == 2


def test_every_summed_metric_of_a_fragment_is_stored(spark):
    from matchlake.operators import ingest as G

    base = {c: None for c in ("distance_m", "minutes_played_s", "visible_minutes_s", "distance_per_min_m", "hi_efforts_count", "clip_minutes", "top_speed_kmh")}
    own = {"player_id": 1.0, "video_id": 1.0, "top_speed_mph": 9.0, "distance_km": 1.0, "minutes_played": 5.0, "visible_minutes": 4.0, "coverage_pct": 50.0, "avg_pitch_x": 1.0,
           "avg_pitch_y": 1.0, "hsr_count": 1.0, "sprint_count": 1.0, "injury_risk": "Low", "high_speed_distance_km": 0.25, "accel_count_high": 3.0, "zone_jog_km": 0.5}
    df = spark.createDataFrame([{**base, **own}] * 2, ", ".join(f"{c} {'string' if c == 'injury_risk' else 'double'}" for c in [*own, *base]))
    one = S.merged_fragments(df).first()
    assert (one.hsr_distance_km, one.accels, one.zone2_distance_km, one.decels) == (0.5, 6.0, 1.0, None)
    assert len(G.METRIC_COLUMNS) == len(set(G.METRIC_COLUMNS)) == 19 and set(G.METRIC_COLUMNS) == set(R.STORED_KEYS)
