"""Work that grows no faster than the rows: inputs are read once, and small results, not rows, meet in joins."""

from conftest import rows
from pyspark.sql import functions as F

from matchlake import constants as C, fixtures
from matchlake.catalog import load_all
from matchlake.fixtures import Data
from matchlake.operators import ball as B, heatmap as H, identity as D, model as M
from matchlake.sources import sinks

SF = "/root/testdata/sf0.001"
READINGS = "video_id bigint, track_id bigint, frame bigint, jersey bigint, team string, role string"


def counted(df, seen):
    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(count, df.schema)


def test_votes_read_the_detections_once(spark):
    seen = spark.sparkContext.accumulator(0)
    data = [(v, t, f, None if f % 4 == 0 else 7 + f % 3, "home" if (f + t) % 2 else "away", None if t == 2 else "player") for v in (1, 2) for t in (1, 2, -1) for f in range(31)]
    det = spark.createDataFrame(data, READINGS)
    stats = spark.createDataFrame([(1, 1, 99, None, None), (3, 5, 4, "home", "player")], "video_id bigint, track_id bigint, jersey bigint, team string, role string")
    got = {(r.video_id, r.track_id): (r.jersey, r.team, r.role) for r in D.track_identity(counted(det, seen), stats).collect()}
    assert seen.value <= 2 * len(data)  # one pass and the list of tracks
    for key, found in got.items():
        mine = det.where((F.col("video_id") == key[0]) & (F.col("track_id") == key[1]))
        own = stats.where((F.col("video_id") == key[0]) & (F.col("track_id") == key[1])).first()
        for c, value in zip(("jersey", "team", "role"), found):
            vote = D.majority_vote(mine, c).first()
            assert value == (own[c] if own and own[c] is not None else vote and vote[c]), (key, c)
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 5)}


def test_cells_of_a_player_add_up_those_of_the_tracks(spark):
    points = spark.createDataFrame([(t, float(x), float(x % 68)) for t in (1, 2, 3) for x in range(0, 120, t)], "track_id bigint, x double, y double")
    who = spark.createDataFrame([(1, "a"), (2, "a")], "track_id bigint, player_key string")
    want = H.sample_heatmap(points.join(who, "track_id"), ["player_key"])
    got = H.sample_heatmap(points, ["track_id"], members=who, member_keys=["player_key"])
    for a, b in zip(got, want):
        assert rows(a, *b.columns) == rows(b, *b.columns)


def test_tracks_of_ordinary_length_are_numbered_after_one_shuffle(spark):
    d = Data(spark, SF).fx_detections
    plan = d.groupBy("video_id", "track_id").agg(F.max("x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_sessions_are_scored_without_a_copy_of_the_match_rows(spark):
    for name in ("latest_score", "risk_history", "scoring_run_summary"):
        plan = load_all()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" not in plan, name


def test_contributions_as_rows_are_those_of_the_score(spark):
    data = [(i, *[None if (i + j) % 5 == 0 else float(i * j % 7) + j for j in range(8)]) for i in range(40)]
    df = spark.createDataFrame(data, "id bigint, " + ", ".join(f"{f} double" for f in C.FEATURES))
    sorted_ones = M.score(df).select("id", F.explode("contributions").alias("c")).select("id", "c.feature", "c.contribution", "c.imputed")
    got = M.contribution_rows(df, ["id"])
    assert got.columns == sorted_ones.columns and rows(got, *got.columns) == rows(sorted_ones, *got.columns)
    plan = load_all()["contributions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "array_sort" not in plan


def test_short_series_are_no_groups_of_their_own(spark):
    data = [(v, t, f, float(f), 1.0) for v in (1, None) for t in (1, 2, None) for f in (3, 3, 4, 9)]
    df = spark.createDataFrame(data, "video_id bigint, track_id bigint, frame bigint, cx double, cy double")
    out = B.smooth_ball(df, 10.0)
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault((r.video_id, r.track_id), []).append(r.frame)
    assert len(got) == 6 and all(sorted(v) == list(range(3, 10)) for v in got.values())


def test_dense_grids_hold_every_cell_in_its_place(spark):
    data = [(k, r, c, float(k + r * 10 + c) if (k, r) != (3, 1) else None) for k in (1, 2, 3) for r in range(4) for c in range(5) if (k + r * 3 + c) % 4 == 0]
    data += [(2, 9, 9, 7.0), (4, 0, 0, 5.0), (5, 3, 4, 6.0), (6, 8, 8, 1.0), (None, 1, 2, 3.0)]  # 9, 9 and 8, 8 lie outside
    df = spark.createDataFrame(data, "k bigint, cell_row bigint, cell_col bigint, value double")
    out = H.dense_grid(df, ["k"], 5, 4)
    got = {r.k: r.grid for r in out.collect()}
    held = {(k, r, c): v for k, r, c, v in data}
    assert got == {k: [[held.get((k, r, c)) or 0.0 for c in range(5)] for r in range(4)] for k in (1, 2, 3, 4, 5, 6, None)}
    assert "try_element_at(m" not in out._jdf.queryExecution().analyzed().toString()  # no search of all cells for every place


def test_outputs_of_many_videos_share_files(spark, tmp_path, monkeypatch):
    from matchlake.sources import files, sinks

    monkeypatch.setattr(sinks, "scratch_path", lambda _spark, name: str(tmp_path / name))
    for name in ("output_file_problems", "stat_lists"):
        monkeypatch.setattr(sinks, "scratch_path", lambda _spark, n, name=name: str(tmp_path / name / n))
        assert load_all()[name](spark, SF).count() > 0
        assert not list((tmp_path / name).rglob("video_id=*"))
    lists = [(1, '[{"track_id": 4, "distance_km": 2.5}, 17, {"track_id": 5}]'), (2, "[{oops"), (3, '{"rows": 1}'), (5, "[]"), (6, '[{"injury_risk": "a\\nb"}]')]
    files.write_bundles(spark.createDataFrame(lists, "video_id bigint, body string"), str(tmp_path / "b"))
    back = files.read_bundles(spark, str(tmp_path / "b"))
    assert rows(back, "video_id", "body") == sorted(lists)
    found = files.list_problems(back, spark.range(1, 7).withColumnRenamed("id", "video_id"))
    assert dict(map(tuple, found.collect())) == {1: None, 2: "output is not valid JSON", 3: "output must be a list", 4: "output is missing", 5: None, 6: None}
    good = files.list_rows(back, files.STATS).where("video_id not in (2, 3)")
    assert sorted((r.video_id, r.track_id or 0, r.distance_km, r.injury_risk) for r in good.collect()) == [(1, 4, 2.5, None), (1, 5, None, None), (6, 0, None, "a\nb")]


def test_cells_are_joined_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 700)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = Data(spark, SF)
        cells = d.fx_cells.agg(F.count(F.lit(1)), F.sum("value")).first()
        joined = d.fx_cells.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        monkeypatch.setattr(fixtures, "TASK_ROWS", 10 * lines)
        assert Data(spark, SF).fx_cells.agg(F.count(F.lit(1)), F.sum("value")).first() == cells
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(joined) == -(-lines // 700) and max(r["count"] for r in joined) < 700


def test_folders_are_made_by_many_tasks(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") % 40).alias("video_id"), "id")
    for _ in range(2):
        sinks.replace_by_video(df, str(tmp_path / "t"))
    files = [f.name for f in (tmp_path / "t").rglob("*.parquet")]
    assert len(files) == 40 and len({f.split("-")[1] for f in files}) > 2  # the tasks' numbers
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2000
