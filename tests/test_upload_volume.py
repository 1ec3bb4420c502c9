"""Commits shape their rows after the shuffle, and an upload is scored once."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_volume import SCHEMA, SHAPED, dealt_first, no_checkpoint  # noqa: F401

from matchlake.operators import uploads as U
from matchlake.sources.snapshots import Replace, commit, snapshot


def test_rows_of_a_snapshot_are_shaped_after_the_shuffle(spark, tmp_path, no_checkpoint):
    root = str(tmp_path / "s")
    SHAPED.clear()
    change = lambda pairs: Replace(spark.createDataFrame(pairs, SCHEMA), "player_id", shape=dealt_first)
    first = commit(snapshot(spark, root), {"t": change([(i, i) for i in range(9)])}, buckets=2)
    second = commit(first, {"t": change([(3, 30), (None, 1)])})
    assert rows(second.read("t").where("player_id is not null"), "player_id", "v") == sorted([(i, f"x{i}") for i in range(9) if i != 3] + [(3, "x30")])
    assert second.read("t").count() == 10 and second.read("t").columns == ["player_id", "v"] and SHAPED.count(True) == 2


def test_an_upload_scores_once_and_reports_what_is_stored(spark, tmp_path, monkeypatch):
    from test_snapshots import COLUMNS, cells

    calls = []
    monkeypatch.setattr(U, "_score", lambda *a, f=U._score: calls.append(1) or f(*a))
    monkeypatch.setattr(U, "materialised", lambda df: pytest.fail("scores are written to the store only"))
    players = spark.createDataFrame([(1, "Ann", "Lee", "mid", 7)], "player_id bigint, first_name string, last_name string, position string, jersey int")
    stats = spark.createDataFrame([], "player_id bigint, stat_id bigint, match_id bigint, video_id bigint, score_date date, distance_km double, top_speed_mph double, minutes_played double, "
                                      "visible_minutes double, sprint_count double, hsr_distance_km double, adapter_source string, calibration string, distance_valid boolean")
    key = F.unhex(F.sha2(F.lit("k"), 256))
    given = cells(spark, 1, (2, ("1", "2026-01-01", "5", "140")), (3, ("1", "2026-01-02", "6", "")))
    seen = ["upload_id", "line", "risk_percent", "level", "score_status", "factors"]
    preview = U.upload(snapshot(spark, str(tmp_path)), given, COLUMNS, players, stats, key, dry_run=True)
    report = U.upload(snapshot(spark, str(tmp_path)), given, COLUMNS, players, stats, key)
    assert rows(report.results, *seen) == rows(preview.results, *seen) and len(calls) == 2
