"""Commits show whole or not at all, also with a writer that dies and with two writers; uploads are stored in one commit."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from matchlake.operators import uploads as U
from matchlake.sources import snapshots
from matchlake.sources.snapshots import Conflict, Replace, commit, expire, snapshot

SCHEMA = "player_id bigint, v bigint"


def table(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def content(spark, root, name="t", version=None):
    return rows(snapshot(spark, root, version).read(name), "player_id", "v")


def test_replace_by_key_and_keys_without_rows(spark, tmp_path):
    root = str(tmp_path / "s")
    first = commit(snapshot(spark, root), {"t": Replace(table(spark, *((i, i) for i in range(20)), (None, 5)), "player_id")}, buckets=4)
    second = commit(first, {"t": Replace(table(spark, (4, 40), (4, 41)), "player_id", table(spark, (4, 0), (7, 0), (None, 0)).select("player_id"))})
    assert content(spark, root) == sorted([(i, i) for i in range(20) if i not in (4, 7)] + [(4, 40), (4, 41)])
    assert snapshot(spark, root, first.version).read("t").count() == 21  # an earlier version stays readable
    assert commit(second, {"t": Replace(table(spark).limit(0), "player_id", second.read("t").select("player_id"))}).read("t").count() == 0
    assert content(spark, root) == []


def test_killed_writer_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    base = commit(snapshot(spark, root), {"t": Replace(table(spark, (1, 1)), "player_id"), "u": Replace(table(spark, (1, 9)), "player_id")}, buckets=2)

    def dies(new):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            commit(base, {"t": Replace(table(spark, (1, 2)), "player_id"), "u": Replace(table(spark, (1, 8)), "player_id")})
    assert content(spark, root) == [(1, 1)] and content(spark, root, "u") == [(1, 9)]
    assert expire(spark, root) == 0  # too young to go
    assert expire(spark, root, older_than=-60) == 2
    commit(base, {"t": Replace(table(spark, (1, 2)), "player_id")})
    assert content(spark, root) == [(1, 2)] and content(spark, root, "u") == [(1, 9)]
    assert expire(spark, root, keep=1, older_than=-60) == 1 and content(spark, root) == [(1, 2)]


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "s")
    base = commit(snapshot(spark, root), {"t": Replace(table(spark, *((i, 0) for i in range(50))), "player_id")}, buckets=16)
    commit(base, {"t": Replace(table(spark, (1, 1)), "player_id")})
    with pytest.raises(Conflict):
        commit(base, {"t": Replace(table(spark, (1, 2)), "player_id")})
    bucket = lambda i: table(spark, (i, 0)).select(snapshots._bucket("player_id", 16)).first()[0]
    other = next(i for i in range(2, 50) if bucket(i) != bucket(1))
    commit(base, {"t": Replace(table(spark, (other, 3)), "player_id")})  # another bucket: both changes stay
    got = dict(content(spark, root))
    assert got[1] == 1 and got[other] == 3 and sum(got.values()) == 4 and len(got) == 50
    # a version file is never overwritten
    newest = snapshot(spark, root)
    assert not snapshots._publish(newest) and snapshot(spark, root) == newest


def test_a_batch_that_comes_again_does_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    one = commit(snapshot(spark, root), {"t": Replace(table(spark, (1, 1)), "player_id")}, tag=("q", 0))
    commit(one, {"t": Replace(table(spark, (1, 2)), "player_id")}, tag=("q", 1))
    assert commit(one, {"t": Replace(table(spark, (1, 3)), "player_id")}, tag=("q", 1)).version == 2
    assert commit(snapshot(spark, root), {"t": Replace(table(spark, (1, 3)), "player_id")}, tag=("q", 0)).version == 2
    assert content(spark, root) == [(1, 2)]


@pytest.fixture(scope="module")
def club(spark):
    players = spark.createDataFrame([(1, "Ann", "Lee", "mid", 7), (2, "Bo", "Ray", "mid", 8)], "player_id bigint, first_name string, last_name string, position string, jersey int")
    stats = spark.createDataFrame([], "player_id bigint, stat_id bigint, match_id bigint, video_id bigint, score_date date, distance_km double, top_speed_mph double, minutes_played double, "
                                      "visible_minutes double, sprint_count double, hsr_distance_km double, adapter_source string, calibration string, distance_valid boolean")
    return players, stats, F.unhex(F.sha2(F.lit("k"), 256))


def cells(spark, upload, *lines):
    return spark.createDataFrame([(upload, f"{upload}.csv", n, *v) for n, v in lines], "upload_id bigint, filename string, line int, player_id string, date string, gps_distance string, heart_rate string")


COLUMNS = ["player_id", "date", "gps_distance", "heart_rate"]


def test_upload_preview_commit_again_and_withdraw(spark, tmp_path, club):
    players, stats, key = club
    store = snapshot(spark, str(tmp_path / "s"))
    first = cells(spark, 1, (2, ("1", "2026-01-01", "5", "140")), (3, ("1", "2026-01-02", "6", "")), (4, ("9", "2026-01-02", "6", "")), (5, ("2", "", "x", "")))
    preview = U.upload(store, first, COLUMNS, players, stats, key, dry_run=True)
    assert preview.store.version == 0 and snapshots.versions(spark, store.root) == []
    report = U.upload(store, first, COLUMNS, players, stats, key)
    seen = ["upload_id", "line", "player_id", "name", "risk_percent", "level", "score_status"]
    assert rows(report.results, *seen) == rows(preview.results, *seen) and report.results.count() == 2
    assert rows(report.uploads, "rows_total", "rows_valid", "rows_invalid", "rows_unmatched") == [(4, 2, 1, 1)]
    assert rows(report.unmatched, "line", "player") == [(4, "9")] and {r["column"] for r in report.errors.collect()} == {"date", "gps_distance"}
    logs = lambda s: rows(U.open_logs(s.read("logs"), key), "player_id", "upload_id", "line", "gps_distance_km", "heart_rate")
    assert logs(report.store)[0] == (1, 1, 2, 5.0, 140.0) and "heart_rate" not in report.store.read("logs").columns

    store = U.upload(report.store, cells(spark, 2, (2, ("2", "2026-01-03", "4", "")), (3, ("1", "2026-01-03", "7", ""))), COLUMNS, players, stats, key).store
    assert store.version == 2 and [r[1:3] for r in logs(store)] == [(1, 2), (1, 3), (2, 3), (2, 2)]
    # the first upload once more, without the rows of one player: its old rows go, the other upload stays
    store = U.upload(store, cells(spark, 1, (2, ("2", "2026-01-01", "3", ""))), COLUMNS, players, stats, key).store
    assert logs(store) == sorted([(2, 1, 2, 3.0, None), (2, 2, 2, 4.0, None), (1, 2, 3, 7.0, None)])
    assert [r["upload_id"] for r in U.listing(store).collect()] == [2, 1]
    store = U.withdraw(store, spark.createDataFrame([(2,)], "upload_id bigint"), players, stats, key)
    assert logs(store) == [(2, 1, 2, 3.0, None)] and [r["upload_id"] for r in U.listing(store).collect()] == [1]
    scores = U.stored_scores(snapshot(spark, store.root), key, "struct<display: string>")
    assert rows(scores, "player_id", "score_status") == [(2, "scored")]


def test_line_numbers_that_do_not_fit_are_refused(spark, club):
    players, stats, key = club
    rows_ = cells(spark, 1, (300, ("1", "2026-01-01", "5", "")))
    with pytest.raises(Exception, match="more than 8 bits"):
        U.upload(snapshot(spark, "/nowhere"), rows_, COLUMNS, players, stats, key, dry_run=True, line_bits=8).results.collect()
