"""Metrics by the rows of a table."""

import pytest
from conftest import rows

from matchlake.operators import custom as X, identity as D


@pytest.fixture(scope="module")
def stats(spark):
    return spark.createDataFrame(
        [(1, 4.0, 10, 90, "a"), (1, 6.0, None, 20, "a"), (1, None, 3, 80, "b"), (2, 0.0, 5, 10, "b"), (None, 2.0, 1, 95, None)], "player_id int, km double, sprints int, minutes int, place string")


def registry(spark, *metrics):
    return spark.createDataFrame([tuple(m) + (None,) * (8 - len(m)) + (i,) for i, m in enumerate(metrics)], X.REGISTRY)


def test_a_ratio_a_guarded_maximum_and_a_derived_metric_by_rows_only(spark, stats):
    reg = registry(spark, ("per_km", "ratio", "sprints", "km", None, 10.0, 1.0, 2), ("longest", "max", "km", None, "minutes >= 60", None, None, 1), ("all_km", "sum", "km"), ("share", "derived", "longest / nullif(all_km, 0)", None, None, 100.0, None, 0))
    got = X.aggregate(stats, ["player_id"], reg)
    assert got.columns == ["player_id", "per_km", "longest", "all_km", "share"]
    assert {tuple(r) for r in got.collect()} == {(1, 25.0, 4.0, 10.0, 40.0), (2, None, None, 0.0, None), (None, 5.0, 2.0, 2.0, 100.0)}
    more = X.aggregate(stats, ["player_id"], reg.union(registry(spark, ("least", "min", "minutes"))))
    assert {r["least"] for r in more.collect()} == {20.0, 10.0, 95.0}
    assert X.aggregate(stats, ["player_id"], reg.limit(0)).columns == ["player_id"]
    assert X.aggregate(stats.limit(0), ["player_id"], reg).count() == 0


@pytest.mark.parametrize("metric", [
    ("m", "sum", "no_such_column"), ("m", "sum", "place"), ("m", "sum", "sum(km)"), ("m", "sum", "km +"), ("m", "max", "km", None, "minutes"), ("m", "median", "km"),
    ("m", "ratio", "sprints"), ("m", "sum", "km", "minutes"), ("m", "derived", "later"), ("m", "sum", None), (None, "sum", "km"), ("m", "avg", "row_number() OVER (ORDER BY km)"),
])
def test_wrong_rows_are_named_before_anything_runs(spark, stats, metric):
    with pytest.raises(X.RegistryError) as e:
        X.aggregate(stats, ["player_id"], registry(spark, metric, ("fine", "sum", "km")))
    assert [p[0] for p in e.value.problems] == [metric[0] or ""]


def test_keys_that_are_there_twice(spark, stats):
    with pytest.raises(X.RegistryError, match="twice"):
        X.aggregate(stats, ["player_id"], registry(spark, ("m", "sum", "km"), ("m", "max", "km")))


def test_unknown_key_warnings(spark):
    m = spark.createDataFrame([(1, "zeta"), (1, "alpha"), (1, "alpha"), (1, "accels"), (2, "accel_count"), (3, None)], "video_id int, metric_key string")
    assert rows(D.unknown_key_warnings(m), "video_id", "warning") == [(1, "unknown metric keys left out: alpha, zeta")]


def test_a_total_of_exactly_the_minimum_reaches_it_in_any_order(spark):
    # added as doubles in the order 0.05, 4.85, 0.1 the total is 4.999999999999999
    data = [(i, km, 1) for i, order in enumerate([(0.05, 4.85, 0.1), (0.05, 0.1, 4.85), (4.85, 0.1, 0.05)]) for km in order]
    parts = spark.createDataFrame(data, "player_id int, km double, sprints int").coalesce(1)
    got = X.aggregate(parts, ["player_id"], registry(spark, ("per_km", "ratio", "sprints", "km", None, 1.0, 5.0, 2)))
    assert {tuple(r) for r in got.collect()} == {(0, 0.6), (1, 0.6), (2, 0.6)}
    # what lies below stays below
    less = spark.createDataFrame([(1, 4.9999999999, 1), (2, 2.0, 1), (2, 2.0, 1), (2, 0.9999999999, 1)], "player_id int, km double, sprints int")
    got = X.aggregate(less, ["player_id"], registry(spark, ("per_km", "ratio", "sprints", "km", None, 1.0, 5.0, 2)))
    assert {tuple(r) for r in got.collect()} == {(1, None), (2, None)}
