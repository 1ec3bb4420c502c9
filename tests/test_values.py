"""Small worked examples: registry rules, gates, scores, text and files."""

import datetime as dt
import json
import math

from pyspark.sql import functions as F

from matchlake import constants as C
from matchlake.catalog import load_all
from matchlake.functions import numbers as N, text as X
from matchlake.operators import athlete as A, calibration as K, model as M, registry as R, risk, stats as S, tags as TG
from matchlake.sources import files, sinks


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def wide(spark, data):
    base = {k: None for k in R.KEYS}
    schema = ", ".join(f"{k} double" for k in R.KEYS)
    return spark.createDataFrame([tuple({**base, **r}[k] for k in R.KEYS) for r in data], schema)


def test_registry_rules(spark):
    df = wide(spark, [
        {"distance_km": 4.0, "visible_minutes": 40.0, "top_speed_mph": 15.0, "coverage_pct": 80.0, "sprint_count": 3.0},
        {"distance_km": 6.0, "minutes_played": 60.0, "top_speed_mph": 18.26, "coverage_pct": 60.0},
        {"distance_km": None, "visible_minutes": 100.0},
    ])
    r = df.agg(*R.aggregate_columns()).first()
    assert (r.distance_km, r.top_speed_mph, r.coverage_pct, r.sprint_count) == (10.0, 18.3, 70.0, 3)
    assert r.distance_per_min == 100.0 and r.hsr_count is None and r.accels is None


def test_single_row_rate(spark):
    rate = lambda **k: wide(spark, [k]).agg(*R.aggregate_columns(["distance_per_min"])).first()[0]
    assert rate(distance_per_min=111.0, distance_km=1.0, visible_minutes=5.0) == 111.0
    assert rate(distance_per_min=438000.0, distance_km=7.0, visible_minutes=0.02) is None
    assert rate(distance_per_min=90.0, distance_km=7.0) == 90.0
    assert rate(distance_km=7.0, visible_minutes=0.05) is None


def test_measured_zero_is_not_missing(spark):
    r = wide(spark, [{"sprint_count": 0.0}, {"sprint_count": None}]).agg(*R.aggregate_columns(["sprint_count", "hsr_count"])).first()
    assert (r.sprint_count, r.hsr_count) == (0, None)


def test_registry_is_complete():
    assert len(R.METRICS) == 21 and len(set(R.KEYS)) == 21
    assert set(R.ALIASES.values()) <= set(R.STORED_KEYS)


def test_contributions_add_up(spark):
    df = spark.createDataFrame([(1.4, 120.0, None, None, 31.0, 80.0, None, 1.0)], ", ".join(f"{f} double" for f in C.FEATURES))
    r = M.score(df).first()
    total = sum(c.contribution for c in r.contributions) + M.DEFAULT_MODEL.intercept
    assert abs(total - math.log(r.probability / (1 - r.probability))) < 1e-3
    size = [abs(c.contribution) for c in r.contributions]
    assert size == sorted(size, reverse=True)
    top = M.score(df).select(M.factors(F.col("contributions")).alias("f")).first().f
    assert len(top) == 5 and not {"sprints_per_90", "hsr_m_per_min", "heart_rate_avg"} & {t.feature for t in top}


def test_level_uses_the_rounded_percent(spark):
    r = one(spark, a=M.level(F.round(F.lit(69.95), 1)), b=M.level(F.lit(69.9)), c=M.level(F.lit(None).cast("double")))
    assert tuple(r) == ("red", "yellow", None)


def test_match_gates(spark):
    schema = "video_id bigint, adapter_source string, calibration string, distance_valid boolean, placeholder boolean, distance_km double, visible_minutes double, minutes_played double"
    cases = [
        ((1, "real", "uploads/a.json", None, False, 5.0, 60.0, None), "scored", None, "calibrated"),
        ((1, "real", "cfg/default_calibration.json", None, False, 5.0, 60.0, None), "uncalibrated", "no custom pitch calibration", None),
        ((1, "real", "uploads/a.json", False, True, None, 0.5, None), "uncalibrated",
         "no roster match (placeholder player); distance_valid=false; distance missing; visible_minutes < 1", None),
        ((None, None, None, None, False, 5.0, None, 70.0), "scored", None, "demo"),
        ((1, "stub", None, None, False, 5.0, None, 0.2), "insufficient_data", "exposure minutes < 1", "demo"),
    ]
    for row, status, note, quality in cases:
        r = risk.gate_match_rows(spark.createDataFrame([row], schema)).first()
        assert (r.score_status, r.score_note, r.data_quality) == (status, note, quality)


def test_training_learns_a_signal(spark):
    df = spark.range(800).select(
        (F.col("id") % 50).alias("player_id"), ((F.col("id") * 37 % 100) / 50).alias("acwr"), *[F.lit(1.0).alias(f) for f in C.FEATURES[1:7]], F.lit(0.0).alias("hr_missing"),
        ((F.col("id") * 37 % 100) > 55).cast("int").alias("label"),
    )
    model = M.train(df)
    s = M.score(df, model).withColumn("k", F.lit(1))
    assert M.auc(s, ["k"]).first().auc > 0.99 and M.quality(s, ["k"]).first().accuracy > 0.9


def test_dates_names_headers(spark):
    r = one(spark, a=A.parse_date(F.lit("2026-9-1")), b=A.parse_date(F.lit(" 9/1/2026 ")), c=A.parse_date(F.lit("2026-02-30")), d=X.name_key(F.lit(" Kane,  Harry ")),
            e=A.canonical_header(F.lit("Top Speed (km/h)")), f=X.jersey_from_placeholder(F.lit("#12")))
    assert str(r.a) == str(r.b) == "2026-09-01" and r.c is None
    assert (r.d, r.e, r.f) == ("harry kane", "top_speed_kmh", 12)
    assert A.header_positions(["Name", "Jersey #", "HR", "hr"]) == {"player": 0, "jersey_number": 1, "heart_rate": 2}


def test_tag_rules(spark):
    r = one(spark, a=TG.clean_key(F.lit(" Kick   off ")), b=TG.clean_key(F.lit("a:b")), c=TG.clean_value(F.lit("  ")), d=TG.parse_filter(F.lit("a:b:c")))
    assert (r.a, r.b, r.c, r.d.value) == ("Kick off", None, None, "b:c")


def test_homography_round_trip(spark):
    pts = [(0, 0), (1000, 0), (1000, 600), (0, 600), (400, 300)]
    data = [(3, float(u), float(v), 0.1 * u + 2, 0.1 * v - 1) for u, v in pts] + [(4, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "camera_id bigint, image_x double, image_y double, pitch_x double, pitch_y double")
    fit = K.fit(df)
    assert [r.camera_id for r in fit.collect()] == [3]
    q = K.quality(df, fit).first()
    assert q.accepted and q.max_error < 1e-6


def test_json_list_with_strays(spark, tmp_path):
    (tmp_path / "video_7.json").write_text(json.dumps([{"frame": 1, "track_id": 2, "pitch_x": 1.5}, 5, "x", {"frame": 2, "track_id": 2}]))
    (tmp_path / "video_8.json").write_text(json.dumps([{"frame": 3, "track_id": 4}]))
    (tmp_path / "video_9.json").write_text("{broken")
    df = files.read_json_list(spark, str(tmp_path), files.DETECTIONS, r"video_(\d+)")
    assert sorted((r.video_id, r.frame, r.pitch_x) for r in df.collect()) == [(7, 1, 1.5), (7, 2, None), (8, 3, None)]


def test_log_file_with_mark_and_blank_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Athlete,Session Date,Distance (km)\n\"Kane, Harry\",2026-09-01,7.5\n,,\nSon,9/2/2026,\n", encoding="utf-8")
    df = files.read_log_csv(spark, str(tmp_path))
    got = sorted((r.line, r.player, r.date, r.gps_distance) for r in df.collect())
    assert got == [(2, "Kane, Harry", "2026-09-01", "7.5"), (4, "Son", "9/2/2026", None)]


def test_replace_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 10), (2, 20)], "video_id bigint, v bigint")
    for _ in range(2):
        sinks.replace_by_video(df, path)
    sinks.replace_by_video(spark.createDataFrame([(2, 99)], "video_id bigint, v bigint"), path)
    assert sorted((r.video_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, 10), (2, 99)]


def test_override_with_null_wins(spark):
    p = spark.createDataFrame([(1, 5, 7), (1, 6, 8)], "video_id bigint, player_id bigint, jersey bigint")
    o = spark.createDataFrame([(1, 5, None)], "video_id bigint, player_id bigint, jersey bigint")
    assert sorted((r.player_id, r.jersey) for r in S.with_jersey_override(p, o).collect()) == [(5, None), (6, 8)]


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    orders = [(0.05, 4.85, 0.1), (0.05, 0.1, 4.85), (4.85, 0.1, 0.05), (0.1, 0.2), (None, 0.1), (None, None), (1e300, 2.0, 3.0), (math.nan, 1.0, 2.0)]
    data = spark.createDataFrame([(i, v) for i, o in enumerate(orders) for v in o], "k int, v double").coalesce(1)
    got = {r["k"]: r["s"] for r in data.groupBy("k").agg(N.steady_sum("v").alias("s")).collect()}
    assert math.isnan(got.pop(7)) and got == {0: 5.0, 1: 5.0, 2: 5.0, 3: 0.1 + 0.2, 4: 0.1, 5: None, 6: 1e300}


def test_the_longest_player_of_equal_ones_has_the_lowest_id(spark, tmp_path):
    # three rows of each player, the same numbers in another order: 4.999999999999999 for the first, 5 for the second
    day = dt.datetime(1995, 3, 4)
    quantities = {1: (1.0, 97.0, 2.0), 26: (1.0, 2.0, 97.0)}
    orders = [(100 * c + i, c, "O", 1.0, day, "5-LOW") for c in quantities for i in range(3)]
    items = [(100 * c + i, 1, 1, 1, q, 1.0, 0.0, 0.0, "N", "O", day) for c, own in quantities.items() for i, q in enumerate(own)]
    write = lambda r, schema, name: spark.createDataFrame(r, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    write(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", "orders")
    write(items, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz", "lineitem")
    got = load_all()["squad_summary"](spark, str(tmp_path)).collect()
    assert [(r["players"], r["longest_player"]) for r in got] == [(2, 1)]
