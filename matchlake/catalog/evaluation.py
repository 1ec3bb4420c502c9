from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from .identity import shifted
from .registry import query, rnd

EV = """
ev AS (SELECT video_id * 100000000 + track_id * 1000 + k AS event_id, video_id, track_id % 23 + 1 AS jersey, k * 1.5e0 + 0.25e0 AS start_s, k * 1.5e0 + 1.75e0 AS end_s,
  6e0 + track_id % 5 AS expected_m, 30e0 AS tolerance_pct FROM (SELECT video_id, track_id, unnest(generate_series(0, CAST(floor(max(t) / 1.5e0) AS BIGINT))) AS k FROM fx_detections GROUP BY video_id, track_id))"""


def events(d):
    t = d.fx_detections.groupBy("video_id", "track_id").agg(F.max("t").alias("t"))
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("t") / 1.5))))
    return t.selectExpr(
        "video_id * 100000000 + track_id * 1000 + k as event_id", "video_id", "track_id % 23 + 1 as jersey", "k * 1.5D + 0.25D as start_s", "k * 1.5D + 1.75D as end_s",
        "6D + track_id % 5 as expected_m", "30D as tolerance_pct",
    )


def detections(d):
    return d.fx_detections.selectExpr("video_id", "track_id", "frame", "t", "true_jersey as jersey", "x", "y")


@query("event_window_rows", "J9 P18", "WITH " + EV + """
SELECT ev.event_id, d.track_id, frame FROM fx_detections d JOIN ev ON ev.video_id = d.video_id AND ev.jersey = d.true_jersey AND t BETWEEN start_s AND end_s""")
def _(d):
    return V.in_event_windows(detections(d), events(d)).select("event_id", "track_id", "frame")


SPRINT = "WITH " + EV + f""",
r AS (SELECT ev.event_id, frame, x, y, d.track_id FROM fx_detections d JOIN ev ON ev.video_id = d.video_id AND ev.jersey = d.true_jersey AND t BETWEEN start_s AND end_s),
s AS (SELECT event_id, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM r WINDOW w AS (PARTITION BY event_id ORDER BY frame, track_id)),
m AS (SELECT event_id, coalesce(sum(step), 0) AS dist, count(*) AS frames FROM s GROUP BY event_id),
res AS (SELECT ev.event_id, video_id, {rnd('dist', 2)} AS distance_m, {rnd('abs(dist - expected_m)', 2)} AS error_m, {rnd('abs(dist - expected_m) / expected_m * 100', 2)} AS error_pct,
  abs(dist - expected_m) / expected_m * 100 <= tolerance_pct AS passed, coalesce(frames, 0) AS frames, CASE WHEN frames IS NULL THEN 'no detections in the time window' END AS error
  FROM ev LEFT JOIN m ON m.event_id = ev.event_id)"""


@query("sprint_validation", "V1", SPRINT + "SELECT * FROM res")
def _(d):
    return V.sprint_errors(detections(d), events(d))


@query("validation_pass_rate", "V3", SPRINT + f"""
SELECT video_id, count(*) AS validations, count(*) FILTER (WHERE passed) AS passed, {rnd('count(*) FILTER (WHERE passed) / count(*) * 100', 2)} AS pass_rate FROM res GROUP BY video_id""")
def _(d):
    return V.pass_rate(V.sprint_errors(detections(d), events(d)))


@query("top_speed_validation", "V2", f"""
WITH e AS (SELECT DISTINCT video_id, CAST(CASE WHEN video_id % 6 = 0 THEN 9 ELSE 1 END AS BIGINT) AS jersey, 20e0 + video_id % 4 AS ex FROM fx_fragments),
s AS (SELECT video_id, track_id % 4 AS jersey, min(track_id) AS t FROM fx_fragments GROUP BY ALL),
f AS (SELECT s.video_id, s.jersey, max(top_speed_kmh) AS kmh FROM s JOIN fx_fragments g ON g.video_id = s.video_id AND g.track_id = s.t GROUP BY ALL)
SELECT e.video_id, e.jersey, {rnd('abs(kmh - ex)', 2)} AS error_kmh, {rnd('abs(kmh - ex) / ex * 100', 2)} AS error_pct, abs(kmh - ex) / ex * 100 <= 15 AS passed,
  CASE WHEN f.video_id IS NULL THEN 'player not found' WHEN kmh IS NULL THEN 'top speed not available' END AS error
FROM e LEFT JOIN f ON f.video_id = e.video_id AND f.jersey = e.jersey""")
def _(d):
    stats = d.fx_fragments.select("video_id", "track_id", (F.col("track_id") % 4).alias("jersey"), "top_speed_kmh")
    e = d.fx_fragments.select("video_id").distinct().select(
        "video_id", F.when(F.col("video_id") % 6 == 0, F.lit(9)).otherwise(F.lit(1)).cast("bigint").alias("jersey"),
        (F.lit(20.0) + F.col("video_id") % 4).alias("expected_kmh"), F.lit(15.0).alias("tolerance_pct"),
    )
    return V.top_speed_errors(e, stats)


@query("position_errors", "V4 J16", """
SELECT p.video_id, p.track_id, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS mean, round(max(e), 6) AS max, round(quantile_cont(e, 0.95), 6) AS p95, count(*) AS samples
FROM (SELECT j.video_id, j.track_id, sqrt(pow(j.x - g.x, 2) + pow(j.y - (g.y + g.frame % 3), 2)) AS e FROM fx_jumpy j JOIN fx_gaps g ON g.video_id = j.video_id AND g.track_id = j.track_id AND g.frame = j.frame) p
GROUP BY p.video_id, p.track_id""")
def _(d):
    truth = d.fx_gaps.select("video_id", "track_id", "frame", "x", (F.col("y") + F.col("frame") % 3).alias("y"))
    out = V.position_errors(d.fx_jumpy.select("video_id", "track_id", "frame", "x", "y"), truth, ["video_id", "track_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("rmse", "mean", "max", "p95")})


@query("track_counts", "V5", "SELECT video_id, count(DISTINCT track_id) AS tracks, count(DISTINCT frame) AS frames, count(*) AS rows FROM fx_gaps GROUP BY video_id")
def _(d):
    return V.counts(d.fx_gaps, ["video_id"])


PAIRS = """
o AS (SELECT a.video_id, a.frame, a.track_id AS a, b.track_id AS b, greatest(0, least(a.x2, b.sx2) - greatest(a.x1, b.sx1)) * greatest(0, least(a.y2, b.sy2) - greatest(a.y1, b.sy1)) AS i
  FROM fx_boxes a JOIN fx_boxes b ON b.video_id = a.video_id AND b.frame = a.frame AND b.track_id % 5 <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame, a ORDER BY i DESC, b) AS ra, row_number() OVER (PARTITION BY video_id, frame, b ORDER BY i DESC, a) AS rb
  FROM o WHERE i / (7200 - i) >= 0.5),
mt AS (SELECT * FROM p WHERE ra = 1 AND rb = 1)"""


def pair_sides(d):
    truth = d.fx_boxes.select("video_id", "frame", "track_id", "x1", "y1", "x2", "y2")
    pred = shifted(d).withColumnRenamed("rid", "track_id").where("track_id % 5 <> 0")
    return truth, pred


@query("detection_scores", "V6", "WITH " + PAIRS + """,
c AS (SELECT video_id, count(*) AS truth, count(*) FILTER (WHERE track_id % 5 <> 0) AS predicted FROM fx_boxes GROUP BY video_id), t AS (SELECT video_id, count(*) AS tp FROM mt GROUP BY video_id)
SELECT c.video_id, tp, predicted, truth, round(tp / predicted, 6) AS precision, round(tp / truth, 6) AS recall, round(2 * (tp / predicted) * (tp / truth) / (tp / predicted + tp / truth), 6) AS f1
FROM c JOIN t ON t.video_id = c.video_id""")
def _(d):
    truth, pred = pair_sides(d)
    out = V.detection_scores(V.one_to_one(truth, pred, ["video_id", "frame"]), pred, truth, ["video_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("id_switches", "V7", """
WITH m AS (SELECT video_id, track_id AS true_id, frame, track_id * 10 + frame // 17 % 3 AS tid FROM fx_gaps),
s AS (SELECT *, CASE WHEN tid <> lag(tid) OVER (PARTITION BY video_id, true_id ORDER BY frame) THEN 1 ELSE 0 END AS sw FROM m),
u AS (SELECT video_id, true_id, max(n) AS most FROM (SELECT video_id, true_id, tid, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL)
SELECT s.video_id, s.true_id, count(*) AS frames, CAST(sum(sw) AS BIGINT) AS switches, round(sum(sw) / (count(*) / 10e0 / 60), 6) AS per_minute, round(max(most) / count(*), 6) AS persistence
FROM s JOIN u ON u.video_id = s.video_id AND u.true_id = s.true_id GROUP BY s.video_id, s.true_id""")
def _(d):
    m = d.fx_gaps.select("video_id", F.col("track_id").alias("true_id"), "frame", (F.col("track_id") * 10 + F.floor(F.col("frame") / 17) % 3).alias("track_id"))
    out = V.id_switches(m, 10.0)
    return out.withColumns({c: F.round(c, 6) for c in ("per_minute", "persistence")})


@query("jersey_scores", "V8", """
SELECT video_id, round(count(*) FILTER (WHERE jersey = true_jersey) / count(*), 6) AS accuracy, round(count(*) FILTER (WHERE jersey = true_jersey) / count(jersey), 6) AS precision,
  round(count(*) FILTER (WHERE jersey = true_jersey) / count(true_jersey), 6) AS recall FROM fx_detections GROUP BY video_id""")
def _(d):
    out = V.jersey_scores(d.fx_detections, ["video_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall")})


@query("team_accuracy", "V8", """
SELECT video_id, round(greatest(avg(a), 1 - avg(a)), 6) AS accuracy FROM (SELECT video_id, CASE WHEN CASE WHEN video_id % 2 = 0 THEN team ELSE 1 - team END = track_id % 2 THEN 1 ELSE 0 END AS a FROM fx_detections) GROUP BY video_id""")
def _(d):
    r = d.fx_detections.select(
        "video_id", F.when(F.col("video_id") % 2 == 0, F.col("team")).otherwise(1 - F.col("team")).alias("team"), (F.col("track_id") % 2).alias("true_team")
    )
    return V.team_accuracy(r, ["video_id"]).withColumn("accuracy", F.round("accuracy", 6))


@query("speed_distance_errors", "V9", """
SELECT video_id, track_id, round(sqrt(avg(pow(x / 10 - cx / 300, 2))), 6) AS speed_rmse, round(abs(sum(x) - sum(cx / 20)) / sum(cx / 20) * 100, 6) AS distance_error_pct FROM fx_gaps GROUP BY ALL""")
def _(d):
    k = ["video_id", "track_id"]
    pred = d.fx_gaps.select(*k, "frame", (F.col("x") / 10).alias("speed"), F.col("x").alias("step"))
    truth = d.fx_gaps.select(*k, "frame", (F.col("cx") / 300).alias("speed"), (F.col("cx") / 20).alias("step"))
    return V.speed_distance_errors(pred, truth, k).withColumns({c: F.round(c, 6) for c in ("speed_rmse", "distance_error_pct")})


@query("schema_report", "V10", """
SELECT 'jersey' AS field, TRUE AS present, TRUE AS typed, count(*) FILTER (WHERE jersey IS NULL) AS nulls, CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS out_of_range FROM fx_detections
UNION ALL SELECT 'x', TRUE, TRUE, CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*) FILTER (WHERE x > 20) FROM fx_detections
UNION ALL SELECT 'frame', TRUE, FALSE, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT count(*) FROM fx_detections)
UNION ALL SELECT 'missing', FALSE, FALSE, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT count(*) FROM fx_detections)""")
def _(d):
    return V.schema_report(d.fx_detections, {"jersey": "bigint", "x": "double", "frame": "int", "missing": "int"}, {"x": (0.0, 20.0)})


@query("nearest_frame", "J10", """
WITH r AS (SELECT video_id, track_id, f + 3 AS q FROM fx_frames WHERE f % 9 = 0)
SELECT video_id, track_id, q AS requested, (SELECT frame FROM fx_gaps g WHERE g.video_id = r.video_id AND g.track_id = r.track_id ORDER BY abs(frame - q), frame LIMIT 1) AS frame FROM r""")
def _(d):
    req = d.fx_frames.where("f % 9 = 0").select("video_id", "track_id", (F.col("f") + 3).alias("at"))
    det = d.fx_gaps.selectExpr("video_id", "track_id", "frame", "cx - 20 as x1", "cy - 45 as y1", "cx + 20 as x2", "cy + 45 as y2")
    return V.nearest_frame(req, det, ["video_id", "track_id"]).withColumnRenamed("at", "requested")


@query("wide_ground_truth", "S8", """
SELECT event_id, 'Player' || p AS player, round(CASE p WHEN 1 THEN value WHEN 2 THEN value * 2 ELSE value * 3 END, 6) AS x, CAST(p * (event_id % 10) AS DOUBLE) AS y
FROM events, (SELECT unnest([1, 2, 3]) AS p)""")
def _(d):
    from ..sources.files import unpivot_axes

    wide = d.events.select(
        "event_id", *[F.round(F.col("value") * k, 6).alias(f"Player{k}_x") for k in (1, 2, 3)],
        *[(F.lit(k) * (F.col("event_id") % 10)).cast("double").alias(f"Player{k}_y") for k in (1, 2, 3)],
    )
    return unpivot_axes(wide, ["event_id"])
