from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import trajectory as T
from ..plans.materialize import reuse
from .registry import query

FPS = 10.0


def kinematics_sql(source: str) -> str:
    """Oracle text: plain windows over whole tracks."""
    return f"""
k1 AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY video_id, track_id) AS n_points,
         lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t) OVER w AS pt, lag(is_detected) OVER w AS pd
       FROM {source} WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
k2 AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS step_m, t - pt AS dt,
         is_detected AND pd AS both_detected, pos - 1 AS i, n_points - 1 AS n FROM k1 WHERE pos > 0),
k3 AS (SELECT *, CASE WHEN dt <= 0 THEN 0.0e0 ELSE step_m / dt END AS velocity_ms FROM k2),
k4 AS (SELECT *, velocity_ms * 2.23694e0 AS speed_mph FROM k3),
k5 AS (SELECT *,
         CASE WHEN n < 5 THEN speed_mph ELSE (sum(speed_mph) OVER f + greatest(0, 2 - i) * first_value(speed_mph) OVER a
           + greatest(0, 2 - (n - 1 - i)) * last_value(speed_mph) OVER a) / 5 END AS smooth_mph,
         CASE WHEN n < 5 THEN velocity_ms ELSE (sum(velocity_ms) OVER f + greatest(0, 2 - i) * first_value(velocity_ms) OVER a
           + greatest(0, 2 - (n - 1 - i)) * last_value(velocity_ms) OVER a) / 5 END AS smooth_ms
       FROM k4 WINDOW f AS (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
         a AS (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
k6 AS (SELECT *, row_number() OVER w - 1 AS vpos, count(*) OVER (PARTITION BY video_id, track_id) AS n_valid
       FROM k5 WHERE smooth_mph <= 25 WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
sus AS (SELECT *, CASE WHEN n_valid < 10 THEN quantile_cont(smooth_mph, 0.5) OVER (PARTITION BY video_id, track_id)
         ELSE quantile_cont(smooth_mph, 0.5) OVER (PARTITION BY video_id, track_id ORDER BY frame
           ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END AS sustained_mph FROM k6),
a1 AS (SELECT *, greatest(-6, least(6, (smooth_ms - lag(smooth_ms) OVER w) * 10)) AS accel_raw FROM k5
       WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
a2 AS (SELECT *, pos - 2 AS j, n_points - 2 AS m FROM a1 WHERE pos > 1),
acc AS (SELECT *, CASE WHEN m < 5 THEN accel_raw ELSE (sum(accel_raw) OVER f + greatest(0, 2 - j) * first_value(accel_raw) OVER a
           + greatest(0, 2 - (m - 1 - j)) * last_value(accel_raw) OVER a) / 5 END AS accel_ms2
       FROM a2 WINDOW f AS (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
         a AS (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def bursts_sql(name: str, threshold: float) -> str:
    return f"""
{name}1 AS (SELECT *, CASE WHEN vpos - lag(vpos) OVER w - 1 <= 2 THEN 0 ELSE 1 END AS fresh
       FROM sus WHERE sustained_mph >= {threshold} * 0.9e0 WINDOW w AS (PARTITION BY video_id, track_id ORDER BY vpos)),
{name}2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, track_id ORDER BY vpos) AS island FROM {name}1),
{name} AS (SELECT video_id, track_id, min(vpos) FILTER (WHERE sustained_mph >= {threshold}) AS start, max(vpos) AS "end",
         max(vpos) - min(vpos) FILTER (WHERE sustained_mph >= {threshold}) + 1
           + least(2, max(n_valid) - 1 - max(vpos)) AS length
       FROM {name}2 GROUP BY video_id, track_id, island
       HAVING max(vpos) - min(vpos) FILTER (WHERE sustained_mph >= {threshold}) + 1
           + least(2, max(n_valid) - 1 - max(vpos)) >= 10)"""


ACCEL_SQL = """
e1 AS (SELECT video_id, track_id, pos, CASE WHEN accel_ms2 >= 3 THEN 'accel' WHEN accel_ms2 <= -3 THEN 'decel' END AS kind
       FROM acc),
e2 AS (SELECT *, pos - row_number() OVER (PARTITION BY video_id, track_id, kind ORDER BY pos) AS island FROM e1
       WHERE kind IS NOT NULL),
e3 AS (SELECT video_id, track_id, kind, CAST(floor(count(*) / 7) AS BIGINT) AS events FROM e2
       GROUP BY video_id, track_id, kind, island),
events_ AS (SELECT video_id, track_id,
         CAST(coalesce(sum(events) FILTER (WHERE kind = 'accel'), 0) AS BIGINT) AS accel_count_high,
         CAST(coalesce(sum(events) FILTER (WHERE kind = 'decel'), 0) AS BIGINT) AS decel_count_high
       FROM e3 GROUP BY video_id, track_id)"""

KIN = "WITH " + kinematics_sql("fx_detections")
KEYS = "video_id, track_id"


def kin(d, source="fx_detections"):
    points = getattr(d, source).select("video_id", "track_id", "frame", "x", "y", "t", "is_detected")
    return T.kinematics(points, FPS)


def sus(d, source="fx_detections"):
    return reuse(T.sustained(kin(d, source), FPS))


@query("instantaneous_speed", "W1", KIN + """
SELECT video_id, track_id, frame, round(speed_mph, 6) AS speed_mph, both_detected FROM k4""")
def _(d):
    return kin(d).where("pos > 0").select(
        "video_id", "track_id", "frame", F.round("speed_mph", 6).alias("speed_mph"), "both_detected"
    )


@query("smoothed_speed", "W2", KIN + """
SELECT video_id, track_id, frame, round(smooth_mph, 6) AS smooth_mph FROM k5""")
def _(d):
    return kin(d).where("pos > 0").select("video_id", "track_id", "frame", F.round("smooth_mph", 6).alias("smooth_mph"))


@query("sustained_speed", "W3", KIN + """
SELECT video_id, track_id, frame, round(sustained_mph, 6) AS sustained_mph FROM sus""")
def _(d):
    return sus(d).select(
        "video_id", "track_id", "frame", F.round("sustained_mph", 6).alias("sustained_mph")
    )


@query("outlier_gate", "P9", "WITH " + kinematics_sql("fx_jumpy") + """
SELECT video_id, track_id, frame, round(smooth_mph, 6) AS smooth_mph, round(sustained_mph, 6) AS sustained_mph FROM sus""")
def _(d):
    return sus(d, "fx_jumpy").select(
        "video_id", "track_id", "frame", F.round("smooth_mph", 6).alias("smooth_mph"),
        F.round("sustained_mph", 6).alias("sustained_mph"),
    )


@query("track_distance", "W4", "WITH " + kinematics_sql("fx_jumpy") + """
SELECT video_id, track_id, round(sum(least(step_m, 25e0 / 2.23694e0 / 10 * 2)) / 1000, 6) AS distance_km
FROM k2 GROUP BY video_id, track_id""")
def _(d):
    return kin(d, "fx_jumpy").groupBy(*T.KEYS).agg(F.round(T.total_distance_km(FPS), 6).alias("distance_km"))


@query("zone_distance", "W5", KIN + """
SELECT video_id, track_id,
  round(coalesce(sum(step_m) FILTER (WHERE kmh < 7), 0) / 1000, 6) AS zone_walk_km,
  round(coalesce(sum(step_m) FILTER (WHERE kmh >= 7 AND kmh < 15), 0) / 1000, 6) AS zone_jog_km,
  round(coalesce(sum(step_m) FILTER (WHERE kmh >= 15 AND kmh < 12.3e0 * 1.60934e0), 0) / 1000, 6) AS zone_run_km,
  round(coalesce(sum(step_m) FILTER (WHERE kmh >= 12.3e0 * 1.60934e0 AND kmh < 15.7e0 * 1.60934e0), 0) / 1000, 6) AS zone_hsr_km,
  round(coalesce(sum(step_m) FILTER (WHERE kmh >= 15.7e0 * 1.60934e0), 0) / 1000, 6) AS zone_sprint_km
FROM (SELECT *, smooth_mph * 1.60934e0 AS kmh FROM k5) GROUP BY video_id, track_id""")
def _(d):
    zones = kin(d).groupBy(*T.KEYS).agg(*T.zone_distances())
    return zones.select(*T.KEYS, *[F.round(f"zone_{z}_km", 6).alias(f"zone_{z}_km") for z in T.ZONES])


@query("fast_distance", "W6", KIN + """
SELECT video_id, track_id, round(coalesce(sum(step_m) FILTER (WHERE sustained_mph >= 12.3), 0) / 1000, 6) AS hsr_km,
  round(coalesce(sum(step_m) FILTER (WHERE sustained_mph >= 15.7), 0) / 1000, 6) AS sprint_km,
  round(coalesce(sum(step_m) FILTER (WHERE sustained_mph >= 0.7e0 * best), 0) / 1000, 6) AS above_70pct_km,
  round(coalesce(sum(step_m) FILTER (WHERE sustained_mph >= 0.85e0 * best), 0) / 1000, 6) AS above_85pct_km
FROM (SELECT *, max(sustained_mph) OVER (PARTITION BY video_id, track_id) AS best FROM sus) GROUP BY video_id, track_id""")
def _(d):
    s = sus(d)
    best = s.groupBy(*T.KEYS).agg(F.max("sustained_mph").alias("best"))
    s = s.join(best, list(T.KEYS))

    def above(limit):
        return F.round(F.coalesce(F.sum(F.when(F.col("sustained_mph") >= limit, F.col("step_m"))), F.lit(0.0)) / 1000, 6)

    return s.groupBy(*T.KEYS).agg(
        above(C.HSR_MPH).alias("hsr_km"),
        above(C.SPRINT_MPH).alias("sprint_km"),
        above(0.7 * F.col("best")).alias("above_70pct_km"),
        above(0.85 * F.col("best")).alias("above_85pct_km"),
    )


@query("burst_intervals", "W7", KIN + "," + bursts_sql("hsr", 12.3) + "," + bursts_sql("sprint", 15.7) + """
SELECT 'hsr' AS kind, video_id, track_id, start, "end", length FROM hsr
UNION ALL SELECT 'sprint' AS kind, video_id, track_id, start, "end", length FROM sprint""")
def _(d):
    return T.bursts(sus(d), {"hsr": C.HSR_MPH, "sprint": C.SPRINT_MPH}, FPS)


@query("acceleration_events", "W8", KIN + "," + ACCEL_SQL + "SELECT * FROM events_")
def _(d):
    return T.acceleration_events(kin(d), FPS)


TOP_SQL = """
d1 AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY sustained_mph DESC) - 1 AS r,
         count(*) OVER (PARTITION BY video_id, track_id) AS nd FROM sus WHERE both_detected),
top AS (SELECT video_id, track_id, coalesce(any_value(d.v), max(sustained_mph)) AS top_speed_mph
        FROM sus LEFT JOIN (SELECT video_id AS v1, track_id AS t1, max(sustained_mph) AS v FROM d1 WHERE r = floor(nd * 0.01e0)
          GROUP BY video_id, track_id) d ON d.v1 = video_id AND d.t1 = track_id GROUP BY video_id, track_id)"""


@query("robust_top_speed", "W9", KIN + "," + TOP_SQL + """
SELECT video_id, track_id, round(top_speed_mph, 6) AS top_speed_mph FROM top""")
def _(d):
    return T.top_speed(sus(d)).select(*T.KEYS, F.round("top_speed_mph", 6).alias("top_speed_mph"))


@query("temporal_summary", "W10", """
SELECT video_id, track_id, min(t) AS first_seen, max(t) AS last_seen, round((max(t) - min(t)) / 60, 6) AS minutes_played,
  round(count(*) / 10e0 / 60, 6) AS visible_minutes, round(avg(x), 6) AS avg_pitch_x, round(avg(y), 6) AS avg_pitch_y,
  count(*) AS n_points, round(count(*) * 100e0 / max(frames), 4) AS coverage_pct
FROM fx_gaps JOIN (SELECT video_id AS v, max(frame) + 1 AS frames FROM fx_detections GROUP BY video_id) ON v = video_id
GROUP BY video_id, track_id""")
def _(d):
    frames = d.fx_detections.groupBy("video_id").agg((F.max("frame") + 1).alias("frames"))
    out = d.fx_gaps.groupBy(*T.KEYS).agg(*T.temporal(FPS)).join(frames, "video_id")
    out = out.withColumn("coverage_pct", F.round(F.col("n_points") * 100 / F.col("frames"), 4)).drop("frames")
    for c in ("minutes_played", "visible_minutes", "avg_pitch_x", "avg_pitch_y"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("workload_band", "W11", """
SELECT stat_id, CASE WHEN p >= 4 THEN 'High' WHEN p >= 2 THEN 'Medium' ELSE 'Low' END AS band
FROM (SELECT stat_id,
  CASE WHEN distance_km > 10 THEN 2 WHEN distance_km > 7 THEN 1 ELSE 0 END
  + CASE WHEN sprints > 50 THEN 2 WHEN sprints > 30 THEN 1 ELSE 0 END
  + CASE WHEN hsr > 1.5 THEN 2 WHEN hsr > 0.8 THEN 1 ELSE 0 END AS p
  FROM (SELECT s.stat_id, max(distance_km) AS distance_km, max(value) FILTER (WHERE metric_key = 'sprint_count') AS sprints,
     max(value) FILTER (WHERE metric_key = 'hsr_distance_km') * 5 AS hsr
     FROM fx_stats s LEFT JOIN fx_metrics m ON m.stat_id = s.stat_id GROUP BY s.stat_id))""")
def _(d):
    m = d.fx_metrics.groupBy("stat_id").pivot("metric_key", ["sprint_count", "hsr_distance_km"]).agg(F.max("value"))
    s = d.fx_stats.select("stat_id", "distance_km").join(m, "stat_id", "left")
    return s.select(
        "stat_id",
        T.workload_risk(F.col("distance_km"), F.col("sprint_count"), F.col("hsr_distance_km") * 5).alias("band"),
    )


@query("physical_report", "G14 W1 W2 W3 W4 W5 W6 W7 W8 W9 W10 W11",
       KIN + "," + bursts_sql("hsr", 12.3) + "," + bursts_sql("sprint", 15.7) + "," + ACCEL_SQL + "," + TOP_SQL + """,
hc AS (SELECT video_id, track_id, count(*) AS c FROM hsr GROUP BY ALL),
sc AS (SELECT video_id, track_id, count(*) AS c FROM sprint GROUP BY ALL),
base AS (SELECT video_id, track_id, min(t) AS t0, max(t) AS t1, count(*) AS n, avg(x) AS ax, avg(y) AS ay
         FROM k1 GROUP BY video_id, track_id HAVING count(*) >= 2),
st AS (SELECT video_id, track_id, sum(least(step_m, 25e0 / 2.23694e0 / 10 * 2)) / 1000 AS km,
  count(*) FILTER (WHERE both_detected) AS det, count(*) AS total,
  coalesce(sum(step_m) FILTER (WHERE kmh < 7), 0) / 1000 AS z1,
  coalesce(sum(step_m) FILTER (WHERE kmh >= 7 AND kmh < 15), 0) / 1000 AS z2,
  coalesce(sum(step_m) FILTER (WHERE kmh >= 15 AND kmh < 12.3e0 * 1.60934e0), 0) / 1000 AS z3,
  coalesce(sum(step_m) FILTER (WHERE kmh >= 12.3e0 * 1.60934e0 AND kmh < 15.7e0 * 1.60934e0), 0) / 1000 AS z4,
  coalesce(sum(step_m) FILTER (WHERE kmh >= 15.7e0 * 1.60934e0), 0) / 1000 AS z5
  FROM (SELECT *, smooth_mph * 1.60934e0 AS kmh FROM k5) GROUP BY video_id, track_id),
fast AS (SELECT video_id, track_id, coalesce(sum(step_m) FILTER (WHERE sustained_mph >= 12.3), 0) / 1000 AS hsr_km,
  coalesce(sum(step_m) FILTER (WHERE sustained_mph >= 15.7), 0) / 1000 AS sprint_km FROM sus GROUP BY video_id, track_id),
vf AS (SELECT video_id AS v, max(frame) + 1 AS frames FROM fx_detections GROUP BY video_id)
SELECT b.video_id, b.track_id, CAST(round(CAST(top_speed_mph AS DECIMAL(28, 9)), 2) AS DOUBLE) AS top_speed_mph, CAST(round(CAST(top_speed_mph * 1.60934e0 AS DECIMAL(28, 9)), 2) AS DOUBLE) AS top_speed_kmh,
  CAST(round(CAST(km AS DECIMAL(28, 9)), 3) AS DOUBLE) AS distance_km, CAST(round(CAST(km * 1000 AS DECIMAL(28, 9)), 1) AS DOUBLE) AS distance_m, CAST(round(CAST((t1 - t0) / 60 AS DECIMAL(28, 9)), 2) AS DOUBLE) AS minutes_played,
  CAST(round(CAST((t1 - t0) / 60 * 60 AS DECIMAL(28, 9)), 1) AS DOUBLE) AS minutes_played_s, CAST(round(CAST(n / 10e0 / 60 AS DECIMAL(28, 9)), 2) AS DOUBLE) AS visible_minutes,
  CAST(round(CAST(n / 10e0 / 60 * 60 AS DECIMAL(28, 9)), 1) AS DOUBLE) AS visible_minutes_s, CAST(round(CAST(km * 1000 / (n / 10e0 / 60) AS DECIMAL(28, 9)), 2) AS DOUBLE) AS distance_per_min_m,
  CAST(round(CAST(ax AS DECIMAL(28, 9)), 2) AS DOUBLE) AS avg_pitch_x, CAST(round(CAST(ay AS DECIMAL(28, 9)), 2) AS DOUBLE) AS avg_pitch_y, CAST(round(CAST(hsr_km AS DECIMAL(28, 9)), 3) AS DOUBLE) AS high_speed_distance_km,
  CAST(round(CAST(sprint_km AS DECIMAL(28, 9)), 3) AS DOUBLE) AS sprint_distance_km, coalesce(hc.c, 0) AS hsr_count, coalesce(sc.c, 0) AS sprint_count,
  coalesce(hc.c, 0) + coalesce(sc.c, 0) AS hi_efforts_count,
  CAST(round(CAST(z1 AS DECIMAL(28, 9)), 3) AS DOUBLE) AS zone_walk_km, CAST(round(CAST(z2 AS DECIMAL(28, 9)), 3) AS DOUBLE) AS zone_jog_km, CAST(round(CAST(z3 AS DECIMAL(28, 9)), 3) AS DOUBLE) AS zone_run_km, CAST(round(CAST(z4 AS DECIMAL(28, 9)), 3) AS DOUBLE) AS zone_hsr_km,
  CAST(round(CAST(z5 AS DECIMAL(28, 9)), 3) AS DOUBLE) AS zone_sprint_km, coalesce(accel_count_high, 0) AS accel_count_high,
  coalesce(decel_count_high, 0) AS decel_count_high, CAST(round(CAST(n * 100e0 / frames AS DECIMAL(28, 9)), 2) AS DOUBLE) AS coverage_pct,
  det AS detected_frames, total AS total_frames,
  CASE WHEN pts >= 4 THEN 'High' WHEN pts >= 2 THEN 'Medium' ELSE 'Low' END AS injury_risk
FROM (SELECT b.*, st.* EXCLUDE (video_id, track_id), fast.hsr_km, fast.sprint_km,
        CASE WHEN km > 10 THEN 2 WHEN km > 7 THEN 1 ELSE 0 END
        + CASE WHEN (SELECT count(*) FROM sprint s2 WHERE s2.video_id = b.video_id AND s2.track_id = b.track_id) > 50 THEN 2
               WHEN (SELECT count(*) FROM sprint s2 WHERE s2.video_id = b.video_id AND s2.track_id = b.track_id) > 30 THEN 1 ELSE 0 END
        + CASE WHEN hsr_km > 1.5 THEN 2 WHEN hsr_km > 0.8 THEN 1 ELSE 0 END AS pts
      FROM base b JOIN st USING (video_id, track_id) JOIN fast USING (video_id, track_id)) b
JOIN top USING (video_id, track_id) LEFT JOIN hc USING (video_id, track_id) LEFT JOIN sc USING (video_id, track_id)
LEFT JOIN events_ USING (video_id, track_id) JOIN vf ON vf.v = b.video_id""")
def _(d):
    frames = d.fx_detections.groupBy("video_id").agg((F.max("frame") + 1).alias("total_frames"))
    return T.physical(d.fx_detections, FPS, frames)
