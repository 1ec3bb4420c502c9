from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import custom as X, identity as D, registry as R
from .registry import query, rnd

LOAD = ["minutes_played", "sprint_count"]
ROWS = """
mw AS (SELECT stat_id AS sid, max(value) FILTER (WHERE metric_key = 'minutes_played') AS minutes_played, max(value) FILTER (WHERE metric_key = 'sprint_count') AS sprint_count FROM fx_metrics GROUP BY stat_id),
r AS (SELECT player_id, distance_km, top_speed_mph, minutes_played, sprint_count FROM fx_stats LEFT JOIN mw ON sid = stat_id)"""

# a ratio, a guarded maximum, a sum, and a metric of metrics, by rows only
METRICS = [
    ("sprints_per_km", "ratio", "sprint_count", "distance_km", None, 1.0, 5.0, 3, 1),
    ("top_speed_full", "max", "top_speed_mph * 1.609344", None, "minutes_played >= 30", None, None, 2, 2),
    ("km_total", "sum", "distance_km", None, None, 1.0, None, 2, 3),
    ("speed_per_km", "derived", "top_speed_full / nullif(km_total, 0)", None, None, 100.0, None, 2, 4),
]


@query("metrics_from_table", "E1 A2", "WITH " + ROWS + f""",
g AS (SELECT player_id, CASE WHEN sum(distance_km) FILTER (WHERE sprint_count IS NOT NULL AND distance_km > 0) >= 5
    THEN sum(sprint_count) FILTER (WHERE sprint_count IS NOT NULL AND distance_km > 0) / sum(distance_km) FILTER (WHERE sprint_count IS NOT NULL AND distance_km > 0) END AS spk,
  max(top_speed_mph * 1.609344e0) FILTER (WHERE minutes_played >= 30) AS tsf, sum(distance_km) AS km FROM r GROUP BY player_id)
SELECT player_id, {rnd('spk', 3)} AS sprints_per_km, {rnd('tsf', 2)} AS top_speed_full, {rnd('km', 2)} AS km_total, {rnd('tsf / nullif(km, 0) * 100', 2)} AS speed_per_km FROM g""")
def _(d):
    registry = d.spark.createDataFrame(METRICS, X.REGISTRY)
    return X.aggregate(R.widen(d.fx_stats, d.fx_metrics, LOAD), ["player_id"], registry)


@query("unknown_key_warnings", "A34", """
WITH m AS (SELECT video_id, CASE WHEN stat_id % 5 = 0 AND metric_key = 'hsr_count' THEN 'xg_' || CAST(stat_id % 3 AS STRING) ELSE metric_key END AS k FROM fx_metrics JOIN fx_stats USING (stat_id))
SELECT video_id, 'unknown metric keys left out: ' || string_agg(DISTINCT k, ', ' ORDER BY k) AS warning FROM m WHERE k LIKE 'xg%' AND video_id IS NOT NULL GROUP BY video_id""")
def _(d):
    m = d.fx_metrics.join(d.fx_stats.select("stat_id", "video_id"), "stat_id").where("video_id is not null")
    odd = (F.col("stat_id") % 5 == 0) & (F.col("metric_key") == "hsr_count")
    m = m.withColumn("metric_key", F.when(odd, F.concat(F.lit("xg_"), (F.col("stat_id") % 3).cast("string"))).otherwise(F.col("metric_key")))
    return D.unknown_key_warnings(m)
