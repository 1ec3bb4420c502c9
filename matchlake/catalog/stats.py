from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import numbers as N
from ..operators import heatmap as H, registry as R, stats as S
from ..plans.ranking import ordinal_position
from .registry import query, rnd

RANK = "CASE injury_risk WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END"
UNRANK = "CASE {} WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END"


def wide_sql(keys) -> str:
    cols = ", ".join(f"max(value) FILTER (WHERE metric_key = '{k}') AS {k}" for k in keys)
    return f"""
wide AS (SELECT s.*, m.* EXCLUDE (sid) FROM fx_stats s LEFT JOIN (SELECT stat_id AS sid, {cols} FROM fx_metrics GROUP BY stat_id) m
  ON m.sid = s.stat_id)"""


USED = ["minutes_played", "visible_minutes", "sprint_count", "hsr_count", "hsr_distance_km", "coverage_pct", "distance_per_min"]
WIDE = "WITH " + wide_sql(USED)
RATIO = """CASE WHEN count(*) = 1 AND max(distance_per_min) IS NOT NULL THEN
    CASE WHEN max(coalesce(visible_minutes, minutes_played)) IS NOT NULL AND (max(den) IS NULL OR max(den) < 0.1) THEN NULL
         ELSE max(distance_per_min) END
  WHEN sum(den) FILTER (WHERE distance_km IS NOT NULL) >= 0.1
    THEN sum(distance_km) FILTER (WHERE den IS NOT NULL) * 1000 / sum(den) FILTER (WHERE distance_km IS NOT NULL) END"""
DEN = "(SELECT *, CASE WHEN visible_minutes > 0 THEN visible_minutes WHEN minutes_played > 0 THEN minutes_played END AS den FROM wide)"
AGG = f"""{rnd('sum(distance_km)', 2)} AS distance_km, {rnd('max(top_speed_mph)', 1)} AS top_speed_mph,
  {rnd(RATIO, 0)} AS distance_per_min, {rnd('sum(minutes_played)', 2)} AS minutes_played,
  {rnd('sum(visible_minutes)', 2)} AS visible_minutes, {rnd('avg(coverage_pct)', 0)} AS coverage_pct,
  {rnd('sum(hsr_distance_km)', 2)} AS hsr_distance_km, CAST(round(sum(hsr_count)) AS BIGINT) AS hsr_count,
  CAST(round(sum(sprint_count)) AS BIGINT) AS sprint_count"""
AGG_KEYS = ["distance_km", "top_speed_mph", "distance_per_min", "minutes_played", "visible_minutes", "coverage_pct",
            "hsr_distance_km", "hsr_count", "sprint_count"]


@query("player_stats", "A1 J1 J17", f"""
SELECT p.player_id, concat(first_name, ' ', last_name) AS name, jersey, {rnd('max(top_speed_mph)', 2)} AS top_speed_mph,
  {rnd('sum(distance_km)', 3)} AS distance_km, {UNRANK.format(f'max({RANK})')} AS injury_risk
FROM fx_stats s JOIN fx_players p ON p.player_id = s.player_id GROUP BY p.player_id, first_name, last_name, jersey""")
def _(d):
    return S.player_stats(d.fx_stats, d.fx_players)


@query("player_stats_scoped", "P1 A1", f"""
SELECT p.player_id, concat(first_name, ' ', last_name) AS name, jersey, {rnd('max(top_speed_mph)', 2)} AS top_speed_mph,
  {rnd('sum(distance_km)', 3)} AS distance_km, {UNRANK.format(f'max({RANK})')} AS injury_risk
FROM fx_stats s JOIN fx_players p ON p.player_id = s.player_id WHERE team_id = 7 GROUP BY p.player_id, first_name, last_name, jersey""")
def _(d):
    return S.player_stats(d.fx_stats, d.fx_players, team_id=7)


@query("players_without_data", "J17", """
SELECT player_id, 'no_data' AS score_status FROM fx_players WHERE player_id NOT IN (SELECT player_id FROM fx_stats)""")
def _(d):
    return d.fx_players.join(d.fx_stats, "player_id", "left_anti").select("player_id", F.lit("no_data").alias("score_status"))


@query("widened_metrics", "S10", WIDE + "SELECT stat_id, distance_km, top_speed_mph, " + ", ".join(USED) + " FROM wide")
def _(d):
    return R.widen(d.fx_stats, d.fx_metrics).select("stat_id", "distance_km", "top_speed_mph", *USED)


@query("registry_aggregate", "A2 A3 A4 A31", WIDE + f"SELECT player_id, {AGG} FROM {DEN} GROUP BY player_id")
def _(d):
    wide = R.widen(d.fx_stats, d.fx_metrics)
    return wide.groupBy("player_id").agg(*R.aggregate_columns(AGG_KEYS))


@query("registry_aggregate_single", "A4", WIDE + f"""
SELECT stat_id, {AGG} FROM {DEN} GROUP BY stat_id""")
def _(d):
    return R.widen(d.fx_stats, d.fx_metrics).groupBy("stat_id").agg(*R.aggregate_columns(AGG_KEYS))


@query("flat_player_stats", "X30 X11 A2", WIDE + f"""
SELECT player_id, distance_km, injury_risk, {rnd(rnd('mph', 2) + f' * {C.KMH_PER_MPH}e0', 2)} AS top_speed_kmh,
  {rnd(rnd('km', 3) + ' * 1000', 2)} AS distance_covered_meters,
  CASE injury_risk WHEN 'High' THEN 100e0 WHEN 'Medium' THEN 50e0 ELSE 0e0 END AS fatigue_risk_score, TRUE AS no_zones,
  TRUE AS no_position
FROM (SELECT player_id, {rnd('sum(distance_km)', 2)} AS distance_km, max(top_speed_mph) AS mph, sum(distance_km) AS km,
  {UNRANK.format(f'max({RANK})')} AS injury_risk FROM wide GROUP BY player_id)""")
def _(d):
    out = S.flat_player_stats(d.fx_stats, d.fx_metrics, d.fx_players)
    return out.select(
        "player_id", "distance_km", "injury_risk", "top_speed_kmh", "distance_covered_meters", "fatigue_risk_score",
        F.col("speed_zones").isNull().alias("no_zones"), F.col("avg_position").isNull().alias("no_position"),
    )


MIN_P = "CASE WHEN minutes_played_s >= 0 THEN minutes_played_s / 60 ELSE minutes_played END"
MIN_V = "CASE WHEN visible_minutes_s >= 0 THEN visible_minutes_s / 60 ELSE visible_minutes END"


@query("fragment_merge", "A5 A6 A7 A8 A9 X14 P8", f"""
WITH f AS (SELECT *, {MIN_P} AS mp0, {MIN_V} AS mv0, coalesce(visible_minutes, 1) AS w,
    CASE WHEN distance_km IS NOT NULL THEN coalesce(CASE WHEN distance_m >= 0 THEN distance_m / 1000 END, distance_km) END AS rk,
    avg_pitch_x IS NOT NULL AND avg_pitch_y IS NOT NULL AS placed FROM fx_fragments),
g AS (SELECT player_id, video_id, count(*) AS tracks, max(top_speed_mph) AS mph, sum(distance_km) AS km, max({RANK}) AS rank,
    sum(CASE WHEN mp0 >= 0 THEN mp0 END) AS played, sum(CASE WHEN mv0 >= 0 THEN mv0 END) AS visible, sum(rk) AS rate_km,
    sum(coverage_pct) AS cov, max(top_speed_kmh) AS kmh, max(distance_per_min_m) AS stored, max(clip_minutes) AS clip,
    CASE WHEN sum(w) FILTER (WHERE placed) > 0 THEN sum(avg_pitch_x * w) FILTER (WHERE placed) / sum(w) FILTER (WHERE placed)
      ELSE avg(avg_pitch_x) FILTER (WHERE placed) END AS ax,
    CASE WHEN sum(w) FILTER (WHERE placed) > 0 THEN sum(avg_pitch_y * w) FILTER (WHERE placed) / sum(w) FILTER (WHERE placed)
      ELSE avg(avg_pitch_y) FILTER (WHERE placed) END AS ay,
    CAST(sum(hsr_count) AS BIGINT) AS hsr_count, CAST(sum(sprint_count) AS BIGINT) AS sprint_count,
    CAST(sum(coalesce(hi_efforts_count, hsr_count + sprint_count)) AS BIGINT) AS high_intensity_efforts
  FROM f GROUP BY player_id, video_id),
h AS (SELECT *, CASE WHEN played IS NULL THEN NULL WHEN clip IS NULL THEN played ELSE least(played, clip) END AS p2,
    CASE WHEN visible IS NULL THEN NULL WHEN clip IS NULL THEN visible ELSE least(visible, clip) END AS v2 FROM g)
SELECT player_id, video_id, tracks, {rnd('mph', 2)} AS top_speed_mph, {rnd('km', 3)} AS distance_km,
  {UNRANK.format('rank')} AS injury_risk, {rnd('p2', 3)} AS minutes_played, {rnd('v2', 3)} AS visible_minutes,
  {rnd('CASE WHEN cov IS NULL THEN NULL ELSE least(cov, 100) END', 2)} AS coverage_pct,
  {rnd('CASE WHEN coalesce(v2, p2) >= 0.1 THEN coalesce(CASE WHEN tracks = 1 THEN stored END, coalesce(rate_km, km) * 1000 / coalesce(v2, p2)) END', 2)} AS distance_per_min,
  coalesce({rnd('kmh', 2)}, {rnd('mph * 1.60934e0', 2)}) AS top_speed_kmh, {rnd('ax', 2)} AS avg_pitch_x, {rnd('ay', 2)} AS avg_pitch_y,
  hsr_count, sprint_count, high_intensity_efforts FROM h""")
def _(d):
    return S.merged_fragments(d.fx_fragments).drop(*S.SUMMED)


@query("registry_merge", "A5", """
SELECT player_id, max(top_speed_mph) AS top_speed_mph, round(sum(distance_km), 6) AS distance_km,
  round(sum(coverage_pct), 6) AS coverage_pct, CAST(sum(hsr_count) AS BIGINT) AS hsr_count
FROM fx_fragments GROUP BY player_id""")
def _(d):
    out = d.fx_fragments.groupBy("player_id").agg(*R.merge_columns(["top_speed_mph", "distance_km", "coverage_pct", "hsr_count"]))
    return out.withColumns({c: F.round(c, 6) for c in ("distance_km", "coverage_pct")})


@query("frame_heatmap", "A14", """
SELECT video_id, track_id, CAST(greatest(0, least(13, trunc(y / 68e0 * 14))) AS BIGINT) AS cell_row,
  CAST(greatest(0, least(20, trunc(x / 105e0 * 21))) AS BIGINT) AS cell_col, count(*) / 10e0 AS seconds
FROM fx_jumpy GROUP BY ALL""")
def _(d):
    return H.frame_heatmap(d.fx_jumpy, ["video_id", "track_id"], 10.0)


@query("sample_heatmap", "A15 P7", """
WITH near AS (SELECT video_id, track_id, least(greatest(x - 8, 0e0), 105e0) AS x, least(greatest(y, 0e0), 68e0) AS y FROM fx_jumpy
  WHERE x - 8 BETWEEN -5 AND 110 AND y BETWEEN -5 AND 73)
SELECT video_id, track_id, CAST(least(7, trunc(y / 68e0 * 8)) AS BIGINT) AS cell_row,
  CAST(least(11, trunc(x / 105e0 * 12)) AS BIGINT) AS cell_col, count(*) AS samples FROM near GROUP BY ALL""")
def _(d):
    cells, _summary = H.sample_heatmap(d.fx_jumpy.withColumn("x", F.col("x") - 8), ["video_id", "track_id"])
    return cells


@query("sample_heatmap_summary", "A15", """
WITH near AS (SELECT video_id, track_id, least(greatest(x - 8, 0e0), 105e0) AS x, least(greatest(y, 0e0), 68e0) AS y FROM fx_jumpy
  WHERE x - 8 BETWEEN -5 AND 110 AND y BETWEEN -5 AND 73)
SELECT video_id, track_id, count(*) AS samples, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM near GROUP BY ALL""")
def _(d):
    _cells, out = H.sample_heatmap(d.fx_jumpy.withColumn("x", F.col("x") - 8), ["video_id", "track_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_x", "mean_y")})


@query("grid_sum", "A16", """
SELECT player_id, grid_cols, grid_rows, cell_row, cell_col, sum(value) AS value FROM fx_cells GROUP BY ALL""")
def _(d):
    return H.sum_grids(d.fx_cells, ["player_id", "grid_cols", "grid_rows"])


@query("combined_heatmap", "A17", """
WITH g AS (SELECT player_id, grid_cols, grid_rows, source, cell_unit, CAST(sum(samples) AS BIGINT) AS samples, count(*) AS used
  FROM fx_heatmaps GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY samples DESC, source = 'pipeline' DESC) AS rn,
  CAST(sum(used) OVER (PARTITION BY player_id) AS BIGINT) AS total FROM g)
SELECT player_id, grid_cols, grid_rows, source, cell_unit, samples, used, total - used AS skipped FROM r WHERE rn = 1""")
def _(d):
    return H.combine(d.fx_heatmaps, ["player_id"])


@query("combined_heatmap_cells", "A17 A16 X16", """
WITH g AS (SELECT player_id, grid_cols, grid_rows, source, cell_unit, sum(samples) AS samples FROM fx_heatmaps GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY samples DESC, source = 'pipeline' DESC) AS rn FROM g),
c AS (SELECT c.player_id, c.cell_row, c.cell_col, sum(value) AS value FROM fx_cells c JOIN r ON r.rn = 1 AND r.player_id = c.player_id
  AND r.grid_cols = c.grid_cols AND r.grid_rows = c.grid_rows AND r.source = c.source AND r.cell_unit = c.cell_unit GROUP BY ALL)
SELECT *, CASE WHEN max(value) OVER (PARTITION BY player_id) > 0 THEN round(value / max(value) OVER (PARTITION BY player_id), 3)
  ELSE 0e0 END AS share FROM c""")
def _(d):
    cells = H.combined_cells(d.fx_heatmaps, d.fx_cells, ["player_id"]).drop("grid_cols", "grid_rows")
    return H.peak_normalised(cells, ["player_id"])


@query("squad_heatmap", "A18", """
WITH h AS (SELECT *, player_id % 25 AS team_id FROM fx_heatmaps),
f AS (SELECT team_id, grid_cols, grid_rows FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY stat_id) AS rn FROM h) WHERE rn = 1),
c AS (SELECT c.*, f.team_id FROM fx_cells c JOIN f ON f.team_id = c.player_id % 25 AND f.grid_cols = c.grid_cols AND f.grid_rows = c.grid_rows),
s AS (SELECT *, round(value / max(value) OVER (PARTITION BY stat_id), 3) AS share FROM c),
t AS (SELECT team_id, grid_cols, grid_rows, cell_row, cell_col, sum(share) AS value FROM s GROUP BY ALL)
SELECT team_id, grid_cols, grid_rows, cell_row, cell_col, round(value, 6) AS value,
  round(round(value / max(value) OVER (PARTITION BY team_id), 9), 3) AS share FROM t""")
def _(d):
    h = d.fx_heatmaps.withColumn("team_id", F.col("player_id") % 25)
    c = d.fx_cells.withColumn("team_id", F.col("player_id") % 25)
    out = H.squad_heatmap(h, c, "team_id", "stat_id")
    return out.withColumn("value", F.round("value", 6))


@query("modal_grid_shape", "A19", """
WITH g AS (SELECT player_id % 25 AS team_id, grid_cols, grid_rows, count(*) AS n FROM fx_heatmaps GROUP BY ALL)
SELECT team_id, grid_cols, grid_rows, n FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY n DESC, grid_cols DESC) AS rn FROM g)
WHERE rn = 1""")
def _(d):
    return H.modal_shape(d.fx_heatmaps.withColumn("team_id", F.col("player_id") % 25), ["team_id"])


@query("weighted_position", "A10", """
SELECT player_id, round(sum(mean_x * samples) / sum(samples), 6) AS x, round(sum(mean_y * samples) / sum(samples), 6) AS y,
  CAST(sum(samples) AS BIGINT) AS samples FROM fx_heatmaps GROUP BY player_id""")
def _(d):
    return H.weighted_position(d.fx_heatmaps, ["player_id"]).withColumns({c: F.round(c, 6) for c in "xy"})


@query("grid_validity", "X17", """
SELECT stat_id, CASE WHEN stat_id % 4 = 1 THEN NULL ELSE grid_cols END AS cols,
  CASE WHEN stat_id % 4 = 1 THEN NULL ELSE grid_rows END AS rows FROM fx_heatmaps""")
def _(d):
    # dense arrays built from the sparse shape; one in four gets a ragged row
    h = d.fx_heatmaps.withColumn(
        "grid",
        F.transform(
            F.sequence(F.lit(1), F.col("grid_rows")),
            lambda r: F.transform(
                F.sequence(
                    F.lit(1),
                    F.when((F.col("stat_id") % 4 == 1) & (r == 2), F.col("grid_cols") + 1).otherwise(F.col("grid_cols")),
                ),
                lambda c: (r * c).cast("double"),
            ),
        ),
    )
    return h.select("stat_id", H.valid_grid(F.col("grid")).alias("g")).select("stat_id", "g.cols", "g.rows")


@query("dense_grid_round_trip", "A16", """
SELECT player_id, grid_cols, cell_row, cell_col, sum(value) AS value FROM fx_cells GROUP BY ALL HAVING sum(value) > 0""")
def _(d):
    # two shapes of grid; the larger one holds both
    keys = ["player_id", "grid_cols"]
    cells = H.sum_grids(d.fx_cells, keys)
    back = H.sparse_grid(H.dense_grid(cells, keys, 21, 21), keys)
    return back.where("value > 0").select("player_id", "grid_cols", F.col("cell_row").cast("bigint"), F.col("cell_col").cast("bigint"), "value")


@query("squad_summary", "A27 A29", f"""
SELECT match_id, count(*) AS players, {rnd('avg(distance_km)', 4)} AS avg_distance_km, {rnd('sum(distance_km)', 3)} AS total_distance_km,
  max(top_speed_mph) AS max_speed_mph, arg_max(player_id, (top_speed_mph, -player_id)) FILTER (WHERE top_speed_mph IS NOT NULL) AS fastest_player,
  arg_max(player_id, (distance_km, -player_id)) FILTER (WHERE distance_km IS NOT NULL) AS longest_player,
  count(*) FILTER (WHERE coverage_pct < 60) AS low_coverage, count(*) FILTER (WHERE distance_km IS NULL) AS missing,
  count(*) FILTER (WHERE injury_risk = 'Low') AS risk_low, count(*) FILTER (WHERE injury_risk = 'Medium') AS risk_medium,
  count(*) FILTER (WHERE injury_risk = 'High') AS risk_high
FROM (SELECT match_id, player_id, max(top_speed_mph) AS top_speed_mph, sum(distance_km) AS distance_km, avg(coverage_pct) AS coverage_pct,
   {UNRANK.format(f'max({RANK})')} AS injury_risk FROM (SELECT s.*, m.value AS coverage_pct FROM fx_stats s LEFT JOIN
     (SELECT * FROM fx_metrics WHERE metric_key = 'coverage_pct') m ON m.stat_id = s.stat_id) GROUP BY match_id, player_id)
GROUP BY match_id""")
def _(d):
    wide = R.widen(d.fx_stats, d.fx_metrics, ["coverage_pct"])
    rows = wide.groupBy("match_id", "player_id").agg(
        F.max("top_speed_mph").alias("top_speed_mph"), N.steady_sum("distance_km").alias("distance_km"),
        F.avg("coverage_pct").alias("coverage_pct"), N.rank_risk(F.max(N.risk_rank(F.col("injury_risk")))).alias("injury_risk"),
    )
    return S.squad_summary(rows, ["match_id"])


@query("player_vs_squad", "A37", """
SELECT stat_id, match_id, round(distance_km - avg(distance_km) OVER m, 6) AS distance_vs_squad, round(avg(distance_km) OVER m, 6) AS squad_avg,
  count(distance_km) OVER m AS squad_n FROM fx_stats WINDOW m AS (PARTITION BY match_id)""")
def _(d):
    s = d.fx_stats.select("stat_id", "match_id", "distance_km")
    squad = s.groupBy("match_id").agg(F.avg("distance_km").alias("squad_avg"), F.count("distance_km").alias("squad_n"))
    return s.join(squad, "match_id").select(
        "stat_id", "match_id", F.round(F.col("distance_km") - F.col("squad_avg"), 6).alias("distance_vs_squad"),
        F.round("squad_avg", 6).alias("squad_avg"), "squad_n",
    )


@query("metric_rank", "W28", """
WITH p AS (SELECT player_id % 25 AS team_id, player_id, round(sum(distance_km), 6) AS distance_km FROM fx_stats GROUP BY ALL)
SELECT *, CASE WHEN distance_km IS NOT NULL THEN row_number() OVER (PARTITION BY team_id ORDER BY distance_km DESC NULLS LAST, player_id) END AS rank
FROM p""")
def _(d):
    p = d.fx_stats.groupBy((F.col("player_id") % 25).alias("team_id"), "player_id").agg(
        F.round(F.sum("distance_km"), 6).alias("distance_km")
    )
    return S.ranked(p, ["team_id"], "distance_km")


@query("top_five", "K2", """
SELECT player_id, round(sum(distance_km), 6) AS distance_km FROM fx_stats GROUP BY player_id
ORDER BY distance_km DESC NULLS LAST, player_id LIMIT 5""")
def _(d):
    p = d.fx_stats.groupBy("player_id").agg(F.round(F.sum("distance_km"), 6).alias("distance_km"))
    return p.orderBy(F.desc_nulls_last("distance_km"), "player_id").limit(5)


@query("top_five_per_team", "K2", """
SELECT team_id, player_id, distance_km, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY distance_km DESC, player_id) AS rank
  FROM (SELECT player_id % 25 AS team_id, player_id, round(sum(distance_km), 6) AS distance_km FROM fx_stats GROUP BY ALL)
  WHERE distance_km IS NOT NULL) WHERE rank <= 5""")
def _(d):
    from pyspark.sql import Window as W

    p = d.fx_stats.groupBy((F.col("player_id") % 25).alias("team_id"), "player_id").agg(
        F.round(F.sum("distance_km"), 6).alias("distance_km")
    )
    w = W.partitionBy("team_id").orderBy(F.desc("distance_km"), "player_id")
    # a top-k filter on row_number is cut to k rows per task before the shuffle
    return p.where("distance_km is not null").withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 5")


@query("nulls_last_sort", "K1", """
SELECT stat_id, row_number() OVER (ORDER BY CASE injury_risk WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC,
  distance_km DESC NULLS LAST, stat_id) - 1 AS place FROM fx_stats""")
def _(d):
    s = d.fx_stats.select("stat_id", "distance_km", N.risk_rank(F.col("injury_risk")).alias("rank"))
    order = [F.desc("rank"), F.desc_nulls_last("distance_km"), F.asc("stat_id")]
    return ordinal_position(s, [], order, out="place").select("stat_id", "place")


@query("jersey_override", "J14", """
SELECT v.video_id, player_id, CASE WHEN v.video_id % 3 = 0 THEN CASE WHEN v.video_id % 2 = 0 THEN NULL ELSE player_id % 99 END
  ELSE jersey END AS jersey FROM (SELECT s.video_id, s.player_id, jersey FROM fx_stats s JOIN fx_players p ON p.player_id = s.player_id
  WHERE s.video_id IS NOT NULL) v""")
def _(d):
    rows = d.fx_stats.where("video_id is not null").select("video_id", "player_id").join(
        d.fx_players.select("player_id", "jersey"), "player_id"
    )
    overrides = d.fx_stats.where("video_id % 3 = 0").select(
        "video_id", "player_id", F.when(F.col("video_id") % 2 != 0, F.col("player_id") % 99).alias("jersey")
    )
    return S.with_jersey_override(rows, overrides)


_VIDEO_THRESHOLDS = """
WITH v AS (SELECT video_id, CASE WHEN video_id % 10 = 0 THEN 'club' END AS preset, hsr_kmh, sprint_kmh,
  CASE WHEN video_id % 10 = 0 THEN 6.5e0 END AS w, CASE WHEN video_id % 10 = 0 THEN 14.25e0 END AS j,
  CASE WHEN video_id % 20 = 0 THEN 20e0 END AS r, CASE WHEN video_id % 20 = 0 THEN 25e0 END AS h FROM fx_videos)
SELECT video_id, coalesce(preset, 'gps_standard') AS preset, round(coalesce(hsr_kmh, 19.8e0), 1) AS hsr_kmh,
  round(coalesce(sprint_kmh, 25.3e0), 1) AS sprint_kmh, CAST(round(CAST(coalesce(w, 7e0) AS DECIMAL(28, 9)), 1) AS DOUBLE) AS edge_walk, CAST(round(CAST(coalesce(j, 15e0) AS DECIMAL(28, 9)), 1) AS DOUBLE) AS edge_jog,
  round(coalesce(r, 19.8e0), 1) AS edge_run, round(coalesce(h, 25.3e0), 1) AS edge_hsr,
  CASE WHEN n = 7 THEN 'pipeline' WHEN n = 0 THEN 'default' ELSE 'mixed' END AS source
FROM (SELECT *, (preset IS NOT NULL)::INT + (hsr_kmh IS NOT NULL)::INT + (sprint_kmh IS NOT NULL)::INT + (w IS NOT NULL)::INT
  + (j IS NOT NULL)::INT + (r IS NOT NULL)::INT + (h IS NOT NULL)::INT AS n FROM v)"""


def video_settings(d):
    """Presets and zone edges that some videos bring along."""
    ten, twenty = F.col("video_id") % 10 == 0, F.col("video_id") % 20 == 0
    return d.fx_videos.select(
        "video_id", F.when(ten, "club").alias("preset"), F.col("hsr_kmh").cast("double"), F.col("sprint_kmh").cast("double"),
        F.when(ten, 6.5).alias("edge_walk"), F.when(ten, 14.25).alias("edge_jog"),
        F.when(twenty, 20.0).alias("edge_run"), F.when(twenty, 25.0).alias("edge_hsr"),
    )


@query("video_thresholds", "A32 J22", _VIDEO_THRESHOLDS)
def _(d):
    return video_settings(d).select("video_id", *S.thresholds())


@query("stat_thresholds", "J22", f"""
WITH t AS ({_VIDEO_THRESHOLDS})
SELECT stat_id, player_id, s.video_id, distance_km, coalesce(preset, 'gps_standard') AS preset, coalesce(hsr_kmh, 19.8e0) AS hsr_kmh, coalesce(sprint_kmh, 25.3e0) AS sprint_kmh,
  coalesce(edge_walk, 7e0) AS edge_walk, coalesce(edge_jog, 15e0) AS edge_jog, coalesce(edge_run, 19.8e0) AS edge_run, coalesce(edge_hsr, 25.3e0) AS edge_hsr, coalesce(source, 'default') AS source
FROM fx_stats s LEFT JOIN t ON t.video_id = s.video_id""")
def _(d):
    return S.with_thresholds(d.fx_stats.select("stat_id", "player_id", "video_id", "distance_km"), video_settings(d))


@query("unit_conversions", "X11 X12 X14 X15", f"""
SELECT stat_id, {rnd('top_speed_mph * 1.609344e0', 2)} AS kmh, {rnd('distance_km * 1000', 2)} AS metres, score,
  CASE WHEN score <= 25 THEN 'Low' WHEN score <= 75 THEN 'Medium' WHEN score IS NOT NULL THEN 'High' END AS label,
  greatest(0e0, least(100e0, score)) AS pct, {rnd('CASE WHEN m >= 0.1 THEN distance_km * 1000 / m END', 4)} AS per_min
FROM (SELECT s.*, CASE injury_risk WHEN 'High' THEN 100e0 WHEN 'Medium' THEN 50e0 ELSE 0e0 END AS score, m.value AS m FROM fx_stats s
  LEFT JOIN (SELECT * FROM fx_metrics WHERE metric_key = 'minutes_played') m ON m.stat_id = s.stat_id)""")
def _(d):
    wide = R.widen(d.fx_stats, d.fx_metrics, ["minutes_played"])
    score = N.fatigue_score(F.col("injury_risk"))
    return wide.select(
        "stat_id", N.kmh_from_mph(F.col("top_speed_mph")).alias("kmh"), N.metres_from_km(F.col("distance_km")).alias("metres"),
        score.alias("score"), N.fatigue_label(score).alias("label"), N.fatigue_percent(score).alias("pct"),
        N.stable_round(N.distance_per_minute(F.col("distance_km"), F.col("minutes_played")), 4).alias("per_min"),
    )


@query("registry_upsert", "S14", """
WITH old AS (SELECT DISTINCT metric_key, length(metric_key) % 2 AS decimals FROM fx_metrics),
new AS (SELECT DISTINCT metric_key, CAST(1 AS BIGINT) AS decimals FROM fx_metrics WHERE metric_key <> 'coverage_pct'
        UNION ALL SELECT DISTINCT concat('extra_', injury_risk) AS metric_key, CAST(2 AS BIGINT) AS decimals FROM fx_stats)
SELECT coalesce(n.metric_key, o.metric_key) AS metric_key, CAST(CASE WHEN n.metric_key IS NULL THEN o.decimals ELSE n.decimals END AS BIGINT) AS decimals,
  CASE WHEN o.metric_key IS NULL THEN 'inserted' WHEN n.metric_key IS NULL OR o.decimals IS NOT DISTINCT FROM n.decimals THEN 'kept'
       ELSE 'changed' END AS change
FROM old o FULL OUTER JOIN new n ON n.metric_key = o.metric_key""")
def _(d):
    old = d.fx_metrics.select("metric_key").distinct().withColumn("decimals", (F.length("metric_key") % 2).cast("bigint"))
    new = d.fx_metrics.where("metric_key <> 'coverage_pct'").select("metric_key").distinct().withColumn("decimals", F.lit(1).cast("bigint"))
    extra = d.fx_stats.select(F.concat(F.lit("extra_"), "injury_risk").alias("metric_key")).distinct()
    return R.upsert(old, new.unionByName(extra.withColumn("decimals", F.lit(2).cast("bigint"))), "metric_key")


@query("alias_report", "E1 U8", """
SELECT part_id, track_id, CAST(hsr_count AS BIGINT) AS hsr_count, CAST(hi_efforts_count AS BIGINT) AS high_intensity_efforts,
  'clip_minutes,part_id,video_id' AS unknown_keys FROM fx_fragments""")
def _(d):
    unknown = R.unknown_numeric_keys(d.fx_fragments)
    return R.rename_aliases(d.fx_fragments).select(
        "part_id", "track_id", "hsr_count", "high_intensity_efforts", F.lit(",".join(unknown)).alias("unknown_keys")
    )


@query("metric_group_status", "E2", """
WITH av AS (SELECT metric_key, CASE WHEN count(value) < 0.9 * count(*) THEN 'soon' ELSE 'ready' END AS availability FROM fx_metrics GROUP BY metric_key),
g AS (SELECT metric_key, CASE WHEN metric_key LIKE '%minutes%' OR metric_key = 'coverage_pct' THEN 'coverage' WHEN metric_key = 'distance_per_min' THEN 'physical'
  ELSE 'intensity' END AS category, 'launch' AS status FROM av
  UNION ALL SELECT metric_key, 'by hand', 'manual' FROM av UNION ALL SELECT concat('other_', metric_key), 'unknown', 'next' FROM av
  UNION ALL SELECT metric_key, concat('only ', metric_key), 'launch' FROM av)
SELECT category, CASE WHEN max(g.status) = 'manual' OR count(availability) = 0 THEN max(g.status) WHEN bool_and(availability = 'ready') THEN 'launch' ELSE 'next' END AS status
FROM g LEFT JOIN av ON av.metric_key = g.metric_key GROUP BY category""")
def _(d):
    # a key is available where nine of ten of its stored values are there; groups are the registry's, one kept by hand, one unknown, one per key
    few = F.count("value") < 0.9 * F.count(F.lit(1))
    available = d.fx_metrics.groupBy("metric_key").agg(F.when(few, "soon").otherwise("ready").alias("availability"))
    keys = available.select("metric_key")
    reg = F.broadcast(R.registry_frame(d.spark).select("metric_key", "category"))  # 21 fixed rows
    own = lambda key, name, status: keys.select(key.alias("metric_key"), name.alias("category"), F.lit(status).alias("status"))
    k = F.col("metric_key")
    groups = keys.join(reg, "metric_key").select("metric_key", "category", F.lit("launch").alias("status"))
    groups = groups.unionByName(own(k, F.lit("by hand"), "manual")).unionByName(own(F.concat(F.lit("other_"), k), F.lit("unknown"), "next"))
    return R.group_status(groups.unionByName(own(k, F.concat(F.lit("only "), k), "launch")), available, ["category"])
