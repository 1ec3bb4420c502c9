"""Sports-shaped views over the supplied tables.

Each view has one SQL text, used as a common table expression by the oracle and (except for the per-track scans, which
need the block-wise position) by Spark as well. Only integer arithmetic and exact doubles are used, so both engines
give the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .plans.blocked import crowded, with_position

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

#: Rows of the larger side that one task of a join takes.
TASK_ROWS = 400_000


def idiv(a: str, b: int) -> str:
    """Integer division of a non-negative number, spelled the same in both dialects."""
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


_TEAM = "(o_custkey % 25)"
_MONTH = "((year(o_orderdate) - 1995) * 12 + month(o_orderdate))"

# columns computed from (track_id, frame, event_id, event_type), shared by both engines
_DETECTION_COLUMNS = f"""
    video_id, track_id, frame, CAST(frame AS DOUBLE) / 10 AS t, event_id, event_type,
    CAST(10500 - abs(pos_cm % 21000 - 10500) AS DOUBLE) / 100 AS x,
    CAST(34 + (track_id % 13 - 6) * 5 AS DOUBLE) AS y,
    event_type <> 'signup' AS is_detected,
    CAST(30 + event_id * 37 % 70 AS DOUBLE) / 100 AS confidence,
    CAST(track_id % 23 + 1 AS BIGINT) AS true_jersey,
    CASE WHEN event_type = 'error' THEN NULL
         ELSE CAST(track_id % 23 + 1 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) END AS jersey,
    CASE WHEN event_id % 9 = 0 THEN 1 - track_id % 2 ELSE track_id % 2 END AS team,
    CASE WHEN track_id % 50 = 49 THEN 'referee' WHEN track_id % 25 = 0 THEN 'goalkeeper' ELSE 'player' END AS role,
    CAST(200 + (track_id * 37 + frame * 3) % 1500 AS DOUBLE) AS cx,
    CAST(150 + (track_id * 53 + frame * 2) % 800 AS DOUBLE) AS cy"""

VIEWS: dict[str, str] = {
    # per-frame detections of many tracks; 20 tracks form one video
    "fx_detections": f"""
SELECT {_DETECTION_COLUMNS}
FROM (
  SELECT *, sum(step_cm) OVER (PARTITION BY track_id ORDER BY frame) AS pos_cm
  FROM (
    SELECT *, CASE (track_id * 7 + {idiv('frame', 15)} * 13) % 5
                WHEN 0 THEN 5 WHEN 1 THEN 20 WHEN 2 THEN 45 WHEN 3 THEN 65 ELSE 85 END AS step_cm
    FROM (
      SELECT {idiv('user_id', 20)} AS video_id, user_id AS track_id, event_id, event_type,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame
      FROM {{events}})))""",
    # the same with one position in 37 thrown 15 m away: exercises the outlier gate
    "fx_jumpy": """
SELECT video_id, track_id, frame, t, CASE WHEN event_id % 37 = 0 THEN x + 15 ELSE x END AS x, y, is_detected
FROM {fx_detections}""",
    # one followed player per track: box is null when lost
    "fx_frames": """
SELECT video_id, track_id, frame AS f, t,
       CASE WHEN event_type = 'error' THEN 'lost' WHEN event_type = 'signup' THEN 'occluded' ELSE 'tracked' END AS state,
       CASE WHEN event_type <> 'error' THEN (cx - 20) / 1920 END AS bx,
       CASE WHEN event_type <> 'error' THEN (cy - 45) / 1080 END AS bt,
       confidence AS conf, cx, cy
FROM {fx_detections}""",
    # detections with missing frames
    "fx_gaps": """
SELECT video_id, track_id, frame, t, cx, cy, x, y, confidence FROM {fx_detections} WHERE event_type <> 'error'""",
    # broken track fragments of 20 frames, every fifth one dropped
    "fx_tracklets": f"""
SELECT video_id, track_id * 100000 + {idiv('frame', 20)} AS track_id,
       CAST(min(frame) AS BIGINT) AS first_frame, CAST(max(frame) AS BIGINT) AS last_frame,
       min_by(x, frame) AS first_x, min_by(y, frame) AS first_y, min(t) AS first_t,
       max_by(x, frame) AS last_x, max_by(y, frame) AS last_y, max(t) AS last_t,
       CASE WHEN {idiv('frame', 20)} % 3 = 2 THEN NULL ELSE CAST(min(track_id % 2) AS BIGINT) END AS team,
       CASE WHEN {idiv('frame', 20)} % 2 = 1 THEN NULL ELSE min(true_jersey) END AS jersey
FROM {{fx_detections}}
WHERE (track_id + {idiv('frame', 20)}) % 5 <> 0
GROUP BY video_id, track_id, {idiv('frame', 20)}""",
    # reference boxes and a shifted second set, for box matching
    "fx_boxes": """
SELECT video_id, track_id, frame, cx - 20 AS x1, cy - 45 AS y1, cx + 20 AS x2, cy + 45 AS y2,
       cx - 20 + event_id % 30 AS sx1, cy - 45 + event_id % 7 AS sy1,
       cx + 20 + event_id % 30 AS sx2, cy + 45 + event_id % 7 AS sy2, confidence
FROM {fx_detections}""",
    "fx_teams": """
SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS name, CAST(n_nationkey % 5 AS BIGINT) AS user_id
FROM {nation}""",
    "fx_players": """
SELECT c_custkey AS player_id, c_custkey % 25 AS team_id, c_custkey % 30 AS jersey,
       CASE WHEN c_custkey % 40 = 0 THEN 'Unknown' ELSE concat('First', CAST(c_custkey % 90 AS STRING)) END AS first_name,
       CASE WHEN c_custkey % 40 = 0 THEN concat('#', CAST(c_custkey % 30 AS STRING))
            ELSE concat('Last', CAST(c_custkey % 700 AS STRING)) END AS last_name,
       CASE WHEN c_custkey % 40 = 0 THEN 'Unassigned' WHEN c_custkey % 11 = 0 THEN 'Goalkeeper' ELSE 'Midfielder' END
         AS position
FROM {customer}""",
    # one match per (team, month)
    "fx_matches": """
SELECT match_id, match_date, team_id,
       CASE WHEN match_id % 2 = 0 THEN team_id ELSE opponent_id END AS home_team_id,
       CASE WHEN match_id % 2 = 0 THEN opponent_id ELSE team_id END AS away_team_id,
       CASE WHEN match_id % 9 = 0 THEN NULL ELSE match_id * 7 % 5 END AS home_score,
       CASE WHEN match_id % 9 = 0 THEN NULL ELSE match_id * 11 % 4 END AS away_score,
       CASE match_id % 3 WHEN 1 THEN 'home' WHEN 2 THEN 'away' END AS our_side,
       CASE match_id % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'D' WHEN 2 THEN 'L' END AS result,
       team_id % 5 AS user_id
FROM (
  SELECT DISTINCT %(team)s * 1000 + %(month)s AS match_id, %(team)s AS team_id,
         (%(team)s + 1 + %(month)s %% 23) %% 25 AS opponent_id,
         make_date(CAST(year(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT), 1) AS match_date
  FROM {orders})""".replace("%(team)s", _TEAM).replace("%(month)s", _MONTH).replace("%%", "%"),
    "fx_videos": f"""
SELECT o_orderkey AS video_id, {_TEAM} * 1000 + {_MONTH} AS match_id,
       CASE WHEN o_orderkey % 17 = 0 THEN (o_custkey + 1) % 5 ELSE o_custkey % 5 END AS user_id,
       CASE WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'done' END AS status,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(600 + o_orderkey % 3000 AS DOUBLE) END AS duration_s,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 19.8 + o_orderkey % 3 END AS hsr_kmh,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 25.3 + o_orderkey % 2 END AS sprint_kmh,
       CASE WHEN o_orderkey % 3 = 0 THEN 'stub' ELSE 'real' END AS adapter_source,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'config/default_calibration.json' WHEN 2 THEN ' none '
            ELSE 'uploads/field_7.json' END AS calibration,
       CASE WHEN o_orderkey % 29 = 0 THEN FALSE WHEN o_orderkey % 2 = 0 THEN TRUE END AS distance_valid,
       CAST(o_orderdate AS DATE) AS created_at, concat('Clip ', CAST(o_orderkey % 97 AS STRING)) AS title
FROM {{orders}} WHERE o_orderkey % 7 <> 0""",
    "fx_stats": f"""
SELECT o_orderkey AS stat_id, o_custkey AS player_id, {_TEAM} * 1000 + {_MONTH} AS match_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS video_id,
       distance_km, top_speed_mph,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'High' WHEN '2' THEN 'Medium' WHEN '3' THEN 'Medium'
            ELSE 'Low' END AS injury_risk
FROM {{orders}} LEFT JOIN (
  SELECT l_orderkey, sum(l_quantity) / 20 AS distance_km, CAST(12 + max(l_linenumber) AS DOUBLE) AS top_speed_mph
  FROM {{lineitem}} GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "fx_metrics": """
SELECT l_orderkey AS stat_id,
       CASE l_linenumber WHEN 1 THEN 'minutes_played' WHEN 2 THEN 'visible_minutes' WHEN 3 THEN 'sprint_count'
            WHEN 4 THEN 'hsr_count' WHEN 5 THEN 'hsr_distance_km' WHEN 6 THEN 'coverage_pct'
            ELSE 'distance_per_min' END AS metric_key,
       CASE WHEN max(l_returnflag) = 'R' THEN NULL WHEN l_linenumber = 5 THEN sum(l_quantity) / 100
            ELSE sum(l_quantity) END AS value
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "fx_tags": """
SELECT match_id, user_id,
       CASE WHEN match_id % 7 = 0 THEN ' weather' ELSE 'Weather' END AS raw_key,
       CASE match_id % 3 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'rainy  day' ELSE ' Windy ' END AS raw_value, 1 AS pos
FROM {fx_matches} WHERE match_id % 10 <> 0
UNION ALL
SELECT match_id, user_id, 'Pitch' AS raw_key, CASE match_id % 2 WHEN 0 THEN 'Grass' ELSE 'TURF' END AS raw_value, 2 AS pos
FROM {fx_matches}
UNION ALL
SELECT match_id, user_id, 'pitch ' AS raw_key, 'grass' AS raw_value, 3 AS pos
FROM {fx_matches} WHERE match_id % 6 = 0""",
    "fx_logs": """
SELECT o_orderkey AS log_id, o_custkey AS player_id, CAST(o_orderdate AS DATE) AS log_date,
       CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 0.0E0 ELSE o_totalprice / 50000 END AS gps_distance_km,
       CAST(20 + o_orderkey % 71 AS DOUBLE) AS minutes_played,
       CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE CAST(o_orderkey % 40 AS DOUBLE) END AS sprints,
       CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE CAST(18 + o_orderkey % 17 AS DOUBLE) END AS top_speed_kmh,
       CASE WHEN o_orderkey % 20 < 9 THEN NULL ELSE CAST(120 + o_orderkey % 75 AS DOUBLE) END AS heart_rate,
       CASE WHEN o_orderkey % 20 < 7 THEN NULL ELSE CAST(150 + o_orderkey % 60 AS DOUBLE) END AS heart_rate_max,
       o_orderkey % 50 AS upload_id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label
FROM {orders}""",
    # one text row per log, some of them broken on purpose
    "fx_csv": """
SELECT log_id AS line, upload_id,
       CASE WHEN log_id % 23 = 0 THEN '999999999' ELSE CAST(player_id AS STRING) END AS player_id,
       CASE WHEN log_id % 13 = 0 THEN '13/45/2026'
            WHEN log_id % 3 = 0 THEN concat(substr(CAST(log_date AS STRING), 6, 2), '/', substr(CAST(log_date AS STRING), 9, 2), '/', substr(CAST(log_date AS STRING), 1, 4))
            ELSE CAST(log_date AS STRING) END AS date,
       CASE WHEN log_id % 17 = 0 THEN 'abc' WHEN log_id % 31 = 0 THEN 'nan' WHEN log_id % 37 = 0 THEN ''
            ELSE CAST(log_id % 15 AS STRING) END AS gps_distance,
       CASE WHEN log_id % 19 = 0 THEN '900' WHEN log_id % 5 = 0 THEN ' ' ELSE CAST(60 + log_id % 100 AS STRING) END AS heart_rate,
       CASE WHEN log_id % 41 = 0 THEN '3.5' ELSE CAST(log_id % 40 AS STRING) END AS sprints
FROM {fx_logs}""",
    # track fragments of one player in one video, as the tracker reports them
    "fx_fragments": """
SELECT o_custkey AS player_id, o_orderkey AS video_id, CAST(l_linenumber AS BIGINT) AS track_id, l_partkey AS part_id,
       CAST(12 + l_linenumber AS DOUBLE) AS top_speed_mph,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(19 + l_linenumber AS DOUBLE) END AS top_speed_kmh,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity / 20 END AS distance_km,
       CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_quantity * 50 END AS distance_m,
       CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS minutes_played,
       CASE WHEN l_linenumber % 2 = 1 THEN NULL ELSE l_quantity * 60 END AS minutes_played_s,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity - 3 END AS visible_minutes,
       CASE WHEN l_linenumber % 4 <> 1 THEN NULL ELSE l_quantity * 60 - 200 END AS visible_minutes_s,
       CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_quantity * 1.5 END AS coverage_pct,
       CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_quantity * 3 END AS distance_per_min_m,
       CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_partkey % 105 AS DOUBLE) END AS avg_pitch_x,
       CAST(l_partkey % 68 AS DOUBLE) AS avg_pitch_y,
       CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 9 END AS hsr_count,
       CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 4 END AS sprint_count,
       CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE l_suppkey % 11 END AS hi_efforts_count,
       CASE l_linestatus WHEN 'F' THEN CASE WHEN l_linenumber > 5 THEN 'High' ELSE 'Low' END ELSE 'Medium' END AS injury_risk,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(30 + o_orderkey % 60 AS DOUBLE) END AS clip_minutes
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # stored per-cell heatmaps of each stat row (sparse), two shapes
    "fx_heatmaps": """
SELECT stat_id, player_id, video_id, CASE WHEN stat_id % 5 = 0 THEN 12 ELSE 21 END AS grid_cols,
       CASE WHEN stat_id % 5 = 0 THEN 8 ELSE 14 END AS grid_rows,
       CASE WHEN stat_id % 5 = 0 THEN 'backend' ELSE 'pipeline' END AS source,
       CASE WHEN stat_id % 5 = 0 THEN 'samples' ELSE 'seconds' END AS cell_unit,
       CAST(10 + stat_id % 90 AS BIGINT) AS samples,
       CAST(stat_id % 105 AS DOUBLE) AS mean_x, CAST(stat_id % 68 AS DOUBLE) AS mean_y
FROM {fx_stats} WHERE stat_id % 3 <> 0""",
    "fx_cells": """
SELECT stat_id, player_id, video_id, grid_cols, grid_rows, source, cell_unit, samples,
       stat_id % grid_rows AS cell_row, l_linenumber * 2 % grid_cols AS cell_col, sum(l_quantity) AS value
FROM {fx_heatmaps} JOIN {lineitem} ON l_orderkey = stat_id
GROUP BY stat_id, player_id, video_id, grid_cols, grid_rows, source, cell_unit, samples,
         stat_id % grid_rows, l_linenumber * 2 % grid_cols""",
}


def _deps(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Data:
    """Lazy access to the supplied tables and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def _build(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "fx_detections":
            return self._detections()
        if name == "fx_colours":
            e = self.embeddings
            return e.select(
                F.floor(F.col("vec_id") / 25).alias("video_id"),
                F.col("vec_id").alias("track_id"),
                *[(F.col("embedding")[i].cast("double") * 100).alias(f"c{i + 1}") for i in range(3)],
            )
        text = VIEWS[name]
        inputs = {d: getattr(self, d) for d in _deps(text)}
        if name == "fx_cells":
            # both sides of the join in as many parts as their rows ask for: a part is joined and counted by one task
            parts = -(-self.lineitem.count() // TASK_ROWS) or 1
            inputs = {d: df.repartition(parts, {"fx_heatmaps": "stat_id", "lineitem": "l_orderkey"}[d]) for d, df in inputs.items()}
        return self.spark.sql(text, **inputs)

    def _detections(self) -> DataFrame:
        e = self.events.select(
            F.floor(F.col("user_id") / 20).alias("video_id"),
            F.col("user_id").alias("track_id"),
            "event_id",
            "event_type",
            "ts",
        )
        minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
        # tracks of ordinary length share one shuffle, by which later groups by track are dealt out already
        split = crowded(e, ["track_id"])
        e = with_position(e, ["track_id"], [F.asc("ts"), F.asc("event_id")], minute, out="frame", split=split).drop("ts")
        # steps repeat every 75 frames, so the running sum has a closed form: whole rounds and a place in the round, from a table
        place = F.col("track_id") * 7 % 5 * 75 + F.col("frame") % 75 + 1
        partial = F.element_at(F.expr(f"array({', '.join(map(str, _round_sums()))})"), place.cast("int"))
        e = e.withColumn("pos_cm", F.floor(F.col("frame") / 75) * 3300 + partial)
        return e.selectExpr(*[c.strip() for c in _split_columns(_DETECTION_COLUMNS)])


def _round_sums() -> list[int]:
    """Distance after each of the 75 frames of a round, for each of the five orders of the steps."""
    return [sum((5, 20, 45, 65, 85)[(first + f // 15 * 13) % 5] for f in range(last + 1)) for first in range(5) for last in range(75)]


def _split_columns(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


_COLOURS_SQL = f"""
SELECT {idiv('vec_id', 25)} AS video_id, vec_id AS track_id,
       CAST(embedding[1] AS DOUBLE) * 100 AS c1, CAST(embedding[2] AS DOUBLE) * 100 AS c2,
       CAST(embedding[3] AS DOUBLE) * 100 AS c3
FROM {{embeddings}}"""


def oracle_with_fixtures(body: str) -> str:
    """Prefix ``body`` with the views it uses, as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        text = _COLOURS_SQL if name == "fx_colours" else VIEWS[name]
        for d in _deps(text):
            visit(d)
        order.append(name)

    used = dict.fromkeys(re.findall(r"\bfx_\w+", body))
    for name in used:
        visit(name)
    if not order:
        return body.strip()
    ctes = []
    for name in order:
        text = _COLOURS_SQL if name == "fx_colours" else VIEWS[name]
        text = re.sub(r"\{(\w+)\}", r"\1", text)
        ctes.append(f"{name} AS ({text.strip()})")
    body = body.strip()
    joined = ",\n".join(ctes)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {joined},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {joined},\n{body[5:]}"
    return f"WITH {joined}\n{body}"
