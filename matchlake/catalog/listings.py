from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listings as L, stats as S
from .insights import TAGS, UM, tags, um
from .registry import query

TAG_TEXT = """
tl AS (SELECT user_id, match_id, string_agg(concat(key_fold, '=', value_fold), ',' ORDER BY key_fold, value_fold) AS tag_text FROM tg GROUP BY ALL)"""


def tag_text():
    return F.array_join(F.transform("tags", lambda t: F.concat(t["key_fold"], F.lit("="), t["value_fold"])), ",").alias("tag_text")


@query("match_listing", "J19 A26 K6", "WITH " + UM + "," + TAGS + "," + TAG_TEXT + """,
vc AS (SELECT user_id, match_id, count(*) AS n FROM fx_videos GROUP BY ALL)
SELECT ms.user_id, ms.match_id, CAST(match_date AS DATE) AS match_date, our_team, opponent, side, outcome, coalesce(n, 0) AS video_count, tag_text
FROM ms LEFT JOIN vc ON vc.user_id = ms.user_id AND vc.match_id = ms.match_id LEFT JOIN tl ON tl.user_id = ms.user_id AND tl.match_id = ms.match_id""")
def _(d):
    out = L.list_matches(um(d), d.fx_videos, tags(d))
    return out.withColumn("tag_text", tag_text()).drop("tags")


@query("match_listing_filtered", "J19 P6", "WITH " + UM + "," + TAGS + """
SELECT ms.user_id, ms.match_id FROM ms WHERE EXISTS (SELECT 1 FROM tg WHERE tg.user_id = ms.user_id AND tg.match_id = ms.match_id AND key_fold = 'pitch' AND value_fold = 'grass')""")
def _(d):
    return L.list_matches(um(d), d.fx_videos, tags(d), ["Pitch:Grass"]).select("user_id", "match_id")


@query("video_counts", "A26", "SELECT user_id, match_id, count(*) AS videos FROM fx_videos GROUP BY ALL")
def _(d):
    return d.fx_videos.groupBy("user_id", "match_id").agg(F.count(F.lit(1)).alias("videos"))


@query("video_listing", "J20", "WITH " + UM + "," + TAGS + "," + TAG_TEXT + """
SELECT v.video_id, v.user_id, v.match_id, our_team, opponent, outcome, coalesce(duration_s, 90.0e0 + v.video_id % 9) AS duration_s, tag_text
FROM fx_videos v LEFT JOIN ms ON ms.user_id = v.user_id AND ms.match_id = v.match_id LEFT JOIN tl ON tl.user_id = v.user_id AND tl.match_id = v.match_id""")
def _(d):
    out = L.list_videos(d.fx_videos, um(d), tags(d), meta_duration=F.lit(90.0) + F.col("video_id") % 9)
    return out.select("video_id", "user_id", "match_id", "our_team", "opponent", "outcome", "duration_s", tag_text())


@query("player_listing", "J21", """
SELECT player_id, first_name, last_name, jersey, t.name AS team_name, t.user_id FROM fx_players p JOIN fx_teams t ON t.team_id = p.team_id""")
def _(d):
    return L.list_players(d.fx_players, d.fx_teams).select("player_id", "first_name", "last_name", "jersey", F.col("team.name").alias("team_name"), "user_id")


@query("team_player_order", "K4", "SELECT player_id, team_id, jersey, last_name FROM fx_players")
def _(d):
    return L.team_order(d.fx_players).select("player_id", "team_id", "jersey", "last_name")


@query("jersey_clash", "J18", """
WITH r AS (SELECT match_id AS video_id, team_id, jersey, p.player_id FROM (SELECT DISTINCT match_id, player_id FROM fx_stats) s JOIN fx_players p ON p.player_id = s.player_id)
SELECT video_id, team_id, jersey, first_player, player_id AS other_player FROM (SELECT *, min(player_id) OVER (PARTITION BY video_id, team_id, jersey) AS first_player FROM r)
WHERE player_id <> first_player""")
def _(d):
    rows = d.fx_stats.select(F.col("match_id").alias("video_id"), "player_id").distinct().join(
        d.fx_players.select("player_id", "team_id", "jersey"), "player_id"
    )
    return L.jersey_clashes(rows)


@query("player_search", "P17", """
SELECT player_id, first_name, last_name FROM fx_players WHERE contains(lower(concat(first_name, ' ', last_name)), 'last12') AND position = 'Midfielder'""")
def _(d):
    return L.search_players(d.fx_players, " LAST12", "Midfielder").select("player_id", "first_name", "last_name")


@query("history_search", "P20", "WITH " + UM + "," + TAGS + """
SELECT v.video_id, title, our_team, opponent FROM fx_videos v JOIN ms ON ms.user_id = v.user_id AND ms.match_id = v.match_id
WHERE contains(lower(concat(title, ' ', our_team, ' ', opponent)), 'nation_1') AND EXISTS (SELECT 1 FROM tg WHERE tg.user_id = v.user_id AND tg.match_id = v.match_id
  AND key_fold = 'weather' AND value_fold = 'sunny')""")
def _(d):
    rows = d.fx_videos.select("video_id", "user_id", "match_id", "title").join(um(d).select("user_id", "match_id", "our_team", "opponent"), ["user_id", "match_id"])
    return L.search_history(rows, tags(d), "Nation_1", ["weather:sunny"]).select("video_id", "title", "our_team", "opponent")


@query("history_totals", "A38", """
SELECT user_id, count(*) AS videos, count(*) FILTER (WHERE status = 'done') AS completed, max(created_at) AS latest FROM fx_videos GROUP BY user_id""")
def _(d):
    return L.history_totals(d.fx_videos)


@query("newest_videos", "K6", """
SELECT video_id, created_at FROM fx_videos ORDER BY created_at DESC, video_id DESC""")
def _(d):
    return d.fx_videos.orderBy(F.desc("created_at"), F.desc("video_id")).select("video_id", "created_at")


@query("stored_people", "J23", """
SELECT video_id, frame, d.track_id, coalesce(d.jersey, p.jersey) AS jersey FROM fx_detections d LEFT JOIN fx_players p ON p.player_id = d.track_id
WHERE role <> 'referee'""")
def _(d):
    det = d.fx_detections.select("video_id", "frame", "track_id", "jersey", F.col("track_id").alias("player_id"), F.col("role").alias("object_class"))
    out = L.people_on_frame(det.where("object_class <> 'referee'"), d.fx_players)
    return out.select("video_id", "frame", "track_id", "jersey")


@query("player_series", "W29", """
WITH m AS (SELECT stat_id, max(value) FILTER (WHERE metric_key = 'minutes_played') AS mp, max(value) FILTER (WHERE metric_key = 'sprint_count') AS sc FROM fx_metrics GROUP BY stat_id),
s AS (SELECT *, CASE WHEN stat_id % 4 = 0 THEN 30.0e0 + stat_id % 5 END AS own FROM fx_stats)
SELECT s.player_id, h.match_date, s.stat_id, round(coalesce(own, round(top_speed_mph * 1.609344e0, 2)), 2) AS kmh, round(distance_km * 1000, 0) AS metres, mp AS minutes_played,
  CAST(sc AS BIGINT) AS sprint_count, CASE injury_risk WHEN 'High' THEN 100e0 WHEN 'Medium' THEN 50e0 ELSE 0e0 END AS fatigue
FROM s JOIN fx_matches h ON h.match_id = s.match_id LEFT JOIN m ON m.stat_id = s.stat_id""")
def _(d):
    own = F.when(F.col("stat_id") % 4 == 0, F.lit(30.0) + F.col("stat_id") % 5)
    s = S.player_series(d.fx_stats.withColumn("top_speed_kmh", own), d.fx_metrics, d.fx_matches)
    return s.select(
        "player_id", "match_date", "stat_id", F.round("top_speed_kmh", 2).alias("kmh"), F.round("distance_covered_meters", 0).alias("metres"), "minutes_played",
        "sprint_count", F.col("fatigue_risk_score").alias("fatigue"),
    )
