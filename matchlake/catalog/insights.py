from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights as I, tags as TG
from ..plans.materialize import reuse
from .registry import query, rnd
from .stats import DEN, RATIO, wide_sql, USED

UM = """
um AS (SELECT DISTINCT m.match_id, t.user_id FROM fx_matches m JOIN fx_teams t ON t.team_id = m.home_team_id OR t.team_id = m.away_team_id),
ms0 AS (SELECT um.user_id, m.* EXCLUDE (user_id), h.name AS home_team, a.name AS away_team,
    CASE WHEN h.user_id = um.user_id AND a.user_id <> um.user_id THEN 'home' WHEN a.user_id = um.user_id AND h.user_id <> um.user_id THEN 'away'
      ELSE coalesce(our_side, 'home') END AS side
  FROM um JOIN fx_matches m ON m.match_id = um.match_id JOIN fx_teams h ON h.team_id = m.home_team_id JOIN fx_teams a ON a.team_id = m.away_team_id),
ms1 AS (SELECT *, CASE WHEN side = 'home' THEN home_team_id ELSE away_team_id END AS our_team_id,
    CASE WHEN side = 'home' THEN home_team ELSE away_team END AS our_team, CASE WHEN side = 'home' THEN away_team ELSE home_team END AS opponent,
    CASE WHEN side = 'home' THEN home_score ELSE away_score END AS os, CASE WHEN side = 'home' THEN away_score ELSE home_score END AS ts FROM ms0),
ms AS (SELECT *, CASE WHEN os > ts THEN 'W' WHEN os < ts THEN 'L' WHEN os = ts THEN 'D' ELSE result END AS outcome FROM ms1)"""

TAGS = r"""
tg0 AS (SELECT user_id, match_id, pos, regexp_replace(trim(raw_key), '\s+', ' ', 'g') AS key, regexp_replace(trim(raw_value), '\s+', ' ', 'g') AS value FROM fx_tags),
tg AS (SELECT user_id, match_id, lower(key) AS key_fold, lower(value) AS value_fold, min(pos) AS pos FROM tg0 GROUP BY ALL)"""

ALL = ["distance_km", "top_speed_mph", "sprint_count", "hsr_distance_km", "sprint_distance_km", "distance_per_min", "workload"]
DIG = {"top_speed_mph": 1, "distance_per_min": 1, "sprint_count": 1}

PM = UM + "," + wide_sql(USED) + f""",
vis AS (SELECT ms.user_id, w.* FROM {DEN} w JOIN fx_players p ON p.player_id = w.player_id
  JOIN ms ON ms.match_id = w.match_id AND p.team_id = ms.our_team_id LEFT JOIN fx_videos v ON v.video_id = w.video_id
  WHERE w.video_id IS NULL OR (v.user_id = ms.user_id AND v.status = 'done')),
pl AS (SELECT user_id, match_id, player_id, {rnd('sum(distance_km)', 2)} AS distance_km, {rnd('max(top_speed_mph)', 1)} AS top_speed_mph,
  CAST(round(sum(sprint_count)) AS BIGINT) AS sprint_count, {rnd('sum(hsr_distance_km)', 2)} AS hsr_distance_km, CAST(NULL AS DOUBLE) AS sprint_distance_km,
  {rnd(RATIO, 0)} AS distance_per_min, CAST(max(CASE injury_risk WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS DOUBLE) AS workload
  FROM vis GROUP BY user_id, match_id, player_id),
pm AS (SELECT user_id, match_id, {", ".join(f"avg({k}) AS {k}" for k in ALL)}, count(*) AS n_players,
  count(*) FILTER (WHERE workload = 1) AS risk_low, count(*) FILTER (WHERE workload = 2) AS risk_medium, count(*) FILTER (WHERE workload = 3) AS risk_high
  FROM pl GROUP BY user_id, match_id)"""


def summary_sql(members: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS matches, count(pm.n_players) AS matches_with_data, count(pm.n_players) < 3 AS low_sample,
  {", ".join(f"{rnd(f'avg(pm.{k})', DIG.get(k, 3))} AS {k}" for k in ALL)}, {", ".join(f"count(pm.{k}) AS n_{k}" for k in ALL)},
  CAST(coalesce(sum(risk_low), 0) AS BIGINT) AS risk_low, CAST(coalesce(sum(risk_medium), 0) AS BIGINT) AS risk_medium, CAST(coalesce(sum(risk_high), 0) AS BIGINT) AS risk_high,
  count(*) FILTER (WHERE outcome = 'W') AS won, count(*) FILTER (WHERE outcome = 'D') AS drawn, count(*) FILTER (WHERE outcome = 'L') AS lost,
  count(*) FILTER (WHERE outcome IS NULL) AS unknown
  FROM {members} x LEFT JOIN pm ON pm.user_id = x.user_id AND pm.match_id = x.match_id GROUP BY {keys}"""


def versus_sql(groups: str, base: str) -> str:
    cols = ", ".join(
        f"{rnd(f'g.{k} - b.{k}', DIG.get(k, 3))} AS delta_{k}, CASE WHEN b.{k} <> 0 THEN {rnd(f'(g.{k} - b.{k}) / b.{k} * 100', 1)} END AS pct_{k}"
        for k in ALL
    )
    return f"SELECT g.*, {cols} FROM {groups} g JOIN {base} b ON b.user_id = g.user_id"


NEXT = """
nx AS (SELECT * FROM (SELECT user_id, match_id, lead(match_id) OVER (PARTITION BY user_id ORDER BY match_date, match_id) AS next_match_id FROM ms)
  WHERE next_match_id IS NOT NULL)"""
BASE = "base AS (" + summary_sql("ms", "x.user_id") + ")"


def um(d):
    return I.user_matches(d.fx_matches, d.fx_teams)


def profile(d, **scope):
    return I.per_match(um(d), d.fx_stats, d.fx_metrics, d.fx_players, d.fx_videos, **scope)


def tags(d):
    return TG.normalised(d.fx_tags)


@query("user_matches", "P3 P4 P5", "WITH " + UM + "SELECT user_id, match_id, side, our_team_id, our_team, opponent, outcome FROM ms")
def _(d):
    return um(d).select("user_id", "match_id", "side", "our_team_id", "our_team", "opponent", "outcome")


@query("visible_stats", "P2 J2", """
SELECT s.stat_id, m.match_id, m.user_id FROM fx_stats s JOIN fx_matches m ON m.match_id = s.match_id LEFT JOIN fx_videos v ON v.video_id = s.video_id
WHERE s.video_id IS NULL OR (v.user_id = m.user_id AND v.status = 'done')""")
def _(d):
    rows = d.fx_stats.join(d.fx_matches.select("match_id", "user_id"), "match_id").select("stat_id", "match_id", "user_id", "video_id")
    return I.visible(rows, d.fx_videos).drop("video_id")


@query("match_profile", "A21", "WITH " + PM + f"""
SELECT user_id, match_id, n_players, risk_low, risk_medium, risk_high, {", ".join(f"round({k}, 6) AS {k}" for k in ALL)} FROM pm""")
def _(d):
    p = profile(d)
    return p.withColumns({k: F.round(k, 6) for k in ALL})


@query("baseline_summary", "A22", "WITH " + PM + "," + BASE + "SELECT * FROM base")
def _(d):
    return I.summary(um(d).select("user_id", "match_id", "outcome"), profile(d), ["user_id"])


@query("tag_insights", "A24 A22 A23", "WITH " + PM + "," + BASE + "," + TAGS + ", g AS (" + summary_sql(
    "(SELECT ms.*, value_fold FROM ms JOIN tg ON tg.user_id = ms.user_id AND tg.match_id = ms.match_id AND key_fold = 'weather')",
    "x.user_id, x.value_fold") + ")" + versus_sql("g", "base"))
def _(d):
    return I.tag_insights(um(d), reuse(profile(d)), tags(d), "Weather")


@query("tag_insights_team", "A24 P1", "WITH " + PM.replace("p.team_id = ms.our_team_id", "p.team_id = 3") + "," + BASE + "," + TAGS + ", g AS (" + summary_sql(
    "(SELECT ms.*, value_fold FROM ms JOIN tg ON tg.user_id = ms.user_id AND tg.match_id = ms.match_id AND key_fold = 'pitch')",
    "x.user_id, x.value_fold") + ")" + versus_sql("g", "base"))
def _(d):
    return I.tag_insights(um(d), reuse(profile(d, team_id=3)), tags(d), "pitch")


@query("next_match", "W16", "WITH " + UM + "," + NEXT + "SELECT * FROM nx")
def _(d):
    return I.next_match(um(d))


EFFECT = "WITH " + PM + "," + BASE + "," + TAGS + "," + NEXT + """,
pr AS (SELECT tg.user_id, tg.match_id, value_fold, next_match_id FROM tg JOIN nx ON nx.user_id = tg.user_id AND nx.match_id = tg.match_id WHERE key_fold = 'weather'),
pc AS (SELECT user_id, value_fold, count(*) AS pairs FROM pr WHERE EXISTS (SELECT 1 FROM pm WHERE pm.user_id = pr.user_id AND pm.match_id = pr.match_id)
  AND EXISTS (SELECT 1 FROM pm WHERE pm.user_id = pr.user_id AND pm.match_id = pr.next_match_id) GROUP BY ALL),
mem AS (SELECT DISTINCT ms.*, value_fold FROM pr JOIN ms ON ms.user_id = pr.user_id AND ms.match_id = pr.next_match_id),
g AS (""" + summary_sql("mem", "x.user_id, x.value_fold") + "), e AS (" + versus_sql("g", "base") + """)
, eff AS (SELECT e.*, coalesce(pairs, 0) AS pairs FROM e LEFT JOIN pc ON pc.user_id = e.user_id AND pc.value_fold = e.value_fold)"""


@query("next_match_effect", "W17 U7 A23", EFFECT + "SELECT * FROM eff")
def _(d):
    return I.next_match_effect(um(d), reuse(profile(d)), tags(d), "weather")


@query("shown_next_match_effect", "P22", EFFECT + """
SELECT user_id, value_fold, CASE WHEN sum(pairs) OVER (PARTITION BY user_id) >= 2 AND n_distance_km >= 3 THEN pct_distance_km END AS shown_pct FROM eff""")
def _(d):
    return I.shown_effect(I.next_match_effect(um(d), reuse(profile(d)), tags(d), "weather"), "distance_km")


EFF = ["distance_km", "top_speed_mph", "sprint_count", "hsr_distance_km", "workload"]


@query("next_match_effect_with_data", "W18", "WITH " + PM + "," + TAGS + f""",
hv AS (SELECT ms.* FROM ms JOIN pm ON pm.user_id = ms.user_id AND pm.match_id = ms.match_id),
nx AS (SELECT user_id, match_id, lead(match_id) OVER (PARTITION BY user_id ORDER BY match_date, match_id) AS next_match_id FROM hv),
j AS (SELECT tg.user_id, value_fold, pm.* EXCLUDE (user_id, match_id) FROM tg JOIN nx ON nx.user_id = tg.user_id AND nx.match_id = tg.match_id
  JOIN pm ON pm.user_id = tg.user_id AND pm.match_id = next_match_id WHERE key_fold = 'weather'),
b AS (SELECT user_id, {", ".join(f"avg({k}) AS b_{k}" for k in EFF)} FROM pm GROUP BY user_id)
SELECT j.user_id, value_fold, count(*) AS pairs, {", ".join(f"count({k}) AS n_{k}" for k in EFF)},
  {", ".join(f"round(CASE WHEN max(b_{k}) <> 0 THEN (avg({k}) - max(b_{k})) / max(b_{k}) * 100 END, 6) AS pct_{k}" for k in EFF)}
FROM j JOIN b ON b.user_id = j.user_id GROUP BY j.user_id, value_fold""")
def _(d):
    out = I.next_match_effect_with_data(um(d), reuse(profile(d)), tags(d), "weather")
    return out.withColumns({f"pct_{k}": F.round(f"pct_{k}", 6) for k in EFF})


@query("weighted_baseline", "A36", "WITH " + PM + "," + TAGS + ", g AS (" + summary_sql(
    "(SELECT ms.*, value_fold FROM ms JOIN tg ON tg.user_id = ms.user_id AND tg.match_id = ms.match_id AND key_fold = 'weather')",
    "x.user_id, x.value_fold") + """)
SELECT user_id, round(sum(distance_km * matches) FILTER (WHERE distance_km IS NOT NULL) / sum(matches) FILTER (WHERE distance_km IS NOT NULL), 6) AS baseline
FROM g GROUP BY user_id""")
def _(d):
    groups = I.tag_insights(um(d), reuse(profile(d)), tags(d), "Weather")
    return I.weighted_baseline(groups, "distance_km").withColumn("baseline", F.round("baseline", 6))


@query("insight_ranking", "K8", "WITH " + PM + "," + TAGS + ", g AS (" + summary_sql(
    "(SELECT ms.*, value_fold FROM ms JOIN tg ON tg.user_id = ms.user_id AND tg.match_id = ms.match_id AND key_fold = 'pitch')",
    "x.user_id, x.value_fold") + """)
SELECT user_id, value_fold, low_sample, distance_km FROM g""")
def _(d):
    groups = I.tag_insights(um(d), reuse(profile(d)), tags(d), "pitch")
    return I.insight_order(groups, "distance_km").select("user_id", "value_fold", "low_sample", "distance_km")


@query("outcome_text", "X25", """
SELECT match_id, CASE WHEN t IN ('w', 'win', 'won') THEN 'w' WHEN t IN ('d', 'draw', 'drew', 'tie') THEN 'd' WHEN t IN ('l', 'loss', 'lost', 'lose') THEN 'l' END AS outcome
FROM (SELECT match_id, lower(trim(CASE match_id % 5 WHEN 0 THEN ' WON ' WHEN 1 THEN 'Tie' WHEN 2 THEN 'LOSS' WHEN 3 THEN result ELSE 'abandoned' END)) AS t FROM fx_matches)""")
def _(d):
    m = F.col("match_id") % 5
    text = F.when(m == 0, " WON ").when(m == 1, "Tie").when(m == 2, "LOSS").when(m == 3, F.col("result")).otherwise("abandoned")
    return d.fx_matches.select("match_id", I.win_draw_loss(text).alias("outcome"))


# ---- tags -----------------------------------------------------------------------------------------------------
@query("distinct_tags", "U3 X18", "WITH " + TAGS + """,
k AS (SELECT user_id, lower(key) AS key_fold, min_by(key, (match_id, pos)) AS key FROM tg0 GROUP BY ALL),
v AS (SELECT user_id, lower(key) AS key_fold, lower(value) AS value_fold, min_by(value, (match_id, pos)) AS value FROM tg0 GROUP BY ALL)
SELECT tg.user_id, match_id, tg.key_fold, tg.value_fold, CAST(pos AS BIGINT) AS pos, key, value FROM tg JOIN k USING (user_id, key_fold) JOIN v USING (user_id, key_fold, value_fold)""")
def _(d):
    return tags(d).withColumn("pos", F.col("pos").cast("bigint"))


@query("last_tag_per_key", "U4", "WITH " + TAGS + "SELECT user_id, match_id, key_fold, max_by(value_fold, pos) AS value_fold FROM tg GROUP BY ALL")
def _(d):
    return TG.last_value_per_key(tags(d))


@query("tag_filter", "P6 J3", "WITH " + TAGS + """
SELECT user_id, match_id FROM tg GROUP BY ALL HAVING bool_or(key_fold = 'weather' AND value_fold IN ('sunny', 'windy')) AND bool_or(key_fold = 'pitch' AND value_fold = 'turf')""")
def _(d):
    return TG.matching(tags(d), ["weather:Sunny", "Weather: windy ", "Pitch:turf"])


@query("match_tag_join", "J4", "WITH " + TAGS + """
SELECT m.match_id, m.user_id, tg.key_fold, tg.value_fold FROM fx_matches m JOIN tg ON tg.match_id = m.match_id AND tg.user_id = m.user_id""")
def _(d):
    return d.fx_matches.select("match_id", "user_id").join(tags(d).select("match_id", "user_id", "key_fold", "value_fold"), ["match_id", "user_id"])


@query("tag_value_counts", "J5 A25", "WITH " + TAGS + """,
v AS (SELECT DISTINCT user_id, key_fold, value_fold FROM tg UNION SELECT DISTINCT user_id, 'weather', 'foggy' FROM tg)
SELECT v.*, (SELECT count(*) FROM tg t WHERE t.user_id = v.user_id AND t.key_fold = v.key_fold AND t.value_fold = v.value_fold) AS count FROM v""")
def _(d):
    t = tags(d)
    v = t.select("user_id", "key_fold", "value_fold").distinct().withColumn("value", F.col("value_fold"))
    unused = t.select("user_id").distinct().select("user_id", F.lit("weather").alias("key_fold"), F.lit("foggy").alias("value_fold"), F.lit("foggy").alias("value"))
    return TG.value_counts(v.unionByName(unused), t).drop("value")


@query("tag_prefix_search", "P19", "WITH " + TAGS + """
SELECT user_id, key_fold, value_fold, count(*) AS count FROM tg WHERE starts_with(value_fold, 'wi') GROUP BY ALL""")
def _(d):
    t = tags(d)
    v = t.select("user_id", "key_fold", "value_fold").distinct().withColumn("value", F.col("value_fold"))
    return TG.value_counts(v, t, prefix=" WI").drop("value")


@query("tag_key_catalogue", "A25", "WITH " + TAGS + """
SELECT user_id, key_fold, count(DISTINCT value_fold) AS value_count, count(DISTINCT match_id) AS match_count FROM tg GROUP BY ALL""")
def _(d):
    return TG.key_catalogue(tags(d))


@query("tag_index", "A39", "WITH " + TAGS + """
SELECT lower(key) AS key_fold, lower(value) AS value_fold, min_by(value, (match_id, pos)) AS value, count(*) AS count FROM tg0 GROUP BY lower(key), lower(value)""")
def _(d):
    return TG.index_from_rows(d.fx_tags)


@query("tag_key_suggestions", "K10", "WITH " + TAGS + """
SELECT lower(key) AS key_fold, count(*) AS uses, 0 AS source, 0 AS place FROM tg0 GROUP BY lower(key)
UNION ALL SELECT 'opponent', 0, 1, 2 UNION ALL SELECT 'time of day', 0, 1, 3""")
def _(d):
    return TG.key_suggestions(TG.index_from_rows(d.fx_tags), ["Weather", "Pitch", "Opponent", "Time of day"])


@query("tag_value_suggestions", "K10", "WITH " + TAGS + """,
p AS (SELECT * FROM (VALUES ('weather', 'rain', 0), ('weather', 'hail', 1), ('mood', 'good', 0)) AS t(key_fold, value_fold, place))
SELECT lower(key) AS key_fold, lower(value) AS value_fold, count(*) AS uses, 0 AS source, 0 AS place FROM tg0 GROUP BY lower(key), lower(value)
UNION ALL SELECT key_fold, value_fold, 0, 1, place FROM p WHERE NOT EXISTS (SELECT 1 FROM tg0 WHERE lower(key) = p.key_fold AND lower(value) = p.value_fold)""")
def _(d):
    found = TG.value_suggestions(TG.index_from_rows(d.fx_tags), {"Weather": ["Rain", "Hail"], "Mood": ["Good"]})
    return found.select("key_fold", "value_fold", "uses", "source", "place")


@query("tag_replacement", "U6", "WITH " + TAGS + """
SELECT user_id, match_id, key_fold, value_fold FROM tg WHERE match_id % 4 <> 0
UNION ALL SELECT user_id, match_id, 'weather' AS key_fold, 'snow' AS value_fold FROM fx_matches WHERE match_id % 4 = 0""")
def _(d):
    t = tags(d).select("user_id", "match_id", "key_fold", "value_fold")
    touched = d.fx_matches.where("match_id % 4 = 0").select("user_id", "match_id")
    new = touched.select("*", F.lit("weather").alias("key_fold"), F.lit("snow").alias("value_fold"))
    return TG.replace_tags(t, new, touched)


@query("tag_expression", "X19", """
SELECT match_id, CASE WHEN match_id % 6 = 0 THEN NULL ELSE 'Kick off' END AS key, CASE WHEN match_id % 6 = 0 THEN NULL ELSE concat('18:', CAST(match_id % 60 AS STRING)) END AS value FROM fx_matches""")
def _(d):
    raw = F.when(F.col("match_id") % 6 == 0, F.lit("no colon")).otherwise(
        F.concat(F.lit(" Kick   off : 18:"), (F.col("match_id") % 60).cast("string"))
    )
    p = d.fx_matches.select("match_id", TG.parse_filter(raw).alias("p"))
    return p.select("match_id", "p.key", "p.value")


@query("tag_display_case", "X18", """
SELECT match_id, CASE match_id % 2 WHEN 0 THEN 'Rainy Day/Night' ELSE 'Semi-Final' END AS shown FROM fx_matches""")
def _(d):
    raw = F.when(F.col("match_id") % 2 == 0, F.lit("  rainy   day/night")).otherwise("semi-final ")
    return d.fx_matches.select("match_id", TG.display_case(raw).alias("shown"))
