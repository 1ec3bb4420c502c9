from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N, secrets as E, text as X
from ..operators import ingest as G
from .registry import query, rnd


@query("tolerant_coercion", "X23", """
SELECT line, CASE line % 5 WHEN 0 THEN CAST(line AS DOUBLE) WHEN 1 THEN 3.5e0 END AS number, CASE line % 5 WHEN 0 THEN line END AS whole,
  CASE line % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'away' WHEN 2 THEN 'home' END AS side, CASE line % 3 WHEN 0 THEN 'referee' WHEN 1 THEN NULL ELSE 'player' END AS role,
  CASE WHEN line % 150 <= 99 THEN line % 150 END AS jersey, CASE line % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'High' END AS band,
  CASE line % 3 WHEN 0 THEN 'referee' WHEN 1 THEN CASE WHEN line % 2 = 0 THEN 'ball' ELSE 'player' END ELSE 'player' END AS class FROM fx_csv""")
def _(d):
    n = F.col("line")
    num = F.when(n % 5 == 0, n.cast("string")).when(n % 5 == 1, " 3.5 ").when(n % 5 == 2, "nan").when(n % 5 == 3, "").otherwise("x1")
    side = F.when(n % 4 == 0, " a ").when(n % 4 == 1, "1").when(n % 4 == 2, "Home").otherwise("7")
    role = F.when(n % 3 == 0, " Referee ").when(n % 3 == 1, "  ").otherwise("player")
    band = F.when(n % 3 == 0, " LOW").when(n % 3 == 1, "high ").otherwise("?")
    track = F.when(n % 2 == 0, -1).otherwise(4)
    return d.fx_csv.select(
        "line", N.tolerant_double(num).alias("number"), N.tolerant_int(num).alias("whole"), X.team_side(side).alias("side"), X.role(role).alias("role"),
        X.jersey((n % 150).cast("string")).alias("jersey"), X.risk_band(band).alias("band"), X.object_class(role, F.lit(""), track).alias("class"),
    )


@query("resolution_text", "X26", """
SELECT video_id, CASE video_id % 3 WHEN 0 THEN '1280x720' WHEN 1 THEN concat(1000 + video_id % 920, 'x', 720) END AS resolution FROM fx_videos""")
def _(d):
    k = F.col("video_id") % 3
    r = X.resolution(F.when(k == 0, " 1280x720 ").when(k == 2, " "), F.when(k == 1, F.lit(1000) + F.col("video_id") % 920), F.when(k == 1, F.lit(720)))
    return d.fx_videos.select("video_id", r.alias("resolution"))


@query("plausible_rate", "P15 X31", f"""
WITH s AS (SELECT part_id, track_id, video_id, distance_km * 40 AS km, coalesce(visible_minutes - 20, minutes_played - 20) AS base, CASE WHEN part_id % 9 = 0 THEN 120e0 END AS given FROM fx_fragments),
r AS (SELECT *, coalesce(given, CASE WHEN base > 0 THEN km * 1000 / base END) AS rate FROM s)
SELECT part_id, track_id, video_id, {rnd('CASE WHEN NOT coalesce(base < 1, FALSE) AND NOT coalesce(rate > 300, FALSE) THEN rate END', 4)} AS rate,
  CASE WHEN rate IS NOT NULL AND base < 1 THEN 'clip too short for a rate' WHEN rate > 300 THEN 'rate out of range' END AS note FROM r""")
def _(d):
    f = d.fx_fragments.withColumns(
        {"visible": F.col("visible_minutes") - 20, "minutes": F.col("minutes_played") - 20, "given": F.when(F.col("part_id") % 9 == 0, 120.0)}
    )
    value, note = G.plausible_rate(F.col("distance_km") * 40, X.first_of("visible", "minutes"), F.col("given"))
    return f.select("part_id", "track_id", "video_id", N.stable_round(value, 4).alias("rate"), note.alias("note"))


@query("row_normalisation", "X31 X30", f"""
SELECT part_id, track_id, video_id, coalesce(top_speed_kmh, {rnd('top_speed_mph * 1.609344e0', 2)}) AS kmh, {rnd('coalesce(distance_m, distance_km * 1000)', 2)} AS metres,
  CASE WHEN coverage_pct IS NOT NULL THEN least(100e0, greatest(0e0, coverage_pct)) END AS coverage, avg_pitch_x IS NOT NULL AS placed FROM fx_fragments""")
def _(d):
    from ..operators.stats import position_struct

    return d.fx_fragments.select(
        "part_id", "track_id", "video_id", F.coalesce("top_speed_kmh", N.kmh_from_mph(F.col("top_speed_mph"))).alias("kmh"),
        N.stable_round(F.coalesce(F.col("distance_m"), F.col("distance_km") * 1000), 2).alias("metres"),
        F.when(F.col("coverage_pct").isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("coverage_pct")))).alias("coverage"),
        position_struct(F.col("avg_pitch_x"), F.col("avg_pitch_y")).isNotNull().alias("placed"),
    )


@query("reading_quality", "X32", """
SELECT event_id, track_id, confidence >= 0.4 AND event_id % 60 >= 20 AND event_id % 50 >= 30 AS legible FROM fx_detections""")
def _(d):
    q = G.legible(F.col("confidence") * 100, F.lit(40), F.col("event_id") % 60, F.when(F.col("event_id") % 50 >= 1, F.col("event_id") % 50))
    return d.fx_detections.select("event_id", "track_id", q.alias("legible"))


@query("encrypted_fields", "X27", """
SELECT log_id, heart_rate, CASE WHEN heart_rate IS NOT NULL THEN TRUE END AS tamper_detected, heart_rate IS NULL OR TRUE AS wrong_key_fails,
  CASE WHEN heart_rate IS NOT NULL THEN CAST(28 + length(CASE WHEN heart_rate >= 100 THEN '100.0' ELSE '10.0' END) AS BIGINT) END AS raw_bytes FROM fx_logs""")
def _(d):
    key = F.unhex(F.sha2(F.lit("matchlake sample key"), 256))
    other = F.unhex(F.sha2(F.lit("another key"), 256))
    # the nonce is random: fix the ciphertext before it is used more than once
    enc = d.fx_logs.select("log_id", E.encrypt_number(F.col("heart_rate"), key).alias("c"))
    flipped = F.concat(F.translate(F.substring("c", 1, 30), "ABCDEFabcdef0123", "BCDEFAbcdefa1230"), F.substring("c", F.lit(31), F.length("c")))
    return enc.select(
        "log_id", E.decrypt_number(F.col("c"), key).alias("heart_rate"),
        F.when(F.col("c").isNotNull(), E.decrypt(flipped, key).isNull() | (flipped == F.col("c"))).alias("tamper_detected"),
        E.decrypt(F.col("c"), other).isNull().alias("wrong_key_fails"),
        F.length(F.unbase64("c")).cast("bigint").alias("raw_bytes"),
    )
