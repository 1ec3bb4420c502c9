from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ball as B, gaps as G
from .registry import query, rnd

FPS = 10.0
P = "PARTITION BY video_id, track_id"


@query("gap_interpolation", "W12 J13", f"""
WITH n AS (SELECT *, lead(frame) OVER w AS nf, lead(cx) OVER w AS nx, lead(cy) OVER w AS ny FROM fx_gaps
  WINDOW w AS ({P} ORDER BY frame)),
m AS (SELECT *, unnest(generate_series(frame + 1, nf - 1)) AS j FROM n WHERE nf - frame - 1 BETWEEN 1 AND 2)
SELECT video_id, track_id, frame, cx, cy, FALSE AS is_interpolated FROM fx_gaps
UNION ALL SELECT video_id, track_id, j AS frame, round(cx * (1 - (j - frame) / (nf - frame)) + nx * ((j - frame) / (nf - frame)), 6) AS cx,
  round(cy * (1 - (j - frame) / (nf - frame)) + ny * ((j - frame) / (nf - frame)), 6) AS cy, TRUE AS is_interpolated FROM m""")
def _(d):
    out = G.interpolate(d.fx_gaps, ["cx", "cy"], max_gap=2)
    return out.withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


@query("gap_extrapolation", "W13", f"""
WITH n AS (SELECT *, lead(frame) OVER w AS nf, lag(frame) OVER w AS pf, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM fx_gaps
  WINDOW w AS ({P} ORDER BY frame)),
l AS (SELECT video_id AS v, track_id AS k, max(frame) + 4 AS last_frame FROM fx_detections GROUP BY ALL),
m AS (SELECT *, unnest(generate_series(1, least(coalesce(nf - 1, last_frame) - frame, 10))) AS j FROM n JOIN l ON v = video_id AND k = track_id
  WHERE pf IS NOT NULL)
SELECT video_id, track_id, frame + j AS frame, round(cx + (cx - px) / (frame - pf) * j, 6) AS cx, round(cy + (cy - py) / (frame - pf) * j, 6) AS cy FROM m""")
def _(d):
    last = d.fx_detections.groupBy("video_id", "track_id").agg((F.max("frame") + 4).alias("last_frame"))
    return G.extrapolate(d.fx_gaps, last).withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


@query("densified_frames", "W26", """
WITH t AS (SELECT video_id, track_id, max(f) + CASE WHEN track_id % 2 = 0 THEN 6 ELSE -5 END AS total FROM fx_frames GROUP BY video_id, track_id),
k AS (SELECT * FROM fx_frames WHERE state <> 'lost'),
s AS (SELECT t.video_id, t.track_id, greatest(max(total), max(f) + 1) AS n FROM t JOIN k USING (video_id, track_id) GROUP BY t.video_id, t.track_id),
p AS (SELECT video_id, track_id, unnest(generate_series(0, n - 1)) AS f FROM s)
SELECT video_id, track_id, f, coalesce(t, round(f / 10e0, 3)) AS t, coalesce(state, 'lost') AS state, conf
FROM p LEFT JOIN k USING (video_id, track_id, f)""")
def _(d):
    totals = d.fx_frames.groupBy("video_id", "track_id").agg(
        (F.max("f") + F.when(F.col("track_id") % 2 == 0, 6).otherwise(-5)).alias("total")
    )
    return G.densify(d.fx_frames.where("state <> 'lost'"), totals, FPS)


SEG = f"""
s1 AS (SELECT *, CASE WHEN lag(state) OVER w = state AND lag(f) OVER w = f - 1 THEN 0 ELSE 1 END AS fresh FROM fx_frames WINDOW w AS ({P} ORDER BY f)),
s2 AS (SELECT *, sum(fresh) OVER ({P} ORDER BY f) AS seg FROM s1),
segs AS (SELECT video_id, track_id, any_value(state) AS state, min(f) AS start, max(f) AS "end", count(*) AS n FROM s2 GROUP BY video_id, track_id, seg)"""


@query("state_segments", "W19", "WITH " + SEG + "SELECT * FROM segs")
def _(d):
    return G.segments(d.fx_frames)


@query("lost_segments", "W20", "WITH " + SEG + "SELECT video_id, track_id, start, \"end\" FROM segs WHERE state = 'lost'")
def _(d):
    return G.lost_segments(d.fx_frames)


SUPPLIED = """sup AS (SELECT video_id, track_id, f - 2 AS start, f + 3 AS "end" FROM fx_frames WHERE f % 17 = 1)"""


@query("lost_interval_union", "W21", "WITH " + SEG + "," + SUPPLIED + f""",
tot AS (SELECT video_id, track_id, max(f) + 1 AS total FROM fx_frames GROUP BY ALL),
i AS (SELECT video_id, track_id, start, "end" FROM segs WHERE state = 'lost'
  UNION ALL SELECT video_id, track_id, greatest(0, start), least("end", total - 1) FROM sup JOIN tot USING (video_id, track_id) WHERE start < total),
r AS (SELECT *, max("end") OVER ({P} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN start <= reach + 1 THEN 0 ELSE 1 END) OVER ({P} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT video_id, track_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY video_id, track_id, island""")
def _(d):
    supplied = d.fx_frames.where("f % 17 = 1").select(
        "video_id", "track_id", (F.col("f") - 2).alias("start"), (F.col("f") + 3).alias("end")
    )
    totals = d.fx_frames.groupBy("video_id", "track_id").agg((F.max("f") + 1).alias("total"))
    return G.lost_runs(d.fx_frames, supplied, totals)


REACQ = f"""
q1 AS (SELECT *, lag(state) OVER ({P} ORDER BY f) AS prev FROM fx_frames WHERE state <> 'occluded'),
q2 AS (SELECT video_id, track_id, count(*) AS n FROM q1 WHERE prev = 'lost' AND state = 'tracked' GROUP BY ALL),
reacq AS (SELECT DISTINCT f.video_id, f.track_id, coalesce(n, 0) AS reacquisitions FROM fx_frames f LEFT JOIN q2
  ON q2.video_id = f.video_id AND q2.track_id = f.track_id)"""


@query("reacquisition_events", "W22", "WITH " + REACQ + "SELECT * FROM reacq")
def _(d):
    return G.reacquisitions(d.fx_frames)


@query("track_quality_summary", "A30", """
SELECT video_id, track_id, count(*) AS frames, count(*) FILTER (WHERE state = 'tracked') AS tracked_frames,
  count(*) FILTER (WHERE state = 'occluded') AS occluded_frames, count(*) FILTER (WHERE state = 'lost') AS lost_frames,
  """ + rnd("count(*) FILTER (WHERE state <> 'lost') / count(*) * 100", 1) + """ AS coverage_pct,
  """ + rnd("avg(conf) FILTER (WHERE state = 'tracked')", 3) + """ AS avg_conf FROM fx_frames GROUP BY video_id, track_id""")
def _(d):
    return G.track_summary(d.fx_frames)


@query("replay_summary", "W23", "WITH " + SEG + "," + REACQ + """,
a AS (SELECT video_id, track_id, count(*) AS frames, count(*) FILTER (WHERE state = 'tracked') / count(*) * 100 AS tp,
  avg(conf) FILTER (WHERE state <> 'lost') AS ac FROM fx_frames GROUP BY ALL),
b AS (SELECT video_id, track_id, count(*) FILTER (WHERE state = 'occluded') AS occluded_segments,
  count(*) FILTER (WHERE state = 'lost') AS lost_segments, coalesce(max(n) FILTER (WHERE state = 'lost'), 0) AS longest_lost FROM segs GROUP BY ALL)
SELECT video_id, track_id, frames, round(CASE WHEN track_id % 4 = 0 THEN 77.5e0 ELSE tp END, 6) AS tracked_pct, round(ac, 6) AS avg_conf,
  occluded_segments, lost_segments, longest_lost, longest_lost / 10e0 AS longest_lost_s,
  CASE WHEN track_id % 4 = 0 AND track_id % 8 = 0 THEN 9 ELSE reacquisitions END AS reacquisitions
FROM a JOIN b USING (video_id, track_id) JOIN reacq USING (video_id, track_id)""")
def _(d):
    server = d.fx_frames.where("track_id % 4 = 0").select("video_id", "track_id").distinct().select(
        "*", F.lit(77.5).alias("server_coverage_pct"), F.lit(None).cast("double").alias("server_avg_conf"),
        F.when(F.col("track_id") % 8 == 0, F.lit(9)).cast("bigint").alias("server_reacquisitions"),
    )
    out = G.replay_summary(d.fx_frames, FPS, server)
    return out.withColumns({c: F.round(c, 6) for c in ("tracked_pct", "avg_conf")})


UNION = f"""
tot AS (SELECT video_id, track_id, max(f) + 1 AS total FROM fx_frames GROUP BY ALL),
i AS (SELECT video_id, track_id, start, "end" FROM segs WHERE state = 'lost'
  UNION ALL SELECT video_id, track_id, greatest(0, start), least("end", total - 1) FROM sup JOIN tot USING (video_id, track_id) WHERE start < total),
r AS (SELECT *, max("end") OVER ({P} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN start <= reach + 1 THEN 0 ELSE 1 END) OVER ({P} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r),
un AS (SELECT video_id, track_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY video_id, track_id, island)"""


def supplied(d):
    return d.fx_frames.where("f % 17 = 1").select("video_id", "track_id", (F.col("f") - 2).alias("start"), (F.col("f") + 3).alias("end"))


@query("replay_summary_supplied", "W23", "WITH " + SEG + "," + SUPPLIED + "," + UNION + """,
k AS (SELECT video_id, track_id, count(*) AS known FROM sup GROUP BY ALL),
o AS (SELECT video_id, track_id, count(*) FILTER (WHERE state = 'lost') AS own FROM segs GROUP BY ALL),
l AS (SELECT video_id, track_id, max("end" - start + 1) AS longest FROM un GROUP BY ALL)
SELECT video_id, track_id, coalesce(known, own) AS lost_segments, coalesce(longest, 0) AS longest_lost, coalesce(longest, 0) / 10e0 AS longest_lost_s
FROM o LEFT JOIN k USING (video_id, track_id) LEFT JOIN l USING (video_id, track_id)""")
def _(d):
    out = G.replay_summary(d.fx_frames, FPS, supplied=supplied(d))
    return out.select("video_id", "track_id", "lost_segments", "longest_lost", "longest_lost_s")


@query("track_issues_supplied", "W24", "WITH " + SEG + "," + SUPPLIED + "," + UNION + f""",
i1 AS (SELECT *, CASE WHEN state = 'lost' OR EXISTS (SELECT 1 FROM un WHERE un.video_id = fr.video_id AND un.track_id = fr.track_id AND fr.f BETWEEN un.start AND un."end") THEN 'lost'
  WHEN state = 'occluded' THEN 'occluded' WHEN conf < 0.5 THEN 'low' END AS kind FROM fx_frames fr),
i2 AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(f) OVER w = f - 1 THEN 0 ELSE 1 END AS fresh FROM i1 WHERE kind IS NOT NULL WINDOW w AS ({P} ORDER BY f)),
i3 AS (SELECT *, sum(fresh) OVER ({P} ORDER BY f) AS seg FROM i2)
SELECT video_id, track_id, any_value(kind) AS kind, min(f) AS start, max(f) AS "end" FROM i3 GROUP BY video_id, track_id, seg""")
def _(d):
    return G.issues(d.fx_frames, FPS, supplied=supplied(d)).select("video_id", "track_id", "kind", "start", "end")


ISSUES = f"""
i1 AS (SELECT *, CASE WHEN state = 'lost' THEN 'lost' WHEN state = 'occluded' THEN 'occluded' WHEN conf < 0.5 THEN 'low' END AS kind FROM fx_frames),
i2 AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(f) OVER w = f - 1 THEN 0 ELSE 1 END AS fresh FROM i1 WHERE kind IS NOT NULL WINDOW w AS ({P} ORDER BY f)),
i3 AS (SELECT *, sum(fresh) OVER ({P} ORDER BY f) AS seg FROM i2),
iss AS (SELECT video_id, track_id, any_value(kind) AS kind, min(f) AS start, max(f) AS "end" FROM i3 GROUP BY video_id, track_id, seg HAVING count(*) >= 2)"""


@query("track_issues", "W24", "WITH " + ISSUES + """
SELECT video_id, track_id, kind, start, "end", start / 10e0 AS start_t, ("end" + 1) / 10e0 AS end_t FROM iss""")
def _(d):
    return G.issues(d.fx_frames, FPS, min_frames=2)


@query("next_previous_issue", "W25", "WITH " + ISSUES + """
SELECT q.video_id, q.track_id, q.f, (SELECT max("end") FROM iss i WHERE i.video_id = q.video_id AND i.track_id = q.track_id AND "end" < q.f) AS prev_end,
  (SELECT min(start) FROM iss i WHERE i.video_id = q.video_id AND i.track_id = q.track_id AND start > q.f) AS next_start
FROM fx_frames q WHERE f % 5 = 0""")
def _(d):
    at = d.fx_frames.where("f % 5 = 0").select("video_id", "track_id", "f")
    return G.next_and_previous_issue(G.issues(d.fx_frames, FPS, min_frames=2), at)


@query("box_trail", "W27", f"""
SELECT video_id, track_id, f, count(*) FILTER (WHERE state <> 'lost') OVER w AS points,
  round(coalesce(sum(cx) FILTER (WHERE state <> 'lost') OVER w, 0), 6) AS sum_x FROM fx_frames
WINDOW w AS ({P} ORDER BY f ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def _(d):
    frames = d.fx_frames.select(
        "video_id", "track_id", "f", F.when(F.col("state") != "lost", F.col("cx")).alias("x"), F.col("cy").alias("y")
    )
    t = G.trail(frames, FPS)
    return t.select(
        "video_id", "track_id", "f", F.size("trail").cast("bigint").alias("points"),
        F.round(F.aggregate("trail", F.lit(0.0), lambda a, p: a + p["x"]), 6).alias("sum_x"),
    )


@query("clip_fps", "A33", """
SELECT video_id, round(max_by(frame, (frame, t)) / max_by(t, (frame, t)), 2) AS fps FROM fx_detections GROUP BY video_id""")
def _(d):
    return G.clip_fps(d.fx_detections)


@query("frame_slice", "P16 X7", """
SELECT video_id, track_id, f, state FROM fx_frames WHERE f BETWEEN 12 AND 30""")
def _(d):
    return d.fx_frames.where(F.col("f").between(12, 30)).select("video_id", "track_id", "f", "state")


@query("frame_time_mapping", "X7", """
SELECT video_id, track_id, f, least(greatest(CAST(floor(t * 1.07e0 * 10 + 0.5) AS BIGINT), 0), 59) AS mapped FROM fx_frames""")
def _(d):
    mapped = F.least(F.greatest(F.floor(F.col("t") * 1.07 * 10 + 0.5), F.lit(0)), F.lit(59))
    return d.fx_frames.select("video_id", "track_id", "f", mapped.alias("mapped"))


@query("clean_lost_segments", "X33", """
SELECT video_id, track_id, f, CASE WHEN f % 4 = 0 OR f + 3 >= 60 THEN NULL ELSE 2 END AS kept, CASE WHEN f % 4 = 0 OR f + 3 >= 60 THEN NULL ELSE 0 END AS first_start
FROM fx_frames""")
def _(d):
    f = F.col("f")
    segs = F.array(F.array(f, F.when(f % 4 == 0, f - 1).otherwise(f + 3)), F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))
    c = d.fx_frames.select("video_id", "track_id", "f", G.clean_segments(segs, F.lit(60)).alias("c"))
    return c.select(
        "video_id", "track_id", "f", F.when(F.col("c").isNotNull(), F.size("c")).cast("bigint").alias("kept"),
        F.col("c")[0][0].alias("first_start"),
    )


@query("ball_filter", "G3 W14", """
WITH RECURSIVE z AS (SELECT video_id, track_id, CAST(frame AS BIGINT) AS frame, cx, cy FROM fx_gaps),
ends AS (SELECT video_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame FROM z GROUP BY ALL),
b AS (
  SELECT z.video_id, z.track_id, z.frame, last_frame, cx AS px, 0e0 AS vx, cy AS py, 0e0 AS vy, 1000e0 AS p, 0e0 AS r, 1000e0 AS v, cx AS lx, cy AS ly, cx AS ox, cy AS oy, TRUE AS is_detected, FALSE AS gated
  FROM z JOIN ends e ON e.video_id = z.video_id AND e.track_id = z.track_id AND e.first_frame = z.frame
  UNION ALL
  SELECT video_id, track_id, frame, last_frame, CASE WHEN ok THEN px + k0 * (cx - px) ELSE px END, CASE WHEN ok THEN vx + k1 * (cx - px) ELSE vx END,
    CASE WHEN ok THEN py + k0 * (cy - py) ELSE py END, CASE WHEN ok THEN vy + k1 * (cy - py) ELSE vy END,
    CASE WHEN ok THEN (1 - k0) * (1 - k0) * p + 25e0 * k0 * k0 ELSE p END, CASE WHEN ok THEN (1 - k0) * (r - k1 * p) + 25e0 * k0 * k1 ELSE r END,
    CASE WHEN ok THEN v - 2e0 * k1 * r + k1 * k1 * p + 25e0 * k1 * k1 ELSE v END, CASE WHEN ok THEN cx ELSE lx END, CASE WHEN ok THEN cy ELSE ly END,
    CASE WHEN ok THEN cx ELSE px END, CASE WHEN ok THEN cy ELSE py END, ok, cx IS NOT NULL AND NOT ok
  FROM (SELECT *, p / (p + 25e0) AS k0, r / (p + 25e0) AS k1, cx IS NOT NULL AND sqrt((cx - lx) * (cx - lx) + (cy - ly) * (cy - ly)) <= 140e0 AS ok
    FROM (SELECT b.video_id, b.track_id, b.frame + 1 AS frame, b.last_frame, px + 0.1e0 * vx AS px, vx, py + 0.1e0 * vy AS py, vy,
        p + 0.2e0 * r + 0.01e0 * v + 0.0125e0 AS p, r + 0.1e0 * v + 0.25e0 AS r, v + 5e0 AS v, lx, ly, z.cx, z.cy
      FROM b LEFT JOIN z ON z.video_id = b.video_id AND z.track_id = b.track_id AND z.frame = b.frame + 1 WHERE b.frame < b.last_frame)))
SELECT video_id, track_id, frame, round(ox, 6) AS cx, round(oy, 6) AS cy, is_detected, gated FROM b""")
def _(d):
    return B.smooth_ball(d.fx_gaps, FPS).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})
