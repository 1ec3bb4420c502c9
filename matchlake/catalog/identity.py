from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaps as G, identity as D, target as TG, trajectory as T
from ..plans.materialize import reuse
from .registry import query, rnd

P = "PARTITION BY video_id, track_id"


@query("majority_jersey", "A11 A12", """
WITH n AS (SELECT video_id, track_id, jersey, count(*) AS n, min(frame) AS f FROM fx_detections WHERE jersey IS NOT NULL GROUP BY ALL)
SELECT video_id, track_id, jersey, readings FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY video_id, track_id) AS BIGINT) AS readings,
  row_number() OVER (PARTITION BY video_id, track_id ORDER BY n DESC, f) AS rn FROM n) WHERE rn = 1 AND readings >= 3""")
def _(d):
    return D.majority_vote(d.fx_detections, "jersey", min_readings=3)


def roster(d):
    p = d.fx_detections.select(F.col("team").cast("bigint").alias("team"), F.col("true_jersey").alias("jersey")).distinct()
    return p.where("jersey % 4 <> 0")


@query("weighted_jersey", "A13", """
WITH n AS (SELECT video_id, track_id, jersey, count(*) AS n, CAST(sum(CAST(confidence AS DECIMAL(20, 6))) AS DOUBLE) AS w, min(frame) AS f FROM fx_detections WHERE jersey IS NOT NULL GROUP BY ALL),
r AS (SELECT video_id, track_id, sum(n) AS readings FROM n GROUP BY ALL HAVING sum(n) >= 3)
SELECT video_id, track_id, jersey, w AS weight, CAST(readings AS BIGINT) AS readings FROM (SELECT n.*, readings, row_number() OVER (PARTITION BY n.video_id, n.track_id ORDER BY w DESC, f) AS rn
  FROM n JOIN r ON r.video_id = n.video_id AND r.track_id = n.track_id) WHERE rn = 1""")
def _(d):
    return D.weighted_vote(d.fx_detections)


@query("weighted_jersey_in_roster", "A13", """
WITH tn AS (SELECT video_id, track_id, team, count(*) AS n, min(frame) AS f FROM fx_detections WHERE team IS NOT NULL GROUP BY ALL),
tt AS (SELECT video_id, track_id, team FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY n DESC, f) AS rn FROM tn) WHERE rn = 1),
ro AS (SELECT DISTINCT team, true_jersey AS jersey FROM fx_detections WHERE true_jersey % 4 <> 0),
rd AS (SELECT d.video_id, d.track_id, d.jersey, d.confidence, d.frame FROM fx_detections d JOIN tt ON tt.video_id = d.video_id AND tt.track_id = d.track_id
  JOIN ro ON ro.team = tt.team AND ro.jersey = d.jersey),
n AS (SELECT video_id, track_id, jersey, count(*) AS n, CAST(sum(CAST(confidence AS DECIMAL(20, 6))) AS DOUBLE) AS w, min(frame) AS f FROM rd GROUP BY ALL),
r AS (SELECT video_id, track_id, sum(n) AS readings FROM n GROUP BY ALL HAVING sum(n) >= 3)
SELECT video_id, track_id, jersey, w AS weight, CAST(readings AS BIGINT) AS readings FROM (SELECT n.*, readings, row_number() OVER (PARTITION BY n.video_id, n.track_id ORDER BY w DESC, f) AS rn
  FROM n JOIN r ON r.video_id = n.video_id AND r.track_id = n.track_id) WHERE rn = 1""")
def _(d):
    return D.weighted_vote(d.fx_detections, roster=roster(d))


IDENT = """
n AS (SELECT video_id, track_id, jersey, count(*) AS n, min(frame) AS f FROM fx_detections WHERE jersey IS NOT NULL GROUP BY ALL),
vj AS (SELECT video_id, track_id, jersey FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY n DESC, f) AS rn FROM n) WHERE rn = 1),
m AS (SELECT video_id, track_id, team, count(*) AS n, min(frame) AS f FROM fx_detections GROUP BY ALL),
vt AS (SELECT video_id, track_id, team FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY n DESC, f) AS rn FROM m) WHERE rn = 1),
ident AS (SELECT d.video_id, d.track_id, CASE WHEN d.track_id % 6 = 0 THEN 9 ELSE vj.jersey END AS jersey, vt.team, role
  FROM (SELECT DISTINCT video_id, track_id, role FROM fx_detections) d LEFT JOIN vj ON vj.video_id = d.video_id AND vj.track_id = d.track_id
  LEFT JOIN vt ON vt.video_id = d.video_id AND vt.track_id = d.track_id)"""


def ident(d):
    own = d.fx_detections.where("track_id % 6 = 0").select(
        "video_id", "track_id", F.lit(9).cast("bigint").alias("jersey"), F.lit(None).cast("bigint").alias("team"), F.lit(None).cast("string").alias("role")
    ).distinct()
    return D.track_identity(d.fx_detections.withColumn("team", F.col("team").cast("bigint")), own)


@query("track_identity", "A11 P8", "WITH " + IDENT + "SELECT * FROM ident")
def _(d):
    return ident(d)


@query("player_resolution", "J6", "WITH " + IDENT + """,
t AS (SELECT video_id, track_id, jersey, CASE WHEN track_id % 5 = 0 THEN NULL WHEN team = 0 THEN 'home' ELSE 'away' END AS side, video_id % 25 AS h, (video_id + 7) % 25 AS a
  FROM ident WHERE role <> 'referee'),
r AS (SELECT team_id, jersey, max(player_id) AS pid FROM fx_players GROUP BY ALL),
j AS (SELECT t.*, x.pid AS hp, y.pid AS ap FROM t LEFT JOIN r x ON x.team_id = h AND x.jersey = t.jersey LEFT JOIN r y ON y.team_id = a AND y.jersey = t.jersey),
f AS (SELECT *, CASE side WHEN 'home' THEN hp WHEN 'away' THEN ap ELSE coalesce(hp, ap) END AS pid FROM j)
SELECT video_id, track_id, pid AS player_id, CASE WHEN pid IS NULL THEN CASE WHEN side = 'away' THEN a ELSE h END END AS placeholder_team_id,
  CASE WHEN pid IS NULL THEN CASE WHEN jersey IS NOT NULL THEN concat('#', jersey) ELSE concat('Track ', track_id, ' (video ', video_id, ')') END END AS placeholder_name FROM f""")
def _(d):
    t = ident(d).withColumn(
        "side", F.when(F.col("track_id") % 5 != 0, F.when(F.col("team") == 0, "home").otherwise("away"))
    )
    v = d.fx_detections.select("video_id").distinct().select(
        "video_id", (F.col("video_id") % 25).alias("home_team_id"), ((F.col("video_id") + 7) % 25).alias("away_team_id")
    )
    return D.resolve_players(t, v, d.fx_players)


SHIFT = """b AS (SELECT video_id, frame, track_id AS rid, sx1, sy1, sx2, sy2 FROM fx_boxes),
p AS (SELECT x.video_id, x.frame, x.track_id, rid, greatest(0, least(x2, b.sx2) - greatest(x1, b.sx1)) * greatest(0, least(y2, b.sy2) - greatest(y1, b.sy1)) AS inter
  FROM fx_boxes x JOIN b ON b.video_id = x.video_id AND b.frame = x.frame),
q AS (SELECT *, CASE WHEN inter > 0 THEN inter / (3600 + 3600 - inter) ELSE 0e0 END AS iou FROM p)"""


def shifted(d):
    return d.fx_boxes.select("video_id", "frame", F.col("track_id").alias("rid"), *[F.col(f"s{c}").alias(c) for c in D.BOX])


@query("box_overlap_match", "J8 X4", "WITH " + SHIFT + """
SELECT video_id, frame, track_id, rid AS matched_id, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame, track_id ORDER BY iou DESC, rid) AS rn FROM q WHERE iou >= 0.5)
WHERE rn = 1""")
def _(d):
    left = d.fx_boxes.select("video_id", "frame", "track_id", *D.BOX)
    return D.best_overlap(left, shifted(d), ["video_id", "frame"], "rid").withColumn("iou", F.round("iou", 6))


@query("best_box_per_frame", "G11", """
SELECT video_id, frame, track_id, x1, y1, x2, y2, confidence FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY confidence DESC, track_id) AS rn FROM fx_boxes) WHERE rn = 1""")
def _(d):
    b = d.fx_boxes.select("video_id", "frame", "track_id", "x1", "y1", "x2", "y2", "confidence")
    return D.best_box_per_frame(b, ["video_id", "frame"])


@query("stitch_candidates", "J12 X10", """
SELECT a.video_id, a.track_id AS a, b.track_id AS b, round((CASE WHEN a.jersey = b.jersey THEN -10 ELSE 0 END) + (CASE WHEN a.team = b.team THEN -5 ELSE 0 END) + (b.first_t - a.last_t) / 10, 6) AS cost
FROM fx_tracklets a JOIN fx_tracklets b ON a.video_id = b.video_id AND b.first_frame > a.last_frame AND coalesce(a.team = b.team, TRUE) AND coalesce(a.jersey = b.jersey, TRUE)
  AND b.first_t > a.last_t AND sqrt((b.first_x - a.last_x) * (b.first_x - a.last_x) + (b.first_y - a.last_y) * (b.first_y - a.last_y)) <= 12 * (b.first_t - a.last_t)
WHERE (CASE WHEN a.jersey = b.jersey THEN -10 ELSE 0 END) + (CASE WHEN a.team = b.team THEN -5 ELSE 0 END) + (b.first_t - a.last_t) / 10 <= 10""")
def _(d):
    return D.stitch_candidates(d.fx_tracklets).withColumn("cost", F.round("cost", 6))


@query("stitched_players", "G1", """
WITH RECURSIVE e AS (SELECT a.video_id, a.track_id AS a, b.track_id AS b, (CASE WHEN a.jersey = b.jersey THEN -10 ELSE 0 END) + (CASE WHEN a.team = b.team THEN -5 ELSE 0 END) + (b.first_t - a.last_t) / 10 AS cost
  FROM fx_tracklets a JOIN fx_tracklets b ON a.video_id = b.video_id AND b.first_frame > a.last_frame AND coalesce(a.team = b.team, TRUE) AND coalesce(a.jersey = b.jersey, TRUE)
    AND b.first_t > a.last_t AND sqrt((b.first_x - a.last_x) * (b.first_x - a.last_x) + (b.first_y - a.last_y) * (b.first_y - a.last_y)) <= 12 * (b.first_t - a.last_t)),
ways AS (SELECT video_id, a, list(b ORDER BY cost, b) AS ways FROM e WHERE cost <= 10 GROUP BY video_id, a),
heads AS (SELECT video_id, list(track_id ORDER BY first_frame, track_id) AS heads FROM fx_tracklets GROUP BY video_id),
walk AS (
  SELECT video_id, heads, heads[1] AS here, [heads[1]] AS seen, CAST(0 AS BIGINT) AS player_uid FROM heads
  UNION ALL
  SELECT n.video_id, n.heads, coalesce(n.way, n.head) AS here, list_append(n.seen, coalesce(n.way, n.head)) AS seen, n.player_uid + CASE WHEN n.way IS NULL THEN 1 ELSE 0 END AS player_uid
  FROM (SELECT g.*, list_filter(coalesce(w.ways, []), lambda x: NOT list_contains(g.seen, x))[1] AS way, list_filter(g.heads, lambda x: NOT list_contains(g.seen, x))[1] AS head
        FROM walk g LEFT JOIN ways w ON w.video_id = g.video_id AND w.a = g.here) n
  WHERE n.head IS NOT NULL)
SELECT video_id, here AS track_id, player_uid FROM walk""")
def _(d):
    return D.stitch(d.fx_tracklets)


@query("stats_per_stitched_player", "A20", """
WITH s AS (SELECT video_id, track_id, jersey, part_id, distance_km, top_speed_mph, coverage_pct, minutes_played, CAST(sprint_count AS BIGINT) AS sprint_count, track_id % 3 AS player_uid, injury_risk FROM fx_fragments),
n AS (SELECT video_id, player_uid, jersey, count(*) AS n, min(track_id) AS f FROM (SELECT * FROM s WHERE jersey IS NOT NULL) GROUP BY ALL),
v AS (SELECT video_id, player_uid, jersey FROM (SELECT *, row_number() OVER (PARTITION BY video_id, player_uid ORDER BY n DESC, f) AS rn FROM n) WHERE rn = 1)
SELECT s.video_id, s.player_uid, round(sum(distance_km), 6) AS distance_km, max(top_speed_mph) AS top_speed_mph, count(*) AS tracks, max(v.jersey) AS jersey,
  CAST(sum(sprint_count) AS BIGINT) AS sprint_count FROM s LEFT JOIN v ON v.video_id = s.video_id AND v.player_uid = s.player_uid GROUP BY s.video_id, s.player_uid""".replace(
    "track_id, jersey, part_id", "track_id, CASE WHEN part_id % 9 = 0 THEN NULL ELSE track_id // 2 END AS jersey, part_id"))
def _(d):
    s = d.fx_fragments.select(
        "video_id", "track_id", F.when(F.col("part_id") % 9 != 0, F.floor(F.col("track_id") / 2)).alias("jersey"), "distance_km", "top_speed_mph",
        "coverage_pct", "sprint_count", F.lit(0).alias("team"), F.lit("player").alias("role"),
    )
    mapping = s.select("video_id", "track_id").distinct().withColumn("player_uid", F.col("track_id") % 3)
    out = D.stats_per_uid(s, mapping)
    return out.select("video_id", "player_uid", F.round("distance_km", 6).alias("distance_km"), "top_speed_mph", "tracks", "jersey", "sprint_count")


@query("data_quality_warnings", "A34", """
WITH t AS (SELECT video_id, track_id, CASE WHEN video_id % 3 = 0 THEN 1 WHEN track_id % 4 = 0 THEN track_id END AS player_uid, CASE WHEN video_id % 2 = 0 THEN 1e0 END AS mph FROM (SELECT DISTINCT video_id, track_id FROM fx_detections)),
a AS (SELECT video_id, count(*) AS n, count(DISTINCT player_uid) AS u, count(player_uid) AS w, count(mph) AS s FROM t GROUP BY video_id)
SELECT video_id, concat_ws('; ', CASE WHEN u / n < 0.3 THEN 'few players for the number of tracks' END, CASE WHEN w / n < 0.5 THEN 'fewer than half of the tracks have a player' END,
  CASE WHEN s = 0 THEN 'no track has a speed' END) AS warnings FROM a""")
def _(d):
    t = d.fx_detections.select("video_id", "track_id").distinct().select(
        "video_id", "track_id",
        F.when(F.col("video_id") % 3 == 0, F.lit(1)).when(F.col("track_id") % 4 == 0, F.col("track_id")).alias("player_uid"),
        F.when(F.col("video_id") % 2 == 0, 1.0).alias("top_speed_mph"),
    )
    return D.quality_warnings(t).withColumn("warnings", F.array_join("warnings", "; "))


# ---- team colours ---------------------------------------------------------------------------------------------
def samples(d):
    """Several colour samples per track, spread around its colour."""
    k = F.explode(F.sequence(F.lit(0), F.lit(11)))
    c = d.fx_colours.withColumn("k", k)
    return c.select("video_id", "track_id", *[(F.col(x) + (F.col("k") * (i + 3)) % 7).alias(x) for i, x in enumerate(D.CHANNELS)])


def colours(d):
    return reuse(D.median_colours(samples(d)))


SAMPLES = """
smp AS (SELECT video_id, track_id, c1 + k * 3 % 7 AS c1, c2 + k * 4 % 7 AS c2, c3 + k * 5 % 7 AS c3 FROM fx_colours, (SELECT unnest(generate_series(0, 11)) AS k)),
col AS (SELECT video_id, track_id, quantile_cont(c1, 0.5) AS c1, quantile_cont(c2, 0.5) AS c2, quantile_cont(c3, 0.5) AS c3 FROM smp GROUP BY ALL)"""


def lloyd_sql(steps: int) -> str:
    out = """,
z0 AS MATERIALIZED (SELECT video_id, 0 AS cluster, min_by(c1, (c1, track_id)) AS c1, min_by(c2, (c1, track_id)) AS c2, min_by(c3, (c1, track_id)) AS c3 FROM col GROUP BY video_id
  UNION ALL SELECT video_id, 1, max_by(c1, (c1, track_id)), max_by(c2, (c1, track_id)), max_by(c3, (c1, track_id)) FROM col GROUP BY video_id)"""
    dist = "sqrt((col.c1 - {0}.c1) * (col.c1 - {0}.c1) + (col.c2 - {0}.c2) * (col.c2 - {0}.c2) + (col.c3 - {0}.c3) * (col.c3 - {0}.c3))"
    for i in range(steps):
        out += f""",
n{i} AS (SELECT col.*, {dist.format('a')} AS d0, {dist.format('b')} AS d1 FROM col JOIN z{i} a ON a.video_id = col.video_id AND a.cluster = 0 JOIN z{i} b ON b.video_id = col.video_id AND b.cluster = 1),
m{i} AS (SELECT video_id, CASE WHEN d1 < d0 THEN 1 ELSE 0 END AS cluster, avg(c1) AS c1, avg(c2) AS c2, avg(c3) AS c3 FROM n{i} GROUP BY ALL),
z{i + 1} AS MATERIALIZED (SELECT z.video_id, z.cluster, coalesce(m.c1, z.c1) AS c1, coalesce(m.c2, z.c2) AS c2, coalesce(m.c3, z.c3) AS c3 FROM z{i} z LEFT JOIN m{i} m ON m.video_id = z.video_id AND m.cluster = z.cluster)"""
    out += f""",
fin AS (SELECT col.*, {dist.format('a')} AS d0, {dist.format('b')} AS d1 FROM col JOIN z{steps} a ON a.video_id = col.video_id AND a.cluster = 0 JOIN z{steps} b ON b.video_id = col.video_id AND b.cluster = 1)"""
    return out


STEPS = 24  # the supplied tables settle in fewer
LLOYD = "WITH " + SAMPLES + lloyd_sql(STEPS)


@query("team_clusters", "G2", LLOYD + """
SELECT video_id, CAST(cluster AS BIGINT) AS cluster, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3 FROM z24""")
def _(d):
    z = D.team_clusters(colours(d))
    return z.select("video_id", F.col("cluster").cast("bigint"), *[F.round(c, 6).alias(c) for c in D.CHANNELS])


@query("team_assignment", "G4", LLOYD + """
SELECT video_id, track_id, CAST(CASE WHEN least(d0, d1) > (d0 + d1) / 2 + 1.5e0 * abs(d0 - d1) / 2 THEN NULL WHEN d1 < d0 THEN 1 ELSE 0 END AS BIGINT) AS team,
  CASE WHEN least(d0, d1) > (d0 + d1) / 2 + 1.5e0 * abs(d0 - d1) / 2 THEN 'referee' ELSE 'player' END AS role FROM fin""")
def _(d):
    c = colours(d)
    return D.assign_teams(c, D.team_clusters(c)).select("video_id", "track_id", F.col("team").cast("bigint"), "role")


@query("team_assignment_cohort", "G4", LLOYD + """,
s AS (SELECT *, least(d0, d1) AS nearest FROM fin), t AS (SELECT *, nearest > avg(nearest) OVER (PARTITION BY video_id) + 1.5e0 * stddev_pop(nearest) OVER (PARTITION BY video_id) AS far FROM s)
SELECT video_id, track_id, CAST(CASE WHEN far THEN NULL WHEN d1 < d0 THEN 1 ELSE 0 END AS BIGINT) AS team, CASE WHEN far THEN 'referee' ELSE 'player' END AS role FROM t""")
def _(d):
    c = colours(d)
    return D.assign_teams(c, D.team_clusters(c), cohort=True).select("video_id", "track_id", F.col("team").cast("bigint"), "role")


@query("team_vote", "G5", LLOYD + """,
v AS (SELECT s.video_id, s.track_id, CASE WHEN (s.c1 - b.c1) * (s.c1 - b.c1) + (s.c2 - b.c2) * (s.c2 - b.c2) + (s.c3 - b.c3) * (s.c3 - b.c3)
   < (s.c1 - a.c1) * (s.c1 - a.c1) + (s.c2 - a.c2) * (s.c2 - a.c2) + (s.c3 - a.c3) * (s.c3 - a.c3) THEN 1 ELSE 0 END AS cluster
  FROM smp s JOIN z24 a ON a.video_id = s.video_id AND a.cluster = 0 JOIN z24 b ON b.video_id = s.video_id AND b.cluster = 1),
w AS (SELECT video_id, track_id, cluster, count(*) AS n FROM v GROUP BY ALL)
SELECT video_id, track_id, CAST(arg_max(cluster, n) AS BIGINT) AS team, CAST(sum(n) AS BIGINT) AS total FROM w GROUP BY ALL HAVING sum(n) >= 10 AND max(n) / sum(n) > 0.7""")
def _(d):
    out = D.team_vote(samples(d), D.team_clusters(colours(d)))
    return out.withColumn("team", F.col("team").cast("bigint"))


@query("goalkeeper_rule", "G6", LLOYD + """,
pos AS (SELECT track_id, avg(x) AS mx, stddev_pop(x) AS sx FROM fx_detections GROUP BY track_id HAVING count(*) >= 10)
SELECT f.video_id, f.track_id, CAST(CASE WHEN d1 < d0 THEN 1 ELSE 0 END AS BIGINT) AS team, round(CASE WHEN d1 < d0 THEN d1 ELSE d0 END, 4) AS colour_distance
FROM fin f JOIN pos ON pos.track_id = f.track_id WHERE (mx < 20 OR mx > 85) AND sx < 15 AND CASE WHEN d1 < d0 THEN d1 ELSE d0 END > 20""")
def _(d):
    c = colours(d)
    z = reuse(D.team_clusters(c))
    # the colour and the position views number videos differently, so positions take the video of the colour view
    pos = d.fx_detections.select("track_id", "x").join(d.fx_colours.select("video_id", "track_id"), "track_id")
    g = D.goalkeepers(pos, D.assign_teams(c, z), c, z)
    return g.select("video_id", "track_id", F.col("team").cast("bigint"), F.round("colour_distance", 4).alias("colour_distance"))


@query("appearance_similarity", "X9", """
SELECT a.vec_id AS a, round((list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) + 1) / 2, 5) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(d):
    e = d.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("a"), F.round(D.cosine(F.col("v"), F.col("w")), 5).alias("similarity"))


# ---- following a player ---------------------------------------------------------------------------------------
REQ = "(SELECT video_id * 1000 + frame AS request_id, video_id, frame, cx - 12 AS tx1, cy - 40 AS ty1, cx + 28 AS tx2, cy + 50 AS ty2, cx + 15 AS px, cy + 30 AS py FROM fx_detections WHERE track_id % 20 = 3 AND frame % 2 = 0)"


def requests(d):
    r = d.fx_detections.where("track_id % 20 = 3 and frame % 2 = 0")
    return r.selectExpr(
        "video_id * 1000 + frame as request_id", "video_id", "frame", "cx - 12 as tx1", "cy - 40 as ty1", "cx + 28 as tx2", "cy + 50 as ty2",
        "cx + 15 as px", "cy + 30 as py",
    )


@query("target_by_box", "G7", f"""
WITH r AS {REQ},
o AS (SELECT request_id, track_id, greatest(0, least(x2, tx2) - greatest(x1, tx1)) * greatest(0, least(y2, ty2) - greatest(y1, ty1)) AS i FROM r JOIN fx_boxes b ON b.video_id = r.video_id AND b.frame = r.frame),
p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY i / (7200 - i) DESC, track_id) AS rn FROM o)
SELECT request_id, CASE WHEN i / (7200 - i) >= 0.3 THEN track_id END AS track_id, CASE WHEN i / (7200 - i) < 0.3 THEN 'no player matches the box' END AS error FROM p WHERE rn = 1""")
def _(d):
    return TG.resolve_by_box(requests(d).drop("px", "py"), d.fx_boxes.select("video_id", "frame", "track_id", *D.BOX))


@query("target_by_point", "G7", f"""
WITH r AS {REQ},
p AS (SELECT request_id, track_id, row_number() OVER (PARTITION BY request_id ORDER BY NOT (px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2),
  CASE WHEN px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 THEN 0 ELSE sqrt((px - (x1 + x2) / 2) * (px - (x1 + x2) / 2) + (py - (y1 + y2) / 2) * (py - (y1 + y2) / 2)) END, track_id) AS rn
  FROM r JOIN fx_boxes b ON b.video_id = r.video_id AND b.frame = r.frame)
SELECT request_id, track_id, CAST(NULL AS STRING) AS error FROM p WHERE rn = 1""")
def _(d):
    return TG.resolve_by_point(requests(d).select("request_id", "video_id", "frame", "px", "py"), d.fx_boxes.select("video_id", "frame", "track_id", *D.BOX))


TRACKS = "(SELECT DISTINCT video_id, track_id, true_jersey AS jersey, track_id % 2 AS team, track_id - track_id % 4 AS player_uid FROM fx_detections)"
JREQ = "(SELECT video_id * 100 + j AS request_id, video_id, j AS jersey, CASE WHEN j % 3 = 0 THEN CAST(1 AS BIGINT) END AS team FROM (SELECT DISTINCT video_id FROM fx_detections), (SELECT unnest(generate_series(1, 24)) AS j))"


def track_table(d):
    return d.fx_detections.select(
        "video_id", "track_id", F.floor(F.col("true_jersey") / 2).alias("jersey"), (F.col("track_id") % 2).alias("team"),
        (F.col("track_id") - F.col("track_id") % 4).alias("player_uid"),
    ).distinct()


def jersey_requests(d):
    v = d.fx_detections.select("video_id").distinct().withColumn("jersey", F.explode(F.sequence(F.lit(1), F.lit(24)).cast("array<bigint>")))
    return v.select((F.col("video_id") * 100 + F.col("jersey")).alias("request_id"), "video_id", "jersey", F.when(F.col("jersey") % 3 == 0, F.lit(1)).cast("bigint").alias("team"))


JERSEY = f"""
WITH t AS {TRACKS.replace('true_jersey AS jersey', 'true_jersey // 2 AS jersey')}, r AS {JREQ},
j AS (SELECT r.request_id, r.video_id, r.team AS want, t.* EXCLUDE (video_id), t.track_id IS NOT NULL AND (r.team IS NULL OR r.team = t.team) AS ok FROM r LEFT JOIN t ON t.video_id = r.video_id AND t.jersey = r.jersey),
g AS (SELECT request_id, count(track_id) AS numbered, count(*) FILTER (WHERE ok) AS n, min(player_uid) FILTER (WHERE ok) AS lo, max(player_uid) FILTER (WHERE ok) AS hi, min(track_id) FILTER (WHERE ok) AS tid FROM j GROUP BY request_id),
a AS (SELECT request_id, CASE WHEN n > 0 AND lo = hi THEN lo END AS player_uid, CASE WHEN n > 0 AND lo = hi THEN tid END AS track_id,
  CASE WHEN numbered = 0 THEN 'no player with this number' WHEN n = 0 THEN 'no player with this number on the team' WHEN lo <> hi THEN 'ambiguous number' END AS error FROM g)"""


@query("target_by_jersey", "G7", JERSEY + "SELECT * FROM a")
def _(d):
    return TG.resolve_by_jersey(jersey_requests(d), track_table(d))


@query("target_candidates", "G8", JERSEY + """
SELECT j.request_id, j.video_id, j.track_id, j.player_uid, j.jersey, j.team FROM j JOIN a ON a.request_id = j.request_id AND a.error = 'ambiguous number' WHERE ok""")
def _(d):
    return TG.ambiguity_candidates(jersey_requests(d), track_table(d))


def follow_candidates(d):
    det = d.fx_detections.where("event_type <> 'error'").selectExpr(
        "video_id", "track_id", "frame", "t", "cx - 20 as x1", "cy - 45 as y1", "cx + 20 as x2", "cy + 45 as y2", "x as pitch_x", "y as pitch_y", "confidence"
    )
    tracks = d.fx_detections.select("video_id", "track_id", F.col("true_jersey").alias("jersey"), (F.col("track_id") % 2).alias("team")).distinct()
    targets = tracks.where("track_id % 3 = 0").select("video_id", F.col("track_id").alias("target_id"), "track_id", "jersey", "team")
    return TG.candidate_frames(targets, det, tracks)


def followed(d):
    return TG.follow(follow_candidates(d), 10.0)


@query("followed_target", "G9")
def _(d):
    return followed(d)


@query("target_statistics", "G10")
def _(d):
    f = reuse(followed(d))
    return TG.statistics(f.withColumn("status", TG.public_status()), 10.0)


@query("frame_candidates", "W32", """
WITH q AS (SELECT DISTINCT video_id, frame AS qf FROM fx_detections), nr AS (SELECT d.*, qf FROM fx_detections d JOIN q ON q.video_id = d.video_id AND abs(d.frame - qf) <= 15),
j AS (SELECT video_id, qf, track_id, jersey, sum(CAST(confidence AS DECIMAL(20, 6))) AS w, min(frame) AS f FROM nr WHERE jersey IS NOT NULL GROUP BY ALL),
vj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, qf, track_id ORDER BY w DESC, f) AS rn FROM j) WHERE rn = 1),
t AS (SELECT video_id, qf, track_id, team, count(*) AS w, min(frame) AS f FROM nr GROUP BY ALL),
vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, qf, track_id ORDER BY w DESC, f) AS rn FROM t) WHERE rn = 1)
SELECT nr.video_id, nr.frame AS at_frame, nr.track_id, vj.jersey AS voted_jersey, CAST(vt.team AS BIGINT) AS voted_team, nr.role AS voted_role
FROM nr JOIN vt ON vt.video_id = nr.video_id AND vt.track_id = nr.track_id AND vt.qf = nr.qf
LEFT JOIN vj ON vj.video_id = nr.video_id AND vj.track_id = nr.track_id AND vj.qf = nr.qf WHERE nr.frame = nr.qf""")
def _(d):
    req = d.fx_detections.select("video_id", F.col("frame").alias("at")).distinct()
    out = TG.frame_candidates(d.fx_detections.select("video_id", "track_id", "frame", "jersey", "team", "role", "confidence"), req)
    return out.select("video_id", F.col("at").alias("at_frame"), "track_id", "voted_jersey", F.col("voted_team").cast("bigint").alias("voted_team"), "voted_role")
