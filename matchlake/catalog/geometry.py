from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as X
from ..operators import calibration as K
from .registry import query, rnd

# a plausible camera: one matrix per video, shared by both engines
HOMOGRAPHY = {
    "h11": ("0.06 + video_id % 7 * 0.001", "0.06e0 + video_id % 7 * 0.001e0"),
    "h12": ("0.005", "0.005e0"),
    "h13": ("-6.0 - video_id % 5", "-6.0e0 - video_id % 5"),
    "h21": ("0.001", "0.001e0"),
    "h22": ("0.075", "0.075e0"),
    "h23": ("-4.0", "-4.0e0"),
    "h31": ("0.00001", "0.00001e0"),
    "h32": ("0.0002", "0.0002e0"),
    "h33": ("1.0", "1.0e0"),
}
SPARK_H = [f"CAST({a.replace('0.06 +', '0.06D +').replace('* 0.001', '* 0.001D') if k == 'h11' else a} AS DOUBLE) AS {k}" for k, (a, _) in HOMOGRAPHY.items()]
H = {k: f"({b})" for k, (_, b) in HOMOGRAPHY.items()}


def proj(u, v):
    w = f"({H['h31']} * {u} + {H['h32']} * {v} + {H['h33']})"
    return f"(({H['h11']} * {u} + {H['h12']} * {v} + {H['h13']}) / {w})", f"(({H['h21']} * {u} + {H['h22']} * {v} + {H['h23']}) / {w})"


def boxes(d):
    return d.fx_boxes.selectExpr("*", *SPARK_H)


def projection(name, covers, u, v, pick):
    px, py = proj(u, v)

    @query(name, covers, f"""
SELECT video_id, track_id, frame, CASE WHEN ok THEN round(px, 6) END AS x, CASE WHEN ok THEN round(py, 6) END AS y FROM (
  SELECT *, px BETWEEN -5 AND 110 AND py BETWEEN -5 AND 73 AS ok FROM (SELECT video_id, track_id, frame, {px} AS px, {py} AS py FROM fx_boxes))""")
    def _(d):
        b = boxes(d)
        p = X.pitch_point(*pick(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
        return b.select("video_id", "track_id", "frame", p.alias("p")).select(
            "video_id", "track_id", "frame", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")
        )


projection("foot_to_pitch", "X1 P7", "((x1 + x2) / 2)", "y2", X.foot)
projection("centre_to_pitch", "X2", "((x1 + x2) / 2)", "((y1 + y2) / 2)", X.centre)


@query("image_space_fallback", "X3", f"""
SELECT video_id, track_id, frame, {rnd('CASE WHEN track_id % 2 = 0 THEN x1 ELSE (x1 + x2) / 2 / 1920 END', 6)} AS x FROM fx_boxes""")
def _(d):
    u, v = X.foot(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    known = F.when(F.col("track_id") % 2 == 0, F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    return d.fx_boxes.select("video_id", "track_id", "frame", F.round(X.image_fallback(known, u, v, 1920.0, 1080.0)["x"], 6).alias("x"))


@query("box_conversions", "X5", f"""
SELECT video_id, track_id, frame, {rnd('x1 / 1920', 6)} AS nx, {rnd('(x2 - x1) / 1920', 6)} AS nw, round((x1 / 1920 + (x2 - x1) / 1920) * 1920, 4) AS back_x2,
  least(1600e0, greatest(x2, greatest(0e0, least(x1, 1599e0)) + 1)) AS clipped_x2, round((x1 + x2) / 2, 2) AS x_center, round(y2 - y1, 2) AS height FROM fx_boxes""")
def _(d):
    cols = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    n = X.to_normalised(*cols, 1920.0, 1080.0)
    return d.fx_boxes.select(
        "video_id", "track_id", "frame", F.round(n[0], 6).alias("nx"), F.round(n[2], 6).alias("nw"),
        F.round(X.to_pixels(n, 1920.0, 1080.0)[2], 4).alias("back_x2"), X.clip_box(F.array(*cols), 1600.0, 1080.0)[2].alias("clipped_x2"),
        X.centre_size(*cols)["x_center"].alias("x_center"), X.centre_size(*cols)["height"].alias("height"),
    )


@query("box_validation", "X6", """
SELECT video_id, track_id, frame, frame % 5 = 4 AS valid FROM fx_boxes""")
def _(d):
    x1, y1, x2, y2 = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    k = F.col("frame") % 5
    box = (
        F.when(k == 0, F.array(x1, y1, x2)).when(k == 1, F.array(x2, y1, x1, y2)).when(k == 2, F.array(x1, y1, x2, F.lit(float("nan"))))
        .when(k == 3, F.array(x1, y1, x2, F.lit(None).cast("double"))).otherwise(F.array(x1, y1, x2, y2))
    )
    return d.fx_boxes.select("video_id", "track_id", "frame", X.valid_box(box).isNotNull().alias("valid"))


@query("frame_states", "X8", """
SELECT video_id, track_id, f, CASE WHEN state = 'lost' THEN 'lost' WHEN f % 3 = 0 THEN 'tracked' WHEN f % 3 = 1 THEN 'occluded' ELSE 'tracked' END AS shown FROM fx_frames""")
def _(d):
    f = F.col("f")
    state = F.when(f % 3 == 0, " Reacquired ").when(f % 3 == 2, "unheard of")
    status = F.when(f % 3 == 1, "interpolated").when(f % 3 == 2, "?")
    return d.fx_frames.select("video_id", "track_id", "f", X.frame_state(state, status, F.col("bx")).alias("shown"))


@query("frame_resolution", "X7", """
SELECT video_id, track_id, f, CASE WHEN g >= 0 AND g <= 60 THEN least(g, 59) END AS resolved FROM (SELECT *, CASE WHEN f % 2 = 0 THEN f ELSE CAST(round_even(t * 10, 0) AS BIGINT) END AS g FROM fx_frames)""")
def _(d):
    frame = F.when(F.col("f") % 2 == 0, F.col("f"))
    return d.fx_frames.select("video_id", "track_id", "f", X.resolve_frame(F.col("t"), frame, 10.0, F.lit(60).cast("bigint")).alias("resolved"))


@query("region_filter", "P21", """
SELECT video_id, track_id, frame FROM fx_boxes WHERE NOT (floor((x1 + x2) / 200) % 4 = 1 AND floor((y1 + y2) / 200) % 3 = 0 AND (y1 + y2) / 2 < 700)""")
def _(d):
    cells = d.fx_boxes.select("video_id").distinct()
    cells = cells.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("cell_x")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("cell_y")
    ).where("cell_x % 4 = 1 and cell_y % 3 = 0")
    cells = cells.select("video_id", F.col("cell_x").cast("bigint"), F.col("cell_y").cast("bigint"))
    return K.outside_mask(d.fx_boxes, cells, 100.0, ["video_id"]).select("video_id", "track_id", "frame")


# ---- calibration ----------------------------------------------------------------------------------------------
POINTS = [(100, 900), (1800, 900), (1400, 200), (500, 200), (960, 500)]


def marked(d, noise=False):
    """Five marked points per camera (one camera per customer), placed by the known matrix."""
    c = d.customer.select(F.col("c_custkey").alias("camera_id"), F.col("c_custkey").alias("video_id"))
    pts = F.array(*[F.struct(F.lit(float(u)).alias("image_x"), F.lit(float(v)).alias("image_y")) for u, v in POINTS])
    c = c.select("camera_id", "video_id", F.posexplode(pts).alias("i", "p")).select("camera_id", "video_id", "i", "p.*").selectExpr("*", *SPARK_H)
    x, y = X.project(F.col("image_x"), F.col("image_y"))
    shift = F.when((F.col("i") == 2) & F.lit(noise), (F.col("camera_id") % 40).cast("double")).otherwise(0.0)
    return c.select("camera_id", "video_id", "i", "image_x", "image_y", (x + shift).alias("pitch_x"), y.alias("pitch_y"))


def true_matrix(d):
    return d.customer.select(F.col("c_custkey").alias("camera_id"), F.col("c_custkey").alias("video_id")).selectExpr("camera_id", *SPARK_H)


@query("homography_fit", "G13 S6", "SELECT c_custkey AS camera_id, " + ", ".join(
    f"round({b}, 4) AS {k}" for k, (_, b) in HOMOGRAPHY.items() if k not in ("h31", "h32")).replace("video_id", "c_custkey") + " FROM customer")
def _(d):
    fit = K.fit(marked(d))
    return fit.select("camera_id", *[F.round(k, 4).alias(k) for k in X.H if k not in ("h31", "h32")])


@query("calibration_quality", "G12", """
SELECT c_custkey AS camera_id, CAST(5 AS BIGINT) AS points, CAST(CASE WHEN c_custkey % 40 <= 5 THEN 5 ELSE 4 END AS BIGINT) AS inliers,
  round(c_custkey % 40 / 5, 4) AS mean_error, c_custkey % 40 <= 30 AS accepted FROM customer""")
def _(d):
    q = K.quality(marked(d, noise=True), true_matrix(d), inlier=5.0000001, limit=6.0000001)
    return q.select("camera_id", "points", "inliers", F.round("mean_error", 4).alias("mean_error"), "accepted")


_SMOOTHED = [k for k in HOMOGRAPHY if k != "h33"]


@query("smoothed_calibration", "W31", f"""
WITH RECURSIVE m AS (SELECT track_id, frame, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS n, {", ".join(f"{b} AS {k}" for k, (_, b) in HOMOGRAPHY.items()).replace("video_id", "track_id")}
  FROM fx_detections),
j AS (SELECT * REPLACE (h13 + frame % 3 AS h13, h33 + frame % 4 * 0.125e0 AS h33) FROM m),
s AS (SELECT * FROM j WHERE n = 1
  UNION ALL
  SELECT j.track_id, j.frame, j.n, {", ".join(f"(0.8e0 * s.{k} + 0.2e0 * j.{k}) / (0.8e0 * s.h33 + 0.2e0 * j.h33)" for k in HOMOGRAPHY)} FROM s JOIN j ON j.track_id = s.track_id AND j.n = s.n + 1)
SELECT track_id AS camera_id, frame, {", ".join(f"round({k}, 7) AS {k}" for k in _SMOOTHED)}, round(h33, 7) AS h33 FROM s""")
def _(d):
    frames = d.fx_detections.select(F.col("track_id").alias("camera_id"), F.col("track_id").alias("video_id"), "frame")
    m = frames.selectExpr("*", *SPARK_H).withColumns({"h13": F.col("h13") + F.col("frame") % 3, "h33": F.col("h33") + F.col("frame") % 4 * 0.125})
    return K.smooth(m).select("camera_id", "frame", *[F.round(h, 7).alias(h) for h in X.H])


@query("uncalibrated_masked", "G16", """
SELECT part_id, video_id, track_id, CASE WHEN video_id % 3 <> 0 THEN distance_km END AS distance_km, CASE WHEN video_id % 3 <> 0 THEN top_speed_mph END AS top_speed_mph, minutes_played FROM fx_fragments""")
def _(d):
    out = K.mask_calibrated(d.fx_fragments, F.col("video_id") % 3 != 0, ["distance_km", "top_speed_mph"])
    return out.select("part_id", "video_id", "track_id", "distance_km", "top_speed_mph", "minutes_played")
