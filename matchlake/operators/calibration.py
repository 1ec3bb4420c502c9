"""Camera calibration: fit, quality, smoothing, region masks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.geometry import H, project
from ..plans.blocked import BLOCK_ROWS, with_position
from ..plans.recurrence import linear_recurrence

# upper triangle of the symmetric 9 x 9 normal matrix
_PAIRS = [(i, j) for i in range(9) for j in range(i, 9)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _null_vector(sums: pd.Series) -> pd.Series:
    """Eigenvector of the smallest eigenvalue of each normal matrix, for a whole batch of cameras at once."""
    flat = np.stack(sums.to_numpy())
    m = np.empty((len(flat), 9, 9))
    for k, (i, j) in enumerate(_PAIRS):
        m[:, i, j] = m[:, j, i] = flat[:, k]
    return pd.Series(list(np.linalg.eigh(m)[1][:, :, 0]))


def fit(points: DataFrame) -> DataFrame:
    """Nine coefficients of the plane homography of every camera with at least four marked points.

    The least-squares system is summed up by Spark (45 sums per camera); only the small eigenproblem is solved in
    Python, in batches.
    """
    norm = points.groupBy("camera_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in ("image_x", "image_y", "pitch_x", "pitch_y")],
        F.sqrt(F.var_pop("image_x") + F.var_pop("image_y")).alias("s_image"),
        F.sqrt(F.var_pop("pitch_x") + F.var_pop("pitch_y")).alias("s_pitch"),
    ).where("n >= 4 and s_image > 0 and s_pitch > 0")
    p = points.join(norm, "camera_id").select(
        "camera_id",
        *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c.split('_')[0]}")).alias(a)
          for a, c in (("u", "image_x"), ("v", "image_y"), ("x", "pitch_x"), ("y", "pitch_y"))],
    )
    u, v, x, y, one, zero = F.col("u"), F.col("v"), F.col("x"), F.col("y"), F.lit(1.0), F.lit(0.0)
    r1 = [u, v, one, zero, zero, zero, -x * u, -x * v, -x]
    r2 = [zero, zero, zero, u, v, one, -y * u, -y * v, -y]
    sums = p.groupBy("camera_id").agg(F.array(*[F.sum(r1[i] * r1[j] + r2[i] * r2[j]) for i, j in _PAIRS]).alias("m"))
    g = sums.select("camera_id", _null_vector("m").alias("g")).join(norm, "camera_id")
    # undo the normalisation: pitch scale and shift on the left, image scale and shift on the right
    e = [F.col("g")[i] for i in range(9)]
    su, mu, mv = F.col("s_image"), F.col("m_image_x"), F.col("m_image_y")
    right = [[e[r] / su, e[r + 1] / su, e[r + 2] - (e[r] * mu + e[r + 1] * mv) / su] for r in (0, 3, 6)]
    sp = F.col("s_pitch")
    top = [[right[k][c] * sp + F.col(m) * right[2][c] for c in range(3)] for k, m in ((0, "m_pitch_x"), (1, "m_pitch_y"))]
    h = [*top[0], *top[1], *right[2]]
    return g.select("camera_id", *[(c / h[8]).alias(n) for c, n in zip(h, H)])


def quality(points: DataFrame, cameras: DataFrame, inlier: float = 5.0, limit: float = 10.0) -> DataFrame:
    """Reprojection errors per camera; ``accepted`` is false when the mean error is above the limit."""
    x, y = project(F.col("image_x"), F.col("image_y"))
    e = points.join(cameras, "camera_id").withColumn(
        "error", F.sqrt(F.pow(x - F.col("pitch_x"), 2) + F.pow(y - F.col("pitch_y"), 2))
    )
    close = F.col("error") <= inlier
    out = e.groupBy("camera_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.count(F.when(close, 1)).alias("inliers"),
        (F.count(F.when(close, 1)) / F.count(F.lit(1))).alias("inlier_ratio"),
        F.avg("error").alias("mean_error"),
        F.max("error").alias("max_error"),
    )
    return out.withColumn("accepted", F.coalesce(F.col("mean_error") <= limit, F.lit(False)))


def smooth(matrices: DataFrame, alpha: float = 0.8) -> DataFrame:
    """Exponential moving average of each camera's matrix, scaled so that h33 stays 1.

    The first matrix is taken as it is. After a step h33 of the average is 1, so the divisor of the next step is known from
    that step's own matrix (the second one also needs the first's h33), and the average is a linear recurrence with the
    divisor as a factor: s[t] = alpha / d[t] * s[t-1] + (1 - alpha) / d[t] * m[t]. Matrices of one frame are taken in any order.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is the share of the average so far, above 0")
    frame = F.floor(F.col("frame") / F.lit(BLOCK_ROWS))
    m = with_position(matrices.select("camera_id", "frame", *H), ["camera_id"], [F.asc("frame")], frame, out="__pos")
    # only the second matrix needs the one before it
    first = m.where("__pos = 0").select(F.struct("camera_id").alias("__camera"), F.col("h33").alias("__h33"), F.lit(1).cast("bigint").alias("__pos"))
    m = m.withColumn("__camera", F.struct("camera_id")).join(first, ["__camera", "__pos"], "left")
    before = F.when(F.col("__pos") == 1, F.col("__h33")).otherwise(F.lit(1.0))
    m = m.withColumn("__d", alpha * before + (1 - alpha) * F.col("h33"))
    terms = {f"__{h}": F.when(F.col("__pos") == 0, F.col(h)).otherwise((1 - alpha) / F.col("__d") * F.col(h)) for h in H}
    out = linear_recurrence(m, ["camera_id"], "__pos", alpha / F.col("__d"), terms)
    return out.select("camera_id", "frame", *[F.col(f"__{h}").alias(h) for h in H])


def outside_mask(boxes: DataFrame, masked_cells: DataFrame, cell: float, keys: Sequence[str] = ("camera_id",)) -> DataFrame:
    """Boxes whose centre does not fall on a masked cell; centres outside the mask are kept."""
    at = boxes.withColumns(
        {
            "cell_x": F.floor((F.col("x1") + F.col("x2")) / 2 / cell),
            "cell_y": F.floor((F.col("y1") + F.col("y2")) / 2 / cell),
        }
    )
    return at.join(masked_cells, [*keys, "cell_x", "cell_y"], "left_anti").drop("cell_x", "cell_y")


def mask_calibrated(rows: DataFrame, calibrated: Column, physical: Sequence[str]) -> DataFrame:
    """Physical metrics only where the video is calibrated; everything else stays."""
    return rows.withColumns({c: F.when(calibrated, F.col(c)) for c in physical})
