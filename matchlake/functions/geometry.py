"""Boxes and plane projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C

H = ("h11", "h12", "h13", "h21", "h22", "h23", "h31", "h32", "h33")


def project(u: Column, v: Column) -> tuple[Column, Column]:
    """Image point to pitch metres with the coefficient columns h11..h33; null when it falls on the horizon."""
    h = {c: F.col(c) for c in H}
    w = h["h31"] * u + h["h32"] * v + h["h33"]
    ok = F.abs(w) > 1e-12
    return (
        F.when(ok, (h["h11"] * u + h["h12"] * v + h["h13"]) / w),
        F.when(ok, (h["h21"] * u + h["h22"] * v + h["h23"]) / w),
    )


def on_pitch(x: Column, y: Column, length: float = C.PITCH_LENGTH_M, width: float = C.PITCH_WIDTH_M) -> Column:
    m = C.PITCH_MARGIN_M
    return x.between(-m, length + m) & y.between(-m, width + m)


def pitch_point(u: Column, v: Column) -> Column:
    """struct(x, y) in metres, null when more than the margin off the pitch."""
    x, y = project(u, v)
    return F.when(on_pitch(x, y), F.struct(x.alias("x"), y.alias("y")))


def foot(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2


def centre(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def image_fallback(point: Column, u: Column, v: Column, width: float, height: float) -> Column:
    """Pitch point when calibrated, else the image position as a share of the frame."""
    return F.coalesce(point, F.struct((u / width).alias("x"), (v / height).alias("y")))


def to_normalised(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> Column:
    """[x, y, w, h] as shares of the frame."""
    return F.array(x1 / width, y1 / height, (x2 - x1) / width, (y2 - y1) / height)


def to_pixels(box: Column, width: float, height: float) -> Column:
    """[x1, y1, x2, y2] from a normalised [x, y, w, h]."""
    return F.array(box[0] * width, box[1] * height, (box[0] + box[2]) * width, (box[1] + box[3]) * height)


def clip_box(box: Column, width: float, height: float, min_size: float = 1.0) -> Column:
    """Box inside the frame with at least ``min_size`` pixels per side."""
    x1 = F.greatest(F.lit(0.0), F.least(box[0], F.lit(width - min_size)))
    y1 = F.greatest(F.lit(0.0), F.least(box[1], F.lit(height - min_size)))
    x2 = F.least(F.lit(width), F.greatest(box[2], x1 + min_size))
    y2 = F.least(F.lit(height), F.greatest(box[3], y1 + min_size))
    return F.array(x1, y1, x2, y2)


def valid_box(box: Column) -> Column:
    """The box when it has four finite numbers in order, else null."""
    finite = F.forall(box, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    ok = (F.size(box) == 4) & finite & (F.try_element_at(box, F.lit(3)) > F.try_element_at(box, F.lit(1)))
    return F.when(ok & (F.try_element_at(box, F.lit(4)) > F.try_element_at(box, F.lit(2))), box)


def centre_size(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(
        F.round((x1 + x2) / 2, 2).alias("x_center"), F.round((y1 + y2) / 2, 2).alias("y_center"),
        F.round(x2 - x1, 2).alias("width"), F.round(y2 - y1, 2).alias("height"),
    )


def frame_state(state: Column, status: Column, box: Column) -> Column:
    """tracked / occluded / lost: an explicit state wins, else the status; no box always means lost."""
    s, t = F.lower(F.trim(state)), F.lower(F.trim(status))
    named = F.when(s.isin("tracked", "reacquired"), "tracked").when(s.isin("occluded", "lost"), s)
    by_status = F.when(t == "tracked", "tracked").when(t == "interpolated", "occluded").when(t == "lost", "lost")
    return F.when(box.isNull(), "lost").otherwise(F.coalesce(named, by_status, F.lit("tracked")))


def resolve_frame(t: Column, frame: Column, fps: float, total: Column) -> Column:
    """Frame index from a frame number or a time in seconds, null when outside the clip."""
    f = F.coalesce(frame, F.bround(t * fps).cast("bigint"))
    return F.when((f >= 0) & (f <= total), F.least(f, total - 1))
