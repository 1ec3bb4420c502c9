"""Speed, distance, zones, bursts and accelerations of every track, in pitch metres.

Input: one row per (video, track, frame) with ``x``, ``y``, ``t`` and ``is_detected``. Every window runs over
``(video, track, block)`` with a halo, so a track of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as C
from ..functions.numbers import stable_round
from ..plans.blocked import BLOCK_ROWS, pos_block, with_halo, with_position
from ..plans.materialize import reuse
from ..plans.runs import runs
from ..plans.topk import kth_largest

KEYS = ("video_id", "track_id")


def sustained_window(fps: float) -> int:
    return int(1.0 * fps)


def step_metres(x: str, y: str, w) -> Column:
    dx = F.col(x) - F.lag(x).over(w)
    dy = F.col(y) - F.lag(y).over(w)
    return F.sqrt(dx * dx + dy * dy)


def _edge_mean(col: str, w, index: Column, size: Column) -> Column:
    """Centred mean of five rows; missing rows at either end of the series repeat the end value."""
    half = C.SMOOTHING_ROWS // 2
    inside = F.sum(col).over(w.rowsBetween(-half, half))
    first = F.first(col, ignorenulls=True).over(w.rowsBetween(-half, 0))
    last = F.last(col, ignorenulls=True).over(w.rowsBetween(0, half))
    left = F.greatest(F.lit(half) - index, F.lit(0))
    right = F.greatest(F.lit(half) - (size - 1 - index), F.lit(0))
    total = inside + F.when(left > 0, left * first).otherwise(0.0) + F.when(right > 0, right * last).otherwise(0.0)
    return total / C.SMOOTHING_ROWS


def numbered(points: DataFrame, keys: Sequence[str] = KEYS, frame: str = "frame", split: bool = True) -> DataFrame:
    """Position of each row in its track and the track length ``n_points``."""
    return with_position(
        points, keys, [F.asc(frame)], F.floor(F.col(frame) / BLOCK_ROWS), out="pos", total="n_points", split=split
    )


def kinematics(points: DataFrame, fps: float, keys: Sequence[str] = KEYS, split: bool = True) -> DataFrame:
    """Per-row step length, raw and smoothed speed, and smoothed acceleration.

    Rows with ``pos = 0`` have no predecessor, so their step and speed are null. Speeds are mph, accelerations m/s².
    """
    rows = numbered(points, keys, split=split)
    rows = with_halo(rows, "pos", before=8, after=8, split=split)
    w = W.partitionBy(*keys, "blk").orderBy("pos")
    dt = F.col("t") - F.lag("t").over(w)
    rows = rows.withColumns(
        {
            "step_m": F.when(F.col("pos") > 0, step_metres("x", "y", w)),
            "dt": F.when(F.col("pos") > 0, dt),
            "both_detected": F.when(F.col("pos") > 0, F.col("is_detected") & F.lag("is_detected").over(w)),
        }
    )
    velocity = F.when(F.col("dt") <= 0, F.lit(0.0)).when(F.col("dt") > 0, F.col("step_m") / F.col("dt"))
    rows = rows.withColumn("velocity_ms", velocity)
    rows = rows.withColumn("speed_mph", F.col("velocity_ms") * C.MPH_PER_MS)
    i, n = F.col("pos") - 1, F.col("n_points") - 1
    enough = n >= C.SMOOTHING_ROWS
    rows = rows.withColumns(
        {
            "smooth_mph": F.when(enough, _edge_mean("speed_mph", w, i, n)).otherwise(F.col("speed_mph")),
            "smooth_ms": F.when(enough, _edge_mean("velocity_ms", w, i, n)).otherwise(F.col("velocity_ms")),
        }
    )
    rows = rows.withColumns(
        {
            "smooth_mph": F.when(F.col("pos") > 0, F.col("smooth_mph")),
            "smooth_ms": F.when(F.col("pos") > 0, F.col("smooth_ms")),
        }
    )
    change = (F.col("smooth_ms") - F.lag("smooth_ms").over(w)) * fps
    clipped = F.greatest(F.lit(-C.ACCEL_CLIP_MS2), F.least(F.lit(C.ACCEL_CLIP_MS2), change))
    rows = rows.withColumn("accel_raw", F.when(F.col("pos") > 1, clipped))
    j, m = F.col("pos") - 2, F.col("n_points") - 2
    smooth = F.when(m >= C.SMOOTHING_ROWS, _edge_mean("accel_raw", w, j, m)).otherwise(F.col("accel_raw"))
    rows = rows.withColumn("accel_ms2", F.when(F.col("pos") > 1, smooth))
    return rows.where("is_owner").drop("is_owner")


def sustained(kin: DataFrame, fps: float, keys: Sequence[str] = KEYS, split: bool = True) -> DataFrame:
    """Rolling median of the plausible smoothed speeds over about one second.

    Implausible speeds are dropped first and the rest renumbered (``vpos`` of ``n_valid``); every value stays on the
    row it was measured on. Series shorter than the window get their overall median.
    """
    size = sustained_window(fps)
    valid = kin.where(F.col("smooth_mph") <= C.MAX_PLAUSIBLE_MPH).drop("blk")
    valid = with_position(valid, keys, [F.asc("pos")], pos_block("pos"), out="vpos", total="n_valid", split=split)
    valid = with_halo(valid, "vpos", before=size, after=size, split=split)
    w = W.partitionBy(*keys, "blk").orderBy("vpos")
    half = size // 2
    rolling = _median(F.collect_list("smooth_mph").over(w.rowsBetween(-half, half)))
    overall = _median(F.collect_list("smooth_mph").over(w.rowsBetween(-size, size)))
    out = valid.withColumn("sustained_mph", F.when(F.col("n_valid") < size, overall).otherwise(rolling))
    return out.where("is_owner").drop("is_owner")


def _median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    hi = F.element_at(s, F.floor(n / 2).cast("int") + 1)
    lo = F.element_at(s, F.floor((n - 1) / 2).cast("int") + 1)
    return (lo + hi) / 2


def total_distance_km(fps: float) -> Column:
    """Sum of steps, each capped at twice the distance a plausible speed covers in one frame."""
    cap = C.MAX_PLAUSIBLE_MPH / C.MPH_PER_MS / fps * 2
    return F.sum(F.when(F.col("step_m") > cap, cap).otherwise(F.col("step_m"))) / 1000


ZONES = ("walk", "jog", "run", "hsr", "sprint")


def zone_of(
    kmh: Column,
    walk: float = C.WALK_KMH,
    jog: float = C.JOG_KMH,
    hsr: float = C.HSR_MPH * C.KMH_PER_MPH_TRACK,
    sprint: float = C.SPRINT_MPH * C.KMH_PER_MPH_TRACK,
) -> Column:
    return (
        F.when(kmh < walk, "walk").when(kmh < jog, "jog").when(kmh < hsr, "run").when(kmh < sprint, "hsr")
        .when(kmh.isNotNull(), "sprint")
    )


def zone_distances() -> list[Column]:
    zone = zone_of(F.col("smooth_mph") * C.KMH_PER_MPH_TRACK)
    return [
        (F.coalesce(F.sum(F.when(zone == z, F.col("step_m"))), F.lit(0.0)) / 1000).alias(f"zone_{z}_km") for z in ZONES
    ]


def bursts(
    sus: DataFrame, thresholds_mph: dict[str, float], fps: float, keys: Sequence[str] = KEYS, split: bool = True
) -> DataFrame:
    """One row per burst and kind: it starts at the threshold, holds at 90 % of it, and bridges gaps of up to 0.2 s."""
    bridge = int(C.BURST_BRIDGE_S * fps)
    dwell = int(C.BURST_DWELL_S * fps)
    speed = F.col("sustained_mph")
    held = [
        F.when(speed >= mph * C.BURST_EXIT_SHARE, F.struct(F.lit(kind).alias("kind"), (speed >= mph).alias("peak")))
        for kind, mph in thresholds_mph.items()
    ]
    hold = sus.select(*keys, "blk", "vpos", "n_valid", F.explode(F.array_compact(F.array(*held))).alias("h"))
    hold = hold.select(*keys, "blk", "vpos", "n_valid", "h.kind", "h.peak")
    islands = runs(
        hold,
        [*keys, "kind"],
        pos="vpos",
        max_gap=bridge,
        measures={
            "first_peak": ("min", F.when(F.col("peak"), F.col("vpos"))),
            "n_valid": ("max", F.col("n_valid")),
        },
        block="blk",
        split=split,
    )
    tail = F.least(F.col("n_valid") - 1 - F.col("end"), F.lit(bridge))
    length = F.col("end") - F.col("first_peak") + 1 + tail
    return (
        islands.where(F.col("first_peak").isNotNull())
        .withColumn("length", length)
        .where(F.col("length") >= dwell)
        .select(*keys, "kind", F.col("first_peak").alias("start"), "end", "length")
    )


def acceleration_events(kin: DataFrame, fps: float, keys: Sequence[str] = KEYS, split: bool = True) -> DataFrame:
    """High accelerations and decelerations per track; a run of k dwell times counts k events."""
    dwell = int(C.ACCEL_DWELL_S * fps)
    kind = F.when(F.col("accel_ms2") >= C.ACCEL_MS2, "accel").when(F.col("accel_ms2") <= -C.ACCEL_MS2, "decel")
    rows = kin.withColumn("kind", kind).where(F.col("kind").isNotNull())
    r = runs(rows, keys, pos="pos", state="kind", block="blk", split=split).withColumn("events", F.floor(F.col("n") / dwell))
    return r.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("state") == "accel", F.col("events"))), F.lit(0)).alias("accel_count_high"),
        F.coalesce(F.sum(F.when(F.col("state") == "decel", F.col("events"))), F.lit(0)).alias("decel_count_high"),
    )


def top_speed(sus: DataFrame, keys: Sequence[str] = KEYS, split: bool = True) -> DataFrame:
    """Sustained top speed without the highest 1 %, from detected rows when a track has any."""
    has_detected = sus.groupBy(*keys).agg(
        F.max(F.when(F.col("both_detected"), 1).otherwise(0)).alias("any_detected"),
        F.max("sustained_mph").alias("max_any"),
    )
    detected = sus.where(F.col("both_detected"))
    index = F.floor(F.col("n_detected") * F.lit(0.01))
    best = kth_largest(detected, keys, "sustained_mph", index, "n_detected", "robust", split=split)
    return has_detected.join(best, list(keys), "left").select(
        *keys, F.coalesce("robust", "max_any").alias("top_speed_mph")
    )


def workload_risk(distance_km: Column, sprint_count: Column, hsr_km: Column) -> Column:
    points = (
        F.when(distance_km > 10, 2).when(distance_km > 7, 1).otherwise(0)
        + F.when(sprint_count > 50, 2).when(sprint_count > 30, 1).otherwise(0)
        + F.when(hsr_km > 1.5, 2).when(hsr_km > 0.8, 1).otherwise(0)
    )
    return F.when(points >= 4, "High").when(points >= 2, "Medium").otherwise("Low")


def temporal(fps: float, total_frames: Column | None = None) -> list[Column]:
    n = F.count(F.lit(1))
    visible = n / F.lit(fps) / 60
    cols = [
        F.min("t").alias("first_seen"),
        F.max("t").alias("last_seen"),
        ((F.max("t") - F.min("t")) / 60).alias("minutes_played"),
        visible.alias("visible_minutes"),
        F.avg("x").alias("avg_pitch_x"),
        F.avg("y").alias("avg_pitch_y"),
        n.alias("n_points"),
    ]
    if total_frames is not None:
        cols.append((n / total_frames * 100).alias("coverage_pct"))
    return cols


def physical(points: DataFrame, fps: float, total_frames: DataFrame | None = None, split: bool = True) -> DataFrame:
    """One row of physical metrics per track. ``total_frames`` holds (video_id, total_frames)."""
    keys = list(KEYS)
    kin = reuse(kinematics(points.select(*keys, "frame", "x", "y", "t", "is_detected"), fps, split=split))
    sus = reuse(sustained(kin, fps, split=split))
    base = kin.groupBy(*keys).agg(
        *temporal(fps),
        F.coalesce(total_distance_km(fps), F.lit(0.0)).alias("distance_km"),
        *zone_distances(),
        F.coalesce(F.sum(F.col("both_detected").cast("int")), F.lit(0)).alias("detected_frames"),
        F.count("speed_mph").alias("total_frames"),
    )
    above = lambda mph: F.coalesce(
        F.sum(F.when(F.col("sustained_mph") >= mph, F.col("step_m"))), F.lit(0.0)
    ) / 1000
    fast = sus.groupBy(*keys).agg(
        above(C.HSR_MPH).alias("high_speed_distance_km"), above(C.SPRINT_MPH).alias("sprint_distance_km")
    )
    counts = bursts(sus, {"hsr": C.HSR_MPH, "sprint": C.SPRINT_MPH}, fps, split=split).groupBy(*keys).agg(
        F.count(F.when(F.col("kind") == "hsr", 1)).alias("hsr_count"),
        F.count(F.when(F.col("kind") == "sprint", 1)).alias("sprint_count"),
    )
    out = base.where("n_points >= 2")
    for part in (fast, top_speed(sus, split=split), counts, acceleration_events(kin, fps, split=split)):
        out = out.join(part, keys, "left")
    zero = ["high_speed_distance_km", "sprint_distance_km", "top_speed_mph"]
    counted = ["hsr_count", "sprint_count", "accel_count_high", "decel_count_high"]
    out = out.fillna(0.0, zero).fillna(0, counted)
    if total_frames is not None:
        out = out.join(total_frames.withColumnRenamed("total_frames", "__frames"), "video_id", "left").withColumn(
            "coverage_pct", stable_round(F.col("n_points") / F.col("__frames") * 100, 2)
        )
    else:
        out = out.withColumn("coverage_pct", F.lit(None).cast("double"))
    visible = F.col("visible_minutes")
    return out.select(
        *keys,
        stable_round("top_speed_mph", 2).alias("top_speed_mph"),
        stable_round(F.col("top_speed_mph") * C.KMH_PER_MPH_TRACK, 2).alias("top_speed_kmh"),
        stable_round("distance_km", 3).alias("distance_km"),
        stable_round(F.col("distance_km") * 1000, 1).alias("distance_m"),
        stable_round("minutes_played", 2).alias("minutes_played"),
        stable_round(F.col("minutes_played") * 60, 1).alias("minutes_played_s"),
        stable_round("visible_minutes", 2).alias("visible_minutes"),
        stable_round(visible * 60, 1).alias("visible_minutes_s"),
        F.when(visible > 0, stable_round(F.col("distance_km") * 1000 / visible, 2)).alias("distance_per_min_m"),
        stable_round("avg_pitch_x", 2).alias("avg_pitch_x"),
        stable_round("avg_pitch_y", 2).alias("avg_pitch_y"),
        stable_round("high_speed_distance_km", 3).alias("high_speed_distance_km"),
        stable_round("sprint_distance_km", 3).alias("sprint_distance_km"),
        "hsr_count",
        "sprint_count",
        (F.col("hsr_count") + F.col("sprint_count")).alias("hi_efforts_count"),
        *[stable_round(f"zone_{z}_km", 3).alias(f"zone_{z}_km") for z in ZONES],
        "accel_count_high",
        "decel_count_high",
        "coverage_pct",
        "detected_frames",
        "total_frames",
        workload_risk(F.col("distance_km"), F.col("sprint_count"), F.col("high_speed_distance_km")).alias("injury_risk"),
    )
