"""Missing frames, lost segments and track quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as C
from ..functions.numbers import stable_round
from ..plans.blocked import BLOCK_ROWS, asof_before, running, with_halo, with_position
from ..plans.runs import runs

KEYS = ("video_id", "track_id")


def _neighbours(df: DataFrame, keys: Sequence[str], frame: str) -> tuple[DataFrame, W]:
    rows = with_position(df, keys, [F.asc(frame)], F.floor(F.col(frame) / BLOCK_ROWS), out="__pos")
    rows = with_halo(rows, "__pos", before=1, after=1)
    return rows, W.partitionBy(*keys, "blk").orderBy("__pos")


def interpolate(
    detections: DataFrame, values: Sequence[str], max_gap: int = C.BALL_GAP_FRAMES, keys: Sequence[str] = KEYS, frame: str = "frame"
) -> DataFrame:
    """Detections plus linearly filled rows for gaps of at most ``max_gap`` frames between two detections."""
    rows, w = _neighbours(detections.select(*keys, frame, *values), keys, frame)
    ahead = {f"__n_{c}": F.lead(c).over(w) for c in [frame, *values]}
    rows = rows.withColumns(ahead).where("is_owner")
    gap = F.col(f"__n_{frame}") - F.col(frame) - 1
    offsets = F.when(gap.between(1, max_gap), F.sequence(F.lit(0), gap.cast("int"))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("__k", F.explode(offsets))
    alpha = F.col("__k") / (F.col(f"__n_{frame}") - F.col(frame))
    filled = {
        c: F.when(F.col("__k") == 0, F.col(c)).otherwise(F.col(c) * (1 - alpha) + F.col(f"__n_{c}") * alpha) for c in values
    }
    return rows.select(
        *keys, (F.col(frame) + F.col("__k")).alias(frame), *[e.alias(c) for c, e in filled.items()],
        (F.col("__k") > 0).alias("is_interpolated"),
    )


def extrapolate(
    detections: DataFrame, last_frame: DataFrame, max_gap: int = C.BALL_EXTRAPOLATE_FRAMES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Predicted centre for the first frames of each gap, from the velocity of the last two detections.

    ``last_frame`` holds (keys, last_frame): trailing gaps are filled up to there.
    """
    rows, w = _neighbours(detections.select(*keys, "frame", "cx", "cy"), keys, "frame")
    rows = rows.withColumns(
        {
            "pf": F.lag("frame").over(w), "px": F.lag("cx").over(w), "py": F.lag("cy").over(w), "nf": F.lead("frame").over(w),
        }
    ).where("is_owner")
    rows = rows.join(last_frame, list(keys))
    end = F.coalesce(F.col("nf") - 1, F.col("last_frame"))
    n = F.least(end - F.col("frame"), F.lit(max_gap)).cast("int")
    rows = rows.where(F.col("pf").isNotNull() & (n > 0)).withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    span = F.col("frame") - F.col("pf")
    return rows.select(
        *keys, (F.col("frame") + F.col("k")).alias("frame"),
        (F.col("cx") + (F.col("cx") - F.col("px")) / span * F.col("k")).alias("cx"),
        (F.col("cy") + (F.col("cy") - F.col("py")) / span * F.col("k")).alias("cy"),
    )


def densify(frames: DataFrame, totals: DataFrame, fps: float, keys: Sequence[str] = KEYS, values: Sequence[str] = ("conf",)) -> DataFrame:
    """Frames 0..n-1 of each track, missing ones as lost; n = max(declared total, last frame + 1).

    ``totals`` holds (keys, total). The frame spine is made block by block, never as one long array.
    """
    seen = frames.groupBy(*keys).agg((F.max("f") + 1).alias("__seen"))
    n = totals.join(seen, list(keys), "left").withColumn("n", F.greatest("total", "__seen"))
    n = n.where("n > 0")
    blocks = n.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK_ROWS))).alias("__b"))
    first = F.col("__b") * BLOCK_ROWS
    last = F.least(first + BLOCK_ROWS, F.col("n")) - 1
    spine = blocks.select(*keys, F.explode(F.sequence(first, last)).alias("f"))
    out = spine.join(frames.select(*keys, "f", "t", "state", *values), [*keys, "f"], "left")
    return out.withColumns(
        {"t": F.coalesce("t", F.round(F.col("f") / fps, 3)), "state": F.coalesce("state", F.lit("lost"))}
    )


def segments(frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of equal state over consecutive frames (inclusive)."""
    return runs(frames, keys, pos="f", state="state")


def lost_segments(frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return segments(frames.where("state = 'lost'"), keys).select(*keys, "start", "end")


def interval_union(intervals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Merge intervals that overlap or touch."""
    block = F.floor(F.col("start") / BLOCK_ROWS)
    order = [F.asc("start"), F.asc("end")]
    rows = running(intervals, keys, order, block, {"reach": ("max", F.col("end"))}, inclusive=False)
    fresh = F.coalesce((F.col("start") > F.col("reach") + 1).cast("int"), F.lit(1))
    rows = running(rows.withColumn("fresh", fresh), keys, order, block, {"island": ("sum", F.col("fresh"))})
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def lost_runs(frames: DataFrame, supplied: DataFrame | None, totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lost runs of the frames merged with supplied segments, clamped to the clip. ``totals`` holds (keys, total)."""
    own = lost_segments(frames, keys)
    if supplied is None:
        return own
    s = supplied.join(totals, list(keys), "left").where(F.col("total").isNull() | (F.col("start") < F.col("total")))
    s = s.select(
        *keys, F.greatest(F.col("start"), F.lit(0)).alias("start"),
        F.when(F.col("total").isNotNull(), F.least(F.col("end"), F.col("total") - 1)).otherwise(F.col("end")).alias("end"),
    )
    return interval_union(own.unionByName(s), keys)


def clean_segments(segments_col: Column, total: Column) -> Column:
    """Sorted supplied segments, or null when any of them is malformed or out of range."""
    ok = F.forall(
        segments_col,
        lambda s: F.coalesce((F.size(s) == 2) & (s[0] >= 0) & (s[1] >= s[0]) & (s[1] < total), F.lit(False)),
    )
    return F.when(ok, F.array_sort(segments_col))


def reacquisitions(frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lost gaps whose next frame that is not occluded is tracked, per track (0 kept)."""
    seen = frames.where("state <> 'occluded'")
    rows, w = _neighbours(seen.select(*keys, "f", "state"), keys, "f")
    back = (F.lag("state").over(w) == "lost") & F.col("state").isin("tracked", "reacquired")
    events = rows.withColumn("back", back).where("is_owner and back").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return frames.select(*keys).distinct().join(events, list(keys), "left").select(
        *keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("reacquisitions")
    )


def track_summary(frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frames per state, coverage and mean confidence of tracked frames."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        n("tracked").alias("tracked_frames"),
        n("occluded").alias("occluded_frames"),
        n("lost").alias("lost_frames"),
        stable_round((n("tracked") + n("occluded")) / F.count(F.lit(1)) * 100, 1).alias("coverage_pct"),
        stable_round(F.avg(F.when(F.col("state") == "tracked", F.col("conf"))), 3).alias("avg_conf"),
    )


def replay_summary(
    frames: DataFrame, fps: float, server: DataFrame | None = None, keys: Sequence[str] = KEYS, client_rule: bool = False,
    supplied: DataFrame | None = None,
) -> DataFrame:
    """Replay numbers per track; values the server supplies win. ``client_rule`` counts every lost run that has a
    following segment as a re-acquisition, the default only those that end in a tracked frame.

    ``supplied`` (keys, start, end) are lost segments known from elsewhere: the longest one is taken over their union with
    the frames' own, and a track that has any counts these instead of its own.
    """
    keys = list(keys)
    base = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        (F.count(F.when(F.col("state") == "tracked", 1)) / F.count(F.lit(1)) * 100).alias("tracked_pct"),
        F.avg(F.when(F.col("state") != "lost", F.col("conf"))).alias("avg_conf"),
        F.max("f").alias("__last"),
    )
    seg = segments(frames, keys).groupBy(*keys).agg(
        F.count(F.when(F.col("state") == "occluded", 1)).alias("occluded_segments"),
        F.count(F.when(F.col("state") == "lost", 1)).alias("lost_segments"),
        F.max(F.when(F.col("state") == "lost", F.col("n"))).alias("longest_lost"),
        F.max(F.when(F.col("state") == "lost", F.col("end"))).alias("__last_lost"),
    )
    out = base.join(seg, keys, "left")
    if supplied is not None:
        totals = frames.groupBy(*keys).agg((F.max("f") + 1).alias("total"))
        union = lost_runs(frames, supplied, totals, keys).groupBy(*keys).agg(F.max(F.col("end") - F.col("start") + 1).alias("__longest"))
        known = supplied.groupBy(*keys).agg(F.count(F.lit(1)).alias("__known"))
        out = out.join(union, keys, "left").join(known, keys, "left").withColumns(
            {"longest_lost": F.coalesce("__longest", "longest_lost"), "__own": F.col("lost_segments"), "lost_segments": F.coalesce("__known", "lost_segments")}
        )
    else:
        out = out.withColumn("__own", F.col("lost_segments"))
    if client_rule:
        trailing = (F.col("__last_lost") == F.col("__last")).cast("int")
        out = out.withColumn("reacquisitions", F.col("__own") - F.coalesce(trailing, F.lit(0)))
    else:
        out = out.join(reacquisitions(frames, keys), keys, "left")
    if server is not None:
        out = out.join(server, keys, "left").withColumns(
            {
                "tracked_pct": F.coalesce("server_coverage_pct", "tracked_pct"),
                "avg_conf": F.coalesce("server_avg_conf", "avg_conf"),
                "reacquisitions": F.coalesce("server_reacquisitions", "reacquisitions"),
            }
        )
    return out.select(
        *keys, "frames", "tracked_pct", "avg_conf", "occluded_segments", "lost_segments",
        F.coalesce("longest_lost", F.lit(0)).alias("longest_lost"),
        (F.coalesce("longest_lost", F.lit(0)) / fps).alias("longest_lost_s"), "reacquisitions",
    )


def issues(
    frames: DataFrame, fps: float, min_frames: int = 1, low_conf: float = 0.5, keys: Sequence[str] = KEYS, supplied: DataFrame | None = None
) -> DataFrame:
    """Lost, occluded and low-confidence runs of at least ``min_frames`` frames; frames of ``supplied`` segments are lost."""
    gone = F.col("state") == "lost"
    if supplied is not None:
        totals = frames.groupBy(*keys).agg((F.max("f") + 1).alias("total"))
        inside = lost_runs(frames, supplied, totals, keys).select(*keys, F.explode(F.sequence("start", "end")).alias("f"), F.lit(True).alias("__gone"))
        frames = frames.join(inside, [*keys, "f"], "left")
        gone = gone | F.col("__gone")
    kind = (
        F.when(gone, "lost").when(F.col("state") == "occluded", "occluded").when(F.col("conf") < low_conf, "low")
    )
    rows = frames.withColumn("kind", kind).where("kind is not null")
    r = runs(rows, keys, pos="f", state="kind").where(F.col("n") >= min_frames)
    return r.select(
        *keys, F.col("state").alias("kind"), "start", "end", (F.col("start") / fps).alias("start_t"),
        ((F.col("end") + 1) / fps).alias("end_t"),
    )


def next_and_previous_issue(issue: DataFrame, at: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each requested frame ``f``: start of the next issue and end of the last one that is already over."""
    out = asof_before(at, issue, keys, "f", "end", "prev_end")
    flipped = issue.select(*keys, (-F.col("start")).alias("start"))
    out = asof_before(out.withColumn("__g", -F.col("f")), flipped, keys, "__g", "start", "next_start")
    return out.withColumn("next_start", -F.col("next_start")).drop("__g")


def trail(frames: DataFrame, fps: float, seconds: float = 1.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Box centres of the last ``seconds`` up to each frame (dense frames), frames without a box left out."""
    n = max(1, int(seconds * fps + 0.5))
    rows = with_halo(frames.withColumn("__pos", F.col("f")), "__pos", before=n, after=0)
    w = W.partitionBy(*keys, "blk").orderBy("f").rowsBetween(-n, 0)
    point = F.when(F.col("x").isNotNull(), F.struct("f", "x", "y"))
    return rows.withColumn("trail", F.collect_list(point).over(w)).where("is_owner").select(*keys, "f", "trail")


def clip_fps(detections: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Frames per second from the latest (frame, time) pair."""
    best = detections.groupBy(*keys).agg(F.max(F.struct("frame", "t")).alias("b"))
    ok = (F.col("b.frame") > 0) & (F.col("b.t") > 0)
    return best.select(*keys, F.when(ok, F.round(F.col("b.frame") / F.col("b.t"), 2)).alias("fps"))


class BallFilter:
    """Constant-velocity filter with a jump gate. Both axes share one covariance, so it is kept once."""

    def __init__(self, fps: float):
        dt = 1.0 / fps
        self.f = np.array([[1.0, dt], [0.0, 1.0]])
        self.q = np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]]) * 500.0
        self.p = np.eye(2) * 1000.0
        self.state = None          # rows: position, velocity; columns: x, y
        self.last = None           # last accepted detection
        self.gate = C.BALL_MAX_SPEED_MS / fps * C.BALL_PX_PER_M * 2.0

    def predict(self):
        self.state = self.f @ self.state
        self.p = self.f @ self.p @ self.f.T + self.q
        return self.state[0]

    def accept(self, z) -> bool:
        if self.state is not None and self.last is not None and np.hypot(*(z - self.last)) > self.gate:
            return False
        if self.state is None:
            self.state = np.array([z, [0.0, 0.0]])
        else:
            self.predict()
            gain = self.p[:, 0] / (self.p[0, 0] + 25.0)
            self.state = self.state + np.outer(gain, z - self.state[0])
            keep = np.eye(2) - np.outer(gain, [1.0, 0.0])
            self.p = keep @ self.p @ keep.T + np.outer(gain, gain) * 25.0
        self.last = z
        return True


BALL_SCHEMA = "video_id bigint, track_id bigint, frame bigint, cx double, cy double, is_detected boolean, gated boolean"


def ball_rows(fps: float, ball: BallFilter | None = None, seen: list[int] | None = None):
    """Step function of a live series: detections in, one row per frame out (predicted where missing or gated).

    ``seen`` holds the last frame handled; both arguments let a stream resume from stored state. Frames up to it come late
    or again and are left out, so no frame is written twice.
    """
    ball = ball or BallFilter(fps)
    seen = [] if seen is None else seen

    def step(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for v, t, frame, x, y in part[["video_id", "track_id", "frame", "cx", "cy"]].itertuples(index=False):
            if seen and frame <= seen[0]:
                continue
            if seen:
                for missing in range(seen[0] + 1, frame):
                    px, py = ball.predict()
                    out.append((v, t, missing, px, py, False, False))
            seen[:] = [frame]
            if ball.accept(np.array([x, y])):
                out.append((v, t, frame, x, y, True, False))
            else:
                px, py = ball.predict()
                out.append((v, t, frame, px, py, False, True))
        return pd.DataFrame(out, columns=["video_id", "track_id", "frame", "cx", "cy", "is_detected", "gated"])

    return step
