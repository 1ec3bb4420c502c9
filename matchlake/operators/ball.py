"""Filtered ball path: constant-velocity Kalman filter with a jump gate, run in blocks that are spliced.

Each row depends on the last accepted detection and on the covariance, so one series is sequential by definition. Both are
forgotten quickly, though: a filter that starts cold at some detection soon accepts the same detections as the one that was
carried there, and then has its covariance and state. So every block of a series is run from a cold start; a second run carries
in the end of the block before and stops where it agrees with the cold one, whose path it then takes. A block whose end has
changed (it never agreed) makes the next block run again, until no end changes. Blocks run in parallel; a task of
that search holds one block, the last pass only the state of one series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as C
from ..plans.materialize import materialised

KEYS = ("video_id", "track_id")
MEASUREMENT = 25.0
DRIFT = 500.0
FIRST_COVARIANCE = 1000.0
#: Paths agree when they differ by no more than this; what remains dies out.
AGREE = 1e-11

State = tuple[float, ...]  # frame, x, vx, y, vy, three covariances (both axes share them), last accepted x, y


class Path:
    """The filter of one frame rate."""

    def __init__(self, fps: float):
        self.dt = dt = 1.0 / fps
        self.q = (DRIFT * dt**4 / 4, DRIFT * dt**3 / 2, DRIFT * dt**2)
        self.gate = C.BALL_MAX_SPEED_MS / fps * C.BALL_PX_PER_M * 2.0

    def start(self, frame: int, x: float, y: float) -> State:
        return (float(frame), x, 0.0, y, 0.0, FIRST_COVARIANCE, 0.0, FIRST_COVARIANCE, x, y)

    def ahead(self, s: State, frames: int) -> State:
        """The prediction ``frames`` frames later, in closed form."""
        f, x, vx, y, vy, p, r, v, lx, ly = s
        a, (q0, q1, q2) = frames * self.dt, self.q
        s1 = self.dt * frames * (frames - 1) / 2
        s2 = self.dt**2 * (frames - 1) * frames * (2 * frames - 1) / 6
        return (f + frames, x + vx * a, vx, y + vy * a, vy, p + 2 * a * r + a * a * v + frames * q0 + 2 * s1 * q1 + s2 * q2, r + a * v + frames * q1 + s1 * q2, v + frames * q2, lx, ly)

    def step(self, s: State | None, frame: int, x: float, y: float) -> tuple[State, bool]:
        """The state after a detection, and whether the detection was accepted."""
        if s is None:
            return self.start(frame, x, y), True
        inside = math.hypot(x - s[8], y - s[9]) <= self.gate
        f, px, vx, py, vy, p, r, v, lx, ly = self.ahead(s, frame - int(s[0]))
        if not inside:
            return (f, px, vx, py, vy, p, r, v, lx, ly), False
        k0, k1 = p / (p + MEASUREMENT), r / (p + MEASUREMENT)
        covariance = ((1 - k0) ** 2 * p + MEASUREMENT * k0 * k0, (1 - k0) * (r - k1 * p) + MEASUREMENT * k0 * k1, v - 2 * k1 * r + k1 * k1 * p + MEASUREMENT * k1 * k1)
        return (f, px + k0 * (x - px), vx + k1 * (x - px), py + k0 * (y - py), vy + k1 * (y - py), *covariance, x, y), True

    def advance(self, cold: State | None, carried: State | None, frame: int, x: float, y: float) -> tuple[State, State | None, State | None, State, bool]:
        """(cold, carried, state before, state after, accepted) after a detection; from where both agree on, ``carried`` is None and the path is that of the cold start."""
        before = carried if carried is not None else cold
        cold, accepted = self.step(cold, frame, x, y)
        if carried is None:
            return cold, None, before, cold, accepted
        now, accepted = self.step(carried, frame, x, y)
        agree = now[8:] == cold[8:] and all(abs(a - b) <= AGREE * max(1.0, abs(a)) for a, b in zip(now, cold))
        return cold, None if agree else now, before, now, accepted

    def walk(self, rows: Sequence[tuple[int, float, float]], carried: State | None) -> Iterator[tuple[State | None, State, bool]]:
        """(state before, state after, accepted) of every detection."""
        cold = None
        for frame, x, y in rows:
            cold, carried, before, now, accepted = self.advance(cold, carried, frame, x, y)
            yield before, now, accepted


ENDS = "video_id bigint, track_id bigint, block bigint, end array<double>"
#: A detection, or the prediction in its place, and the state before it: its frame, place and speed.
STEPS = "video_id bigint, track_id bigint, frame bigint, cx double, cy double, accepted boolean, last bigint, px double, vx double, py double, vy double"


NAMES = [c.split()[0] for c in STEPS.split(", ")]
TYPES = [{"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in STEPS.split(", ")]


def _rows(part: pd.DataFrame) -> list[tuple[int, float, float]]:
    part = part.sort_values(["frame", "cx", "cy"]).drop_duplicates("frame")  # of several detections in a frame the first
    return list(part[["frame", "cx", "cy"]].itertuples(index=False, name=None))


def _carried(carry: pd.DataFrame) -> State | None:
    return tuple(carry["end"].iloc[0]) if len(carry) and carry["end"].iloc[0] is not None else None


def smooth_ball(detections: DataFrame, fps: float, *, block_frames: int = 4096) -> DataFrame:
    """One row per frame from the first to the last detection of a series: the detection where it is accepted, else the prediction.

    Columns: video_id, track_id, frame, cx, cy, ``is_detected`` and ``gated`` (a detection beyond the gate). Frames without
    detections are made in expressions from the state before them, however many they are. Null keys are keys like any other;
    detections without a frame or place are left out.
    """
    path = Path(fps)
    src = detections.select(*[F.col(k).cast("bigint").alias(k) for k in KEYS], F.col("frame").cast("bigint").alias("frame"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    src = src.where("frame is not null and cx is not null and cy is not null").withColumn("block", F.floor(F.col("frame") / F.lit(block_frames)))
    group = [*KEYS, "block"]
    spans = src.groupBy(*KEYS).agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    many = materialised(spans.where("lo < hi").select(F.struct(*KEYS).alias("series")))

    def one(part: pd.DataFrame, end: State) -> pd.DataFrame:
        return pd.DataFrame({"video_id": part["video_id"].iloc[:1], "track_id": part["track_id"].iloc[:1], "block": part["block"].iloc[:1], "end": [list(end)]})

    def cold_end(part: pd.DataFrame) -> pd.DataFrame:
        return one(part, list(path.walk(_rows(part), None))[-1][1])

    def carried_end(part: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        return one(part, list(path.walk(_rows(part), _carried(carry)))[-1][1]) if len(part) else pd.DataFrame({"video_id": [], "track_id": [], "block": [], "end": []})

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # many short series pass one after the other; all that is kept is the state of the current one
        current, cold, carried, seen = None, None, None, None
        for batch in batches:
            out = []
            for *key, frame, x, y, end in zip(*[c.to_pylist() for c in batch.columns]):
                if key != current:
                    current, cold, carried, seen = key, None, None if end is None else tuple(end), None
                if frame == seen:
                    continue  # of several detections in a frame the first
                seen = frame
                cold, carried, prior, now, ok = path.advance(cold, carried, frame, x, y)
                out.append((key[0], key[1], frame, x if ok else now[1], y if ok else now[3], ok, *((None,) * 5 if prior is None else (int(prior[0]), *prior[1:5]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)] if out else [pa.array([], t) for t in TYPES], names=NAMES)

    def before(ends: DataFrame) -> DataFrame:
        return ends.withColumn("end", F.lag("end").over(W.partitionBy(*KEYS).orderBy("block")))

    carry = F.lit(None).cast("array<double>").alias("end")
    rows = src.select(*group, "frame", "cx", "cy", carry)
    if not many.isEmpty():
        long = materialised(src.withColumn("series", F.struct(*KEYS)).join(many, "series", "left_semi").drop("series"))
        ends = materialised(long.groupBy(*group).applyInPandas(cold_end, ENDS))
        while True:
            moved = materialised(long.groupBy(*group).cogroup(before(ends).groupBy(*group)).applyInPandas(carried_end, ENDS))
            settled = ends.union(moved).groupBy(*group).agg(F.count_distinct("end").alias("ends")).where("ends > 1").isEmpty()
            ends = moved
            if settled:
                break
        known = before(ends).where("end is not null").select(F.struct(*group).alias("place"), "end")
        rows = src.withColumn("place", F.struct(*group)).join(known, "place", "left").select(*group, "frame", "cx", "cy", "end")
    found = rows.repartition(*group).sortWithinPartitions(*group, "frame", "cx", "cy").mapInArrow(steps, STEPS)

    seen = F.struct("frame", "cx", "cy", F.col("accepted").alias("is_detected"), (~F.col("accepted")).alias("gated"))
    along = lambda f, at, speed: F.col(at) + F.col(speed) * (f - F.col("last")) * path.dt
    missing = F.when(F.col("frame") - F.col("last") > 1, F.sequence(F.col("last") + 1, F.col("frame") - 1))
    gap = F.transform(missing, lambda f: F.struct(f.alias("frame"), along(f, "px", "vx").alias("cx"), along(f, "py", "vy").alias("cy"), F.lit(False).alias("is_detected"), F.lit(False).alias("gated")))
    return found.select(*KEYS, F.inline(F.concat(F.coalesce(gap, F.array().cast(gap_type())), F.array(seen))))


def gap_type() -> str:
    return "array<struct<frame:bigint,cx:double,cy:double,is_detected:boolean,gated:boolean>>"
