"""Following one chosen player through a video."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..plans.runs import runs
from ..plans.scan import ordered_scan
from .identity import iou


def resolve_by_box(requests: DataFrame, boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """requests (request_id, video_id, frame, tx1..ty2) -> best overlapping track, or an error."""
    j = requests.join(boxes, ["video_id", "frame"], "left")
    o = iou([F.col(c) for c in ("tx1", "ty1", "tx2", "ty2")], [F.col(c) for c in ("x1", "y1", "x2", "y2")])
    best = j.groupBy("request_id").agg(
        F.max(F.when(F.col("track_id").isNotNull(), F.struct(o.alias("iou"), (-F.col("track_id")).alias("t")))).alias("b")
    )
    found = F.col("b.iou") >= threshold
    return best.select(
        "request_id", F.when(found, -F.col("b.t")).alias("track_id"),
        F.when(F.col("b").isNull(), "no player on this frame").when(~found, "no player matches the box").alias("error"),
    )


def resolve_by_point(requests: DataFrame, boxes: DataFrame) -> DataFrame:
    """requests (request_id, video_id, frame, px, py) -> the box around the point, else the nearest centre."""
    j = requests.join(boxes, ["video_id", "frame"], "left")
    inside = F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2"))
    dist = F.sqrt(F.pow(F.col("px") - (F.col("x1") + F.col("x2")) / 2, 2) + F.pow(F.col("py") - (F.col("y1") + F.col("y2")) / 2, 2))
    rank = F.struct((~inside).alias("o"), F.when(inside, 0.0).otherwise(dist).alias("d"), F.col("track_id").alias("t"))
    best = j.groupBy("request_id").agg(F.min(F.when(F.col("track_id").isNotNull(), rank)).alias("b"))
    return best.select(
        "request_id", F.col("b.t").alias("track_id"), F.when(F.col("b").isNull(), "no player on this frame").alias("error")
    )


def resolve_by_jersey(requests: DataFrame, tracks: DataFrame) -> DataFrame:
    """requests (request_id, video_id, jersey, team?) over tracks (video_id, track_id, jersey, team, player_uid).

    Several tracks are fine when they are one player; different players are an error.
    """
    t = tracks.select("video_id", F.col("track_id"), "jersey", F.col("team").alias("track_team"), F.coalesce("player_uid", "track_id").alias("uid"))
    j = requests.join(t, ["video_id", "jersey"], "left")
    ok = F.col("track_id").isNotNull() & (F.col("team").isNull() | (F.col("team") == F.col("track_team")))
    g = j.groupBy("request_id").agg(
        F.count("track_id").alias("numbered"), F.count(F.when(ok, 1)).alias("n"),
        F.min(F.when(ok, F.col("uid"))).alias("lo"), F.max(F.when(ok, F.col("uid"))).alias("hi"), F.min(F.when(ok, F.col("track_id"))).alias("track_id"),
    )
    clear = (F.col("n") > 0) & (F.col("lo") == F.col("hi"))
    return g.select(
        "request_id", F.when(clear, F.col("lo")).alias("player_uid"), F.when(clear, F.col("track_id")).alias("track_id"),
        F.when(F.col("numbered") == 0, "no player with this number").when(F.col("n") == 0, "no player with this number on the team")
        .when(~clear, "ambiguous number").alias("error"),
    )


def ambiguity_candidates(requests: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks to choose from for requests that are ambiguous."""
    bad = resolve_by_jersey(requests, tracks).where("error = 'ambiguous number'").select("request_id")
    r = requests.join(bad, "request_id", "left_semi").select("request_id", "video_id", "jersey", F.col("team").alias("wanted"))
    j = r.join(tracks, ["video_id", "jersey"]).where(F.col("wanted").isNull() | (F.col("wanted") == F.col("team")))
    return j.select("request_id", "video_id", "track_id", "player_uid", "jersey", "team")


def candidate_frames(targets: DataFrame, detections: DataFrame, tracks: DataFrame, threshold: float = C.APPEARANCE_THRESHOLD) -> DataFrame:
    """One row per (video, target, frame) with the few detections that could be the target.

    ``targets``: video_id, target_id, track_id, jersey, team. ``tracks``: video_id, track_id, jersey, team and, when
    appearances are known, ``similarity`` per target_id. A closing row after the last frame of the video ends the scan.
    """
    t = targets.select("video_id", "target_id", F.col("track_id").alias("own"), F.col("jersey").alias("want_jersey"), F.col("team").alias("want_team"))
    k = tracks.select("video_id", "track_id", F.col("jersey").alias("k_jersey"), F.col("team").alias("k_team"),
                      *(["target_id", "similarity"] if "similarity" in tracks.columns else []))
    k = k if "similarity" in k.columns else k.withColumn("similarity", F.lit(None).cast("double"))
    # tracks, not detections, are matched with targets: track-level attributes decide every gate but motion
    pairs = t.join(k, ["video_id", "target_id"] if "target_id" in k.columns else ["video_id"])
    same_team = F.col("want_team").isNull() | F.coalesce(F.col("want_team") == F.col("k_team"), F.lit(False))
    gate2 = F.coalesce(F.col("k_jersey") == F.col("want_jersey"), F.lit(False)) & same_team
    gate3 = F.coalesce(F.col("similarity") >= threshold, F.lit(False)) & same_team
    own = F.col("track_id") == F.col("own")
    pairs = pairs.withColumns({"own_track": own, "gate2": gate2, "gate3": gate3}).where(own | gate2 | gate3)
    pairs = pairs.select("video_id", "target_id", "track_id", "own_track", "gate2", "gate3", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    box = F.struct("track_id", "own_track", "gate2", "gate3", "similarity", "x1", "y1", "x2", "y2", "pitch_x", "pitch_y", "confidence", "t")
    found = detections.join(pairs, ["video_id", "track_id"]).groupBy("video_id", "target_id", "frame").agg(
        F.array_sort(F.collect_list(box)).alias("boxes")
    )
    end = detections.groupBy("video_id").agg((F.max("frame") + 1).alias("frame"))
    none = F.array().cast(found.schema["boxes"].dataType)
    closing = targets.select("video_id", "target_id").join(end, "video_id").select("video_id", "target_id", "frame", none.alias("boxes"))
    return found.unionByName(closing)


FOLLOW_SCHEMA = (
    "video_id bigint, target_id bigint, frame bigint, t double, x1 double, y1 double, x2 double, y2 double, confidence double, "
    "state string, source string, track_id bigint"
)
_COLUMNS = ["video_id", "target_id", "frame", "t", "x1", "y1", "x2", "y2", "confidence", "state", "source", "track_id"]


class Follower:
    """State carried from frame to frame: known tracks, last box and place, frames since the last sight."""

    def __init__(self, fps: float):
        self.fps = fps
        self.tracks: set[int] = set()
        self.box = None
        self.place = None
        self.missing = 0
        self.state = "lost"
        self.next_frame = 0

    def snapshot(self) -> dict:
        num = lambda v: None if v is None else float(v)
        return {
            "tracks": sorted(int(t) for t in self.tracks), "box": None if self.box is None else [num(v) for v in self.box],
            "place": None if self.place is None else [num(v) for v in self.place], "missing": self.missing, "state": self.state,
            "next": int(self.next_frame),
        }

    def restore(self, s: dict) -> None:
        self.tracks, self.missing, self.state, self.next_frame = set(s["tracks"]), s["missing"], s["state"], s["next"]
        self.box = None if s["box"] is None else tuple(s["box"])
        self.place = None if s["place"] is None else tuple(s["place"])

    def near(self, b) -> bool:
        """Within reach of the last known place, with half as much again for measurement error."""
        if self.place is None or b["pitch_x"] is None or b["pitch_y"] is None or np.isnan(b["pitch_x"]) or np.isnan(b["pitch_y"]):
            return True
        x, y, t = self.place
        dt = b["t"] - t
        return dt <= 0 or np.hypot(b["pitch_x"] - x, b["pitch_y"] - y) <= C.STITCH_MAX_SPEED_MS * dt * 1.5

    def choose(self, boxes):
        for b in boxes:
            if b["own_track"] or b["track_id"] in self.tracks:
                return b
        for b in boxes:
            if b["gate2"] and self.near(b):
                return b
        alike = [b for b in boxes if b["gate3"] and self.near(b)]
        return max(alike, key=lambda b: b["similarity"]) if alike else None

    def jumps(self, b) -> bool:
        """A jump further than a player can run relative to the box height is another person (for about two seconds)."""
        if self.box is None or self.missing >= 2 * self.fps:
            return False
        x1, y1, x2, y2 = self.box
        dx = (b["x1"] + b["x2"]) / 2 - (x1 + x2) / 2
        dy = (b["y1"] + b["y2"]) / 2 - (y1 + y2) / 2
        return np.hypot(dx, dy) > max(y2 - y1, 1.0) * (1.0 + 0.35 * self.missing)

    def frame(self, frame: int, boxes) -> tuple:
        b = self.choose(boxes) if len(boxes) else None
        if b is not None and self.jumps(b):
            b = None
        t = round(frame / self.fps, 3)
        if b is None:
            self.missing += 1
            self.state = "occluded" if self.missing <= C.OCCLUSION_FRAMES else "lost"
            held = self.box if self.box is not None and self.missing < 10 else None
            return (frame, t, *(held or (None,) * 4), 0.0, self.state, "interpolated" if held else "lost", None)
        back = self.state in ("occluded", "lost") and self.missing > 5
        self.state = "reacquired" if back else "tracked"
        known = b["pitch_x"] is not None and not np.isnan(b["pitch_x"])
        self.place = (b["pitch_x"], b["pitch_y"], frame / self.fps) if known else None
        self.box = (b["x1"], b["y1"], b["x2"], b["y2"])
        self.missing = 0
        self.tracks.add(b["track_id"])
        return (frame, t, *self.box, round(b["confidence"], 3), self.state, "detected", b["track_id"])


def follow_rows(fps: float, f: Follower | None = None):
    f = f or Follower(fps)

    def step(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for video, target, frame, boxes in part[["video_id", "target_id", "frame", "boxes"]].itertuples(index=False):
            while f.next_frame < frame:
                out.append((video, target, *f.frame(f.next_frame, [])))
                f.next_frame += 1
            if len(boxes):
                out.append((video, target, *f.frame(frame, boxes)))
                f.next_frame = frame + 1
        return pd.DataFrame(out, columns=_COLUMNS)

    return step


def follow(candidates: DataFrame, fps: float) -> DataFrame:
    """Frame-by-frame states of each target. Each frame depends on the one before, so a target is scanned in order."""
    return ordered_scan(candidates, ["video_id", "target_id"], ["frame"], lambda: follow_rows(fps), FOLLOW_SCHEMA)


def statistics(frames: DataFrame, fps: float) -> DataFrame:
    """Tracked share, re-acquisitions, lost time and tracks used per target."""
    keys = ["video_id", "target_id"]
    seen = F.col("state").isin("tracked", "reacquired")
    base = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_frames"),
        F.count(F.when(seen, 1)).alias("tracked_frames"),
        F.round(F.count(F.when(seen, 1)) / F.count(F.lit(1)) * 100, 2).alias("tracked_pct"),
        F.count(F.when(F.col("state") == "reacquired", 1)).alias("reacquisition_count"),
        F.countDistinct("track_id").alias("tracks_used"),
    )
    lost = runs(frames.where("state = 'lost'"), keys, pos="frame").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lost_segments"), F.round(F.sum(F.col("n") / fps), 2).alias("lost_seconds")
    )
    return base.join(lost, keys, "left").fillna(0, ["lost_segments"]).fillna(0.0, ["lost_seconds"])


def public_status(state: str = "state"):
    """tracked / interpolated / lost for each frame state."""
    s = F.col(state)
    return F.when(s.isin("tracked", "reacquired"), "tracked").when(s == "occluded", "interpolated").otherwise("lost")


def frame_candidates(boxes: DataFrame, requests: DataFrame, radius: int = 15) -> DataFrame:
    """People on a requested frame with number, team and role voted from the frames around it.

    ``requests``: video_id, at. Only rows within ``radius`` frames of a request take part in the votes: rows are joined on
    slots of as many frames, of which a request touches two, and then tested.
    """
    width = 2 * radius + 1
    slot = lambda f: F.floor(f / width)
    asked = requests.distinct().withColumn("__slot", F.explode(F.array_distinct(F.array(slot(F.col("at") - radius), slot(F.col("at") + radius)))))
    near = boxes.withColumn("__slot", slot(F.col("frame"))).join(asked, ["video_id", "__slot"]).drop("__slot")
    near = near.where(F.abs(F.col("frame") - F.col("at")) <= radius)
    keys = ["video_id", "at", "track_id"]

    def vote(column: str, weight=None) -> DataFrame:
        w = F.count(F.lit(1)) if weight is None else F.sum(F.col(weight).cast("decimal(20,6)"))
        n = near.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(w.alias("__w"), F.min("frame").alias("__f"))
        return n.groupBy(*keys).agg(F.max_by(column, F.struct(F.col("__w"), (-F.col("__f")).alias("f"))).alias(f"voted_{column}"))

    out = near.where("frame = at")
    for v in (vote("jersey", "confidence"), vote("team"), vote("role")):
        out = out.join(v, keys, "left")
    return out
