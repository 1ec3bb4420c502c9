"""From tracker output to stored facts: identity, merged statistics, metric rows, heatmaps, detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import centre_size
from ..functions.numbers import stable_round
from ..functions.text import object_class, team_side
from ..plans.materialize import reuse
from . import heatmap as H
from .identity import resolve_players, track_identity
from .stats import SUMMED, merged_fragments

METRIC_COLUMNS = [
    "minutes_played", "visible_minutes", "coverage_pct", "distance_per_min", "top_speed_kmh", "avg_pitch_x", "avg_pitch_y", "hsr_count",
    "sprint_count", "high_intensity_efforts", *SUMMED,
]


def player_key(resolved: DataFrame) -> DataFrame:
    """One key per person: the roster id, or the team and placeholder name."""
    made = F.concat_ws(":", F.lit("new"), F.col("placeholder_team_id"), F.col("placeholder_name"))
    return resolved.withColumn("player_key", F.coalesce(F.concat(F.lit("id:"), F.col("player_id")), made))


def metric_rows(merged: DataFrame, keys: Sequence[str] = ("video_id", "player_key"), metrics: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """Wide metrics to (keys, metric_key, value); unmeasured values stay as null rows."""
    pairs = [F.struct(F.lit(m).alias("metric_key"), F.col(m).cast("double").alias("value")) for m in metrics]
    return merged.select(*keys, F.explode(F.array(*pairs)).alias("m")).select(*keys, "m.*")


def ingest(detections: DataFrame, fragments: DataFrame, videos: DataFrame, players: DataFrame) -> dict[str, DataFrame]:
    """Tables of one or many videos at once.

    ``detections``: video_id, track_id, frame, jersey, team (text), role, class, confidence, x, y, x1..y2.
    ``fragments``: the tracker's statistics per track. ``videos``: video_id, home_team_id, away_team_id.
    """
    det = detections.withColumn("team", team_side(F.col("team")))
    own = fragments.select("video_id", "track_id", "jersey", team_side(F.col("team")).alias("team"), "role")
    tracks = track_identity(det, own).withColumnRenamed("team", "side")
    who = reuse(player_key(resolve_players(tracks, videos, players)))
    stats = merged_fragments(
        fragments.where("track_id >= 0").join(who.select("video_id", "track_id", "player_key"), ["video_id", "track_id"]),
        ["video_id", "player_key"],
    )
    person = who.where("player_key is not null").select("video_id", "track_id", "player_key")
    cells, summary = H.sample_heatmap(
        det.where("x is not null and y is not null"), ["video_id", "track_id"], members=person, member_keys=["video_id", "player_key"]
    )
    # the tracker's own mean position wins, the mean of the detections fills in
    stats = stats.join(summary.select("video_id", "player_key", "mean_x", "mean_y"), ["video_id", "player_key"], "left").withColumns(
        {"avg_pitch_x": F.coalesce("avg_pitch_x", stable_round("mean_x", 2)), "avg_pitch_y": F.coalesce("avg_pitch_y", stable_round("mean_y", 2))}
    ).drop("mean_x", "mean_y")
    roles = tracks.select("video_id", "track_id", F.col("role").alias("__role"))
    known = det.join(who.select("video_id", "track_id", "player_key"), ["video_id", "track_id"], "left")
    rows = known.join(roles, ["video_id", "track_id"], "left")
    size = centre_size(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    stored = rows.select(
        "video_id", "track_id", F.col("frame").alias("frame_number"), "player_key",
        object_class(F.coalesce("role", "__role"), F.col("class"), F.col("track_id")).alias("object_class"),
        "jersey", "x1", "y1", "x2", "y2", size.alias("s"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.col("x").alias("pitch_x"), F.col("y").alias("pitch_y"),
    ).select("*", "s.*").drop("s")
    return {"players": who, "stats": stats, "metrics": metric_rows(stats), "heatmap": cells, "detections": stored}


def fill_nulls(rows: DataFrame, derived: dict) -> DataFrame:
    """Backfill: a column gets its derived value only where it is null."""
    return rows.withColumns({c: F.coalesce(F.col(c), e) for c, e in derived.items()})


def plausible_rate(distance_km, minutes, given=None):
    """(metres per minute, note): null with a note under one minute or above 300 m/min."""
    rate = F.when(minutes > 0, distance_km * 1000 / minutes)
    rate = rate if given is None else F.coalesce(given, rate)
    short, high = F.coalesce(minutes < 1, F.lit(False)), F.coalesce(rate > 300, F.lit(False))
    value = F.when(~short & ~high, rate)
    note = F.when(rate.isNotNull() & short, "clip too short for a rate").when(rate.isNotNull() & high, "rate out of range")
    return value, note


def legible(height, width, sharpness, contrast):
    """A number reading is used when its crop is large, sharp and contrasted enough (measured upstream)."""
    return F.coalesce((height >= 40) & (width >= 30) & (sharpness >= 20) & (contrast >= 30), F.lit(False))
