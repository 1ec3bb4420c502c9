"""Who is who: votes per track, roster resolution, tracklet stitching and team colours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..plans.components import component_labels
from ..plans.materialize import materialised
from ..plans.ranking import ordinal_position
from . import registry as R

KEYS = ("video_id", "track_id")


# ---- votes ------------------------------------------------------------------------------------------------------
def majority_vote(rows: DataFrame, value: str, keys: Sequence[str] = KEYS, frame: str = "frame", min_readings: int = 1) -> DataFrame:
    """Most frequent value per track, the one seen first on a tie; null when there are too few readings."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(frame).alias("__first"))
    best = n.groupBy(*keys).agg(
        F.max_by(value, F.struct(F.col("__n"), (-F.col("__first")).alias("f"))).alias(value), F.sum("__n").alias("readings")
    )
    return best.where(F.col("readings") >= min_readings).select(*keys, value, "readings")


def weighted_vote(
    rows: DataFrame, roster: DataFrame | None = None, keys: Sequence[str] = KEYS, min_readings: int = 3
) -> DataFrame:
    """Number with the highest summed confidence.

    ``roster`` (team, jersey) keeps only readings of numbers that the track's team has, before anything is counted; the
    team is the one that most of the track's rows name.
    """
    read = rows.where("jersey is not null")
    if roster is not None:
        team = majority_vote(rows, "team", keys).select(*keys, "team")
        read = read.drop("team").join(team, list(keys)).join(roster.select("team", "jersey").distinct(), ["team", "jersey"], "left_semi")
    counts = read.groupBy(*keys, "jersey").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col("confidence").cast("decimal(20,6)")).alias("__w"), F.min("frame").alias("__first"),
    )
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("readings")).where(F.col("readings") >= min_readings)
    best = counts.groupBy(*keys).agg(
        F.max_by(F.struct("jersey", "__w"), F.struct(F.col("__w"), (-F.col("__first")).alias("f"))).alias("b")
    )
    return best.join(total, list(keys)).select(
        *keys, F.col("b.jersey").alias("jersey"), F.col("b.__w").cast("double").alias("weight"), "readings"
    )


def majority_votes(rows: DataFrame, values: Sequence[str], keys: Sequence[str] = KEYS, frame: str = "frame") -> DataFrame:
    """``majority_vote`` of several columns at once: the rows are counted in one pass, and the votes are taken from the counts.

    Every key has a row, also one without any reading.
    """
    counts = rows.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("__n"), F.min(frame).alias("__first"))
    read = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in values])
    each = counts.select(*keys, F.explode(read).alias("__r"), "__n", "__first").select(*keys, "__r.*", "__n", "__first")
    n = each.groupBy(*keys, "what", "value").agg(F.sum("__n").alias("__n"), F.min("__first").alias("__first"))
    rank = F.struct(F.col("__n"), (-F.col("__first")).alias("f"))
    best = lambda c: F.max_by("value", F.when((F.col("what") == c) & F.col("value").isNotNull(), rank))
    return n.groupBy(*keys).agg(*[best(c).cast(rows.schema[c].dataType).alias(c) for c in values])


def track_identity(detections: DataFrame, stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number, side and role per track: the tracker's own stat row wins over the vote of the detections."""
    keys, values = list(keys), ["jersey", "team", "role"]
    votes = majority_votes(detections.where("track_id >= 0"), values, keys).withColumnsRenamed({c: f"__v_{c}" for c in values})
    own = stats.select(*keys, *[F.col(c).alias(f"__s_{c}") for c in values])
    out = votes.select(*keys).union(stats.select(*keys)).distinct()
    out = out.join(votes, keys, "left").join(own, keys, "left")
    return out.select(*keys, *[F.coalesce(f"__s_{c}", f"__v_{c}").alias(c) for c in values])


def resolve_players(tracks: DataFrame, videos: DataFrame, players: DataFrame) -> DataFrame:
    """Player of each track by roster number, else a placeholder key; referees get none.

    ``tracks``: video_id, track_id, jersey, side (home / away / null), role. ``videos``: video_id, home_team_id,
    away_team_id. A placeholder is shared by all videos of a team when the number is known.
    """
    roster = players.where("jersey is not null").groupBy("team_id", "jersey").agg(F.max("player_id").alias("__pid"))
    t = tracks.where(~F.coalesce(F.col("role") == "referee", F.lit(False))).join(videos, "video_id")
    for side in ("home", "away"):
        r = roster.select(
            F.col("team_id").alias(f"{side}_team_id"), F.col("jersey"), F.col("__pid").alias(f"__{side}")
        )
        t = t.join(r, [f"{side}_team_id", "jersey"], "left")
    found = (
        F.when(F.col("side") == "home", F.col("__home")).when(F.col("side") == "away", F.col("__away"))
        .otherwise(F.coalesce("__home", "__away"))
    )
    team = F.when(F.col("side") == "away", F.col("away_team_id")).otherwise(F.col("home_team_id"))
    label = F.when(F.col("jersey").isNotNull(), F.concat(F.lit("#"), F.col("jersey"))).otherwise(
        F.concat(F.lit("Track "), F.col("track_id"), F.lit(" (video "), F.col("video_id"), F.lit(")"))
    )
    return t.select(
        "video_id", "track_id", found.alias("player_id"),
        F.when(found.isNull(), team).alias("placeholder_team_id"), F.when(found.isNull(), label).alias("placeholder_name"),
    )


# ---- boxes ------------------------------------------------------------------------------------------------------
def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Overlap of two (x1, y1, x2, y2) boxes, 0 when they do not meet."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise(inter / union)


BOX = ("x1", "y1", "x2", "y2")


def best_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], right_id: str, threshold: float = 0.5, cell: float = 64.0) -> DataFrame:
    """For each left box the right box of the same frame with the highest overlap at or above ``threshold``.

    Boxes meet only inside a common grid cell, so both sides are spread over the cells they touch and joined per
    (frame, cell): a crowded frame is split instead of being paired as a whole.
    """
    keys = list(keys)

    def cells(df: DataFrame) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
        return df.withColumn("__cx", F.explode(span("x1", "x2"))).withColumn("__cy", F.explode(span("y1", "y2")))

    r = right.select(*keys, F.col(right_id).alias("__rid"), *[F.col(c).alias(f"__{c}") for c in BOX])
    r = r.withColumnsRenamed({f"__{c}": c for c in BOX})
    rc = cells(r).withColumnsRenamed({c: f"__{c}" for c in BOX})
    j = cells(left).join(rc, [*keys, "__cx", "__cy"])
    overlap = iou([F.col(c) for c in BOX], [F.col(f"__{c}") for c in BOX])
    j = j.withColumn("iou", overlap).where(F.col("iou") >= threshold)
    ids = [c for c in left.columns if c not in BOX]
    best = F.max(F.struct(F.col("iou"), (-F.col("__rid")).alias("r"))).alias("b")
    return j.groupBy(*ids).agg(best).select(*ids, (-F.col("b.r")).alias("matched_id"), F.col("b.iou").alias("iou"))


def best_box_per_frame(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Single best box per frame: what suppression of overlapping boxes leaves on top."""
    others = [c for c in boxes.columns if c not in keys]
    rank = F.struct(F.col("confidence"), (-F.col("track_id")).alias("t"))
    return boxes.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("b")).select(*keys, "b.*")


# ---- appearance and motion --------------------------------------------------------------------------------------
def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity mapped to 0..1; 0 for a missing or zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    n = norm(a) * norm(b)
    return F.when(n > 0, (dot / n + 1) / 2).otherwise(F.lit(0.0))


def reachable(dx: Column, dy: Column, dt: Column, max_speed: float = C.STITCH_MAX_SPEED_MS) -> Column:
    return (dt > 0) & (F.sqrt(dx * dx + dy * dy) <= max_speed * dt)


# ---- tracklet stitching -----------------------------------------------------------------------------------------
def stitch_candidates(tracklets: DataFrame, appearance: bool = False, keep: int | None = None) -> DataFrame:
    """Successor pairs (a, b, cost) with cost <= 10 inside a video.

    A cost of at most 10 bounds the time gap, so both ends are bucketed by that gap and joined on the bucket and its
    successor only; the exact conditions follow.
    """
    size = C.STITCH_MAX_GAP_S
    a = tracklets.select(
        "video_id", F.col("track_id").alias("a"), F.col("last_frame").alias("a_last"), F.col("last_x").alias("ax"),
        F.col("last_y").alias("ay"), F.col("last_t").alias("at"), F.col("team").alias("a_team"), F.col("jersey").alias("a_jersey"),
        *([F.col("appearance").alias("a_look")] if appearance else []),
        F.explode(F.array(F.floor(F.col("last_t") / size), F.floor(F.col("last_t") / size) + 1)).alias("bucket"),
    )
    b = tracklets.select(
        "video_id", F.col("track_id").alias("b"), F.col("first_frame").alias("b_first"), F.col("first_x").alias("bx"),
        F.col("first_y").alias("by"), F.col("first_t").alias("bt"), F.col("team").alias("b_team"), F.col("jersey").alias("b_jersey"),
        *([F.col("appearance").alias("b_look")] if appearance else []),
        F.floor(F.col("first_t") / size).alias("bucket"),
    )
    gap = F.col("bt") - F.col("at")
    j = a.join(b, ["video_id", "bucket"]).where(F.col("b_first") > F.col("a_last"))
    j = j.where(F.coalesce(F.col("a_team") == F.col("b_team"), F.lit(True)) & F.coalesce(F.col("a_jersey") == F.col("b_jersey"), F.lit(True)))
    j = j.where(reachable(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), gap))
    cost = (
        F.when(F.col("a_jersey") == F.col("b_jersey"), -10.0).otherwise(0.0)
        + F.when(F.col("a_team") == F.col("b_team"), -5.0).otherwise(0.0)
        + gap / 10
    )
    if appearance:
        cost = cost - cosine(F.col("a_look"), F.col("b_look")) * 5
    return j.select("video_id", "a", "b", cost.alias("cost")).where(F.col("cost") <= C.STITCH_MAX_COST)


def _chain_component(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Greedy chains of one component, earliest track first: each goes on with the cheapest successor that no chain has yet."""
    nodes = nodes.sort_values(["first_frame", "track_id"], ignore_index=True)
    number = pd.Series(nodes.index, index=nodes["node"])
    edges = edges.assign(a=number.loc[edges["a"]].to_numpy(), b=number.loc[edges["b"]].to_numpy())
    edges = edges.assign(tie=nodes["track_id"].to_numpy()[edges["b"]]).sort_values(["a", "cost", "tie"])
    ways = edges["b"].to_numpy()
    first = np.searchsorted(edges["a"].to_numpy(), np.arange(len(nodes) + 1))
    head = np.full(len(nodes), -1, dtype=np.int64)
    for i in range(len(nodes)):
        at = i if head[i] < 0 else -1
        while at >= 0:
            head[at] = i
            at = next((j for j in ways[first[at] : first[at + 1]] if head[j] < 0), -1)
    return pd.DataFrame({"node": nodes["node"], "head": nodes["node"].to_numpy()[head]})


def stitch(tracklets: DataFrame) -> DataFrame:
    """(video, track, player_uid): tracks chained by greedy path cover of the candidate edges, numbered per video from the earliest head.

    A chain only ever meets tracks of its own component of the edges, so components, not videos, are the groups; a track
    without an edge is in none. The edges are bounded by the largest useful time gap. The numbers are positions among the
    heads of a video, by first frame, then track.
    """
    look = ["appearance"] if "appearance" in tracklets.columns else []
    cols = ["video_id", "track_id", "first_frame", "last_frame", "first_x", "first_y", "first_t", "last_x", "last_y", "last_t"]
    tracks = tracklets.select(*cols, F.col("team").cast("double"), F.col("jersey").cast("double"), *look)
    tracks = materialised(tracks.withColumn("node", F.monotonically_increasing_id()))
    edges = materialised(stitch_candidates(tracks.withColumn("track_id", F.col("node")), appearance=bool(look)).select("a", "b", "cost"))
    labels = component_labels(edges)
    members = tracks.select("node", "first_frame", "track_id").join(labels, "node").groupBy("label")
    inside = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("component")), "a").groupBy("component")
    heads = members.cogroup(inside).applyInPandas(_chain_component, "node bigint, head bigint")
    tracks = tracks.select("video_id", "track_id", "first_frame", "node").join(heads, "node", "left").withColumn("head", F.coalesce("head", "node"))
    tracks = materialised(tracks)
    starts = tracks.where("head = node").select("video_id", "first_frame", "track_id", "head")
    uids = ordinal_position(starts, ["video_id"], [F.asc("first_frame"), F.asc("track_id")], "player_uid").select("head", "player_uid")
    return tracks.join(uids, "head").select("video_id", "track_id", "player_uid")


def stats_per_uid(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """Physical metrics of a stitched player: totals added, peaks kept, number by majority of its tracks."""
    j = stats.join(mapping, ["video_id", "track_id"])
    jersey = majority_vote(j, "jersey", ["video_id", "player_uid"], frame="track_id").drop("readings")
    summed = ["distance_km", "minutes_played", "sprint_count", "hsr_count", "accel_count_high", "decel_count_high", "detections"]
    out = j.groupBy("video_id", "player_uid").agg(
        *[F.sum(c).alias(c) for c in summed if c in j.columns],
        F.max("top_speed_mph").alias("top_speed_mph"),
        F.when(F.sum("coverage_pct") > 100, 100.0).otherwise(F.sum("coverage_pct")).alias("coverage_pct"),
        F.min_by("team", "track_id").alias("team"),
        F.min_by("role", "track_id").alias("role"),
        F.count(F.lit(1)).alias("tracks"),
    )
    return out.join(jersey, ["video_id", "player_uid"], "left")


def quality_warnings(tracks: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Warnings per video from (player_uid, top_speed_mph) of its tracks."""
    t = tracks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tracks"), F.countDistinct("player_uid").alias("uids"), F.count("player_uid").alias("with_uid"),
        F.count("top_speed_mph").alias("with_speed"),
    )
    return t.select(
        *keys,
        F.array_compact(
            F.array(
                F.when(F.col("uids") / F.col("tracks") < 0.3, "few players for the number of tracks"),
                F.when(F.col("with_uid") / F.col("tracks") < 0.5, "fewer than half of the tracks have a player"),
                F.when(F.col("with_speed") == 0, "no track has a speed"),
            )
        ).alias("warnings"),
    )


def unknown_key_warnings(metrics: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """A warning per video that has metric keys which no definition, alias or other reader takes; null keys don't count.

    ``metrics``: one row per value with its ``metric_key``.
    """
    known = sorted({*R.ALIASES, *R.KNOWN_OTHER, *R.KEYS})
    odd = metrics.where(~F.col("metric_key").isin(known)).select(*keys, "metric_key").distinct()
    names = F.array_join(F.array_sort(F.collect_set("metric_key")), ", ")
    return odd.groupBy(*keys).agg(F.concat(F.lit("unknown metric keys left out: "), names).alias("warning"))


# ---- team colours -----------------------------------------------------------------------------------------------
CHANNELS = ("c1", "c2", "c3")


def median_colours(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return samples.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(c) for c in CHANNELS])


def _distance2(prefix_a: str, prefix_b: str) -> Column:
    d = [F.col(f"{prefix_a}{c}") - F.col(f"{prefix_b}{c}") for c in CHANNELS]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _centres_wide(centres: DataFrame) -> DataFrame:
    """(video_id, 0_c1 .. 1_c3): both centres of a video in one row."""
    return centres.groupBy("video_id").agg(
        *[F.max(F.when(F.col("cluster") == k, F.col(c))).alias(f"{k}_{c}") for k in (0, 1) for c in CHANNELS]
    )


def nearest_centre(colours: DataFrame, centres: DataFrame) -> DataFrame:
    """Cluster and distances (d0, d1) of each colour; the lower cluster wins a tie."""
    j = colours.join(_centres_wide(centres), "video_id")
    j = j.withColumns({"d0": F.sqrt(_distance2("", "0_")), "d1": F.sqrt(_distance2("", "1_"))})
    return j.withColumn("cluster", F.when(F.col("d1") < F.col("d0"), 1).otherwise(0)).drop(
        *[f"{k}_{c}" for k in (0, 1) for c in CHANNELS]
    )


def seed_centres(colours: DataFrame) -> DataFrame:
    """Two seeds per video without randomness: the lowest and the highest first channel."""
    key = F.struct(F.col("c1"), F.col("track_id"))
    s = colours.groupBy("video_id").agg(
        F.min_by(F.struct(*CHANNELS), key).alias("s0"), F.max_by(F.struct(*CHANNELS), key).alias("s1")
    )
    return s.select("video_id", F.explode(F.array(
        F.struct(F.lit(0).alias("cluster"), *[F.col(f"s0.{c}").alias(c) for c in CHANNELS]),
        F.struct(F.lit(1).alias("cluster"), *[F.col(f"s1.{c}").alias(c) for c in CHANNELS]),
    )).alias("s")).select("video_id", "s.*")


def team_clusters(colours: DataFrame, seeds: DataFrame | None = None, max_steps: int = 300, tolerance: float = 1e-6) -> DataFrame:
    """Centres (video, cluster, c1..c3) by Lloyd steps for all videos at once, until no centre moves by more than ``tolerance``.

    Each step is one aggregate over the colours, written to the shared checkpoint folder, so that the plan stays one step
    long. ``max_steps`` only ends a run that never settles.
    """
    centres = materialised(seeds if seeds is not None else seed_centres(colours))
    for _ in range(max_steps):
        moved = nearest_centre(colours, centres).groupBy("video_id", "cluster").agg(*[F.avg(c).alias(c) for c in CHANNELS])
        # an empty cluster keeps its centre
        old = centres.select("video_id", "cluster", *[F.col(c).alias(f"__{c}") for c in CHANNELS])
        step = materialised(old.join(moved, ["video_id", "cluster"], "left").select(
            "video_id", "cluster", *[F.coalesce(c, f"__{c}").alias(c) for c in CHANNELS],
            F.greatest(*[F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")), F.lit(0.0)) for c in CHANNELS]).alias("__by"),
        ))
        centres = step.drop("__by")
        if step.where(F.col("__by") > tolerance).isEmpty():
            break
    return centres


def assign_teams(colours: DataFrame, centres: DataFrame, outlier: float = 1.5, cohort: bool = False) -> DataFrame:
    """Nearest centre as team, far colours as referee.

    The strict rule compares with the two distances of the same track. ``cohort`` compares with the distances of all
    tracks of the video instead.
    """
    j = nearest_centre(colours, centres).withColumn("nearest", F.least("d0", "d1"))
    if cohort:
        s = j.groupBy("video_id").agg(F.avg("nearest").alias("__m"), F.stddev_pop("nearest").alias("__s"))
        j = j.join(s, "video_id")
        far = F.col("nearest") > F.col("__m") + outlier * F.col("__s")
    else:
        far = F.col("nearest") > (F.col("d0") + F.col("d1")) / 2 + outlier * F.abs(F.col("d0") - F.col("d1")) / 2
    return j.select(
        "video_id", "track_id", F.when(~far, F.col("cluster")).alias("team"), F.when(far, "referee").otherwise("player").alias("role"),
        "nearest",
    )


def team_vote(samples: DataFrame, centres: DataFrame, min_observations: int = 10, share: float = 0.7) -> DataFrame:
    """Tracks where one cluster holds more than ``share`` of at least ``min_observations`` colour samples."""
    n = nearest_centre(samples, centres).groupBy(*KEYS, "cluster").agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy(*KEYS).agg(F.sum("n").alias("total"), F.max_by("cluster", "n").alias("team"), F.max("n").alias("best"))
    return t.where((F.col("total") >= min_observations) & (F.col("best") / F.col("total") > share)).select(*KEYS, "team", "total")


def goalkeepers(positions: DataFrame, teams: DataFrame, colours: DataFrame, centres: DataFrame, length: float = C.PITCH_LENGTH_M) -> DataFrame:
    """Tracks that stay near a goal in a colour unlike their team's."""
    p = positions.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"))
    near = (F.col("mx") < 20) | (F.col("mx") > length - 20)
    p = p.where((F.col("n") >= 10) & near & (F.col("sx") < 15))
    own = centres.select("video_id", F.col("cluster").alias("team"), *[F.col(c).alias(f"t_{c}") for c in CHANNELS])
    j = p.join(teams.where("team is not null").select(*KEYS, "team"), list(KEYS)).join(colours, list(KEYS)).join(own, ["video_id", "team"])
    return j.withColumn("colour_distance", F.sqrt(_distance2("", "t_"))).where("colour_distance > 20").select(*KEYS, "team", "colour_distance")
