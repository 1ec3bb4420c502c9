"""Validation against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import stable_round
from ..plans.blocked import BLOCK_ROWS, with_halo, with_position
from .identity import iou


def in_event_windows(detections: DataFrame, events: DataFrame, slot_s: float = 10.0) -> DataFrame:
    """Detections of the event's player inside its time window.

    Windows are spread over fixed time slots, so the join is an equality on (clip, number, slot).
    """
    e = events.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start_s") / slot_s), F.floor(F.col("end_s") / slot_s))))
    d = detections.withColumn("slot", F.floor(F.col("t") / slot_s))
    j = d.join(e, ["video_id", "jersey", "slot"])
    return j.where(F.col("t").between(F.col("start_s"), F.col("end_s"))).drop("slot")


def path_length(rows: DataFrame, keys: Sequence[str], frame: str = "frame", tie: str = "track_id") -> DataFrame:
    """Length of the path through the rows of a key in frame order, and the number of rows."""
    keys = list(keys)
    src = rows.select(*keys, frame, tie, "x", "y")
    pos = with_position(src, keys, [F.asc(frame), F.asc(tie)], F.floor(F.col(frame) / BLOCK_ROWS), out="p")
    h = with_halo(pos, "p", before=1, after=0)
    w = W.partitionBy(*keys, "blk").orderBy("p")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    h = h.withColumn("step", F.sqrt(dx * dx + dy * dy)).where("is_owner")
    return h.groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("distance_m"), F.count(F.lit(1)).alias("frames"))


def sprint_errors(detections: DataFrame, events: DataFrame) -> DataFrame:
    """Measured against expected distance per event (event_id, video_id, jersey, start_s, end_s, expected_m, tolerance_pct)."""
    rows = in_event_windows(detections.where("x is not null and y is not null"), events)
    m = path_length(rows, ["event_id"])
    e = events.join(m, "event_id", "left")
    error = F.abs(F.col("distance_m") - F.col("expected_m"))
    pct = error / F.col("expected_m") * 100
    return e.select(
        "event_id", "video_id", stable_round("distance_m", 2).alias("distance_m"), stable_round(error, 2).alias("error_m"),
        stable_round(pct, 2).alias("error_pct"), (pct <= F.col("tolerance_pct")).alias("passed"),
        F.coalesce("frames", F.lit(0)).alias("frames"),
        F.when(F.col("frames").isNull(), "no detections in the time window").alias("error"),
    )


def top_speed_errors(expected: DataFrame, stats: DataFrame) -> DataFrame:
    """expected (video_id, jersey, expected_kmh, tolerance_pct) against the first track with that number, at its highest speed."""
    # one ordering instead of a table of tracks first; unknown speeds come last
    order = F.struct("track_id", F.col("top_speed_kmh").isNull().alias("unknown"), -F.col("top_speed_kmh"))
    first = stats.groupBy("video_id", "jersey").agg(F.min_by("top_speed_kmh", order).alias("kmh"), F.lit(True).alias("known"))
    j = expected.join(first, ["video_id", "jersey"], "left")
    error = F.abs(F.col("kmh") - F.col("expected_kmh"))
    pct = error / F.col("expected_kmh") * 100
    return j.select(
        "video_id", "jersey", stable_round(error, 2).alias("error_kmh"), stable_round(pct, 2).alias("error_pct"),
        (pct <= F.col("tolerance_pct")).alias("passed"),
        F.when(F.col("known").isNull(), "player not found").when(F.col("kmh").isNull(), "top speed not available").alias("error"),
    )


def pass_rate(results: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    passed = F.count(F.when(F.col("passed"), 1))
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("validations"), passed.alias("passed"), stable_round(passed / F.count(F.lit(1)) * 100, 2).alias("pass_rate")
    )


def position_errors(predicted: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE, mean, maximum and 95th percentile of the distance between matched positions."""
    t = truth.select(*keys, "frame", F.col("x").alias("tx"), F.col("y").alias("ty"))
    j = predicted.join(t, [*keys, "frame"])
    e2 = F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)
    j = j.withColumn("e", F.sqrt(e2))
    return j.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("mean"), F.max("e").alias("max"),
        F.percentile("e", 0.95).alias("p95"), F.count(F.lit(1)).alias("samples"),
    )


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Pairs of boxes that are each other's best overlap on a frame."""
    x = a.select(*keys, F.col("track_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    y = b.select(*keys, F.col("track_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    o = iou([F.col(f"a_{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    j = x.join(y, list(keys)).withColumn("iou", o).where(F.col("iou") >= threshold).select(*keys, "a", "b", "iou")
    for_a = j.groupBy(*keys, "a").agg(F.max_by("b", F.struct(F.col("iou"), (-F.col("b")).alias("t"))).alias("b"), F.max("iou").alias("iou"))
    for_b = j.groupBy(*keys, "b").agg(F.max_by("a", F.struct(F.col("iou"), (-F.col("a")).alias("t"))).alias("a"))
    return for_a.join(for_b, [*keys, "a", "b"])


def detection_scores(matches: DataFrame, predicted: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 per key from one-to-one matches."""
    n = lambda df, c: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c))
    j = n(truth, "truth").join(n(predicted, "predicted"), list(keys), "full_outer").join(n(matches, "tp"), list(keys), "left")
    j = j.fillna(0, ["truth", "predicted", "tp"])
    p, r = F.try_divide("tp", "predicted"), F.try_divide("tp", "truth")
    return j.select(*keys, "tp", "predicted", "truth", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def id_switches(matched: DataFrame, fps: float, keys: Sequence[str] = ("video_id", "true_id")) -> DataFrame:
    """Changes of the predicted track of each true player, per minute, and the share of its most used track.

    ``matched``: keys, frame, track_id.
    """
    keys = list(keys)
    src = matched.select(*keys, "frame", "track_id")
    pos = with_position(src, keys, [F.asc("frame")], F.floor(F.col("frame") / BLOCK_ROWS), out="p")
    h = with_halo(pos, "p", before=1, after=0)
    w = W.partitionBy(*keys, "blk").orderBy("p")
    h = h.withColumn("switch", (F.col("track_id") != F.lag("track_id").over(w)).cast("int")).where("is_owner")
    s = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum("switch"), F.lit(0)).alias("switches"))
    used = matched.groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("most"))
    j = s.join(used, keys)
    return j.select(
        *keys, "frames", "switches", (F.col("switches") / (F.col("frames") / fps / 60)).alias("per_minute"),
        (F.col("most") / F.col("frames")).alias("persistence"),
    )


def jersey_scores(rows: DataFrame, keys: Sequence[str], read: str = "jersey", truth: str = "true_jersey") -> DataFrame:
    """Accuracy over all rows, precision over rows with a reading, recall of the true numbers."""
    right = F.count(F.when(F.col(read) == F.col(truth), 1))
    return rows.groupBy(*keys).agg(
        (right / F.count(F.lit(1))).alias("accuracy"),
        F.try_divide(right, F.count(read)).alias("precision"),
        F.try_divide(right, F.count(truth)).alias("recall"),
    )


def team_accuracy(rows: DataFrame, keys: Sequence[str], team: str = "team", truth: str = "true_team") -> DataFrame:
    """Share of right sides, where both sides may be swapped as a whole."""
    acc = F.avg((F.col(team) == F.col(truth)).cast("int"))
    return rows.groupBy(*keys).agg(F.greatest(acc, 1 - acc).alias("accuracy"))


def speed_distance_errors(predicted: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Speed RMSE and distance error in percent per player. Rows: keys, frame, speed, step."""
    t = truth.select(*keys, "frame", F.col("speed").alias("tspeed"), F.col("step").alias("tstep"))
    j = predicted.join(t, [*keys, "frame"])
    d, td = F.sum("step"), F.sum("tstep")
    return j.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(F.col("speed") - F.col("tspeed"), 2))).alias("speed_rmse"),
        F.when(td > 0, F.abs(d - td) / td * 100).alias("distance_error_pct"),
    )


def counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.countDistinct("track_id").alias("tracks"), F.countDistinct("frame").alias("frames"), F.count(F.lit(1)).alias("rows"))


def schema_report(df: DataFrame, required: dict[str, str], ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row per required field: present, type as declared, nulls, NaNs and values out of range."""
    types = dict(df.dtypes)
    ranges = ranges or {}
    none = F.lit(0).cast("bigint")
    parts = []
    for c, want in required.items():
        known = c in types
        number = known and types[c] in ("double", "float")
        lo, hi = ranges.get(c, (None, None))
        parts.append(
            F.struct(
                F.lit(c).alias("field"), F.lit(known).alias("present"), F.lit(known and types[c] == want).alias("typed"),
                (F.count(F.when(F.col(c).isNull(), 1)) if known else none).alias("nulls"),
                (F.count(F.when(F.isnan(c), 1)) if number else none).alias("nans"),
                (F.count(F.when(~F.col(c).between(lo, hi), 1)) if known and lo is not None else none).alias("out_of_range"),
            )
        )
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def nearest_frame(requests: DataFrame, detections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detection closest in time to a requested frame ``at``; the earlier one wins a tie, boxes without size are skipped.

    Both neighbours come from a position lookup, so a long track is never paired with its requests row by row.
    """
    keys = list(keys)
    usable = detections.where("x2 > x1 and y2 > y1").select(*keys, "frame")
    from ..plans.blocked import asof_before

    before = asof_before(requests.withColumn("__a", F.col("at") + 1), usable, keys, "__a", "frame", "__before").drop("__a")
    flipped = usable.select(*keys, (-F.col("frame")).alias("frame"))
    both = asof_before(before.withColumn("__g", -F.col("at") + 1), flipped, keys, "__g", "frame", "__after").drop("__g")
    both = both.withColumn("__after", -F.col("__after"))
    pick = F.when(
        F.col("__after").isNull() | (F.col("at") - F.col("__before") <= F.col("__after") - F.col("at")), F.coalesce("__before", "__after")
    ).otherwise(F.col("__after"))
    return both.withColumn("frame", pick).drop("__before", "__after")
