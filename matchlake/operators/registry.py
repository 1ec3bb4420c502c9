"""The metric registry: each row says how a metric aggregates, and is compiled to native column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions.numbers import stable_round


class Metric(NamedTuple):
    metric_key: str
    label: str
    unit: str
    category: str
    value_type: str
    aggregation: str
    decimals: int
    higher_is_better: bool | None
    requires_calibration: bool
    storage: str
    sort_order: int
    numerator: str | None = None
    denominators: tuple[str, ...] = ()
    scale: float = 1.0
    is_estimate: bool = True
    availability: str = "ready"  # ready or soon


# Metric keys, labels, units, aggregation rules and decimals.
METRICS = [
    Metric("distance_km", "Total distance", "km", "physical", "float", "sum", 2, True, True, "column", 10),
    Metric("top_speed_mph", "Top speed (max sustained)", "mph", "physical", "float", "max", 1, True, True, "column", 11),
    Metric("top_speed_kmh", "Top speed (max sustained)", "km/h", "physical", "float", "max", 1, True, True, "metric", 12),
    Metric("distance_per_min", "Distance per minute", "m/min", "physical", "float", "ratio", 0, True, True, "metric", 13,
           "distance_km", ("visible_minutes", "minutes_played"), 1000.0),
    Metric("minutes_played", "Minutes played (first to last seen)", "min", "coverage", "float", "sum", 2, None, False,
           "metric", 14),
    Metric("visible_minutes", "Minutes tracked", "min", "coverage", "float", "sum", 2, None, False, "metric", 15),
    Metric("coverage_pct", "Tracking coverage", "%", "coverage", "float", "avg", 0, None, False, "metric", 16),
    Metric("avg_pitch_x", "Average position (x, along length)", "m", "positional", "float", "avg", 1, None, True,
           "metric", 17),
    Metric("avg_pitch_y", "Average position (y, across width)", "m", "positional", "float", "avg", 1, None, True,
           "metric", 18),
    Metric("hsr_distance_km", "High-speed running distance", "km", "intensity", "float", "sum", 2, True, True, "metric", 20),
    Metric("sprint_distance_km", "Sprint distance", "km", "intensity", "float", "sum", 2, True, True, "metric", 21),
    Metric("hsr_count", "High-speed runs", "count", "intensity", "int", "sum", 0, True, True, "metric", 22),
    Metric("sprint_count", "Sprints", "count", "intensity", "int", "sum", 0, True, True, "metric", 23),
    Metric("high_intensity_efforts", "High-intensity efforts", "count", "intensity", "int", "sum", 0, True, True,
           "metric", 24),
    Metric("accels", "High accelerations (estimate)", "count", "workload", "int", "sum", 0, True, True, "metric", 30),
    Metric("decels", "High decelerations (estimate)", "count", "workload", "int", "sum", 0, True, True, "metric", 31),
    Metric("zone1_distance_km", "Distance: walk zone", "km", "speed_zone", "float", "sum", 2, None, True, "metric", 40),
    Metric("zone2_distance_km", "Distance: jog zone", "km", "speed_zone", "float", "sum", 2, None, True, "metric", 41),
    Metric("zone3_distance_km", "Distance: run zone", "km", "speed_zone", "float", "sum", 2, True, True, "metric", 42),
    Metric("zone4_distance_km", "Distance: high-speed zone", "km", "speed_zone", "float", "sum", 2, True, True, "metric", 43),
    Metric("zone5_distance_km", "Distance: sprint zone", "km", "speed_zone", "float", "sum", 2, True, True, "metric", 44),
]
BY_KEY = {m.metric_key: m for m in METRICS}
KEYS = [m.metric_key for m in METRICS]
STORED_KEYS = [m.metric_key for m in METRICS if m.storage == "metric"]

# Tracker output name -> metric key.
ALIASES = {
    "high_speed_distance_km": "hsr_distance_km",
    "hsr_distance_km": "hsr_distance_km",
    "sprint_distance_km": "sprint_distance_km",
    "sprint_count": "sprint_count",
    "hsr_count": "hsr_count",
    "high_intensity_efforts": "high_intensity_efforts",
    "hi_efforts_count": "high_intensity_efforts",
    "accels": "accels",
    "accel_count": "accels",
    "accel_count_high": "accels",
    "decels": "decels",
    "decel_count": "decels",
    "decel_count_high": "decels",
    "zone_walk_km": "zone1_distance_km",
    "zone_jog_km": "zone2_distance_km",
    "zone_run_km": "zone3_distance_km",
    "zone_hsr_km": "zone4_distance_km",
    "zone_sprint_km": "zone5_distance_km",
    "zone1_distance_km": "zone1_distance_km",
    "zone2_distance_km": "zone2_distance_km",
    "zone3_distance_km": "zone3_distance_km",
    "zone4_distance_km": "zone4_distance_km",
    "zone5_distance_km": "zone5_distance_km",
}
# Tracker output names that are read elsewhere or carry no metric.
KNOWN_OTHER = [
    "track_id", "jersey_number", "team", "role", "top_speed_mph", "distance_km", "injury_risk", "player_id", "name",
    "minutes_played", "visible_minutes", "coverage_pct", "distance_per_min_m", "avg_pitch_x", "avg_pitch_y",
    "top_speed_kmh", "distance_m", "minutes_played_s", "visible_minutes_s", "detected_frames", "total_frames",
    "player_uid", "contributing_track_ids",
]


def registry_frame(spark: SparkSession) -> DataFrame:
    rows = [
        (m.metric_key, m.label, m.unit, m.category, m.value_type, m.aggregation, m.decimals, m.higher_is_better,
         m.requires_calibration, m.storage, m.sort_order, m.numerator, "|".join(m.denominators) or None, m.scale, m.is_estimate, m.availability)
        for m in METRICS
    ]
    return spark.createDataFrame(
        rows,
        "metric_key string, label string, unit string, category string, value_type string, aggregation string, "
        "decimals int, higher_is_better boolean, requires_calibration boolean, storage string, sort_order int, "
        "numerator string, denominators string, scale double, is_estimate boolean, availability string",
    )


def group_status(groups: DataFrame, registry: DataFrame, keys: Sequence[str] = ("group",)) -> DataFrame:
    """``status`` of each group of metric keys: launch if all keys that the registry knows are ready, next if one is not.

    ``groups``: the group's columns, metric_key and its own status. Groups with the status manual, and those without a
    known key, keep their own. ``registry``: metric_key, availability (one row per key; a table of a few rows).
    """
    known = groups.join(registry.select("metric_key", "availability"), "metric_key", "left")
    own = F.first("status", ignorenulls=True)
    derived = F.when(F.every(F.col("availability") == "ready"), "launch").otherwise("next")
    return known.groupBy(*keys).agg(F.when((own == "manual") | (F.count("availability") == 0), own).otherwise(derived).alias("status"))


def _ratio(m: Metric) -> Column:
    num = F.col(m.numerator)
    den = F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c in m.denominators])
    both = num.isNotNull() & den.isNotNull()
    total = F.sum(F.when(both, den))
    value = F.when(total >= C.MIN_RATE_MINUTES, F.sum(F.when(both, num)) * m.scale / total)
    # one row: its stored value stands unless its own minutes are known and too short
    known = F.max(F.coalesce(*[F.col(c) for c in m.denominators])).isNotNull()
    short = known & (F.max(den).isNull() | (F.max(den) < C.MIN_RATE_MINUTES))
    stored = F.max(m.metric_key)
    return F.when(
        (F.count(F.lit(1)) == 1) & stored.isNotNull(), F.when(~short, stored)
    ).otherwise(value)


def aggregate_columns(keys: Sequence[str] | None = None, rounded: bool = True) -> list[Column]:
    """Aggregate expressions over wide rows (one column per metric), for use in one ``agg`` call."""
    out = []
    for key in keys or KEYS:
        m = BY_KEY[key]
        if m.aggregation == "ratio":
            value = _ratio(m)
        else:
            value = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}[m.aggregation](key)
        if rounded:
            value = stable_round(value, m.decimals)
        if m.value_type == "int":
            value = F.round(value).cast("bigint")
        out.append(value.alias(key))
    return out


def widen(stats: DataFrame, metrics: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Stat rows with one column per stored metric; every stat row is kept."""
    keys = [k for k in (keys or STORED_KEYS) if BY_KEY[k].storage == "metric"]
    wide = metrics.where(F.col("metric_key").isin(keys)).groupBy("stat_id").agg(
        *[F.max(F.when(F.col("metric_key") == k, F.col("value"))).alias(k) for k in keys]
    )
    return stats.join(wide, "stat_id", "left")


def merge_columns(keys: Sequence[str]) -> list[Column]:
    """Combine track fragments of one player: extrema by rule, everything else (also averages) is added up."""
    how = {"max": F.max, "min": F.min}
    return [how.get(BY_KEY[k].aggregation if k in BY_KEY else "sum", F.sum)(k).alias(k) for k in keys]


def rename_aliases(df: DataFrame) -> DataFrame:
    """Rename tracker output columns to metric keys; the first alias present wins."""
    taken: set[str] = set()
    cols = []
    for c in df.columns:
        target = ALIASES.get(c, c)
        if target in taken:
            continue
        taken.add(target)
        cols.append(F.col(c).alias(target))
    return df.select(*cols)


def unknown_numeric_keys(df: DataFrame, extra_known: Sequence[str] = ()) -> list[str]:
    known = {*ALIASES, *KNOWN_OTHER, *KEYS, *extra_known}
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return sorted(c for c, t in df.dtypes if c not in known and (t in numeric or t.startswith("decimal")))


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``current`` replaced or extended by ``incoming``; ``change`` is inserted, changed or kept."""
    cols = [c for c in incoming.columns if c != key]
    o, n = current.alias("o"), incoming.alias("n")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    missing_new, missing_old = F.col(f"n.{key}").isNull(), F.col(f"o.{key}").isNull()
    return joined.select(
        F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key),
        *[F.when(missing_new, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in cols],
        F.when(missing_old, "inserted").when(missing_new | same, "kept").otherwise("changed").alias("change"),
    )
