"""Player, squad and video statistics over stat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.numbers import fatigue_score, kmh_from_mph, metres_from_km, rank_risk, risk_rank, stable_round
from ..plans.topk import ordinal_rank
from . import registry as R


def scoped(stats: DataFrame, match_id=None, team_id=None, video_id=None) -> DataFrame:
    """Optional filters, each applied only when given, so they reach the scan."""
    for column, wanted in (("match_id", match_id), ("team_id", team_id), ("video_id", video_id)):
        if wanted is not None:
            stats = stats.where(F.col(column) == wanted)
    return stats


def player_stats(stats: DataFrame, players: DataFrame, **scope) -> DataFrame:
    """Highest speed, total distance and worst workload band per player with rows in scope."""
    rows = stats.join(players.select("player_id", "team_id", "jersey", "first_name", "last_name"), "player_id")
    rows = scoped(rows, **scope)
    out = rows.groupBy("player_id", "first_name", "last_name", "jersey").agg(
        F.max("top_speed_mph").alias("top_speed_mph"),
        F.sum("distance_km").alias("distance_km"),
        F.max(risk_rank(F.col("injury_risk"))).alias("rank"),
    )
    return out.select(
        "player_id",
        F.concat_ws(" ", "first_name", "last_name").alias("name"),
        F.col("jersey"),
        stable_round("top_speed_mph", 2).alias("top_speed_mph"),
        stable_round("distance_km", 3).alias("distance_km"),
        rank_risk(F.col("rank")).alias("injury_risk"),
    )


ZONE_NAMES = ("walk", "jog", "run", "hsr", "sprint")


def flat_player_stats(stats: DataFrame, metrics: DataFrame, players: DataFrame, **scope) -> DataFrame:
    """Registry aggregates per player with flat columns, a zone struct and an average-position struct."""
    rows = stats.join(players.select("player_id", "team_id"), "player_id")
    rows = scoped(rows, **scope)
    wide = R.widen(rows, metrics)
    agg = wide.groupBy("player_id").agg(
        *R.aggregate_columns(), F.max(risk_rank(F.col("injury_risk"))).alias("rank"),
        F.max("top_speed_mph").alias("__mph"), F.sum("distance_km").alias("__km"),
    )
    return agg.withColumns(
        {
            "injury_risk": rank_risk(F.col("rank")),
            "top_speed_kmh": F.coalesce("top_speed_kmh", kmh_from_mph(stable_round("__mph", 2))),
            "distance_covered_meters": metres_from_km(stable_round("__km", 3)),
            "fatigue_risk_score": fatigue_score(rank_risk(F.col("rank"))),
            "avg_position": position_struct(F.col("avg_pitch_x"), F.col("avg_pitch_y")),
            "speed_zones": zone_struct(),
        }
    ).drop("rank", "__mph", "__km")


def position_struct(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def zone_struct() -> Column:
    cols = [F.col(f"zone{i}_distance_km") for i in range(1, 6)]
    return F.when(
        F.coalesce(*cols).isNotNull(), F.struct(*[c.alias(n) for c, n in zip(cols, ZONE_NAMES)])
    )


def with_jersey_override(players: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per-video jersey corrections; an override that says null wins over the roster number."""
    o = overrides.select("video_id", "player_id", F.col("jersey").alias("__o"), F.lit(True).alias("__has"))
    joined = players.join(o, ["video_id", "player_id"], "left")
    return joined.withColumn("jersey", F.when(F.col("__has"), F.col("__o")).otherwise(F.col("jersey"))).drop("__o", "__has")


#: Stored metrics that are added up over the fragments of a player, whatever name the tracker gives them.
SUMMED = ["hsr_distance_km", "sprint_distance_km", "accels", "decels", *[f"zone{n}_distance_km" for n in range(1, 6)]]


def _tracker_value(fragments: DataFrame, key: str) -> Column:
    """The first column of ``fragments`` that means metric ``key``; null without one."""
    name = next((c for c, k in R.ALIASES.items() if k == key and c in fragments.columns), None)
    return F.col(name).cast("double") if name else F.lit(None).cast("double")


def merged_fragments(fragments: DataFrame, keys: Sequence[str] = ("player_id", "video_id")) -> DataFrame:
    """Combine the tracks that belong to one player in one video."""
    played = _minutes("minutes_played")
    visible = _minutes("visible_minutes")
    km = F.when(
        F.col("distance_km").isNotNull(),
        F.coalesce(F.when(F.col("distance_m") >= 0, F.col("distance_m") / 1000), F.col("distance_km")),
    )
    weight = F.coalesce(F.col("visible_minutes"), F.lit(1.0))
    placed = F.col("avg_pitch_x").isNotNull() & F.col("avg_pitch_y").isNotNull()
    efforts = F.coalesce(F.col("hi_efforts_count"), F.col("hsr_count") + F.col("sprint_count"))
    total_w = F.sum(F.when(placed, weight))

    def mean(c):
        return F.when(total_w > 0, F.sum(F.when(placed, F.col(c) * weight)) / total_w).otherwise(
            F.avg(F.when(placed, F.col(c)))
        )

    agg = fragments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tracks"),
        F.max("top_speed_mph").alias("top_speed_mph"),
        F.sum("distance_km").alias("distance_km"),
        F.max(risk_rank(F.col("injury_risk"))).alias("rank"),
        F.sum(played).alias("played"),
        F.sum(visible).alias("visible"),
        F.sum(km).alias("rate_km"),
        F.sum("coverage_pct").alias("coverage"),
        F.max("top_speed_kmh").alias("kmh"),
        F.max("distance_per_min_m").alias("stored_rate"),
        F.max("clip_minutes").alias("clip"),
        mean("avg_pitch_x").alias("avg_pitch_x"),
        mean("avg_pitch_y").alias("avg_pitch_y"),
        F.sum("hsr_count").alias("hsr_count"),
        F.sum("sprint_count").alias("sprint_count"),
        F.sum(efforts).alias("high_intensity_efforts"),
        *[F.sum(_tracker_value(fragments, k)).alias(k) for k in SUMMED],
    )
    # the clip caps the minutes, but only when its length is known
    cap = lambda c: F.when(F.col("clip").isNotNull(), F.least(F.col(c), F.col("clip"))).otherwise(F.col(c))
    agg = agg.withColumns(
        {
            "played": F.when(F.col("played").isNotNull(), cap("played")),
            "visible": F.when(F.col("visible").isNotNull(), cap("visible")),
        }
    )
    minutes = F.coalesce("visible", "played")
    rate = F.when(
        minutes >= C.MIN_RATE_MINUTES,
        F.coalesce(
            F.when(F.col("tracks") == 1, F.col("stored_rate")), F.coalesce("rate_km", "distance_km") * 1000 / minutes
        ),
    )
    return agg.select(
        *keys,
        "tracks",
        stable_round("top_speed_mph", 2).alias("top_speed_mph"),
        stable_round("distance_km", 3).alias("distance_km"),
        rank_risk(F.col("rank")).alias("injury_risk"),
        stable_round("played", 3).alias("minutes_played"),
        stable_round("visible", 3).alias("visible_minutes"),
        stable_round(
            F.when(F.col("coverage").isNotNull(), F.least(F.col("coverage"), F.lit(100.0))), 2
        ).alias("coverage_pct"),
        stable_round(rate, 2).alias("distance_per_min"),
        F.coalesce(stable_round("kmh", 2), stable_round(F.col("top_speed_mph") * C.KMH_PER_MPH_TRACK, 2)).alias(
            "top_speed_kmh"
        ),
        stable_round("avg_pitch_x", 2).alias("avg_pitch_x"),
        stable_round("avg_pitch_y", 2).alias("avg_pitch_y"),
        "hsr_count",
        "sprint_count",
        "high_intensity_efforts",
        *[stable_round(k, R.BY_KEY[k].decimals + 1).alias(k) for k in SUMMED],
    )


def _minutes(key: str) -> Column:
    """Seconds win over minutes; negative values do not count."""
    seconds = F.col(f"{key}_s")
    value = F.when(seconds >= 0, seconds / 60).otherwise(F.col(key))
    return F.when(value >= 0, value)


def squad_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, means, maxima and the players behind the maxima."""
    have = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col("player_id")))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("players"),
        stable_round(F.avg("distance_km"), 4).alias("avg_distance_km"),
        stable_round(F.sum("distance_km"), 3).alias("total_distance_km"),
        F.max("top_speed_mph").alias("max_speed_mph"),
        F.max_by("player_id", have("top_speed_mph")).alias("fastest_player"),
        F.max_by("player_id", have("distance_km")).alias("longest_player"),
        F.count(F.when(F.col("coverage_pct") < 60, 1)).alias("low_coverage"),
        F.count(F.when(F.col("distance_km").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("injury_risk") == "Low", 1)).alias("risk_low"),
        F.count(F.when(F.col("injury_risk") == "Medium", 1)).alias("risk_medium"),
        F.count(F.when(F.col("injury_risk") == "High", 1)).alias("risk_high"),
    )


def ranked(rows: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    return ordinal_rank(rows, keys, metric, "player_id", "rank")


THRESHOLD_COLUMNS = ("preset", "hsr_kmh", "sprint_kmh", "edge_walk", "edge_jog", "edge_run", "edge_hsr")


def thresholds() -> list[Column]:
    """Video speed thresholds with gaps filled from the defaults, and where they came from."""
    d = C.DEFAULT_THRESHOLDS
    got = [F.col(c) for c in THRESHOLD_COLUMNS]
    n = sum((g.isNotNull().cast("int") for g in got), F.lit(0))
    fill = lambda c, v: stable_round(F.coalesce(F.col(c), F.lit(v)), 1)
    return [
        F.coalesce(F.col("preset"), F.lit(d["preset"])).alias("preset"),
        fill("hsr_kmh", d["hsr_kmh"]).alias("hsr_kmh"),
        fill("sprint_kmh", d["sprint_kmh"]).alias("sprint_kmh"),
        fill("edge_walk", d["walk"]).alias("edge_walk"),
        fill("edge_jog", d["jog"]).alias("edge_jog"),
        fill("edge_run", d["run"]).alias("edge_run"),
        fill("edge_hsr", d["hsr"]).alias("edge_hsr"),
        F.when(n == len(got), "pipeline").when(n == 0, "default").otherwise("mixed").alias("source"),
    ]


def with_thresholds(stats: DataFrame, videos: DataFrame) -> DataFrame:
    """Stat rows with the speed thresholds of their video; rows without a video, or of an unknown one, get the defaults."""
    known = videos.select(F.col("video_id").alias("__video"), *[F.col(c) for c in THRESHOLD_COLUMNS])
    own = [c for c in stats.columns if c not in THRESHOLD_COLUMNS]
    joined = stats.select(*own).join(known, F.col("video_id") == F.col("__video"), "left")
    return joined.select(*own, *thresholds())


def player_series(stats: DataFrame, metrics: DataFrame, matches: DataFrame) -> DataFrame:
    """History of every player: one row per stat row, with its match date.

    A value is the stat row's own column, else its stored metric, else derived from another unit. What was never measured
    stays null. Columns that ``stats`` lacks count as null.
    """
    keys = ["top_speed_kmh", "minutes_played", "sprint_count"]
    stored = R.widen(stats.select("stat_id"), metrics, keys).select("stat_id", *[F.col(k).alias(f"m_{k}") for k in keys])
    own = lambda c: F.col(c) if c in stats.columns else F.lit(None)
    s = stats.join(stored, "stat_id", "left").join(matches.select("match_id", "match_date"), "match_id")
    return s.select(
        "player_id", "match_date", "match_id", "video_id", "stat_id",
        F.coalesce(own("top_speed_kmh"), "m_top_speed_kmh", kmh_from_mph(F.col("top_speed_mph"))).alias("top_speed_kmh"),
        F.coalesce(own("distance_covered_meters"), metres_from_km(F.col("distance_km"))).alias("distance_covered_meters"),
        F.coalesce(own("minutes_played"), "m_minutes_played").alias("minutes_played"),
        F.coalesce(own("sprint_count"), "m_sprint_count").cast("bigint").alias("sprint_count"),
        "injury_risk", F.coalesce(own("fatigue_risk_score"), fatigue_score(F.col("injury_risk"))).alias("fatigue_risk_score"),
    )
