"""Scoring sessions: gates, rolling workload, features, scores and roster reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .. import constants as C
from ..functions.numbers import finite, per_minute, stable_round
from ..functions.secrets import decrypt_number, decrypt_packed, encrypt_number, encrypt_packed
from ..functions.text import file_name
from ..plans.blocked import crowded, running, with_halo
from ..plans.materialize import reuse
from ..sources.sinks import upsert_by_player
from . import model as M

DISPLAY = [
    "distance_km", "sprint_count", "minutes_played", "top_speed_kmh", "hsr_distance_km", "accels", "decels",
    "heart_rate_avg", "heart_rate_max",
]


# ---- gates ------------------------------------------------------------------------------------------------------
# The texts of the gate notes below are published ones.
def custom_calibration(path: Column) -> Column:
    """A calibration of the video's own: given, not 'none'/'null', and not the shipped default file."""
    p = F.trim(path)
    named = (p != "") & ~F.lower(p).isin("none", "null")
    return F.coalesce(named & (file_name(p) != "default_calibration.json"), F.lit(False))


def is_placeholder(first: Column, last: Column, position: Column, listed: Column | None = None) -> Column:
    by_name = (first == "Unknown") & ((position == "Unassigned") | last.startswith("#") | last.startswith("Track "))
    by_name = F.coalesce(by_name, F.lit(False))
    return by_name if listed is None else by_name | F.coalesce(listed, F.lit(False))


def gate_match_rows(rows: DataFrame) -> DataFrame:
    """Status, note, data quality and exposure of match rows.

    Needs: video_id, adapter_source, calibration, distance_valid, placeholder, distance_km, visible_minutes,
    minutes_played.
    """
    demo = F.col("video_id").isNull() | F.coalesce(F.col("adapter_source").isin("stub", "seed"), F.lit(False))
    no_cal = ~demo & ~custom_calibration(F.col("calibration"))
    bad_distance = ~demo & F.coalesce(~F.col("distance_valid"), F.lit(False))
    exposure = F.when(F.col("visible_minutes").isNotNull() | ~demo, F.col("visible_minutes")).otherwise(F.col("minutes_played"))
    short = exposure.isNull() | (exposure < C.MIN_EXPOSURE_MINUTES)
    failed = F.array_compact(
        F.array(
            F.when(F.col("placeholder"), "no roster match (placeholder player)"),
            F.when(no_cal, "no custom pitch calibration"),
            F.when(bad_distance, "distance_valid=false"),
            F.when(F.col("distance_km").isNull(), "distance missing"),
            F.when(short & ~demo, "visible_minutes < 1").when(short, "exposure minutes < 1"),
        )
    )
    uncalibrated = no_cal | bad_distance
    return rows.withColumns(
        {
            "score_status": F.when(F.size(failed) == 0, "scored").when(uncalibrated, "uncalibrated").otherwise("insufficient_data"),
            "score_note": F.when(F.size(failed) > 0, F.array_join(failed, "; ")),
            "data_quality": F.when(demo, "demo").when(~uncalibrated, "calibrated"),
            "exposure": exposure,
            "model_minutes": F.when(demo, F.col("minutes_played")),
        }
    )


def gate_log_rows(logs: DataFrame) -> DataFrame:
    # The text of the note.
    measured = F.coalesce("gps_distance_km", "heart_rate", "sprints", "top_speed_kmh").isNotNull()
    note = "no load values (gps_distance, heart_rate, sprints, top_speed)"
    return logs.withColumns(
        {
            "score_status": F.when(measured, "scored").otherwise("insufficient_data"),
            "score_note": F.when(~measured, note),
            "data_quality": F.lit("csv"),
        }
    )


# ---- rolling workload -------------------------------------------------------------------------------------------
def rolling_ratio(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], load: str, out: str = "acwr", split: bool | None = None
) -> DataFrame:
    """Load relative to the mean of the last four usable loads before it, capped; null without history.

    ``order`` is a date followed by a unique id. Where ``rows`` has a key of more than ``BLOCK_ROWS`` rows (counted if ``split``
    is None, so ``rows`` should be cheap to read twice), each row looks up the mean by the number of usable loads before it,
    and the history of a key is spread over many tasks; else windows over whole keys share one shuffle.
    """
    keys = list(keys)
    if split is None:
        split = crowded(rows, keys)
    usable = F.coalesce(F.col(load) > 0, F.lit(False))
    sort = [F.asc_nulls_first(c) for c in order]
    if split:
        block = F.coalesce(F.unix_date(F.col(order[0])), F.lit(-1000000))
        counted = running(rows, keys, sort, block, {"__seen": ("sum", usable.cast("int"))}, inclusive=False)
        history = counted.where(usable).select(*keys, "__seen", F.col(load).alias("__load"))
        history = with_halo(history, "__seen", before=C.ACWR_SESSIONS, after=0)
        w = W.partitionBy(*keys, "blk").orderBy("__seen").rowsBetween(-(C.ACWR_SESSIONS - 1), 0)
        history = history.withColumn("__mean", F.avg("__load").over(w)).where("is_owner")
        history = history.select(*keys, (F.col("__seen") + 1).alias("__seen"), "__mean")
        joined = counted.join(history, [*keys, "__seen"], "left").drop("__seen")
    else:
        alike = W.partitionBy(*keys, "__usable").orderBy(*sort).rowsBetween(-(C.ACWR_SESSIONS - 1), 0)
        before = W.partitionBy(*keys).orderBy(*sort).rowsBetween(W.unboundedPreceding, -1)
        # one shuffle by the keys serves both windows
        joined = rows.withColumn("__usable", usable).repartition(*keys).withColumn("__own", F.when(F.col("__usable"), F.avg(load).over(alike)))
        joined = joined.withColumn("__mean", F.last("__own", ignorenulls=True).over(before)).drop("__usable", "__own")
    ratio = F.least(F.col(load) / F.col("__mean"), F.lit(C.ACWR_CAP))
    value = F.when(F.col(load).isNotNull() & F.col("__mean").isNotNull(), stable_round(ratio, 3))
    return joined.withColumn(out, value).drop("__mean")


# ---- features ---------------------------------------------------------------------------------------------------
def stat_values(rows: DataFrame) -> DataFrame:
    """Distances in km and speeds in km/h with their fallbacks (metres, mph); NaN and infinities become null."""
    have = set(rows.columns)
    col = lambda c: finite(F.col(c).cast("double")) if c in have else F.lit(None).cast("double")
    return rows.withColumns(
        {
            "distance_km": F.coalesce(col("distance_km"), col("distance_covered_meters") / 1000),
            "top_speed_kmh": F.coalesce(col("top_speed_kmh"), stable_round(col("top_speed_mph") * C.KMH_PER_MPH, 2)),
            **{c: col(c) for c in ("sprint_count", "minutes_played", "visible_minutes", "hsr_distance_km", "accels", "decels")},
        }
    )


def _only_scored(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.when(F.col("score_status") == "scored", v) for c, v in values.items()})


def match_load() -> Column:
    return per_minute(F.col("distance_km"), F.col("exposure"), 1000.0)


def match_features(rows: DataFrame, split: bool | None = None) -> DataFrame:
    """Model features of gated match rows; rows that are not scored have none and build no history."""
    rows = rows.withColumn("load", F.when(F.col("score_status") == "scored", match_load()))
    rows = rolling_ratio(rows, ["player_id", "data_quality"], ["score_date", "stat_id"], "load", split=split)
    e = F.col("exposure")
    hr = F.col("heart_rate")
    return _only_scored(
        rows,
        {
            "f_acwr": F.col("acwr"),
            "f_distance_m_per_min": F.col("load"),
            "f_sprints_per_90": per_minute(F.col("sprint_count"), e, 90.0),
            "f_hsr_m_per_min": per_minute(F.col("hsr_distance_km"), e, 1000.0),
            "f_top_speed_kmh": F.col("top_speed_kmh"),
            "f_minutes_played": F.col("model_minutes"),
            "f_heart_rate_avg": hr,
            "f_hr_missing": F.when(hr.isNull(), 1.0).otherwise(0.0),
        }
    ).drop("acwr", "load")


def log_features(logs: DataFrame, split: bool | None = None) -> DataFrame:
    """Model features of gated log rows; rows that are not scored have none and, without a distance, build no history."""
    logs = rolling_ratio(logs, ["player_id"], ["score_date", "order_id"], "gps_distance_km", split=split)
    m, hr = F.col("minutes_played"), F.col("heart_rate")
    return _only_scored(
        logs,
        {
            "f_acwr": F.col("acwr"),
            "f_distance_m_per_min": per_minute(F.col("gps_distance_km"), m, 1000.0),
            "f_sprints_per_90": per_minute(F.col("sprints"), m, 90.0),
            "f_hsr_m_per_min": F.lit(None).cast("double"),
            "f_top_speed_kmh": F.col("top_speed_kmh"),
            "f_minutes_played": m,
            "f_heart_rate_avg": hr,
            "f_hr_missing": F.when(hr.isNull(), 1.0).otherwise(0.0),
        }
    ).drop("acwr")


def display_from_stat(rows: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in DISPLAY[:7]], F.col("heart_rate").alias("heart_rate_avg"), F.col("heart_rate_max"))


def display_from_log() -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        F.col("gps_distance_km").alias("distance_km"), F.col("sprints").alias("sprint_count"), F.col("minutes_played"),
        F.col("top_speed_kmh"), none.alias("hsr_distance_km"), none.alias("accels"), none.alias("decels"),
        F.col("heart_rate").alias("heart_rate_avg"), F.col("heart_rate_max"),
    )


# ---- heart rate of the day --------------------------------------------------------------------------------------
def heart_rate_by_day(logs: DataFrame) -> DataFrame:
    """(player, day) -> heart rates of the last log of that day that has any."""
    have = logs.where(F.coalesce("heart_rate", "heart_rate_max").isNotNull())
    last = have.groupBy("player_id", "log_date").agg(F.max_by(F.struct("heart_rate", "heart_rate_max"), F.col("order_id")).alias("h"))
    return last.select("player_id", F.col("log_date").alias("score_date"), "h.heart_rate", "h.heart_rate_max")


def all_logs(stored: DataFrame, unsaved: DataFrame | None) -> DataFrame:
    """Stored logs plus unsaved preview rows, which come after all stored ones."""
    place = lambda new, file, number: F.struct(F.lit(new).alias("unsaved"), file.cast("string").alias("file"), number.cast("bigint").alias("number"))
    s = stored.withColumn("order_id", place(False, F.lit(""), F.col("log_id")))
    if unsaved is None:
        return s
    file = F.col("file") if "file" in unsaved.columns else F.lit("")
    u = unsaved.withColumn("order_id", place(True, file, F.col("line")))
    return s.unionByName(u, allowMissingColumns=True)


ROW = [
    "player_id", "source", "stat_id", "log_id", "match_id", "video_id", "score_date", "score_status", "score_note", "data_quality",
    "display", *[f"f_{f}" for f in C.FEATURES],
]


def score_rows(
    stats: DataFrame, logs: DataFrame, players: DataFrame, model: M.RiskModel = M.DEFAULT_MODEL, split: bool | None = None
) -> DataFrame:
    """Scored sessions of both sources.

    ``stats``: one row per stat with its values, video meta and ``score_date``; ``logs`` as from ``all_logs``;
    ``players``: id and names. Rows of unknown players are left out.
    """
    p = players.select(
        "player_id", is_placeholder(F.col("first_name"), F.col("last_name"), F.col("position")).alias("placeholder")
    )
    m = stat_values(stats.join(p, "player_id"))
    m = gate_match_rows(m).join(heart_rate_by_day(logs), ["player_id", "score_date"], "left")
    mf = match_features(reuse(m) if split is None else m, split)
    mf = mf.select(
        "player_id", F.lit("match").alias("source"), "stat_id", F.lit(None).cast("bigint").alias("log_id"), "match_id", "video_id",
        "score_date", "score_status", "score_note", "data_quality", display_from_stat(mf).alias("display"),
        *[F.col(f"f_{f}") for f in C.FEATURES],
    )
    lg = logs.join(p.select("player_id"), "player_id", "left_semi").withColumn("score_date", F.col("log_date"))
    lf = log_features(gate_log_rows(lg), crowded(logs, ["player_id"]) if split is None else split)
    none = F.lit(None).cast("bigint")
    lf = lf.select(
        "player_id", F.lit("csv").alias("source"), none.alias("stat_id"), "log_id", none.alias("match_id"), none.alias("video_id"),
        "score_date", "score_status", "score_note", "data_quality", display_from_log().alias("display"),
        *[F.col(f"f_{f}") for f in C.FEATURES],
    )
    rows = mf.unionByName(lf)
    feats = rows.select(
        *[c for c in rows.columns if not c.startswith("f_")], *[F.col(f"f_{f}").alias(f) for f in C.FEATURES]
    )
    out = M.score(feats, model)
    done = F.col("score_status") == "scored"
    return out.withColumns(
        {
            "risk_percent": F.when(done, F.col("risk_percent")),
            "probability": F.when(done, F.col("probability")),
            "level": F.when(done, F.col("level")).otherwise("unknown"),
            "contributions": F.when(done, F.col("contributions")),
        }
    )


# ---- stored scores ----------------------------------------------------------------------------------------------
STORED = ["player_id", "source", "stat_id", "log_id", "match_id", "video_id", "score_date", "level", "score_status", "score_note", "data_quality"]
#: Columns by which a store deals rows out.
BUCKETS = ["player_bucket", "__bucket"]


#: A text like those of the details, by which they are packed before they are encrypted: part of the stored format.
DETAILS_WORDS = (
    '"hsr_distance_km":0.15,"accels":12.0,"decels":10.0,"hsr_m_per_min":5.0,"imputed":false,"scaled":0.004,"contribution":8.0E-4,"place":3}]}'
    '{"display":{"distance_km":1.92,"sprint_count":25.0,"minutes_played":58.0,"top_speed_kmh":31.0,"heart_rate_avg":140.0,"heart_rate_max":180.0},'
    '"model_features":{"acwr":0.324,"distance_m_per_min":33.1082,"sprints_per_90":38.7931,"top_speed_kmh":31.0,"minutes_played":58.0,"heart_rate_avg":140.0,"hr_missing":1.0},'
    '"contributions":[{"feature":"heart_rate_avg","value":140.0,"imputed":false,"scaled":1.0,"contribution":0.5,"place":6},'
    '{"feature":"hsr_m_per_min","value":5.0,"imputed":false,"scaled":-1.0,"contribution":-0.1,"place":3},'
    '{"feature":"hr_missing","value":0.0,"imputed":false,"scaled":-0.9,"contribution":-0.0318,"place":7},'
    '{"feature":"acwr","imputed":true,"scaled":0.0,"contribution":0.0,"place":0},'
    '{"feature":"distance_m_per_min","value":33.1082,"imputed":false,"scaled":-6.9077,"contribution":-3.6443,"place":1},'
    '{"feature":"acwr","value":0.324,"imputed":false,"scaled":-2.0743,"contribution":-3.5553,"place":0},'
    '{"feature":"sprints_per_90","value":38.7931,"imputed":false,"scaled":1.977,"contribution":0.956,"place":2},'
    '{"feature":"minutes_played","value":58.0,"imputed":false,"scaled":-1.4667,"contribution":-0.346,"place":5},'
    '{"feature":"hr_missing","value":1.0,"imputed":false,"scaled":1.1,"contribution":0.0389,"place":7},'
    '{"feature":"heart_rate_avg","imputed":true,"scaled":0.0181,"contribution":0.0083,"place":6},'
    '{"feature":"top_speed_kmh","value":31.0,"imputed":false,"scaled":0.3125,"contribution":-0.0045,"place":4},'
    '{"feature":"hsr_m_per_min","imputed":true,"scaled":0.004,"contribution":8.0E-4,"place":3}]}'
)


def _details(rows: DataFrame) -> Column:
    return F.struct("display", F.struct(*C.FEATURES).alias("model_features"), "contributions")


def seal(rows: DataFrame, key: Column) -> DataFrame:
    """Scored rows as they are stored: percent and details encrypted, the rest in the clear."""
    return rows.select(*STORED, *[c for c in BUCKETS if c in rows.columns], encrypt_number(F.col("risk_percent"), key).alias("risk_percent_enc"), encrypt_packed(F.to_json(_details(rows)), key, DETAILS_WORDS).alias("details_enc"))


def unseal(stored: DataFrame, key: Column, details: T.DataType) -> DataFrame:
    """Stored rows with ``risk_percent`` and the fields of ``details``; what can't be decrypted is null."""
    opened = stored.withColumn("__d", F.from_json(decrypt_packed(F.col("details_enc"), key, DETAILS_WORDS), details))
    return opened.select(*STORED, decrypt_number(F.col("risk_percent_enc"), key).alias("risk_percent"), "__d.*")


def store_scores(rows: DataFrame, players: DataFrame, path: str, key: Column, buckets: int = 256) -> None:
    """Replace the stored scores of ``players`` by ``rows``; a player without rows is cleared. Reports read the table instead of scoring."""
    upsert_by_player(rows, path, players, buckets, shape=lambda dealt: seal(dealt, key))


def stored_scores(spark: SparkSession, path: str, key: Column, details: T.DataType) -> DataFrame:
    return unseal(spark.read.parquet(path), key, details)


def details_type(rows: DataFrame) -> T.DataType:
    """Schema of the stored details of scored rows."""
    return rows.select(_details(rows).alias("d")).schema["d"].dataType


# ---- reports ----------------------------------------------------------------------------------------------------
def latest_scores(rows: DataFrame, row_id: str = "risk_id") -> DataFrame:
    """Newest scored session per player; unscored rows only when nothing is scored; match before csv on one day."""
    rank = F.struct(
        (F.col("score_status") == "scored").alias("s"), F.coalesce("score_date", F.lit("0001-01-01").cast("date")).alias("d"),
        (F.col("source") == "match").alias("m"), F.col(row_id).alias("i"),
    )
    best = rows.groupBy("player_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "player_id"]), rank).alias("r"))
    return best.select("player_id", "r.*")


def roster_report(players: DataFrame, rows: DataFrame, row_id: str = "risk_id") -> DataFrame:
    """One row per player, highest risk first, players without a score last by name."""
    shown = list(dict.fromkeys(["player_id", row_id, "risk_percent", "level", "score_status", "source", "score_date"]))
    j = players.join(latest_scores(rows.select(*shown), row_id), "player_id", "left")
    out = j.select(
        "player_id", F.concat_ws(" ", "first_name", "last_name").alias("name"), "team_id", "risk_percent",
        F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce("score_status", F.lit("no_data")).alias("score_status"),
        "source", "score_date",
    )
    return out.orderBy(F.col("risk_percent").isNull(), F.desc("risk_percent"), F.lower("name"), "player_id")


def history(rows: DataFrame) -> DataFrame:
    return rows.orderBy("player_id", F.desc("score_date"), F.desc("risk_id"))


def run_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("score_status", "data_quality", "level").agg(F.count(F.lit(1)).alias("rows"))


def run_cube(rows: DataFrame) -> DataFrame:
    """Counts for every combination of status, quality and level, and all their totals; ``grouping_id`` tells which columns are added up."""
    return rows.cube("score_status", "data_quality", "level").agg(F.grouping_id().alias("grouping_id"), F.count(F.lit(1)).alias("rows"))


def level_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Players per level and whether fewer than half have a score."""
    n = lambda v: F.count(F.when(F.col("level") == v, 1))
    scored = F.count(F.when((F.col("score_status") == "scored") & F.col("risk_percent").isNotNull(), 1))
    return rows.groupBy(*keys).agg(
        n("red").alias("red"), n("yellow").alias("yellow"), n("green").alias("green"), n("unknown").alias("unknown"),
        (scored * 2 < F.count(F.lit(1))).alias("mostly_unscored"),
    )


def normalised_score(status: Column, percent: Column, server_level: Column) -> dict[str, Column]:
    """Client view of a score: known status or derived from the percent; the server's level wins when it is known."""
    s = F.lower(F.trim(status))
    known = F.when(s.isin("scored", "uncalibrated", "insufficient_data", "no_data"), s)
    st = F.coalesce(known, F.when(percent.isNull(), "no_data").otherwise("scored"))
    lv = F.lower(F.trim(server_level))
    lv = F.when(lv.isin("red", "yellow", "green"), lv).otherwise(M.level(percent))
    risk = F.when(st == "scored", finite(percent))
    out_level = F.when(risk.isNotNull(), lv).otherwise("unknown")
    return {
        "score_status": F.when((st == "scored") & (out_level == "unknown"), "no_data").otherwise(st),
        "risk_percent": risk,
        "level": out_level,
    }


def replace_rows(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows of every key present in ``new`` replaced by the new ones."""
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def touched(changes: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """Input rows of the keys a change touches: what an incremental run has to recompute."""
    return inputs.join(changes.select(key).distinct(), key, "left_semi")


def delete_upload(logs: DataFrame, upload_id: int) -> tuple[DataFrame, DataFrame]:
    """(remaining logs, players to score again) after one upload is removed."""
    gone = F.col("upload_id") == upload_id
    return logs.where(~gone), logs.where(gone).select("player_id").distinct()
