"""Athlete-log files: headers, typed validation, roster matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import finite
from ..functions.text import name_key

# Accepted header spellings, lower case without punctuation.
HEADER_ALIASES = {
    "date": ["date", "logdate", "sessiondate", "matchdate", "day"],
    "player_id": ["playerid", "athleteid"],
    "jersey_number": ["jerseynumber", "jersey", "jerseyno", "shirtnumber", "shirt", "number", "no"],
    "player": ["player", "name", "playername", "athlete", "athletename", "fullname"],
    "gps_distance": ["gpsdistance", "gpsdistancekm", "distance", "distancekm", "totaldistance", "totaldistancekm"],
    "gps_distance_m": [
        "gpsdistancem", "gpsdistancemeters", "gpsdistancemetres", "distancem", "distancemeters", "distancemetres", "totaldistancem",
    ],
    "heart_rate": ["heartrate", "hr", "avghr", "hravg", "heartrateavg", "avgheartrate", "averageheartrate", "heartratebpm"],
    "heart_rate_max": ["heartratemax", "maxhr", "hrmax", "maxheartrate"],
    "minutes_played": ["minutesplayed", "minutes", "mins", "minsplayed", "minutesonpitch"],
    "sprints": ["sprints", "sprintcount", "numsprints", "sprintsn"],
    "top_speed_kmh": ["topspeedkmh", "topspeed", "maxspeed", "maxspeedkmh", "peakspeed", "peakspeedkmh"],
}
# Accepted range and unit per numeric column.
RANGES = {
    "gps_distance": (0, 30, "km"),
    "gps_distance_m": (0, 30000, "m"),
    "heart_rate": (30, 230, "bpm"),
    "heart_rate_max": (30, 230, "bpm"),
    "minutes_played": (0, 130, "min"),
    "sprints": (0, 300, ""),
    "top_speed_kmh": (0, 45, "km/h"),
}
IDENTITY = ("player_id", "jersey_number", "player")


def header_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def canonical_header(text: Column) -> Column:
    """Canonical column name of a header cell, null when unknown."""
    lookup = F.create_map(*[F.lit(x) for name, aliases in HEADER_ALIASES.items() for a in aliases for x in (a, name)])
    return F.try_element_at(lookup, header_key(text))


def header_positions(header: Sequence[str]) -> dict[str, int]:
    """Canonical name -> column index of one header row; the first match wins."""
    known = {a: name for name, aliases in HEADER_ALIASES.items() for a in aliases}
    out: dict[str, int] = {}
    for i, cell in enumerate(header):
        name = known.get("".join(ch for ch in (cell or "").lower() if ch.isascii() and ch.isalnum()))
        if name and name not in out:
            out[name] = i
    return out


def missing_columns(present: Column) -> Column:
    """Required columns absent from an array of canonical names."""
    identity = F.arrays_overlap(present, F.array(*[F.lit(c) for c in IDENTITY]))
    return F.array_compact(
        F.array(
            F.when(~F.array_contains(present, "date"), "date"),
            F.when(~identity, "player_id|jersey_number|player"),
        )
    )


def parse_date(text: Column) -> Column:
    """yyyy-MM-dd or MM/dd/yyyy, else null."""
    t = F.trim(text)
    us = F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 0)
    iso = F.regexp_extract(t, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 0)
    iso_padded = F.when(iso != "", F.regexp_replace(F.regexp_replace(iso, r"-(\d)(?=-|$)", "-0$1"), r"-(\d)$", "-0$1"))
    us_padded = F.when(us != "", F.regexp_replace(F.regexp_replace(us, r"^(\d)/", "0$1/"), r"/(\d)/", "/0$1/"))
    return F.coalesce(
        F.try_to_timestamp(iso_padded, F.lit("yyyy-MM-dd")), F.try_to_timestamp(us_padded, F.lit("MM/dd/yyyy"))
    ).cast("date")


def validate(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Typed values plus ``errors``: one struct per failing cell. ``rows`` holds text cells and a ``line`` number."""
    present = [c for c in RANGES if c in columns]
    cell = {c: F.coalesce(F.trim(F.col(c)), F.lit("")) for c in columns}
    problems, values = [], {}

    def problem(column: str, bad: Column, message: str) -> Column:
        return F.when(
            bad,
            F.struct(
                F.lit(column).alias("column"), cell[column].alias("value"), F.lit(message).alias("message")
            ),
        )

    date = parse_date(cell["date"])
    problems.append(problem("date", cell["date"] == "", "date is required"))
    problems.append(problem("date", (cell["date"] != "") & date.isNull(), "invalid date (use YYYY-MM-DD or MM/DD/YYYY)"))
    for c in present:
        lo, hi, unit = RANGES[c]
        number = F.expr(f"try_cast(nullif(trim(`{c}`), '') AS double)")
        given = cell[c] != ""
        not_number = given & (number.isNull() | F.isnan(number))
        outside = given & ~not_number & ~number.between(lo, hi)
        problems.append(problem(c, not_number, "not a number"))
        problems.append(problem(c, outside, f"out of range ({lo}-{hi}{' ' + unit if unit else ''})"))
        if c == "sprints":
            problems.append(problem(c, given & ~not_number & ~outside & (number != F.floor(number)), "must be a whole number"))
        values[c] = number
    ids = {}
    if "player_id" in columns:
        ids["player_id"] = F.expr("try_cast(nullif(trim(`player_id`), '') AS bigint)")
        problems.append(problem("player_id", (cell["player_id"] != "") & ids["player_id"].isNull(), "not an integer"))
    if "jersey_number" in columns:
        jersey = F.expr("try_cast(nullif(trim(`jersey_number`), '') AS double)")
        ids["jersey_number"] = finite(jersey).cast("bigint")
        problems.append(problem("jersey_number", (cell["jersey_number"] != "") & ids["jersey_number"].isNull(), "not an integer"))
    named = [c for c in IDENTITY if c in columns]
    ident = F.coalesce(*[F.nullif(cell[c], F.lit("")) for c in named])
    problems.append(problem(named[0], ident.isNull(), "player is required"))
    out = rows.select(
        *[c for c in rows.columns if c not in columns],
        date.alias("log_date"),
        *[v.alias(c) for c, v in values.items()],
        *[v.alias(c) for c, v in ids.items()],
        *([cell["player"].alias("player")] if "player" in columns else []),
        ident.alias("ident"),
        F.array_compact(F.array(*problems)).alias("errors"),
    )
    km = F.col("gps_distance") if "gps_distance" in columns else F.lit(None).cast("double")
    if "gps_distance_m" in columns:
        km = F.coalesce(km, F.col("gps_distance_m") / 1000)
    return out.withColumn("gps_distance_km", km)


def error_rows(validated: DataFrame) -> DataFrame:
    return validated.select("line", F.explode("errors").alias("e")).select("line", "e.column", "e.value", "e.message")


def match_roster(rows: DataFrame, players: DataFrame, by_jersey: bool = False, by_name: bool = False) -> DataFrame:
    """Add ``matched_id``: by id (final when given), else a number only one player wears, else a name only one has."""
    ids = players.select(F.col("player_id").alias("__id"))
    out = rows.join(ids, F.col("player_id") == F.col("__id"), "left") if "player_id" in rows.columns else rows.withColumns(
        {"player_id": F.lit(None).cast("bigint"), "__id": F.lit(None).cast("bigint")}
    )
    candidates = []
    if by_jersey:
        j = players.where("jersey is not null").groupBy(F.col("jersey").alias("jersey_number"))
        j = j.agg(F.min("player_id").alias("__j"), F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
        out = out.join(j, "jersey_number", "left")
        candidates.append(F.col("__j"))
    if by_name:
        n = players.groupBy(name_key(F.concat_ws(" ", "first_name", "last_name")).alias("__key"))
        n = n.agg(F.min("player_id").alias("__p"), F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
        out = out.withColumn("__key", name_key(F.col("player"))).join(n, "__key", "left").drop("__key")
        candidates.append(F.col("__p"))
    fallback = F.coalesce(*candidates) if candidates else F.lit(None).cast("bigint")
    out = out.withColumn("matched_id", F.when(F.col("player_id").isNotNull(), F.col("__id")).otherwise(fallback))
    return out.drop("__id", "__j", "__p")


def upload_quality(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in total, valid, invalid and without a matching player, per upload."""
    bad = F.size("errors") > 0
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count(F.when(~bad & F.col("matched_id").isNotNull(), 1)).alias("rows_valid"),
        F.count(F.when(bad, 1)).alias("rows_invalid"),
        F.count(F.when(~bad & F.col("matched_id").isNull(), 1)).alias("rows_unmatched"),
    )
