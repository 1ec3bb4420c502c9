"""Null-safe numeric helpers and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C


def stable_round(value: Column | str, digits: int) -> Column:
    """Half-up rounding that does not depend on the last bits of a sum of doubles."""
    v = F.col(value) if isinstance(value, str) else value
    return F.round(F.round(v, 9), digits)


def steady_sum(value: Column | str) -> Column:
    """Sum of doubles that does not depend on the order of the rows.

    Two doubles have one sum. More of them are added as the decimal numbers they are written as; numbers too large
    for that, NaN and infinities are added as doubles.
    """
    v = F.col(value) if isinstance(value, str) else value
    exact = v.try_cast("decimal(38,18)")
    n = F.count(v)
    return F.coalesce(F.when((n > 2) & (n == F.count(exact)), F.try_sum(exact).cast("double")), F.sum(v))


def finite(value: Column | str) -> Column:
    """NaN and infinities become null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def tolerant_double(text: Column | str) -> Column:
    """Number from text; empty, unparsable, NaN or infinite text gives null."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    return finite(t.try_cast("double"))


def tolerant_int(text: Column | str) -> Column:
    """Whole number from text ('7', '7.0'); anything else gives null."""
    v = tolerant_double(text)
    return F.when(v == F.floor(v), v.cast("bigint"))


def per_minute(value: Column, minutes: Column, scale: float = 1.0) -> Column:
    """value * scale per minute, null under one minute of exposure."""
    return F.when(minutes >= C.MIN_EXPOSURE_MINUTES, stable_round(value * scale / minutes, 4))


def distance_per_minute(km: Column, minutes: Column) -> Column:
    return F.when(minutes >= C.MIN_RATE_MINUTES, km * 1000 / minutes)


def kmh_from_mph(mph: Column) -> Column:
    return stable_round(mph * C.KMH_PER_MPH, 2)


def metres_from_km(km: Column) -> Column:
    return stable_round(km * 1000, 2)


def fatigue_score(risk: Column) -> Column:
    """Low, Medium, High -> 0, 50, 100; anything else is null."""
    return F.when(risk == "Low", 0.0).when(risk == "Medium", 50.0).when(risk == "High", 100.0)


def fatigue_label(score: Column) -> Column:
    return F.when(score <= 25, "Low").when(score <= 75, "Medium").when(score.isNotNull(), "High")


def fatigue_percent(score: Column) -> Column:
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "High", 3).when(risk == "Medium", 2).otherwise(1)


def rank_risk(rank: Column) -> Column:
    return F.when(rank == 3, "High").when(rank == 2, "Medium").otherwise("Low")
