"""Tolerant text coercions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import tolerant_int


def name_key(text: Column) -> Column:
    """Folded name; 'Last, First' is flipped and whitespace collapsed."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    last, first = F.split(t, ",", 2)[0], F.try_element_at(F.split(t, ",", 2), F.lit(2))
    flipped = F.when(t.contains(","), F.concat_ws(" ", F.trim(first), F.trim(last))).otherwise(t)
    return F.trim(F.regexp_replace(flipped, r"\s+", " "))


def team_side(text: Column) -> Column:
    """home / away from 0, 1, A, B, home, away."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("0", "a", "home"), "home").when(t.isin("1", "b", "away"), "away")


def role(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t != "", t)


def object_class(role_text: Column, class_text: Column, track_id: Column) -> Column:
    fallback = F.when(track_id < 0, "ball").otherwise("player")
    return F.substring(F.coalesce(role(role_text), F.when(class_text != "", class_text), fallback), 1, 20)


def jersey(text: Column) -> Column:
    """Shirt number 0-99, else null."""
    n = tolerant_int(text)
    return F.when(n.between(0, 99), n)


def jersey_from_placeholder(name: Column) -> Column:
    """The number in a placeholder name such as '#7'."""
    hit = F.regexp_extract(name, r"#\s*(\d{1,3})\s*$", 1)
    return F.when(hit != "", hit.cast("bigint"))


def risk_band(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t == "low", "Low").when(t == "medium", "Medium").when(t == "high", "High")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.trim(path), "/"), -1)


def resolution(text: Column, width: Column, height: Column) -> Column:
    """'1920x1080' from text or from a pair of numbers."""
    t = F.trim(text)
    return F.coalesce(F.when(t != "", t), F.when(width.isNotNull() & height.isNotNull(), F.concat(width, F.lit("x"), height)))


def first_of(*columns: str) -> Column:
    """First non-null of alternative column names."""
    return F.coalesce(*[F.col(c) for c in columns])
