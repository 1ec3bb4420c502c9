"""User-scoped match tags. Keys and values match case-insensitively; the first spelling is kept for display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def clean(text: Column | str) -> Column:
    """Trimmed, with inner whitespace collapsed to single blanks."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_key(text: Column | str) -> Column:
    """Cleaned key of 1-50 characters without ':' or control characters, else null."""
    k = clean(text)
    return F.when(k.rlike(r"^[^:\x00-\x1f\x7f]{1,50}$"), k)


def clean_value(text: Column | str) -> Column:
    v = clean(text)
    return F.when(F.length(v).between(1, 100), v)


def display_case(text: Column | str) -> Column:
    """Cleaned text with the first letter of each word (after blank, '/' or '-') in upper case."""
    words = F.split(clean(text), r"(?<=[\s/-])|(?=[\s/-])")
    return F.concat_ws("", F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))))


def parse_filter(raw: Column | str) -> Column:
    """struct(key, value) of 'key:value'; the first colon splits, null when there is none."""
    c = F.col(raw) if isinstance(raw, str) else raw
    parts = F.split(c, ":", 2)
    return F.when(c.contains(":"), F.struct(clean_key(parts[0]).alias("key"), clean_value(parts[1]).alias("value")))


def normalised(raw: DataFrame) -> DataFrame:
    """Distinct (user, match, key, value) by folded text, spelled as first seen by that user."""
    t = raw.select("user_id", "match_id", clean_key("raw_key").alias("key"), clean_value("raw_value").alias("value"), "pos")
    t = t.where("key is not null and value is not null").withColumns({"key_fold": F.lower("key"), "value_fold": F.lower("value")})
    when = F.struct("match_id", "pos")
    keys = t.groupBy("user_id", "key_fold").agg(F.min_by("key", when).alias("key"))
    values = t.groupBy("user_id", "key_fold", "value_fold").agg(F.min_by("value", when).alias("value"))
    distinct = t.groupBy("user_id", "match_id", "key_fold", "value_fold").agg(F.min("pos").alias("pos"))
    return distinct.join(keys, ["user_id", "key_fold"]).join(values, ["user_id", "key_fold", "value_fold"])


def last_value_per_key(tags: DataFrame) -> DataFrame:
    """One value per match and key: the last one given."""
    return tags.groupBy("user_id", "match_id", "key_fold").agg(F.max_by("value_fold", "pos").alias("value_fold"))


def matching(tags: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(user, match) that satisfy 'key:value' filters: same key = any of the values, different keys = all of them."""
    wanted: dict[str, list[str]] = {}
    for raw in filters:
        key, sep, value = raw.partition(":")
        if not sep:
            raise ValueError("a tag filter looks like key:value")
        wanted.setdefault(" ".join(key.split()).lower(), []).append(" ".join(value.split()).lower())
    hits = {
        f"__k{i}": (F.col("key_fold") == k) & F.col("value_fold").isin(vs) for i, (k, vs) in enumerate(wanted.items())
    }
    any_hit = F.lit(False)
    for h in hits.values():
        any_hit = any_hit | h
    found = tags.where(any_hit).groupBy("user_id", "match_id").agg(*[F.max(h).alias(n) for n, h in hits.items()])
    for n in hits:
        found = found.where(F.col(n))
    return found.select("user_id", "match_id")


def filter_by_tags(rows: DataFrame, tags: DataFrame, filters: Sequence[str]) -> DataFrame:
    if not filters:
        return rows
    return rows.join(matching(tags, filters), ["user_id", "match_id"], "left_semi")


def replace_tags(current: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """All tags of the touched (user, match) pairs replaced by ``new``."""
    return current.join(touched, ["user_id", "match_id"], "left_anti").unionByName(new)


def remove_tags(current: DataFrame, user_id: int, match_id: int, key: str, value: str | None = None) -> DataFrame:
    hit = (F.col("user_id") == user_id) & (F.col("match_id") == match_id) & (F.col("key_fold") == clean(F.lit(key.lower())))
    if value is not None:
        hit = hit & (F.col("value_fold") == clean(F.lit(value.lower())))
    return current.where(~hit)


def value_counts(values: DataFrame, tags: DataFrame, prefix: str | None = None) -> DataFrame:
    """Matches per (user, key, value) of a value table; values without matches count 0."""
    if prefix:
        values = values.where(F.lower("value").startswith(prefix.strip().lower()))
    n = tags.groupBy("user_id", "key_fold", "value_fold").agg(F.count(F.lit(1)).alias("count"))
    return values.join(n, ["user_id", "key_fold", "value_fold"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def key_catalogue(tags: DataFrame) -> DataFrame:
    return tags.groupBy("user_id", "key_fold").agg(
        F.countDistinct("value_fold").alias("value_count"), F.countDistinct("match_id").alias("match_count")
    )


def index_from_rows(raw: DataFrame) -> DataFrame:
    """Key and value counts straight from tagged rows (every occurrence counts), first spelling kept."""
    t = raw.select(clean("raw_key").alias("key"), clean("raw_value").alias("value"), "match_id", "pos")
    when = F.struct("match_id", "pos")
    return t.groupBy(F.lower("key").alias("key_fold"), F.lower("value").alias("value_fold")).agg(
        F.min_by("value", when).alias("value"), F.count(F.lit(1)).alias("count")
    )


def key_suggestions(index: DataFrame, presets: Sequence[str]) -> DataFrame:
    """Keys by total use, then presets that are not used yet."""
    used = index.groupBy("key_fold").agg(F.sum("count").alias("uses")).withColumn("source", F.lit(0))
    spark = index.sparkSession
    extra = spark.createDataFrame([(p.lower(), i) for i, p in enumerate(presets)], "key_fold string, place int")
    extra = extra.join(used, "key_fold", "left_anti").select("key_fold", F.lit(0).cast("bigint").alias("uses"), F.lit(1).alias("source"), "place")
    return used.withColumn("place", F.lit(0)).unionByName(extra).orderBy("source", F.desc("uses"), "place", "key_fold")


def value_suggestions(index: DataFrame, presets: dict[str, Sequence[str]]) -> DataFrame:
    """Per key its past values by use, then the presets of that key that are not used yet (a few fixed rows)."""
    rows = [(k.lower(), v.lower(), v, i) for k, values in presets.items() for i, v in enumerate(values)]
    extra = index.sparkSession.createDataFrame(rows, "key_fold string, value_fold string, value string, place int")
    used = index.select("key_fold", "value_fold", "value", F.col("count").alias("uses"), F.lit(0).alias("source"), F.lit(0).alias("place"))
    fresh = extra.join(index, ["key_fold", "value_fold"], "left_anti").select(
        "key_fold", "value_fold", "value", F.lit(0).cast("bigint").alias("uses"), F.lit(1).alias("source"), "place"
    )
    return used.unionByName(fresh).orderBy("key_fold", "source", F.desc("uses"), "place", "value_fold")
