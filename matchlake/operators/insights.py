"""Comparing matches by tag: per-match profiles, group summaries, baseline deltas and next-match effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.numbers import risk_rank, stable_round
from ..plans.blocked import with_position
from . import registry as R

METRICS = ["distance_km", "top_speed_mph", "sprint_count", "hsr_distance_km", "sprint_distance_km", "distance_per_min"]
ALL = [*METRICS, "workload"]
EFFECT_METRICS = ["distance_km", "top_speed_mph", "sprint_count", "hsr_distance_km", "workload"]
DIGITS = {k: 1 if k in ("top_speed_mph", "distance_per_min", "sprint_count") else 3 for k in ALL}


def effective_side(home_mine: Column, away_mine: Column, our_side: Column) -> Column:
    return (
        F.when(home_mine & ~away_mine, "home").when(away_mine & ~home_mine, "away").otherwise(F.coalesce(our_side, F.lit("home")))
    )


def result_for(side: Column, home: Column, away: Column, stored: Column) -> Column:
    ours, theirs = F.when(side == "home", home).otherwise(away), F.when(side == "home", away).otherwise(home)
    scored = home.isNotNull() & away.isNotNull()
    return F.when(scored & (ours > theirs), "W").when(scored & (ours < theirs), "L").when(scored, "D").otherwise(stored)


def user_matches(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """(user, match) with the user's side, team and result; a match is the user's when either team is."""
    m = matches.drop("user_id", "team_id")
    home = teams.select(F.col("team_id").alias("home_team_id"), F.col("user_id").alias("home_user"), F.col("name").alias("home_team"))
    away = teams.select(F.col("team_id").alias("away_team_id"), F.col("user_id").alias("away_user"), F.col("name").alias("away_team"))
    m = m.join(home, "home_team_id").join(away, "away_team_id")
    m = m.withColumn("user_id", F.explode(F.array_distinct(F.array("home_user", "away_user"))))
    side = effective_side(F.col("home_user") == F.col("user_id"), F.col("away_user") == F.col("user_id"), F.col("our_side"))
    m = m.withColumn("side", side)
    return m.withColumns(
        {
            "our_team_id": F.when(F.col("side") == "home", F.col("home_team_id")).otherwise(F.col("away_team_id")),
            "our_team": F.when(F.col("side") == "home", F.col("home_team")).otherwise(F.col("away_team")),
            "opponent": F.when(F.col("side") == "home", F.col("away_team")).otherwise(F.col("home_team")),
            "outcome": result_for(F.col("side"), F.col("home_score"), F.col("away_score"), F.col("result")),
        }
    )


def visible(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """Stat rows of (user_id, video_id, ...) the user may see: no video, or an own finished one."""
    v = videos.select("video_id", F.col("user_id").alias("__owner"), "status")
    joined = rows.join(v, "video_id", "left")
    own = (F.col("__owner") == F.col("user_id")) & (F.col("status") == "done")
    return joined.where(F.col("video_id").isNull() | own).drop("__owner", "status")


def per_match(
    matches: DataFrame, stats: DataFrame, metrics: DataFrame, players: DataFrame, videos: DataFrame,
    team_id: int | None = None, player_id: int | None = None,
) -> DataFrame:
    """Mean over players of each registry metric per (user, match), with workload bands. Default scope: our team."""
    rows = stats.join(players.select("player_id", F.col("team_id").alias("__team")), "player_id")
    m = matches.select("user_id", "match_id", "our_team_id")
    if player_id is not None:
        rows = rows.where(F.col("player_id") == player_id).join(m, "match_id")
    elif team_id is not None:
        rows = rows.where(F.col("__team") == team_id).join(m, "match_id")
    else:
        rows = rows.join(m, (rows["match_id"] == m["match_id"]) & (rows["__team"] == m["our_team_id"])).drop(m["match_id"])
    rows = R.widen(visible(rows, videos), metrics)
    player = rows.groupBy("user_id", "match_id", "player_id").agg(
        *R.aggregate_columns(METRICS), F.max(risk_rank(F.col("injury_risk"))).cast("double").alias("workload")
    )
    return player.groupBy("user_id", "match_id").agg(
        *[F.avg(k).alias(k) for k in ALL],
        F.count(F.lit(1)).alias("n_players"),
        *[F.count(F.when(F.col("workload") == r, 1)).alias(f"risk_{n.lower()}") for n, r in C.RISK_RANK.items()],
    )


def summary(members: DataFrame, profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each match weighs the same. ``members`` holds (keys, user_id, match_id, outcome)."""
    profile = profile.withColumn("__has", F.lit(1))
    j = members.join(profile, ["user_id", "match_id"], "left")
    has = F.count("__has")
    w = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"),
        has.alias("matches_with_data"),
        (has < C.LOW_SAMPLE).alias("low_sample"),
        *[stable_round(F.avg(k), DIGITS[k]).alias(k) for k in ALL],
        *[F.count(k).alias(f"n_{k}") for k in ALL],
        *[F.coalesce(F.sum(f"risk_{n.lower()}"), F.lit(0)).alias(f"risk_{n.lower()}") for n in C.RISK_RANK],
        w("W").alias("won"), w("D").alias("drawn"), w("L").alias("lost"),
        F.count(F.when(F.col("outcome").isNull() | ~F.col("outcome").isin("W", "D", "L"), 1)).alias("unknown"),
    )


def versus_baseline(groups: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Differences and percentages taken on the rounded values; no percentage for a missing or zero baseline."""
    b = baseline.select(*keys, *[F.col(k).alias(f"base_{k}") for k in ALL])
    j = groups.join(b, list(keys))
    cols = {}
    for k in ALL:
        diff = F.col(k) - F.col(f"base_{k}")
        cols[f"delta_{k}"] = stable_round(diff, DIGITS[k])
        cols[f"pct_{k}"] = F.when(F.col(f"base_{k}") != 0, stable_round(diff / F.col(f"base_{k}") * 100, 1))
    return j.withColumns(cols).drop(*[f"base_{k}" for k in ALL])


def next_match(matches: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """(keys, match_id, next_match_id): the chronological successor, found by position so no key is sorted in one task."""
    src = matches.select(*keys, "match_id", "match_date")
    block = F.floor(F.unix_date("match_date") / 30)
    pos = with_position(src, keys, [F.asc("match_date"), F.asc("match_id")], block, out="p")
    after = pos.select(*keys, F.col("match_id").alias("next_match_id"), (F.col("p") - 1).alias("p"))
    return pos.select(*keys, "match_id", "p").join(after, [*keys, "p"]).drop("p")


def tag_insights(matches: DataFrame, profile: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Group summaries per (user, tag value) against the user's baseline over all matches."""
    out = matches.select("user_id", "match_id", "outcome")
    tagged = tags.where(F.col("key_fold") == key.lower()).select("user_id", "match_id", "value_fold").distinct()
    base = summary(out, profile, ["user_id"])
    groups = summary(out.join(tagged, ["user_id", "match_id"]), profile, ["user_id", "value_fold"])
    return versus_baseline(groups, base)


def next_match_effect(matches: DataFrame, profile: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Summary of the distinct successors of tagged matches against the baseline, with the number of full pairs."""
    out = matches.select("user_id", "match_id", "outcome")
    succ = next_match(matches)
    tagged = tags.where(F.col("key_fold") == key.lower()).select("user_id", "match_id", "value_fold").distinct()
    pairs = tagged.join(succ, ["user_id", "match_id"])
    known = profile.select("user_id", "match_id")
    complete = (
        pairs.join(known, ["user_id", "match_id"], "left_semi")
        .join(known.withColumnRenamed("match_id", "next_match_id"), ["user_id", "next_match_id"], "left_semi")
        .groupBy("user_id", "value_fold").agg(F.count(F.lit(1)).alias("pairs"))
    )
    members = pairs.select("user_id", "value_fold", F.col("next_match_id").alias("match_id")).distinct()
    groups = summary(members.join(out, ["user_id", "match_id"]), profile, ["user_id", "value_fold"])
    base = summary(out, profile, ["user_id"])
    eff = versus_baseline(groups, base).join(complete, ["user_id", "value_fold"], "left")
    return eff.withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def next_match_effect_with_data(matches: DataFrame, profile: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Variant: the successor is the next match that has data, and repeated successors count each time."""
    have = matches.join(profile.select("user_id", "match_id"), ["user_id", "match_id"], "left_semi")
    succ = next_match(have)
    tagged = tags.where(F.col("key_fold") == key.lower()).select("user_id", "match_id", "value_fold").distinct()
    nxt = profile.select("user_id", F.col("match_id").alias("next_match_id"), *ALL)
    j = tagged.join(succ, ["user_id", "match_id"]).join(nxt, ["user_id", "next_match_id"])
    base = profile.groupBy("user_id").agg(*[F.avg(k).alias(f"base_{k}") for k in ALL])
    g = j.groupBy("user_id", "value_fold").agg(
        F.count(F.lit(1)).alias("pairs"), *[F.avg(k).alias(k) for k in EFFECT_METRICS], *[F.count(k).alias(f"n_{k}") for k in EFFECT_METRICS]
    )
    g = g.join(base, "user_id")
    return g.select(
        "user_id", "value_fold", "pairs", *[f"n_{k}" for k in EFFECT_METRICS],
        *[
            F.when(F.col(f"base_{k}") != 0, (F.col(k) - F.col(f"base_{k}")) / F.col(f"base_{k}") * 100).alias(f"pct_{k}")
            for k in EFFECT_METRICS
        ],
    )


def shown_effect(effect: DataFrame, metric: str) -> DataFrame:
    """Effects fit for display: at least two pairs over all values of the user and three values of the metric."""
    total = effect.groupBy("user_id").agg(F.sum("pairs").alias("__all_pairs"))
    ok = (F.col("__all_pairs") >= 2) & (F.col(f"n_{metric}") >= 3)
    return effect.join(total, "user_id").select("user_id", "value_fold", F.when(ok, F.col(f"pct_{metric}")).alias("shown_pct"))


def weighted_baseline(groups: DataFrame, metric: str, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Baseline from group means when none is supplied: weighted by the matches of each group."""
    use = F.col(metric).isNotNull() & (F.col("matches") > 0)
    n = F.sum(F.when(use, F.col("matches")))
    return groups.groupBy(*keys).agg((F.sum(F.when(use, F.col(metric) * F.col("matches"))) / n).alias("baseline"))


def insight_order(groups: DataFrame, metric: str) -> DataFrame:
    """Groups with enough matches by value, the others after them by name."""
    return groups.orderBy(
        "user_id", "low_sample", F.when(~F.col("low_sample"), F.col(metric)).desc_nulls_last(), "value_fold"
    )


def win_draw_loss(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("w", "win", "won"), "w").when(t.isin("d", "draw", "drew", "tie"), "d").when(
        t.isin("l", "loss", "lost", "lose"), "l"
    )
