"""Match, video and player listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tags import filter_by_tags


def tags_of_matches(tags: DataFrame) -> DataFrame:
    """Sorted tag list per (user, match). A match carries at most 100 tags."""
    return tags.groupBy("user_id", "match_id").agg(
        F.array_sort(F.collect_list(F.struct("key_fold", "value_fold", "key", "value"))).alias("tags")
    )


def list_matches(user_matches: DataFrame, videos: DataFrame, tags: DataFrame, filters=()) -> DataFrame:
    counts = videos.groupBy("user_id", "match_id").agg(F.count(F.lit(1)).alias("video_count"))
    m = filter_by_tags(user_matches, tags, filters)
    m = m.join(counts, ["user_id", "match_id"], "left").join(tags_of_matches(tags), ["user_id", "match_id"], "left")
    return m.select(
        "user_id", "match_id", "match_date", "our_team", "opponent", "side", "outcome",
        F.coalesce("video_count", F.lit(0)).alias("video_count"), "tags",
    ).orderBy(F.desc("match_date"), F.desc("match_id"), "user_id")


def list_videos(videos: DataFrame, user_matches: DataFrame, tags: DataFrame, meta_duration: Column | None = None) -> DataFrame:
    m = user_matches.select("user_id", "match_id", "match_date", "our_team", "opponent", "outcome")
    v = videos.join(m, ["user_id", "match_id"], "left").join(tags_of_matches(tags), ["user_id", "match_id"], "left")
    if meta_duration is not None:
        v = v.withColumn("duration_s", F.coalesce("duration_s", meta_duration))
    return v.orderBy(F.desc("created_at"), F.desc("video_id"))


def list_players(players: DataFrame, teams: DataFrame, team_id: int | None = None) -> DataFrame:
    if team_id is not None:
        players = players.where(F.col("team_id") == team_id)
    t = teams.select("team_id", "user_id", F.struct("team_id", "name").alias("team"))
    return players.join(t, "team_id")


def team_order(players: DataFrame) -> DataFrame:
    return players.orderBy("team_id", F.asc_nulls_last("jersey"), "last_name", "first_name", "player_id")


def jersey_clashes(rows: DataFrame) -> DataFrame:
    """Team-mates with the same number in one video.

    A clash needs two rows of (video, team, jersey), so only such groups are paired, each row with the lowest id.
    """
    g = rows.groupBy("video_id", "team_id", "jersey").agg(F.min("player_id").alias("first_player"), F.count(F.lit(1)).alias("n"))
    g = g.where("n > 1 and jersey is not null")
    return rows.join(g, ["video_id", "team_id", "jersey"]).where("player_id <> first_player").select(
        "video_id", "team_id", "jersey", "first_player", F.col("player_id").alias("other_player")
    )


def search_players(players: DataFrame, text: str | None = None, position: str | None = None) -> DataFrame:
    if text:
        players = players.where(F.lower(F.concat_ws(" ", "first_name", "last_name")).contains(text.strip().lower()))
    if position:
        players = players.where(F.col("position") == position)
    return players


def search_history(rows: DataFrame, tags: DataFrame, text: str | None = None, filters=()) -> DataFrame:
    if text:
        rows = rows.where(F.lower(F.concat_ws(" ", "title", "our_team", "opponent")).contains(text.strip().lower()))
    return filter_by_tags(rows, tags, filters)


def history_totals(videos: DataFrame) -> DataFrame:
    return videos.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("videos"), F.count(F.when(F.col("status") == "done", 1)).alias("completed"),
        F.max("created_at").alias("latest"),
    )


def people_on_frame(detections: DataFrame, players: DataFrame) -> DataFrame:
    """Stored people on a frame; the number read from the shirt wins over the roster's."""
    p = players.select("player_id", F.col("jersey").alias("__roster"))
    d = detections.where("object_class <> 'ball'").join(p, "player_id", "left")
    return d.withColumn("jersey", F.coalesce("jersey", "__roster")).drop("__roster")
