from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk as K
from ..sources.sinks import scratch_path, upsert_by_player
from ..streaming import accounted as A, twins as S
from .registry import query


def events(d):
    return S.stream_of(d.spark, d.sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("live_jersey_votes", "T1", """
WITH n AS (SELECT user_id AS track_id, user_id % 23 + 1 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS jersey, count(*) AS n, min(event_id) AS f FROM events WHERE event_type <> 'error' GROUP BY ALL)
SELECT track_id, jersey FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, f) AS rn FROM n) WHERE rn = 1""")
def _(d):
    r = events(d).where("event_type <> 'error'").selectExpr(
        "user_id as track_id", "user_id % 23 + 1 + if(event_id % 5 = 0, 1, 0) as jersey", "event_id as seen"
    )
    votes = S.latest(S.drain(S.live_votes(r, ["track_id"], "jersey"), "votes", "update"), ["track_id", "jersey"])
    return S.votes_to_winner(votes, ["track_id"], "jersey")


@query("live_workload_windows", "T2", """
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, user_id, count(*) AS samples, CAST(sum(CAST(value AS DECIMAL(20, 4))) AS DOUBLE) AS load FROM events
WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def _(d):
    return S.drain(S.live_workload(events(d), ["user_id"], "6 hours"), "workload").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("live_workload_sliding", "T2", """
SELECT s AS window_start, user_id, count(*) AS samples, CAST(sum(CAST(value AS DECIMAL(20, 4))) AS DOUBLE) AS load FROM events,
  LATERAL (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS s FROM (SELECT unnest([0, 1]) AS k)) w
WHERE s + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def _(d):
    out = S.drain(S.live_workload(events(d), ["user_id"], "12 hours", "6 hours"), "sliding")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("live_sessions", "T5", """
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 8 HOUR AS session_end, count(*) AS samples FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(d):
    out = S.drain(S.activity_sessions(events(d), ["user_id"], "8 hours"), "sessions")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("idempotent_delivery", "T6 S12", """
SELECT user_id // 20 AS video_id, event_id, event_type FROM events""")
def _(d):
    # every event arrives twice; duplicates fall out, and a second delivery of the stream leaves the table unchanged
    path = scratch_path(d.spark, "delivered")
    for _run in range(2):
        twice = events(d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
        once = S.deduplicated(twice, ["event_id"]).select(F.floor(F.col("user_id") / 20).alias("video_id"), "event_id", "event_type")
        S.deliver_by_video(once, path, scratch_path(d.spark, "delivered-log"), ["event_id"]).awaitTermination()
    return d.spark.read.schema("video_id bigint, event_id bigint, event_type string").parquet(path)


@query("live_progress", "T8", """
WITH e AS (SELECT user_id AS video_id, event_id AS at, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'detect' END AS stage, event_id % 97 AS percent FROM events),
t AS (SELECT video_id, max(at) AS tt, max_by(percent, at) AS tp FROM e WHERE stage = 'failed' GROUP BY video_id),
n AS (SELECT e.video_id, max(percent) AS percent, max(coalesce(tp, 0)) AS floor_ FROM e LEFT JOIN t ON t.video_id = e.video_id
  WHERE stage = 'detect' AND at > coalesce(tt, -1) AND percent >= coalesce(tp, 0) GROUP BY e.video_id)
SELECT v.video_id, CASE WHEN n.video_id IS NOT NULL THEN 'detect' WHEN t.video_id IS NOT NULL THEN 'failed' ELSE 'queued' END AS stage, coalesce(n.percent, t.tp, 0) AS percent
FROM (SELECT DISTINCT video_id FROM e) v LEFT JOIN n ON n.video_id = v.video_id LEFT JOIN t ON t.video_id = v.video_id""".replace(" AS at,", " AS seq,").replace("max(at)", "max(seq)").replace(", at)", ", seq)").replace("AND at >", "AND seq >"))
def _(d):
    e = events(d).selectExpr(
        "user_id as video_id", "event_id as at", "if(event_id % 11 = 0, 'failed', 'detect') as stage", "event_id % 97 as percent"
    )
    return S.latest(S.drain(S.live_progress(e), "progress", "update"), ["video_id"])


@query("log_stages", "T8", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'metrics' WHEN 1 THEN 'ocr' WHEN 2 THEN 'track' WHEN 3 THEN 'detect' END AS stage,
  CASE event_id % 5 WHEN 0 THEN 78 WHEN 1 THEN 75 WHEN 2 THEN 72 WHEN 3 THEN 10 + CAST(floor(least(100, event_id % 120) * 0.6e0) AS BIGINT) END AS percent FROM events""")
def _(d):
    k = F.col("event_id") % 5
    line = (
        F.when(k == 0, "12:01 Calculating player statistics...").when(k == 1, "Finalizing jersey numbers").when(k == 2, "Finalizing team and roles")
        .when(k == 3, F.concat(F.lit("Processing frames:  "), (F.col("event_id") % 120).cast("string"), F.lit("%|###"))).otherwise("loading weights")
    )
    return d.events.select("event_id", S.stage_from_log(line).alias("s")).select("event_id", "s.stage", "s.percent")


@query("live_ball_filter", "T3")
def _(d):
    src = d.fx_gaps.select("video_id", "track_id", "frame", "cx", "cy")
    step = F.least(F.floor(F.col("frame") / 20), F.lit(2))
    return S.drain_in_steps(src, "ball", step, lambda s: S.live_ball(s, 10.0))


@query("live_target", "T4")
def _(d):
    from .identity import follow_candidates

    src = follow_candidates(d)
    step = F.least(F.floor(F.col("frame") / 25), F.lit(2))
    return S.drain_in_steps(src, "target", step, lambda s: S.live_follow(s, 10.0))


@query("rescore_on_arrival", "T7 K7")
def _(d):
    from .risk import logs, one_task_enough, stat_rows

    out, split = scratch_path(d.spark, "rescored"), not one_task_enough(d)

    def rescore(players):
        rows = K.score_rows(
            stat_rows(d).join(players, "player_id", "left_semi"), logs(d).join(players, "player_id", "left_semi"), d.fx_players, split=split,
        )
        rows = rows.select("player_id", "source", "log_id", "stat_id", "risk_percent", "level")
        upsert_by_player(rows, out, players)

    new = S.stream_of(d.spark, d.sf_dir, "orders").select(F.col("o_custkey").alias("player_id"))
    S.rescore_on_arrival(new, rescore, scratch_path(d.spark, "rescore-log")).awaitTermination()
    return d.spark.read.parquet(out).drop("player_bucket")


@query("live_late_rows", "T2 T5", """
WITH b AS (SELECT min(epoch_us(ts) // 1000000) AS lo, max(epoch_us(ts) // 1000000) AS hi FROM events),
e AS (SELECT user_id, ts, value, time_bucket(INTERVAL 6 HOUR, ts) AS w, CASE WHEN event_id % 10 = 0 THEN 3 ELSE 3 * (epoch_us(ts) // 1000000 - lo) // (hi - lo + 1) END AS arrival FROM events, b),
m AS (SELECT arrival, max(ts) AS top FROM e GROUP BY arrival),
k AS (SELECT a.arrival, max(o.top) - INTERVAL 10 MINUTE AS mark FROM m a LEFT JOIN m o ON o.arrival < a.arrival GROUP BY a.arrival),
l AS (SELECT e.*, coalesce(w + INTERVAL 6 HOUR <= mark, FALSE) AS late FROM e JOIN k ON k.arrival = e.arrival)
SELECT w AS window_start, user_id, count(*) FILTER (WHERE NOT late) AS samples, count(*) FILTER (WHERE late) AS late_samples,
  CAST(sum(CAST(value AS DECIMAL(20, 4))) FILTER (WHERE NOT late) AS DOUBLE) AS load FROM l GROUP BY ALL""")
def _(d):
    """All events in four arrivals, a tenth of them long after their time."""
    spark, columns = d.spark, "user_id bigint, event_id bigint, ts timestamp, value double"
    source, out, log = (scratch_path(spark, f"late-{n}") for n in ("in", "out", "log"))
    e = d.events.selectExpr("CAST(user_id AS BIGINT) AS user_id", "CAST(event_id AS BIGINT) AS event_id", "CAST(ts AS TIMESTAMP) AS ts", "CAST(value AS DOUBLE) AS value")
    seconds = F.unix_seconds("ts")
    lo, hi = e.agg(F.min(seconds), F.max(seconds)).first()
    third = F.lit(0) if lo is None else F.floor((seconds - lo) * 3 / (hi - lo + 1))
    e = e.withColumn("arrival", F.when(F.col("event_id") % 10 == 0, 3).otherwise(third))
    for arrival in range(4):
        e.where(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(source)
        A.account(spark.readStream.schema(columns).parquet(source), out, log, ["user_id"], "6 hours").awaitTermination()
    late = A.late_rows(spark, out, columns).groupBy(F.window("ts", "6 hours").start.alias("window_start"), "user_id").agg(F.count(F.lit(1)).alias("late_samples"))
    both = A.windows(spark, out, "user_id bigint").join(late, ["window_start", "user_id"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return both.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", zero("samples"), zero("late_samples"), "load")
