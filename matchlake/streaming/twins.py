"""Structured Streaming forms of the stateful operators; each equals its batch form on closed data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import constants as C
from ..operators.ball import Path
from ..operators.gaps import BALL_SCHEMA
from ..operators.target import FOLLOW_SCHEMA, Follower, follow_rows
from ..sources.sinks import merge_by_video, scratch_path
from .stateful import OrderedProcessor, stateful


# ---- running a stream to its end --------------------------------------------------------------------------------
def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and return its result as a table in the shared folder.

    In update mode each batch appends its changed rows with a batch number; ``latest`` keeps the newest per key.
    """
    spark = stream.sparkSession
    out, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    writer = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:

        def save(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

        query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    fields = stream.schema.fields if mode == "append" else [*stream.schema.fields, T.StructField("batch", T.IntegerType())]
    schema = T.StructType(fields)
    return spark.read.schema(schema).option("recursiveFileLookup", mode != "append").parquet(out)


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in updates.columns if c not in keys and c != "batch"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


# ---- built-in state ---------------------------------------------------------------------------------------------
def live_votes(readings: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts and first sight per track and value, kept up to date as readings arrive."""
    return readings.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("readings"), F.min("seen").alias("first_seen")
    )


def votes_to_winner(votes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return votes.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("readings"), (-F.col("first_seen")).alias("f"))).alias(value))


def live_workload(events: DataFrame, keys: Sequence[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Samples and summed value per track and event-time window; rows later than ``late`` are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    w = events.withWatermark("ts", late).groupBy(window.alias("w"), *keys)
    g = w.agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("value").cast("decimal(20,4)")).cast("double").alias("load"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "samples", "load")


def activity_sessions(events: DataFrame, keys: Sequence[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions per track, split where nothing was seen for ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("samples"))
    return s.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "samples")


def deduplicated(events: DataFrame, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def deliver_by_video(stream: DataFrame, path: str, log: str, keys: Sequence[str]):
    """Idempotent delivery: every batch is merged by ``keys`` into the rows its videos already have."""

    def save(batch: DataFrame, _number: int) -> None:
        merge_by_video(batch, path, keys)

    return stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(save).start()


def rescore_on_arrival(stream: DataFrame, rescore: Callable[[DataFrame], None], log: str):
    """Each batch of new sessions recomputes only the players it touches; ``rescore`` gets their distinct ids."""

    def run(batch: DataFrame, _number: int) -> None:
        rescore(batch.select("player_id").distinct())

    return stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(run).start()


# ---- custom state -----------------------------------------------------------------------------------------------
class BallPath(OrderedProcessor):
    """The filter of ``operators.ball``, its state carried from batch to batch; a frame that comes again or late is left out."""

    order = "frame"
    row_columns = {"frame": "bigint", "cx": "double", "cy": "double"}
    state_schema = ", ".join(f"{n} double" for n in ("frame", "x", "vx", "y", "vy", "p", "r", "v", "last_x", "last_y"))

    def __init__(self, fps: float, **timed):
        super().__init__(**timed)
        self.path = Path(fps)

    def advance(self, key, state, rows):
        out = []
        for frame, x, y in rows.itertuples(index=False, name=None):
            if state is not None and frame <= state[0]:
                continue
            if state is not None:
                for f in range(int(state[0]) + 1, frame):
                    ahead = self.path.ahead(state, f - int(state[0]))
                    out.append((*key, f, ahead[1], ahead[3], False, False))
            state, accepted = self.path.step(state, frame, x, y)
            out.append((*key, frame, x, y, True, False) if accepted else (*key, frame, state[1], state[3], False, True))
        return pd.DataFrame(out, columns=["video_id", "track_id", "frame", "cx", "cy", "is_detected", "gated"]), state


def live_ball(detections: DataFrame, fps: float, **timed) -> DataFrame:
    """Filtered ball path across micro-batches; rows of a series arrive in frame order between batches. ``timed``: see ``OrderedProcessor``."""
    return stateful(detections, ["video_id", "track_id"], BallPath(fps, **timed), BALL_SCHEMA)


class TargetStates(OrderedProcessor):
    """The follower of ``operators.target``. Once it is silent, the frames of the occlusion are written and it is lost."""

    order = "frame"
    state_schema = ("tracks array<bigint>, box array<double>, place array<double>, missing bigint, state string, next bigint")

    def __init__(self, fps: float, boxes: str, **timed):
        super().__init__(**timed)
        self.fps, self.row_columns = fps, {"frame": "bigint", "boxes": boxes}

    def _follower(self, state) -> Follower:
        f = Follower(self.fps)
        if state is not None:
            f.restore(dict(zip(("tracks", "box", "place", "missing", "state", "next"), state)))
        return f

    def _state(self, f: Follower) -> tuple:
        s = f.snapshot()
        return (s["tracks"], s["box"], s["place"], int(s["missing"]), s["state"], s["next"])

    def advance(self, key, state, rows):
        f = self._follower(state)
        rows = rows.assign(video_id=key[0], target_id=key[1])
        return follow_rows(self.fps, f)(rows), self._state(f)

    def silent(self, key, state):
        f = self._follower(state)
        left = max(0, C.OCCLUSION_FRAMES + 1 - f.missing)
        out = follow_rows(self.fps, f)(pd.DataFrame({"video_id": [key[0]], "target_id": [key[1]], "frame": [f.next_frame + left], "boxes": [[]]}))
        return out, self._state(f)


def live_follow(candidates: DataFrame, fps: float, **timed) -> DataFrame:
    """Target states across micro-batches; candidates arrive in frame order between batches."""
    boxes = candidates.schema["boxes"].dataType.simpleString()
    return stateful(candidates, ["video_id", "target_id"], TargetStates(fps, boxes, **timed), FOLLOW_SCHEMA)


PROGRESS_SCHEMA = "video_id bigint, stage string, percent bigint"
TERMINAL = ("done", "failed")


class Progress(OrderedProcessor):
    order = "at"
    row_columns = {"at": "bigint", "stage": "string", "percent": "bigint"}
    state_schema = "stage string, percent bigint"

    def advance(self, key, state, rows):
        stage, percent = state or ("queued", 0)
        for s, p in zip(rows["stage"], rows["percent"]):
            if p >= percent or s in TERMINAL:
                stage, percent = s, int(min(100, max(0, p)))
        return pd.DataFrame({"video_id": [key[0]], "stage": [stage], "percent": [percent]}), (stage, percent)


def live_progress(events: DataFrame, **timed) -> DataFrame:
    """Latest stage per video from (video_id, at, stage, percent); the percent never falls unless a stage is final."""
    return stateful(events, ["video_id"], Progress(**timed), PROGRESS_SCHEMA, "update")


def stage_from_log(text: Column) -> Column:
    """struct(stage, percent) of a log line, null when it says nothing about progress."""
    percent = F.regexp_extract(text, r"Processing frames:\s+(\d{1,3})%", 1)
    value = F.least(F.lit(100.0), percent.try_cast("double"))
    mk = lambda stage, p: F.struct(F.lit(stage).alias("stage"), p.cast("bigint").alias("percent"))
    return (
        F.when(text.contains("Calculating player statistics"), mk("metrics", F.lit(78)))
        .when(text.contains("Finalizing jersey numbers"), mk("ocr", F.lit(75)))
        .when(text.contains("Finalizing team and role"), mk("track", F.lit(72)))
        .when(percent != "", mk("detect", F.lit(10) + F.floor(value * 0.6)))
    )


def stream_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A supplied table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def drain_in_steps(df: DataFrame, name: str, step: Column, build: Callable[[DataFrame], DataFrame], steps: int = 3) -> DataFrame:
    """Feed ``df`` to a stream in ``steps`` arrivals (``step`` = 0..steps-1) and return everything it wrote.

    ``df`` is computed once. Each arrival is appended to the source folder and processed by a run that resumes from the
    same stored state.
    """
    spark = df.sparkSession
    arrivals, source, out, log = (scratch_path(spark, f"{name}-{part}") for part in ("all", "in", "out", "log"))
    df.withColumn("__step", step).where(F.col("__step").between(0, steps - 1)).write.partitionBy("__step").parquet(arrivals)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__step", T.LongType())])).parquet(arrivals)
    for i in range(steps):
        rows.where(F.col("__step") == i).drop("__step").write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(df.schema).parquet(source))
        writer = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True)
        writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
