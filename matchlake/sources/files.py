"""Readers for tracker output, calibration, rosters, ground truth and athlete-log files."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

DETECTIONS = T.StructType(
    [
        T.StructField("frame", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("player_uid", T.LongType()),
        T.StructField("class", T.StringType()),
        T.StructField("bbox_x1", T.DoubleType()),
        T.StructField("bbox_y1", T.DoubleType()),
        T.StructField("bbox_x2", T.DoubleType()),
        T.StructField("bbox_y2", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("pitch_x", T.DoubleType()),
        T.StructField("pitch_y", T.DoubleType()),
        T.StructField("is_detected", T.BooleanType()),
        T.StructField("is_interpolated", T.BooleanType()),
        T.StructField("jersey_number", T.LongType()),
        T.StructField("team", T.StringType()),
        T.StructField("role", T.StringType()),
    ]
)
# Fields of the tracker's statistics per player.
STATS = T.StructType(
    [
        T.StructField("track_id", T.LongType()),
        T.StructField("jersey_number", T.LongType()),
        T.StructField("team", T.StringType()),
        T.StructField("role", T.StringType()),
        *[
            T.StructField(n, T.DoubleType())
            for n in (
                "top_speed_mph", "top_speed_kmh", "distance_km", "distance_m", "minutes_played", "minutes_played_s", "visible_minutes",
                "visible_minutes_s", "coverage_pct", "distance_per_min_m", "avg_pitch_x", "avg_pitch_y", "high_speed_distance_km",
                "sprint_distance_km", "sprint_count", "hsr_count", "hi_efforts_count", "accel_count_high", "decel_count_high",
                "zone_walk_km", "zone_jog_km", "zone_run_km", "zone_hsr_km", "zone_sprint_km",
            )
        ],
        T.StructField("injury_risk", T.StringType()),
        T.StructField("contributing_track_ids", T.ArrayType(T.LongType())),
    ]
)
CALIBRATION = (
    "camera_id long, pitch_dimensions struct<width_m: double, length_m: double>, "
    "correspondences array<struct<image: array<double>, pitch: array<double>>>"
)
EVENTS = (
    "map<string, struct<events: array<struct<type: string, player_jersey: long, start_time_s: double, end_time_s: double, "
    "distance_m: double, notes: string, tolerance_pct: double>>>>"
)


def read_json_list(
    spark: SparkSession, path: str, schema: T.StructType | str, id_from_path: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Rows of JSON list files; elements that are not objects are dropped, other broken text gives no rows.

    ``id_from_path`` is a regular expression whose first group is the video id in the file name. With
    ``multi_line=False`` every line is a list of its own, so large files can be split.
    """
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    kept = T.StructType([*struct.fields, T.StructField("__bad", T.StringType())])
    reader = spark.read.schema(kept).option("multiLine", multi_line).option("mode", "PERMISSIVE")
    df = reader.option("columnNameOfCorruptRecord", "__bad").json(path)
    ids = []
    if id_from_path:
        df = df.withColumn("video_id", F.regexp_extract(F.input_file_name(), id_from_path, 1).cast("bigint"))
        ids = ["video_id"]
    names = struct.fieldNames()
    good = df.where(F.col("__bad").isNull()).select(*ids, *names)
    # a list with a stray element is reported as broken as a whole: take its objects one by one
    each = df.where(F.col("__bad").isNotNull()).select(
        *ids, F.col(names[0]).alias("__first"), F.explode(F.from_json("__bad", "array<string>")).alias("e")
    )
    obj = each.where(F.trim("e").startswith("{")).select(*ids, "__first", F.from_json("e", struct).alias("o"))
    repaired = obj.select(*ids, F.coalesce(F.col(f"o.{names[0]}"), F.col("__first")).alias(names[0]), *[f"o.{n}" for n in names[1:]])
    return good.unionByName(repaired)


def read_stat_lists(spark: SparkSession, path: str, id_from_path: str, multi_line: bool = True) -> DataFrame:
    """Statistic rows of JSON list files, one file per video, by the same rules as detections."""
    return read_json_list(spark, path, STATS, id_from_path, multi_line)


def output_problems(spark: SparkSession, path: str, id_from_path: str, videos: DataFrame) -> DataFrame:
    """``problem`` of the list file of each video: missing, not valid JSON, not a list; null if it can be read.

    A video with a problem must not be stored: its rows are incomplete. Files are read whole, one per task at a time.
    """
    return list_problems(read_text_files(spark, path, id_from_path), videos)


def list_problems(outputs: DataFrame, videos: DataFrame) -> DataFrame:
    """``output_problems`` of outputs that are rows (video_id, body) already."""
    found = outputs.select("video_id", F.lit(True).alias("__found"), F.try_parse_json("body").alias("__v"))
    kind = F.schema_of_variant("__v")
    problem = (
        F.when(F.col("__found").isNull(), "output is missing").when(F.col("__v").isNull(), "output is not valid JSON")
        .when(~kind.startswith("ARRAY"), "output must be a list")
    )
    return videos.select("video_id").distinct().join(found, "video_id", "left").select("video_id", problem.alias("problem"))


def list_rows(outputs: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of the lists in (video_id, body); elements that are not objects are dropped, other text gives no rows."""
    each = outputs.select("video_id", F.explode(F.from_json("body", "array<string>")).alias("e")).where(F.trim("e").startswith("{"))
    return each.select("video_id", F.from_json("e", schema).alias("o")).select("video_id", "o.*")


def write_bundles(outputs: DataFrame, path: str) -> None:
    """Whole outputs (video_id, body) of many videos, one a line: a small file and a folder for each cost far more than their content."""
    outputs.select("video_id", "body").write.json(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("video_id bigint, body string").json(path)


def read_text_files(spark: SparkSession, path: str, id_from_path: str) -> DataFrame:
    """(video_id, body) of whole small files."""
    df = spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")
    return df.select(F.regexp_extract(F.input_file_name(), id_from_path, 1).cast("bigint").alias("video_id"), "body")


def parse_meta(body: Column) -> Column:
    """Free JSON as a variant; broken text gives null."""
    return F.try_parse_json(body)


def meta_fields(df: DataFrame, body: str = "body") -> DataFrame:
    """Typed fields out of free JSON meta data, read defensively."""
    v = df.withColumn("__v", parse_meta(F.col(body)))
    get = lambda p, t: F.try_variant_get("__v", p, t)
    pair = F.concat(get("$.resolution[0]", "string"), F.lit("x"), get("$.resolution[1]", "string"))
    is_list = F.schema_of_variant(F.try_variant_get("__v", "$.resolution", "variant")).startswith("ARRAY")
    text = F.when(~is_list, get("$.resolution", "string"))
    return v.withColumns(
        {
            "duration_s": get("$.duration_s", "double"),
            "fps": get("$.fps", "double"),
            "calibration": get("$.calibration", "string"),
            "adapter_source": get("$.adapter_source", "string"),
            "distance_valid": get("$.distance_valid", "boolean"),
            "resolution": F.coalesce(pair, text),
            "broken": F.col("__v").isNull(),
        }
    ).drop("__v")


def heatmap_cells(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(cells, fallback flags) from JSON text {track: rows of columns}; broken text sets the flag."""
    grids = df.withColumn("__m", F.from_json(body, "map<string, array<array<double>>>"))
    flags = grids.select("video_id", (F.col("__m").isNull() | (F.size("__m") == 0)).alias("use_fallback"))
    g = grids.select("video_id", F.explode("__m").alias("track", "grid")).withColumn("track_id", F.col("track").try_cast("bigint"))
    r = g.select("video_id", "track_id", F.posexplode("grid").alias("cell_row", "row"))
    return r.select("video_id", "track_id", "cell_row", F.posexplode("row").alias("cell_col", "value")), flags


def calibration_points(df: DataFrame) -> DataFrame:
    """Marked points per camera; cameras with fewer than four are dropped."""
    enough = df.where(F.size("correspondences") >= 4)
    p = enough.select("camera_id", F.explode("correspondences").alias("c"))
    return p.select(
        "camera_id", F.col("c.image")[0].alias("image_x"), F.col("c.image")[1].alias("image_y"), F.col("c.pitch")[0].alias("pitch_x"),
        F.col("c.pitch")[1].alias("pitch_y"),
    )


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return calibration_points(spark.read.schema(CALIBRATION).option("multiLine", True).json(path))


def ground_truth_events(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per event of nested JSON {clip: {events: [...]}}."""
    c = df.select(F.explode(F.from_json(body, EVENTS)).alias("clip", "v"))
    return c.select("clip", F.explode("v.events").alias("e")).select("clip", "e.*")


def unpivot_axes(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Columns ``<name>_x`` / ``<name>_y`` to rows (ids, player, x, y)."""
    names = sorted({m.group(1) for c in wide.columns if (m := re.fullmatch(r"(.+)_[xy]", c))})
    rows = [
        F.struct(F.lit(n).alias("player"), F.col(f"`{n}_x`").cast("double").alias("x"), F.col(f"`{n}_y`").cast("double").alias("y"))
        for n in names
    ]
    return wide.select(*ids, F.explode(F.array(*rows)).alias("p")).select(*ids, "p.*")


def read_tracking_csv(spark: SparkSession, path: str, ids: Sequence[str]) -> DataFrame:
    return unpivot_axes(spark.read.option("header", True).csv(path), ids).where("x is not null and y is not null")


def kit_colours(text: Column) -> Column:
    """Array of [r, g, b] from '#RRGGBB,#RRGGBB'; entries that are not colours are dropped."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p.rlike("^#[0-9A-Fa-f]{6}$"))
    channel = lambda p, i: F.conv(F.substring(p, i, 2), 16, 10).cast("int")
    return F.transform(parts, lambda p: F.array(channel(p, 2), channel(p, 4), channel(p, 6)))


def roster_entries(text: Column) -> Column:
    """Array of shirt numbers from 'A:1,2,3;B:4,5' as struct(team, jersey)."""
    teams = F.filter(F.split(text, ";"), lambda t: t.contains(":"))
    each = F.transform(
        teams,
        lambda t: F.transform(
            F.filter(F.split(F.split(t, ":", 2)[1], ","), lambda n: F.trim(n).rlike(r"^\d{1,2}$")),
            lambda n: F.struct(F.upper(F.trim(F.split(t, ":", 2)[0])).alias("team"), F.trim(n).cast("bigint").alias("jersey")),
        ),
    )
    return F.flatten(each)


def csv_cells(text: Column) -> Column:
    """Cells of one CSV line; quoted cells may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(r',(?:"(?:[^"]|"")*"|[^,]*)'), F.lit(0))

    def clean(cell: Column) -> Column:
        body = F.substring(cell, F.lit(2), F.length(cell))
        quoted = F.regexp_replace(F.regexp_replace(body, r'^"|"$', ""), '""', '"')
        return F.when(body.startswith('"'), quoted).otherwise(body)

    return F.transform(raw, clean)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole CSV files; a quoted cell may hold line breaks. ``line`` is where a record starts."""
    csv.field_size_limit(1 << 31)
    for batch in batches:
        for name, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
            reader, before = csv.reader(io.StringIO((text or "").removeprefix("\ufeff"), newline="")), 0
            head: list[str] | None = None
            rows: list[tuple[int, list[str]]] = []
            for cells in reader:
                line, before = before + 1, reader.line_num
                if head is None:
                    head = cells
                elif any(c.strip() for c in cells):
                    rows.append((line, cells))
                if len(rows) == 5_000:
                    yield _record_batch(name, head, rows)
                    rows = []
            if rows:
                yield _record_batch(name, head, rows)


def _record_batch(name: str, head: list[str], rows: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    n, cells = len(rows), pa.list_(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * n, pa.string()), pa.array([head] * n, cells), pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], cells)],
        names=["file", "head", "line", "cells"],
    )


def read_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """Athlete-log files as text cells with canonical column names and a line number per file.

    Every file may have its own header; each row is read by the header of its file, so nothing passes the driver. Of
    repeated columns the first wins, absent ones are null, rows without content are skipped. A file is small (a service
    accepts 5 MB) and read by one task.
    """
    from ..operators.athlete import HEADER_ALIASES, canonical_header

    body = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = body.mapInArrow(_records, "file string, head array<string>, line int, cells array<string>")
    rows = rows.withColumn("names", F.transform("head", lambda c: F.coalesce(canonical_header(c), F.lit(""))))

    def value(name: str) -> Column:
        at = F.array_position("names", name).cast("int")
        return F.when(at > 0, F.nullif(F.try_element_at("cells", F.when(at > 0, at).otherwise(1)), F.lit(""))).alias(name)

    return rows.select("file", "line", *[value(n) for n in HEADER_ALIASES])
