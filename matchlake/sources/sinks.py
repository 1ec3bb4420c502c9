"""Writers with replace semantics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.materialize import shuffles_removed
from ..session import checkpoint_dir

#: Compression of stored tables: it takes the two spare bits of every character out of base64 texts.
CODEC = "zstd"
#: A store is replaced in so many groups of buckets at most, one after the other.
GROUPS = 8


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the cluster (a temporary folder in local runs)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_partitions(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet", salt: int = 1, **options) -> None:
    """Replace the partitions of every key value present in ``df``; running it again gives the same table.

    ``salt`` spreads the rows of one hot key over that many tasks and files. The number of tasks is a given one, because the
    cost is that of the folders: a few tasks for few bytes would make very many folders one after the other.
    """
    spark = df.sparkSession
    cols, tasks = [F.col(k) for k in keys], max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = df.repartition(tasks, *cols) if salt <= 1 else df.withColumn("__s", F.floor(F.rand(7) * salt)).repartition(tasks, *cols, "__s").drop("__s")
    writer = spread.write.mode("overwrite").partitionBy(*keys).format(fmt).option("partitionOverwriteMode", "dynamic")
    writer.options(**options).save(path)


def _folder(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a table folder, wherever it is stored."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _folder(spark, path)
    return fs.exists(where)


def _drop_partitions(spark: SparkSession, path: str, column: str, values: DataFrame) -> None:
    """Remove the folders of key values that have no rows left; only those few values pass the driver, one at a time."""
    fs, _ = _folder(spark, path)
    for row in values.toLocalIterator():
        name = "__HIVE_DEFAULT_PARTITION__" if row[0] is None else row[0]
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={name}"), True)


def replace_by_video(df: DataFrame, path: str, videos: DataFrame | None = None, salt: int = 1) -> None:
    """Delete and insert the rows of each video in ``df``. A video of ``videos`` without rows in ``df`` loses its old ones."""
    write_partitions(df, path, ["video_id"], salt=salt)
    if videos is not None:
        empty = videos.select("video_id").distinct().join(df.select("video_id").distinct(), "video_id", "left_anti")
        _drop_partitions(df.sparkSession, path, "video_id", empty)


def replace_by_player(
    new: DataFrame, current: DataFrame, path: str, buckets: int = 256, players: DataFrame | None = None,
    shape: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Replace the rows of each player in ``players`` (by default those in ``new``). Only their buckets are rewritten.

    A player of ``players`` without new rows loses the old ones. ``buckets`` grows with the table: a bucket is rewritten
    whole. ``current`` is the same table: every row is written once, to a hidden folder, new ones all before the first old one
    goes; then the folders of a few touched buckets at a time are put in the place of the old ones. ``shape`` makes stored rows of ``new`` after these are dealt out by bucket,
    so that wide columns (ciphertext) are not shuffled; it keeps ``player_id`` and ``player_bucket``.
    """
    bucket = F.pmod(F.hash("player_id"), F.lit(buckets)).alias("player_bucket")
    spark = new.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"

    def stage(rows: DataFrame, name: str) -> DataFrame:
        with shuffles_removed(spark):
            rows.write.option("compression", CODEC).partitionBy("player_bucket").parquet(f"{staged}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{staged}/{name}")

    dealt = new.withColumn("player_bucket", bucket).hint("rebalance", "player_bucket")  # splits a bucket with very many rows
    who = stage(dealt if shape is None else shape(dealt), "new").select("player_id")
    # as a file, so that few players are seen to be few
    who.unionByName(players.select("player_id") if players is not None else who).distinct().write.parquet(f"{staged}/players")
    who = spark.read.parquet(f"{staged}/players")
    touched = sorted(r[0] for r in who.select(bucket).distinct().collect())
    kept = current if "player_bucket" in current.columns else current.withColumn("player_bucket", bucket)

    fs, _ = _folder(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    # a group of buckets at a time, so that only a group has its old rows beside the new ones; without the column of the
    # folders every group would read all files, so that is one group
    there = [b for b in touched if fs.exists(at(f"{path}/player_bucket={b}"))]
    step = (-(-len(there) // GROUPS) if "player_bucket" in current.columns else len(there)) or 1
    groups = [there[i : i + step] for i in range(0, len(there), step)]
    for n, group in enumerate([*groups, [b for b in touched if b not in set(there)]]):
        if n < len(groups):
            stage(kept.where(F.col("player_bucket").isin(group)).join(who, "player_id", "left_anti"), f"kept-{n}")
        for b in group:
            name = f"player_bucket={b}"
            fs.delete(at(f"{path}/{name}"), True)
            made = [f"{staged}/{f}/{name}" for f in (f"kept-{n}", "new") if fs.exists(at(f"{staged}/{f}/{name}"))]
            # files of both runs have names of their own, so the second folder's go into the first
            for f in fs.listStatus(at(made[1])) if len(made) == 2 else []:
                fs.rename(f.getPath(), at(f"{made[0]}/{f.getPath().getName()}"))
            if made:
                fs.rename(at(made[0]), at(f"{path}/{name}"))
    fs.delete(at(staged), True)


def upsert_by_player(new: DataFrame, path: str, players: DataFrame, buckets: int = 256, shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """``replace_by_player`` on the table at ``path``, which need not exist yet. Running it again gives the same table."""
    spark = new.sparkSession
    stored = new.schema if shape is None else shape(new.withColumn("player_bucket", F.lit(0))).drop("player_bucket").schema
    current = spark.read.schema(stored).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], stored)
    replace_by_player(new, current, path, buckets, players, shape)


def merge_by_video(batch: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Add a batch to the rows its videos already have; a row with the same ``keys`` is replaced, so a repeated batch changes nothing."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates(list(keys))
    if table_exists(spark, path):
        old = spark.read.schema(batch.schema).parquet(path).join(rows.select("video_id").distinct(), "video_id", "left_semi")
        rows = old.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)
    checkpoint_dir(spark)
    replace_by_video(rows.checkpoint(), path)


def write_files(df: DataFrame, path: str, fmt: str, keys: Sequence[str] = ("video_id",)) -> None:
    """Plain export as JSON lines, CSV or Parquet, one folder per key value."""
    write_partitions(df, path, keys, fmt=fmt, **({"header": "true"} if fmt == "csv" else {}))
