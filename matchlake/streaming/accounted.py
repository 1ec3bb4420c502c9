"""Event-time windows that account for every row: what comes behind the watermark goes to a side table instead of being dropped.

Each batch writes three folders, ``windows`` (its partial sums), ``late`` (its late rows) and ``marks`` (its counts and the
watermark it ran under), all named by the batch number, so a batch that runs again replaces what it wrote. Readers add
the partial sums up. No state is kept in executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..plans.materialize import reuse
from ..sources.sinks import table_exists

MARKS = "batch bigint, rows bigint, late_rows bigint, top timestamp, watermark timestamp"


def account(stream: DataFrame, path: str, log: str, keys: Sequence[str], size: str, late: str = "10 minutes"):
    """Run a stream with ``ts`` and ``value`` over everything available and account for its rows by ``keys`` and window.

    A row is late if its window ended at or before the watermark: the newest ``ts`` of all earlier batches less ``late``. Rows
    without ``ts`` count as late, for they have no window. The query is returned; wait for it before reading.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def save(batch: DataFrame, number: int) -> None:
        before = marks(spark, path).where(F.col("batch") < number).agg(F.max("top")).first()[0]
        # a window leaves out rows without a time, so those get any
        end = F.window(F.coalesce("ts", F.timestamp_seconds(F.lit(0))), size).end
        mark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {late}")
        behind = F.coalesce(end <= mark, F.col("ts").isNull())
        seen = Observation()
        rows = batch.select(*schema.fieldNames(), behind.alias("__late"))
        rows = reuse(rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("__late").alias("late_rows"), F.max("ts").alias("top")))
        try:
            on_time = rows.where(~F.col("__late")).groupBy(F.window("ts", size).start.alias("window_start"), *keys)
            sums = on_time.agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("value").cast("decimal(20,4)")).alias("load"))
            sums.write.mode("overwrite").parquet(f"{path}/windows/batch={number}")
            rows.where("__late").drop("__late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            got = seen.get
        finally:
            rows.unpersist()
        one = spark.range(1).select(
            F.lit(number).cast("bigint").alias("batch"), F.lit(got["rows"]).cast("bigint").alias("rows"), F.lit(got["late_rows"]).cast("bigint").alias("late_rows"),
            F.lit(got["top"]).cast("timestamp").alias("top"), mark.alias("watermark"))
        one.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(save).start()


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    where = f"{path}/{name}"
    return spark.read.schema(schema).parquet(where) if table_exists(spark, where) else spark.createDataFrame([], schema)


def marks(spark: SparkSession, path: str) -> DataFrame:
    """Per batch: rows, late rows, newest time, and the watermark it ran under (null for the first)."""
    return _read(spark, path, "marks", MARKS)


def windows(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """``window_start``, the columns of ``keys`` (a schema text), ``samples`` and ``load`` of the rows that were on time."""
    parts = _read(spark, path, "windows", f"window_start timestamp, {keys}, samples bigint, load decimal(30,4)")
    by = [c for c in parts.columns if c not in ("samples", "load", "batch")]
    return parts.groupBy(*by).agg(F.sum("samples").alias("samples"), F.sum("load").cast("double").alias("load"))


def late_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that came behind the watermark, as they came, with their batch number."""
    return _read(spark, path, "late", f"{schema}, batch bigint")
