"""Positions in a total order, without a window over a whole key.

Rows are range-partitioned by key and order on bounds that Spark samples, and sorted inside the partitions. A row's place in
its partition comes with the sort; what lies before the partition comes from a table of one row per partition and key that it
holds, whose prefix sums are the only window. A key that holds most rows, or a single key, is spread over as many partitions
as its rows fill. Rows with equal values are spread as well, because the tie-breaking columns are part of the bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .materialize import materialised

#: ``monotonically_increasing_id`` numbers the rows of a partition in this many low bits.
_LOW_BITS = 33


def ordinal_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "pos") -> DataFrame:
    """Add the 0-based position of each row among the rows of its key, by ``order``; null keys are keys like any other.

    ``order`` should name the rows uniquely; rows that it leaves equal are numbered in any order. The sorted rows are written
    once, since the bounds of a range partitioning are sampled and a second run may draw others.
    """
    keys = list(keys)
    rows = df.withColumn("__key", F.struct(*keys) if keys else F.lit(0))
    bounds = [F.asc("__key"), *order]
    ids = F.monotonically_increasing_id()
    rows = materialised(rows.repartitionByRange(*bounds).sortWithinPartitions(*bounds).withColumn("__at", ids))
    rows = rows.withColumn("__part", F.shiftright("__at", _LOW_BITS))
    blocks = rows.groupBy("__key", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__key").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("__key", "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = rows.join(blocks, ["__key", "__part"])
    return numbered.withColumn(out, F.col("__start") + F.col("__at") - F.col("__first")).drop("__key", "__part", "__at", "__first", "__start")
