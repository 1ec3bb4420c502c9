"""Order statistics per key without sorting a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranking import ordinal_position


def kth_largest(
    df: DataFrame, keys: Sequence[str], value: str, index: Column, count: str, out: str, bin_width: float = 0.01,
    split: bool = True,
) -> DataFrame:
    """Value at 0-based descending position ``index`` (an expression over the row count column ``count``).

    Values are counted into fixed-width bins, the bin that holds the position is found from the bin counts, and only
    that bin is resolved exactly. Null values are ignored.
    """
    keys = list(keys)
    if not split:
        w = W.partitionBy(*keys)
        rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
        rows = rows.withColumns({count: F.count(F.lit(1)).over(w), "__r": F.row_number().over(w.orderBy(F.desc("__v"))) - 1})
        return rows.where(F.col("__r") == index).select(*keys, F.col("__v").alias(out), count)
    src = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("__v"), F.floor(F.col(value) / F.lit(bin_width)).alias("__bin")
    )
    by_key = W.partitionBy(*keys)
    bins = src.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__c"))
    bins = bins.withColumns(
        {
            count: F.sum("__c").over(by_key),
            "__upto": F.sum("__c").over(
                by_key.orderBy(F.desc("__bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
            ),
        }
    )
    bins = bins.withColumn("__k", index).where((F.col("__upto") > F.col("__k")) & (F.col("__upto") - F.col("__c") <= F.col("__k")))
    bins = bins.select(*keys, "__bin", count, (F.col("__k") - F.col("__upto") + F.col("__c")).alias("__skip"))
    values = src.join(bins, [*keys, "__bin"]).groupBy(*keys, "__bin", "__v").agg(
        F.count(F.lit(1)).alias("__c"), F.max("__skip").alias("__skip"), F.max(count).alias(count)
    )
    upto = F.sum("__c").over(
        W.partitionBy(*keys, "__bin").orderBy(F.desc("__v")).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        values.withColumn("__upto", upto)
        .where(F.col("__upto") > F.col("__skip"))
        .groupBy(*keys)
        .agg(F.max("__v").alias(out), F.max(count).alias(count))
    )


def ordinal_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    """1-based rank by ``value`` descending, then ``tie`` ascending; null values get no rank."""
    ranked = ordinal_position(df.where(F.col(value).isNotNull()), keys, [F.desc(value), F.asc(tie)], "__pos")
    ranked = ranked.withColumn(out, F.col("__pos") + 1).drop("__pos")
    missing = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("bigint"))
    return ranked.unionByName(missing)
