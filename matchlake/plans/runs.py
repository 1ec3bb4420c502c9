"""Run-length encoding of ordered rows, block by block.

Runs are first cut inside blocks. Only the first and last run of a block can continue in a neighbour, so just those
edge runs (at most two per block) are merged in a window over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .blocked import BLOCK_ROWS

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def runs(
    rows: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    state: str | None = None,
    max_gap: int = 0,
    measures: dict[str, tuple[str, Column]] | None = None,
    block: str | None = None,
    block_rows: int = BLOCK_ROWS,
    split: bool = True,
) -> DataFrame:
    """One row per run: keys, ``state``, ``start``, ``end``, ``n`` and the merged ``measures``.

    A run ends where ``state`` changes or where more than ``max_gap`` positions are missing. ``measures`` maps an
    output name to ``("sum" | "min" | "max", expression)``. With ``max_gap`` > 0 pass rows of a single state.
    ``block`` names an existing block column of ``pos`` that the rows are already partitioned by.
    """
    keys = list(keys)
    measures = measures or {}
    st = F.col(state) if state else F.lit(True)
    src = rows.select(
        *keys,
        F.col(pos).alias("__pos"),
        st.alias("state"),
        (F.lit(0) if not split else F.col(block) if block else F.floor(F.col(pos) / F.lit(block_rows))).alias("__blk"),
        *[e.alias(f"__m_{m}") for m, (_, e) in measures.items()],
    )
    w = W.partitionBy(*keys, "__blk").orderBy("__pos")
    prev = F.lag("__pos").over(w)
    fresh = prev.isNull() | (F.col("__pos") - prev - 1 > max_gap) | ~F.lag("state").over(w).eqNullSafe(F.col("state"))
    src = src.withColumn("__new", fresh.cast("int"))
    src = src.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    src = src.withColumn("__last", F.max("__run").over(W.partitionBy(*keys, "__blk")) if split else F.col("__run"))
    cut = src.groupBy(*keys, "__blk", "__run").agg(
        F.first("state").alias("state"),
        F.min("__pos").alias("start"),
        F.max("__pos").alias("end"),
        F.count(F.lit(1)).alias("n"),
        F.max("__last").alias("__last"),
        *[_MERGE[how](f"__m_{m}").alias(m) for m, (how, _) in measures.items()],
    )
    out = [*keys, "state", "start", "end", "n", *measures]
    if not split:
        return cut.select(*out)
    at_edge = (F.col("__run") == 1) | (F.col("__run") == F.col("__last"))
    ow = W.partitionBy(*keys).orderBy("start")
    gap = F.col("start") - F.lag("end").over(ow) - 1
    joins_prev = (gap <= max_gap) & F.lag("state").over(ow).eqNullSafe(F.col("state"))
    edges = (
        cut.where(at_edge)
        .withColumn("__new", F.coalesce((~joins_prev).cast("int"), F.lit(1)))
        .withColumn("__id", F.sum("__new").over(ow.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "__id")
        .agg(
            F.first("state").alias("state"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("n").alias("n"),
            *[_MERGE[how](m).alias(m) for m, (how, _) in measures.items()],
        )
        .select(*out)
    )
    return cut.where(~at_edge).select(*out).unionByName(edges)
