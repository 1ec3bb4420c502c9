"""Bounded samples of learning rows, and the optimiser that the trained models share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hashed_sample(rows: DataFrame, size: int, *, id_col: str = "doc_id") -> DataFrame:
    """At most ``size`` rows: those with the smallest hashes of their id, the same ones at every run.

    Only the hashes are ordered; the rows themselves are filtered by the largest hash taken, so wide rows are not moved.
    """
    key = F.xxhash64(F.col(id_col).cast("string"))
    taken = [r[0] for r in rows.select(key.alias("h")).orderBy("h").limit(size).collect()]
    return rows.where(key <= F.lit(taken[-1] if taken else -(1 << 63))).limit(size)


def stratified_sample(rows: DataFrame, size: int, *, stratum: str, text_col: str, id_col: str = "doc_id") -> DataFrame:
    """``stratum``, ``text_col``: about ``size`` distinct documents, shared equally among all strata that ``rows`` has.

    A stratum keeps the rows whose hash of id and text lies below twice its quota's share (all rows of a small one), which is
    a bounded number whatever the stratum's size, and of these the smallest hashes. Equal rows count once.
    """
    rows = rows.withColumn("h", F.xxhash64(F.col(id_col).cast("string"), text_col))
    counts = {r[0]: max(1, r[1]) for r in rows.groupBy(stratum).agg(F.approx_count_distinct("h")).collect()}
    quota = -(-size // max(1, len(counts)))
    limit = F.lit(-(1 << 63))
    for name, n in sorted(counts.items()):
        share = min(1.0, 2 * quota / n)
        limit = F.when(F.col(stratum) == name, F.lit(int(min(share * 2.0**64 - 2.0**63, 2.0**63 - 1024)) if share < 1 else (1 << 63) - 1)).otherwise(limit)
    once = rows.where(F.col("h") <= limit).groupBy(stratum, "h").agg(F.min(text_col).alias(text_col))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("h"))
    return once.withColumn("place", place).where(F.col("place") <= quota).select(stratum, text_col)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g + self.decay * self.params[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)
