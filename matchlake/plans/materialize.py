"""Results that several branches of one job read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def reuse(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors (memory, then disk) so that branches do not recompute it.

    The lineage stays, so a lost executor only costs the recomputation of its partitions.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries made in this block leave no shuffle files behind: for results that are written, so that nothing reads these files again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialised(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The lineage ends at files that every executor sees, so a lost executor costs no recomputation and every later
    reader gets the same rows. The shuffle files behind them are removed as soon as they are written.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    with shuffles_removed(spark):
        return df.select("*").checkpoint(eager=True)  # a new query, which reads the setting when it is made


def written(df: DataFrame) -> DataFrame:
    """As ``materialised``, but as compressed columns, of which a reader takes only its own."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
