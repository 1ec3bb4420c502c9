"""Tables replaced by key in snapshots: a commit over several tables shows as a whole or not at all.

A store is a folder. ``data`` holds immutable Parquet folders, one per table, commit and bucket of keys; ``versions`` holds
one small file per commit that names the folders of every bucket of every table. A commit writes new folders for the
buckets it touches and then puts its version file in place by one rename that never overwrites, which decides between two
writers. Readers take the newest version file, so they see every commit whole, and what they read stays as it is.

A writer that dies before the rename leaves folders that no version names; ``expire`` removes them later.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..plans.materialize import shuffles_removed
from .sinks import CODEC


class Conflict(RuntimeError):
    """Another writer has changed the same buckets since the rows were computed; compute them again."""


@dataclass(frozen=True)
class Replace:
    """The rows of every key value in ``keys`` (by default those in ``rows``) become ``rows``; a value without rows loses its old ones.

    ``shape`` makes the stored rows after ``rows`` are dealt out by bucket, so that wide columns (ciphertext) are not shuffled.
    It keeps the key and ``__bucket``.
    """

    rows: DataFrame
    key: str
    keys: DataFrame | None = None
    shape: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Snapshot:
    """One version of a store. ``tables``: schema, key, number of buckets and folder per bucket; ``tags``: last batch per stream."""

    spark: SparkSession
    root: str
    version: int = 0
    tables: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        state = self.tables[table]
        schema = T.StructType.fromJson(state["schema"])
        paths = [f"{self.root}/{p}" for b, p in state["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list:
    """Entries of a folder (none if it is absent)."""
    fs, where = _files(spark, path)
    return list(fs.listStatus(where)) if fs.exists(where) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all versions kept, ascending."""
    return sorted(int(n) for n in (s.getPath().getName() for s in _names(spark, f"{root}/versions")) if n.isdigit())


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The newest version of a store (an empty one if there is none), or an earlier one that is still kept."""
    root = root.rstrip("/")
    if version is None:
        version = max(versions(spark, root), default=0)
    if not version:
        return Snapshot(spark, root)
    fs, where = _files(spark, f"{root}/versions/{version:012d}")
    stream = fs.open(where)
    try:
        content = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(spark, root, version, content["tables"], content["tags"])


def _publish(new: Snapshot) -> bool:
    """Put the version file in place; False if that version exists already."""
    jvm, folder = new.spark._jvm, f"{new.root}/versions"
    fs, draft = _files(new.spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps({"tables": new.tables, "tags": new.tags}).encode()))
    finally:
        out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{folder}/{new.version:012d}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), new.spark._jsc.hadoopConfiguration())
    no_overwrite = new.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), no_overwrite)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        fs.delete(draft, False)
        return False


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _write(base: Snapshot, table: str, change: Replace, buckets: int) -> tuple[dict, list[int]]:
    """New state of a table whose touched buckets lie in a fresh folder, and those buckets (at most their number passes the driver)."""
    spark = base.spark
    shape = change.shape or (lambda dealt: dealt)
    stored = shape(change.rows.withColumn("__bucket", F.lit(0))).drop("__bucket").schema
    state = base.tables.get(table) or {"schema": stored.jsonValue(), "key": change.key, "buckets": buckets, "folders": {}}
    if state["key"] != change.key:
        raise ValueError(f"{table} is kept by {state['key']}, not {change.key}")
    bucket = _bucket(change.key, state["buckets"])
    place = f"data/{table}/{uuid.uuid4().hex}"
    # rebalance splits a bucket with very many rows over several tasks and files
    with shuffles_removed(spark):
        shape(change.rows.withColumn("__bucket", bucket).hint("rebalance", "__bucket")).write.option("compression", CODEC).partitionBy("__bucket").parquet(f"{base.root}/{place}")
    who = (spark.read.schema(stored).parquet(f"{base.root}/{place}") if change.keys is None else change.keys).select(change.key).distinct()
    touched = sorted(r[0] for r in who.select(bucket.alias("b")).distinct().collect())
    if any(str(b) in state["folders"] for b in touched):
        gone = who.select(F.col(change.key).alias("__gone"))
        old = base.read(table, touched).join(gone, F.col(change.key).eqNullSafe(F.col("__gone")), "left_anti")
        # what stays comes from folders by bucket, so it is not shuffled again
        with shuffles_removed(spark):
            old.withColumn("__bucket", bucket).write.option("compression", CODEC).mode("append").partitionBy("__bucket").parquet(f"{base.root}/{place}")
    made = [s.getPath().getName() for s in _names(spark, f"{base.root}/{place}") if s.isDirectory()]
    folders = {str(b): f for b, f in state["folders"].items() if int(b) not in touched}
    folders |= {n.removeprefix("__bucket="): f"{place}/{n}" for n in made}
    return state | {"folders": folders}, touched


def commit(base: Snapshot, changes: Mapping[str, Replace], *, buckets: int = 256, tag: tuple[str, int] | None = None) -> Snapshot:
    """Replace rows of one or more tables in one version, on top of the snapshot that the rows were computed from.

    Commits of other writers in between are kept if they touched other buckets; else ``Conflict`` is raised and nothing
    changes. ``tag`` (stream, batch number) makes a batch that comes again do nothing. ``buckets`` is fixed when a table is
    made: a bucket is rewritten whole, so it should grow with the table. Null keys are a key like any other.
    """
    spark, root = base.spark, base.root
    seen = lambda s: tag is not None and s.tags.get(tag[0], -1) >= tag[1]
    if seen(base):
        return base
    written = {name: _write(base, name, change, buckets) for name, change in changes.items()}
    while True:
        now = snapshot(spark, root)
        if seen(now):
            return now
        tables = dict(now.tables)
        for name, (state, touched) in written.items():
            before, current = (s.tables.get(name, {}).get("folders", {}) for s in (base, now))
            if any(before.get(str(b)) != current.get(str(b)) for b in touched):
                raise Conflict(f"{name}: version {now.version} changed what version {base.version} had")
            if name in now.tables and now.tables[name]["buckets"] != state["buckets"]:
                raise Conflict(f"{name} was made with another number of buckets")
            mine = {b: f for b, f in state["folders"].items() if int(b) in touched}
            tables[name] = state | {"folders": {b: f for b, f in current.items() if int(b) not in touched} | mine}
        new = Snapshot(spark, root, now.version + 1, tables, now.tags | ({tag[0]: tag[1]} if tag else {}))
        if _publish(new):
            return new


def expire(spark: SparkSession, root: str, keep: int = 2, older_than: float = 86_400) -> int:
    """Remove all but the last ``keep`` versions and the folders that none of those names; returns the number of folders removed.

    Folders younger than ``older_than`` seconds stay, because a writer may not have named them yet.
    """
    root = root.rstrip("/")
    numbers = versions(spark, root)
    for n in numbers[:-keep]:
        fs, where = _files(spark, f"{root}/versions/{n:012d}")
        fs.delete(where, False)
    named = {f for n in numbers[-keep:] for t in snapshot(spark, root, n).tables.values() for f in t["folders"].values()}
    limit, removed = (time.time() - older_than) * 1000, 0
    for table in _names(spark, f"{root}/data"):
        for made in _names(spark, table.getPath().toString()):
            place = f"data/{table.getPath().getName()}/{made.getPath().getName()}"
            for folder in _names(spark, f"{root}/{place}"):
                if folder.isDirectory() and f"{place}/{folder.getPath().getName()}" not in named and folder.getModificationTime() < limit:
                    _files(spark, root)[0].delete(folder.getPath(), True)
                    removed += 1
    return removed
