"""Uploads of athlete logs: text rows become stored logs and fresh scores in one commit, or a preview that stores nothing.

A store (``sources.snapshots``) holds three tables: ``logs`` and ``scores`` by player, ``uploads`` by upload. Heart rates,
percents and details are encrypted. A run takes the rows of any number of uploads; only the buckets of the players they
name are read and written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.secrets import decrypt_number, encrypt_number
from ..plans.materialize import materialised, written
from ..sources.snapshots import Replace, Snapshot, commit
from . import athlete as A, model as M, risk as K

PLAIN = ["log_id", "player_id", "log_date", "upload_id", "line", "gps_distance_km", "minutes_played", "sprints", "top_speed_kmh"]
SECRET = ["heart_rate", "heart_rate_max"]
#: Bits of a log id that hold the line; a file of 5 MB has fewer lines than 2^24.
LINE_BITS = 24


@dataclass(frozen=True)
class Report:
    """What became of the rows: counts per upload, wrong cells, rows without a player, and a score per good row."""

    uploads: DataFrame
    errors: DataFrame
    unmatched: DataFrame
    results: DataFrame
    #: the store after the commit (before it, for a preview)
    store: Snapshot


def plain_logs(logs: DataFrame) -> DataFrame:
    """Logs with the columns and types that a store has, heart rates in the clear; absent columns are null."""
    have = set(logs.columns)
    types = {"log_date": "date", "log_id": "bigint", "player_id": "bigint", "upload_id": "bigint", "line": "bigint"}
    return logs.select(*[(F.col(c) if c in have else F.lit(None)).cast(types.get(c, "double")).alias(c) for c in [*PLAIN, *SECRET]])


def seal_logs(logs: DataFrame, key: Column) -> DataFrame:
    """Logs as they are stored: absent columns are null, heart rates encrypted."""
    rows = plain_logs(logs) if not set(K.BUCKETS) & set(logs.columns) else logs
    return rows.select(*PLAIN, *[c for c in K.BUCKETS if c in rows.columns], *[encrypt_number(F.col(c), key).alias(f"{c}_enc") for c in SECRET])


def log_change(logs: DataFrame, key: Column, players: DataFrame | None = None) -> Replace:
    """The logs of ``players`` (by default those in ``logs``) become ``logs``."""
    return Replace(plain_logs(logs), "player_id", players, lambda dealt: seal_logs(dealt, key))


def score_change(scores: DataFrame, key: Column, players: DataFrame) -> Replace:
    return Replace(scores, "player_id", players, lambda dealt: K.seal(dealt, key))


def open_logs(stored: DataFrame, key: Column) -> DataFrame:
    return stored.select(*PLAIN, *[decrypt_number(F.col(f"{c}_enc"), key).alias(c) for c in SECRET])


def log_id(line_bits: int = LINE_BITS) -> Column:
    """Id of a log from its upload and line: no counter is shared between writers, and later uploads sort after earlier ones."""
    wide = F.col("line") >= F.lit(1 << line_bits)
    line = F.when(wide, F.raise_error(F.lit(f"a line number needs more than {line_bits} bits")).cast("bigint")).otherwise(F.col("line"))
    return F.shiftleft(F.col("upload_id").cast("bigint"), line_bits) + line


def _current(store: Snapshot, key: Column, players: DataFrame) -> DataFrame | None:
    """Stored logs of some players."""
    if "logs" not in store.tables:
        return None
    return open_logs(K.touched(players, store.read("logs"), "player_id"), key)


def _score(logs: DataFrame, affected: DataFrame, stats: DataFrame, players: DataFrame, model: M.RiskModel) -> DataFrame:
    return K.score_rows(K.touched(affected, stats, "player_id"), K.all_logs(logs, None), players, model)


def upload(
    store: Snapshot, cells: DataFrame, columns: Sequence[str], players: DataFrame, stats: DataFrame, key: Column, *,
    dry_run: bool = False, model: M.RiskModel = M.DEFAULT_MODEL, line_bits: int = LINE_BITS, buckets: int = 256,
) -> Report:
    """Check text rows, match them with the roster, add them to their players' logs and score those players again.

    ``cells``: ``upload_id``, ``filename``, ``line`` and the text ``columns`` (canonical names); ``stats`` as ``score_rows`` takes
    them. Rows with a wrong cell or without a player are reported and left out. With ``dry_run`` the scores are those
    that a commit would store, and nothing is written. An upload that comes again replaces its rows. If another
    writer changed one of the players meanwhile, ``Conflict`` is raised: take a new snapshot and run again.
    """
    checked = A.match_roster(
        A.validate(cells, columns), players, by_jersey="jersey_number" in columns, by_name="player" in columns)
    checked = written(checked)
    fine = F.size("errors") == 0
    good = checked.where(fine & F.col("matched_id").isNotNull()).drop("player_id").withColumnRenamed("matched_id", "player_id")
    good = good.withColumn("log_id", log_id(line_bits))
    counts = A.upload_quality(checked, ["upload_id", "filename"])
    affected = good.select("player_id")
    repeated = None
    if "logs" in store.tables:
        # rows of the same uploads from an earlier run go, also those of players that are no longer in the file
        repeated = store.read("logs").join(counts.select("upload_id"), "upload_id", "left_semi") if _known(store, counts) else None
    if repeated is not None:
        affected = affected.unionByName(repeated.select("player_id"))
    affected = affected.distinct()
    new = plain_logs(good)
    old = _current(store, key, affected)
    if old is not None:
        old = old.join(counts.select("upload_id"), "upload_id", "left_anti") if repeated is not None else old
    logs = new if old is None else old.unionByName(new)
    scores = _score(logs, affected, stats, players, model)
    if not dry_run:
        store = commit(store, {
            "logs": log_change(logs, key, affected),
            "scores": score_change(scores, key, affected),
            "uploads": Replace(counts.withColumn("created_at", F.current_timestamp()), "upload_id"),
        }, buckets=buckets)
        scores = stored_scores(store, key, K.details_type(scores))  # scored once: the report reads what is stored
    names = players.select("player_id", F.concat_ws(" ", "first_name", "last_name").alias("name"))
    by_line = scores.where("source = 'csv'").select("log_id", "risk_percent", "level", "score_status", M.factors(F.col("contributions")).alias("factors"))
    results = good.select("upload_id", "line", "log_id", "player_id", "log_date").join(names, "player_id", "left").join(by_line, "log_id", "left")
    results = results.withColumns({"level": F.coalesce("level", F.lit("unknown")), "score_status": F.coalesce("score_status", F.lit("no_data"))})
    errors = checked.select("upload_id", "line", F.explode("errors").alias("e")).select("upload_id", "line", "e.column", "e.value", "e.message")
    unmatched = checked.where(fine & F.col("matched_id").isNull()).select("upload_id", "line", F.col("ident").alias("player"))
    return Report(counts, errors, unmatched, results, store)


def _known(store: Snapshot, counts: DataFrame) -> bool:
    """Whether one of these uploads is stored already."""
    return "uploads" in store.tables and not store.read("uploads").join(counts.select("upload_id"), "upload_id", "left_semi").isEmpty()


def withdraw(store: Snapshot, uploads: DataFrame, players: DataFrame, stats: DataFrame, key: Column, *, model: M.RiskModel = M.DEFAULT_MODEL, buckets: int = 256) -> Snapshot:
    """Remove uploads (``upload_id``) with their logs, and score the players they named again, in one commit."""
    gone = uploads.select("upload_id").distinct()
    affected = materialised(store.read("logs").join(gone, "upload_id", "left_semi").select("player_id").distinct())
    logs = _current(store, key, affected).join(gone, "upload_id", "left_anti")
    scores = _score(logs, affected, stats, players, model)
    return commit(store, {
        "logs": log_change(logs, key, affected),
        "scores": score_change(scores, key, affected),
        "uploads": Replace(store.read("uploads").where("false"), "upload_id", gone),
    }, buckets=buckets)


def listing(store: Snapshot) -> DataFrame:
    """Stored uploads, newest first."""
    return store.read("uploads").orderBy(F.desc("upload_id"))


def stored_scores(store: Snapshot, key: Column, details: T.DataType) -> DataFrame:
    return K.unseal(store.read("scores"), key, details)
