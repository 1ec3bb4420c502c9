from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import uploads as U
from ..sources.sinks import scratch_path
from ..sources.snapshots import commit, snapshot
from .athlete import CHECKED, COLUMNS
from .registry import query
from .risk import ALLROWS, stat_rows

FIRST, BITS = 1000, 40  # new uploads come after the stored ones; the fixture's line numbers grow with the data

UPLOADED = "WITH " + CHECKED.lstrip("\n") + f""",
good AS (SELECT (({FIRST} + upload_id) << {BITS}) + line AS log_id, {FIRST} + upload_id AS upload_id, line, matched_id AS player_id, log_date, g, h, s FROM chk WHERE NOT bad AND matched_id IS NOT NULL),
up_logs AS (SELECT log_id, player_id, log_date, gps_distance_km, minutes_played, sprints, top_speed_kmh, heart_rate, heart_rate_max FROM fx_logs
  UNION ALL SELECT log_id, player_id, log_date, g, NULL, s, NULL, h, NULL FROM good),""" + ALLROWS.replace("fx_logs", "up_logs")


def uploaded(d, dry_run=False):
    """All text rows uploaded to a store that holds the logs so far."""
    key = F.unhex(F.sha2(F.lit("matchlake sample key"), 256))
    empty = snapshot(d.spark, scratch_path(d.spark, "uploads"))
    store = commit(empty, {"logs": U.log_change(d.fx_logs.withColumn("line", F.col("log_id")), key)}, buckets=16)
    cells = d.fx_csv.withColumn("upload_id", F.col("upload_id") + FIRST).withColumn("filename", F.concat(F.lit("upload-"), F.col("upload_id").cast("string"), F.lit(".csv")))
    return U.upload(store, cells, COLUMNS, d.fx_players, stat_rows(d), key, dry_run=dry_run, line_bits=BITS, buckets=16), key


@query("upload_commit", "M12 S5 S13 M9", UPLOADED + """
SELECT player_id, source, stat_id, log_id, score_date, score_status, risk_percent, level FROM ar WHERE player_id IN (SELECT player_id FROM good)""")
def _(d):
    report, key = uploaded(d)
    # what a reader of the new snapshot sees
    rows = U.stored_scores(snapshot(d.spark, report.store.root), key, "struct<display: string>")
    return rows.select("player_id", "source", "stat_id", "log_id", "score_date", "score_status", "risk_percent", "level")


@query("upload_preview", "M12 U1", UPLOADED + """
SELECT good.upload_id, line, good.player_id, concat(first_name, ' ', last_name) AS name, log_date, risk_percent, level, score_status
FROM good JOIN fx_players p ON p.player_id = good.player_id JOIN ar ON ar.log_id = good.log_id""")
def _(d):
    return uploaded(d, dry_run=True)[0].results.select("upload_id", "line", "player_id", "name", "log_date", "risk_percent", "level", "score_status")


@query("upload_listing", "K6 A28", "WITH " + CHECKED + f"""
SELECT {FIRST} + upload_id AS upload_id, concat('upload-', CAST({FIRST} + upload_id AS STRING), '.csv') AS filename, count(*) FILTER (WHERE NOT bad AND matched_id IS NOT NULL) AS rows_valid,
  count(*) FILTER (WHERE bad) AS rows_invalid FROM chk GROUP BY upload_id""")
def _(d):
    return U.listing(uploaded(d)[0].store).select("upload_id", "filename", "rows_valid", "rows_invalid")
