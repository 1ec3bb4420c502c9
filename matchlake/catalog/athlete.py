from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators import athlete as A
from .registry import query

COLUMNS = ["player_id", "date", "gps_distance", "heart_rate", "sprints"]

# cells of the text fixture, typed and checked
CHECKED = r"""
c0 AS (SELECT line, upload_id, trim(player_id) AS pid, trim(date) AS dt, trim(gps_distance) AS gd, trim(heart_rate) AS hr, trim(sprints) AS sp FROM fx_csv),
c1 AS (SELECT *, coalesce(try_strptime(dt, '%Y-%m-%d'), try_strptime(dt, '%m/%d/%Y'))::DATE AS log_date,
  try_cast(nullif(gd, '') AS DOUBLE) AS g, try_cast(nullif(hr, '') AS DOUBLE) AS h, try_cast(nullif(sp, '') AS DOUBLE) AS s FROM c0),
errs AS (
  SELECT line, 'date' AS "column", dt AS value, 'date is required' AS message FROM c1 WHERE dt = ''
  UNION ALL SELECT line, 'date', dt, 'invalid date (use YYYY-MM-DD or MM/DD/YYYY)' FROM c1 WHERE dt <> '' AND log_date IS NULL
  UNION ALL SELECT line, 'gps_distance', gd, 'not a number' FROM c1 WHERE gd <> '' AND (g IS NULL OR isnan(g))
  UNION ALL SELECT line, 'gps_distance', gd, 'out of range (0-30 km)' FROM c1 WHERE gd <> '' AND NOT isnan(g) AND NOT g BETWEEN 0 AND 30
  UNION ALL SELECT line, 'heart_rate', hr, 'not a number' FROM c1 WHERE hr <> '' AND (h IS NULL OR isnan(h))
  UNION ALL SELECT line, 'heart_rate', hr, 'out of range (30-230 bpm)' FROM c1 WHERE hr <> '' AND NOT isnan(h) AND NOT h BETWEEN 30 AND 230
  UNION ALL SELECT line, 'sprints', sp, 'not a number' FROM c1 WHERE sp <> '' AND (s IS NULL OR isnan(s))
  UNION ALL SELECT line, 'sprints', sp, 'out of range (0-300)' FROM c1 WHERE sp <> '' AND NOT isnan(s) AND NOT s BETWEEN 0 AND 300
  UNION ALL SELECT line, 'sprints', sp, 'must be a whole number' FROM c1 WHERE sp <> '' AND s BETWEEN 0 AND 300 AND s <> floor(s)),
chk AS (SELECT c1.*, try_cast(pid AS BIGINT) AS player_id, p.player_id AS matched_id, EXISTS (SELECT 1 FROM errs e WHERE e.line = c1.line) AS bad
  FROM c1 LEFT JOIN fx_players p ON p.player_id = try_cast(pid AS BIGINT))"""


def checked(d):
    v = A.validate(d.fx_csv, COLUMNS)
    return A.match_roster(v, d.fx_players)


@query("csv_cell_errors", "P14 A28", "WITH " + CHECKED + "SELECT * FROM errs")
def _(d):
    return A.error_rows(A.validate(d.fx_csv, COLUMNS))


@query("csv_valid_rows", "P14 X21 J7", "WITH " + CHECKED + """
SELECT line, log_date, g AS gps_distance, h AS heart_rate, s AS sprints, matched_id FROM chk WHERE NOT bad AND matched_id IS NOT NULL""")
def _(d):
    c = checked(d).where("size(errors) = 0 and matched_id is not null")
    return c.select("line", "log_date", "gps_distance", "heart_rate", "sprints", "matched_id")


@query("csv_unmatched_rows", "J7", "WITH " + CHECKED + "SELECT line, pid AS player FROM chk WHERE NOT bad AND matched_id IS NULL")
def _(d):
    return checked(d).where("size(errors) = 0 and matched_id is null").select("line", F.col("ident").alias("player"))


@query("csv_upload_quality", "A28", "WITH " + CHECKED + """
SELECT upload_id, count(*) AS rows_total, count(*) FILTER (WHERE NOT bad AND matched_id IS NOT NULL) AS rows_valid, count(*) FILTER (WHERE bad) AS rows_invalid,
  count(*) FILTER (WHERE NOT bad AND matched_id IS NULL) AS rows_unmatched FROM chk GROUP BY upload_id""")
def _(d):
    return A.upload_quality(checked(d), ["upload_id"])


@query("roster_match_cascade", "J7 X22", """
WITH r AS (SELECT line, CASE WHEN line % 3 = 0 THEN try_cast(player_id AS BIGINT) END AS pid, CASE WHEN line % 3 = 1 THEN line % 45 END AS jn,
  concat('last', CAST(line % 700 AS STRING), ' , FIRST', CAST(line % 90 AS STRING)) AS nm FROM fx_csv),
pl AS (SELECT *, CASE WHEN player_id < 1000 THEN jersey + 30 WHEN player_id < 1020 THEN jersey ELSE 100 + player_id END AS jn FROM fx_players),
j AS (SELECT jn, min(player_id) AS id FROM pl GROUP BY jn HAVING count(*) = 1),
n AS (SELECT lower(concat(first_name, ' ', last_name)) AS k, min(player_id) AS id FROM pl GROUP BY 1 HAVING count(*) = 1)
SELECT line, CASE WHEN pid IS NOT NULL THEN pl.player_id ELSE coalesce(j.id, n.id) END AS matched_id
FROM r LEFT JOIN pl ON pl.player_id = r.pid LEFT JOIN j ON j.jn = r.jn
LEFT JOIN n ON n.k = concat('first', CAST(line % 90 AS STRING), ' last', CAST(line % 700 AS STRING))""")
def _(d):
    line = F.col("line")
    rows = d.fx_csv.select(
        "line",
        F.when(line % 3 == 0, F.col("player_id").cast("bigint")).alias("player_id"),
        F.when(line % 3 == 1, line % 45).alias("jersey_number"),
        F.concat(F.lit("last"), (line % 700).cast("string"), F.lit(" , FIRST"), (line % 90).cast("string")).alias("player"),
    )
    p = F.col("player_id")
    pl = d.fx_players.withColumn("jersey", F.when(p < 1000, F.col("jersey") + 30).when(p < 1020, F.col("jersey")).otherwise(100 + p))
    return A.match_roster(rows, pl, by_jersey=True, by_name=True).select("line", "matched_id")


@query("header_aliases", "X20", """
SELECT log_id, CASE log_id % 6 WHEN 0 THEN 'gps_distance' WHEN 1 THEN 'heart_rate' WHEN 2 THEN 'jersey_number' WHEN 3 THEN 'top_speed_kmh' WHEN 4 THEN 'date' END AS canonical FROM fx_logs""")
def _(d):
    k = F.col("log_id") % 6
    text = F.when(k == 0, "Total-Distance (km)").when(k == 1, "Avg. HR").when(k == 2, "Shirt #").when(k == 3, " Top Speed").when(
        k == 4, "Session Date").otherwise("colour")
    text = F.when(k == 2, "Shirt Number").otherwise(text)
    return d.fx_logs.select("log_id", A.canonical_header(text).alias("canonical"))


@query("missing_columns", "U8 X20", """
SELECT log_id, CASE log_id % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'player_id|jersey_number|player' ELSE '' END AS missing FROM fx_logs""")
def _(d):
    k = F.col("log_id") % 3
    present = F.when(k == 0, F.array(F.lit("player"), F.lit("sprints"))).when(k == 1, F.array(F.lit("date"))).otherwise(
        F.array(F.lit("date"), F.lit("jersey_number")))
    return d.fx_logs.select("log_id", F.array_join(A.missing_columns(present), ",").alias("missing"))


@query("date_formats", "X21", "WITH " + CHECKED + "SELECT line, log_date FROM c1")
def _(d):
    return d.fx_csv.select("line", A.parse_date(F.col("date")).alias("log_date"))


@query("name_keys", "X22", """
SELECT player_id, lower(concat(first_name, ' ', last_name)) AS k FROM fx_players""")
def _(d):
    flipped = F.concat(F.lit("  "), F.upper("last_name"), F.lit(" ,  "), F.col("first_name"))
    return d.fx_players.select("player_id", name_key(flipped).alias("k"))


@query("numeric_input_check", "P14", "WITH " + CHECKED + "SELECT line, s AS sprints, bad FROM chk")
def _(d):
    v = A.validate(d.fx_csv, COLUMNS)
    return v.select("line", "sprints", (F.size("errors") > 0).alias("bad"))
