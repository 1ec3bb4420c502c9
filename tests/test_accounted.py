"""Late rows are kept: on time and late together are the input, over batches out of order."""

import datetime as dt

from conftest import rows

from matchlake.streaming import accounted as A

SCHEMA = "user_id bigint, ts timestamp, value double"
DAY = dt.datetime(2026, 1, 1)


def test_on_time_and_late_rows_are_the_input(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    at = lambda h: DAY + dt.timedelta(hours=h)
    batches = [
        [(1, at(1), 1.0), (1, at(13), 2.0), (2, at(13), 4.0)],
        [(1, at(2), 8.0), (1, at(12.5), 16.0), (2, at(30), 32.0), (None, at(14), 1.0)],  # the first is late
        [(1, at(13), 64.0), (2, at(31), 128.0), (3, None, 5.0)],  # late, on time, without a time
    ]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(source)
        A.account(spark.readStream.schema(SCHEMA).parquet(source), out, log, ["user_id"], "6 hours").awaitTermination()
    marks = A.marks(spark, out)
    assert rows(marks, "batch", "rows", "late_rows") == [(0, 3, 0), (1, 4, 1), (2, 3, 2)]
    assert [r["watermark"] for r in marks.orderBy("batch").collect()] == [None, at(13) - dt.timedelta(minutes=10), at(30) - dt.timedelta(minutes=10)]
    assert {(r["user_id"], r["value"]) for r in A.late_rows(spark, out, SCHEMA).collect()} == {(1, 8.0), (1, 64.0), (3, 5.0)}
    got = {(r["user_id"], r["window_start"]): (r["samples"], r["load"]) for r in A.windows(spark, out, "user_id bigint").collect()}
    assert got == {(1, at(0)): (1, 1.0), (1, at(12)): (2, 18.0), (2, at(12)): (1, 4.0), (2, at(30)): (2, 160.0), (None, at(12)): (1, 1.0)}
    assert sum(n for n, in rows(A.windows(spark, out, "user_id bigint"), "samples")) + A.late_rows(spark, out, SCHEMA).count() == 10


def test_nothing_has_run(spark, tmp_path):
    assert A.marks(spark, str(tmp_path / "no")).count() == A.late_rows(spark, str(tmp_path / "no"), SCHEMA).count() == 0
