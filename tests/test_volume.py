"""Stored rows are written once, ciphertext is not shuffled, and rows of ordinary keys are ordered after one shuffle."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.classic.dataframe import DataFrame as Classic

from matchlake.operators import risk as K
from matchlake.plans.blocked import crowded
from matchlake.sources import sinks

SCHEMA = "player_id bigint, v bigint"


@pytest.fixture
def no_checkpoint(monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a second copy of the rows")

    monkeypatch.setattr(Classic, "checkpoint", refused)


SHAPED = []


def dealt_first(df: DataFrame) -> DataFrame:
    SHAPED.append("REBALANCE" in df._jdf.queryExecution().analyzed().toString().upper())
    return df.select("player_id", *[c for c in K.BUCKETS if c in df.columns], F.concat(F.lit("x"), "v").alias("v"))


def test_rows_of_a_store_are_written_once(spark, tmp_path, no_checkpoint):
    path = str(tmp_path / "p")
    SHAPED.clear()
    everyone = spark.createDataFrame([(i, i) for i in range(20)], SCHEMA)
    for _ in range(2):
        sinks.upsert_by_player(everyone, path, everyone, buckets=3, shape=dealt_first)
    sinks.upsert_by_player(spark.createDataFrame([(4, 40)], SCHEMA), path, spark.createDataFrame([(4,), (7,)], "player_id bigint"), buckets=3, shape=dealt_first)
    want = sorted([(i, f"x{i}") for i in range(20) if i not in (4, 7)] + [(4, "x40")])
    assert rows(spark.read.parquet(path), "player_id", "v") == want
    assert {p.name.split("=")[0] for p in (tmp_path / "p").iterdir()} == {"player_bucket"}  # nothing staged is left
    sinks.upsert_by_player(everyone.limit(0), path, everyone, buckets=3, shape=dealt_first)
    assert list((tmp_path / "p").iterdir()) == [] and SHAPED.count(True) == 4


def history(spark, per_key):
    day = dt.date(2020, 1, 1)
    data = [(k, day + dt.timedelta(days=i // 3), i, None if i % 7 == 3 else float((i * 5 + k) % 11)) for k, n in per_key.items() for i in range(n)]
    return spark.createDataFrame(data, "player_id bigint, score_date date, log_id bigint, load double")


def test_ordinary_keys_are_ordered_after_one_shuffle(spark):
    df = history(spark, {1: 40, 2: 25, 3: 1})
    got = K.rolling_ratio(df, ["player_id"], ["score_date", "log_id"], "load")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    cols = ["player_id", "log_id", "acwr"]
    key = lambda r: tuple(r)[:2]
    take = lambda x: sorted(map(tuple, x.select(*cols).collect()), key=key)
    assert take(got) == take(K.rolling_ratio(df, ["player_id"], ["score_date", "log_id"], "load", split=True))


def test_a_key_with_many_rows_is_spread(spark):
    df = history(spark, {1: 5000, 2: 10})
    assert crowded(df, ["player_id"]) and not crowded(df.where("player_id = 2"), ["player_id"])
    cols = ["player_id", "log_id", "acwr"]
    take = lambda x: sorted(map(tuple, x.select(*cols).collect()), key=lambda r: r[:2])
    got = K.rolling_ratio(df, ["player_id"], ["score_date", "log_id"], "load")
    assert "blk" in got._jdf.queryExecution().optimizedPlan().toString()
    assert take(got) == take(K.rolling_ratio(df, ["player_id"], ["score_date", "log_id"], "load", split=False))
