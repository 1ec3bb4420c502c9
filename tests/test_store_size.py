"""What is stored is small, and a store is never there twice."""

from conftest import rows
from pyspark.sql import functions as F

from matchlake.functions import secrets as S
from matchlake.sources import sinks

WORDS = '{"feature":"speed","imputed":true,"value":1.5}'


def test_a_packed_text_is_short_and_comes_back_whole(spark):
    key, wrong = (F.unhex(F.sha2(F.lit(k), 256)) for k in "kw")
    texts = ['{"feature":"speed","imputed":true,"value":2.25}', "{}", "ä" * 5000, None]
    kept = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    kept = kept.select("i", S.encrypt_packed(F.col("t"), key, WORDS).alias("e"), S.encrypt(F.col("t"), key).alias("plain"))
    back = kept.select("i", *[S.decrypt_packed(F.col(c), key, WORDS).alias(c) for c in ("e", "plain")], S.decrypt_packed(F.col("e"), wrong, WORDS).alias("w"))
    assert rows(back, "i", "e", "plain") == [(i, t, t) for i, t in enumerate(texts)]  # also what was stored before
    assert {r["w"] for r in back.collect()} == {None}
    short, plain = kept.where("i = 0").select(F.length("e"), F.length("plain")).first()
    assert short < plain - 24


def test_old_rows_of_few_buckets_at_a_time_lie_beside_the_new_ones(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    path = str(tmp_path / "p")
    everyone = spark.createDataFrame([(i, i) for i in range(200)], "player_id bigint, v bigint")
    sinks.upsert_by_player(everyone, path, everyone, buckets=16)
    beside = []

    def seen(self, where, *args, f=DataFrameWriter.parquet, **kw):
        f(self, where, *args, **kw)
        if "/_staged" in where:
            beside.append(len({p.parent for p in (tmp_path / "p").glob("_staged-*/kept*/*/*.parquet")}))

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    few = everyone.where("player_id < 40").withColumn("v", F.lit(-1).cast("bigint"))
    sinks.upsert_by_player(few, path, everyone.where("player_id < 41"), buckets=16)
    assert rows(spark.read.parquet(path), "player_id", "v") == sorted([(i, -1) for i in range(40)] + [(i, i) for i in range(41, 200)])
    assert 0 < max(beside) <= 2
    assert {p.name.split("=")[0] for p in (tmp_path / "p").iterdir()} == {"player_bucket"}


def test_a_snapshot_is_stored_without_the_spare_bits_of_base64(spark, tmp_path):
    from matchlake.sources.snapshots import Replace, commit, snapshot

    rows_ = spark.range(2000).select(F.col("id").alias("player_id"), F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 512))).alias("t"))
    store = commit(snapshot(spark, str(tmp_path)), {"t": Replace(rows_, "player_id")}, buckets=1)
    assert store.read("t").count() == 2000
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert size < 2000 * (88 * 0.85 + 8)  # 88 characters for 64 bytes
