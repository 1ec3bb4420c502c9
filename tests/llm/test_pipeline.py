import pytest

import corpus_pipeline as C
from matchlake.llm import queries, oracle_sql
from tests.llm.helpers import DOCS, awkward, empty, prose

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_hand_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for n, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF).cache()
        if n < len(C.STAGES) - 1:
            assert out.columns == C.COLUMNS and out.dtypes == docs.select(*C.COLUMNS).dtypes
            assert 0 < out.count() <= docs.count()
            docs = out
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_filters_keep_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r[0] for r in labels.where("quality = 1").select("doc_id").collect()}
    kept = {r[0] for r in C.quality_stage(spark, docs, SF).select("doc_id").collect()}
    assert len(good & kept) >= 0.97 * len(good)
    assert C.language_stage(spark, docs, SF).count() >= 0.97 * docs.count()


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d", "en", "s", 1), (1, "a b c d", "en", "s", 1), (1, "a b c d", "en", "s", 1), (2, prose(1, 50), None, "s", 1), (None, prose(1, 50), "en", "s", 1), (None, prose(2, 50), "en", "s", 1)]
    kept = [tuple(r) for r in C.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), SF).collect()]
    assert sorted(kept, key=str) == sorted([rows[1], rows[3], rows[5]], key=str)


def test_awkward_and_empty_tables_pass_every_stage(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in C.STAGES:
            stage(spark, docs, SF).collect()


def test_run_returns_pieces(spark):
    got = C.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() == got.select("sequence_id").distinct().count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF)
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert set(names) == set(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 14)}
