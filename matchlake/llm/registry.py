"""Queries of this subpackage: name -> callable(spark, sf_dir), and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def llm_query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
