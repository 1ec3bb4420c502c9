from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Data, oracle_with_fixtures


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Data], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Data(spark, sf_dir))

    @property
    def oracle_sql(self) -> str | None:
        return None if self.oracle is None else oracle_with_fixtures(self.oracle)


def rnd(expr: str, digits: int) -> str:
    """Oracle text for ``stable_round``: half-up rounding in decimals, so that ties do not depend on binary fractions."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28, 9)), {digits}) AS DOUBLE)"


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None):
    """Register ``build(data) -> DataFrame`` under ``name``; ``covers`` lists the operator ids it exercises."""

    def register(build: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, tuple(covers.split()), build, oracle)
        return build

    return register
