"""Metrics defined by the rows of a table: a new row adds a metric without code.

A row holds a scalar SQL formula over the columns of the stat rows, how it aggregates, and what limits it. Spark resolves
the texts, so names and types are checked against the rows before anything runs, and all metrics become plain columns of one
aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.numbers import stable_round, steady_sum

#: One row per metric. ``formula``: scalar expression; ``weight``: denominator of a ratio; ``guard``: condition a row has to meet;
#: ``minimum``: least total weight of a ratio; ``scale``: factor on the result; ``sort_order``: place of the column.
REGISTRY = "metric_key string, aggregation string, formula string, weight string, guard string, scale double, minimum double, decimals int, sort_order int"
#: Metrics of one registry; the table is read on the driver, so its size is checked.
MOST_METRICS = 2000
AGGREGATIONS = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}


class RegistryError(ValueError):
    """Registry rows that can't be compiled; ``problems`` has (metric_key, what is wrong)."""

    def __init__(self, problems: list[tuple[str, str]]):
        super().__init__("; ".join(f"{k}: {p}" for k, p in problems))
        self.problems = problems


def _checked(rows: DataFrame, text: str, wanted: type[T.DataType]) -> str | None:
    """Why ``text`` is no scalar of the wanted type over ``rows`` (None if it is one)."""
    try:
        kind = rows.select(F.expr(text).alias("v")).schema["v"].dataType
        rows.where(F.expr(f"({text}) IS NOT NULL")).schema  # aggregates and windows have no place in a condition
    except (AnalysisException, ParseException) as e:
        return f"{text!r} is not understood ({e.getCondition()})"
    if not isinstance(kind, wanted):
        return f"{text!r} is {kind.simpleString()}, not {'a number' if wanted is T.NumericType else 'a condition'}"
    return None


def problems(registry: Sequence, rows: DataFrame) -> list[tuple[str, str]]:
    """What keeps registry rows from being compiled over ``rows``: repeated keys, unknown rules, names or types."""
    out, seen, later = [], set(rows.columns), rows
    for m in registry:
        key = m["metric_key"]
        if not key:
            out.append(("", "a metric needs a key"))
            continue
        if key in seen and key not in rows.columns:
            out.append((key, "the key is there twice"))
            continue
        derived = m["aggregation"] == "derived"
        if m["aggregation"] not in AGGREGATIONS and m["aggregation"] != "ratio" and not derived:
            out.append((key, f"unknown aggregation {m['aggregation']!r}"))
        texts = [(m["formula"], T.NumericType), (m["weight"], T.NumericType), (m["guard"], T.BooleanType)]
        if not m["formula"] or (m["aggregation"] == "ratio") != bool(m["weight"]) or (derived and m["guard"]):
            out.append((key, "a metric needs a formula, a ratio and nothing else a weight, and a derived metric has no guard"))
        elif not any(p[0] == key for p in out):
            out += [(key, why) for why in (_checked(later if derived else rows, t, kind) for t, kind in texts if t) if why]
        seen.add(key)
        later = later.withColumn(key, F.lit(None).cast("double"))
    return out


def _column(m) -> Column:
    value = F.expr(m["formula"]).cast("double")
    if m["guard"]:
        value = F.when(F.expr(m["guard"]), value)
    if m["aggregation"] != "ratio":
        return AGGREGATIONS[m["aggregation"]](value)
    weight = F.expr(m["weight"]).cast("double")
    both = value.isNotNull() & (weight > 0)
    total = steady_sum(F.when(both, weight))  # a total of exactly the minimum reaches it in any order of the rows
    return F.when(total >= F.lit(m["minimum"] or 0.0), F.sum(F.when(both, value)) / total)


def aggregate(rows: DataFrame, keys: Sequence[str], registry: DataFrame) -> DataFrame:
    """One row per key with a column per metric of ``registry`` (columns as in ``REGISTRY``), nulls skipped, rounded at the end.

    ``derived`` metrics are formulas over the metrics before them in ``sort_order``, before rounding. An empty registry gives the
    keys alone. Raises ``RegistryError`` with all that is wrong with the registry.
    """
    metrics = registry.orderBy("sort_order", "metric_key").limit(MOST_METRICS + 1).collect()
    if len(metrics) > MOST_METRICS:
        raise RegistryError([("", f"more than {MOST_METRICS} metrics")])
    wrong = problems(metrics, rows)
    if wrong:
        raise RegistryError(wrong)
    plain = [m for m in metrics if m["aggregation"] != "derived"]
    scaled = lambda c, m: c * F.lit(m["scale"]) if m["scale"] is not None else c
    out = rows.groupBy(*keys).agg(*[scaled(_column(m), m).alias(m["metric_key"]) for m in plain]) if plain else rows.select(*keys).distinct()
    for m in metrics:
        if m["aggregation"] == "derived":
            out = out.withColumn(m["metric_key"], scaled(F.expr(m["formula"]).cast("double"), m))
    final = [(F.col(m["metric_key"]) if m["decimals"] is None else stable_round(F.col(m["metric_key"]), m["decimals"])).alias(m["metric_key"]) for m in metrics]
    return out.select(*keys, *final)
