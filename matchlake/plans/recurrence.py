"""Linear recurrences over ordered rows as an associative scan, in expressions only.

``s[t] = a[t] * s[t-1] + b[t]`` is one linear map per row, and maps compose: (a, b) then (a', b') is (a' * a, a' * b + b').
Rows of a key are cut into blocks of ``BLOCK`` positions. Inside a block the composed map up to each row is a window of at
most ``BLOCK`` rows; the composed maps of whole blocks are a recurrence over blocks, solved the same way on a table
``BLOCK`` times smaller; what comes out is the state at the start of each block. So a single long series is spread over as
many tasks as it has blocks, and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Products of this many factors and their inverses stay in range for factors between 1e-4 and 1e4.
BLOCK = 64


def linear_recurrence(df: DataFrame, keys: Sequence[str], pos: str, factor: Column, terms: dict[str, Column], *, block: int = BLOCK) -> DataFrame:
    """Add the states of ``terms`` (output name to b[t]) with ``factor`` a[t], over positions ``pos`` = 0, 1, 2 ... of each key.

    The state before position 0 is zero, so the first row's term is its state. Factors must not be zero; null factors and
    terms count as not a number, which stays in the state from there on, as it would in a loop.
    """
    keys = list(keys)
    nan = F.lit(float("nan"))
    names = list(terms)
    rows = df.withColumns({"__a": F.coalesce(F.when(F.col(pos) == 0, F.lit(1.0)).otherwise(factor), nan), **{f"__b{i}": F.coalesce(terms[n], nan) for i, n in enumerate(names)}})
    rows = rows.withColumn("__key", F.struct(*keys))  # null keys are keys like any other
    return _scan(rows, pos, names, rows.agg(F.max(pos)).first()[0] or 0, block, 0).drop("__key", "__a", *[f"__b{i}" for i in range(len(names))])


def _scan(rows: DataFrame, pos: str, names: list[str], last: int, block: int, level: int) -> DataFrame:
    blk = f"__blk{level}"
    rows = rows.withColumn(blk, F.floor(F.col(pos) / F.lit(block)))
    upto = W.partitionBy("__key", blk).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    # the map up to a row: factor a = product of factors, term a * sum(b / product of factors up to b)
    rows = rows.withColumn("__p", F.product("__a").over(upto))
    rows = rows.withColumns({f"__t{i}": F.col("__p") * F.sum(F.col(f"__b{i}") / F.col("__p")).over(upto) for i in range(len(names))})
    if last < block:
        return rows.withColumns({n: F.col(f"__t{i}") for i, n in enumerate(names)}).drop(blk, "__p", *[f"__t{i}" for i in range(len(names))])
    ends = rows.groupBy("__key", blk).agg(F.max_by("__p", pos).alias("__a"), *[F.max_by(f"__t{i}", pos).alias(f"__b{i}") for i in range(len(names))])
    before = [f"__s{level}_{i}" for i in range(len(names))]
    states = _scan(ends, blk, before, last // block, block, level + 1)
    # the state at a block's start is the one at the end of the block before
    starts = states.select(F.col("__key"), (F.col(blk) + 1).alias(blk), *before)
    whole = rows.join(starts, ["__key", blk], "left")
    out = {n: F.when(F.col(blk) == 0, F.col(f"__t{i}")).otherwise(F.col("__p") * F.col(before[i]) + F.col(f"__t{i}")) for i, n in enumerate(names)}
    return whole.withColumns(out).drop(blk, "__p", *before, *[f"__t{i}" for i in range(len(names))])
