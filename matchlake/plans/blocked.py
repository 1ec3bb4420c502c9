"""Ordered scans that never put a whole key in one task.

A window over ``partitionBy(key)`` sorts every row of the key in one task, so a key that holds a third of the table
stalls the job. The helpers here cut each key into blocks along its order:

* ``with_position`` numbers rows per key from block counts (partial aggregation) plus a row number inside the block;
* ``with_halo`` copies the few rows next to a block border into the neighbouring block, so any window whose row frame
  is bounded gives the same values as the window over the whole key;
* ``running`` is the prefix aggregate built the same way.

Only the block table (one row per key and block) is ever windowed by the key alone.

The blocked plan suits keys of any size. ``split=False`` is the plain window over whole keys, which gives the same rows with
fewer shuffles; the tests compare the two. It suits inputs whose keys are bounded, by construction or because ``crowded``
has counted them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK_ROWS = 4096


def _key(keys: Sequence[str]) -> Column:
    """The keys as one value: structs with null fields are equal, so null keys are keys like any other, and window and join share a shuffle."""
    return F.struct(*keys)


def crowded(df: DataFrame, keys: Sequence[str], rows: int = BLOCK_ROWS) -> bool:
    """Whether any key has more than ``rows`` rows, so that a window over whole keys would load one task."""
    return not df.groupBy(_key(keys).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows).isEmpty()


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column,
    out: str = "pos",
    total: str | None = None,
    split: bool = True,
) -> DataFrame:
    """Add the 0-based position of each row in its key, and the number of rows of the key as ``total``.

    ``block`` must be non-null and must never decrease along ``order``.
    """
    keys = list(keys)
    by_key = W.partitionBy(*keys)
    if not split:
        rows = df.withColumn(out, F.row_number().over(by_key.orderBy(*order)).cast("bigint") - 1)
        return rows.withColumn(total, F.count(F.lit(1)).over(by_key)) if total else rows
    src = df.withColumns({"__key": _key(keys), "__blk": block})
    before = W.partitionBy("__key").orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)
    blocks = src.groupBy("__key", "__blk").agg(F.count(F.lit(1)).alias("__n"))
    cols = ["__key", "__blk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")]
    if total:
        cols.append(F.sum("__n").over(W.partitionBy("__key")).alias(total))
    local = F.row_number().over(W.partitionBy("__key", "__blk").orderBy(*order)) - 1
    numbered = src.withColumn("__local", local).join(blocks.select(*cols), ["__key", "__blk"])
    return numbered.withColumn(out, F.col("__start") + F.col("__local")).drop("__key", "__blk", "__local", "__start")


_RUNNING = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    split: bool = True,
) -> DataFrame:
    """Prefix aggregates per key along ``order``; ``inclusive=False`` leaves the row itself out.

    ``values`` maps an output name to ``("sum" | "max" | "min", expression)``.
    """
    keys = list(keys)
    if not split:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        plain = {c: _RUNNING[how](v).over(w) for c, (how, v) in values.items()}
        return df.withColumns({c: F.coalesce(e, F.lit(0)) if values[c][0] == "sum" else e for c, e in plain.items()})
    src = df.withColumns({"__key": _key(keys), "__blk": block, **{f"__v_{c}": v for c, (_, v) in values.items()}})
    before = W.partitionBy("__key").orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)
    blocks = src.groupBy("__key", "__blk").agg(*[_RUNNING[how](f"__v_{c}").alias(f"__t_{c}") for c, (how, _) in values.items()])
    blocks = blocks.select("__key", "__blk", *[_RUNNING[how](f"__t_{c}").over(before).alias(f"__b_{c}") for c, (how, _) in values.items()])
    inside = W.partitionBy("__key", "__blk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = src.withColumns({f"__l_{c}": _RUNNING[how](f"__v_{c}").over(inside) for c, (how, _) in values.items()})
    out = local.join(blocks, ["__key", "__blk"])

    def merged(c, how):
        b, l = F.col(f"__b_{c}"), F.col(f"__l_{c}")  # noqa: E741
        if how == "sum":
            return F.coalesce(b, F.lit(0)) + F.coalesce(l, F.lit(0))
        return F.greatest(b, l) if how == "max" else F.least(b, l)

    out = out.withColumns({c: merged(c, how) for c, (how, _) in values.items()})
    return out.drop("__key", "__blk", *[f"__{p}_{c}" for c in values for p in "vlb"])


def asof_before(
    queries: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, fact_at: str, out: str, block_size: int = BLOCK_ROWS,
    split: bool = True,
) -> DataFrame:
    """Add to each query row the greatest ``fact_at`` strictly below ``at`` within its key (null if none).

    Both sides are merged into one ordered stream, so no pair of query and fact is ever built.
    """
    keys = list(keys)
    cols = [c for c in queries.columns if c not in keys]
    packed = queries.select(*keys, F.col(at).cast("bigint").alias("__at"), F.lit(0).alias("__fact"), F.struct(*cols).alias("__row"))
    empty = F.lit(None).cast(packed.schema["__row"].dataType)
    known = facts.select(*keys, F.col(fact_at).cast("bigint").alias("__at"), F.lit(1).alias("__fact"), empty.alias("__row")).distinct()
    merged = packed.unionByName(known)
    merged = running(
        merged, keys, [F.asc("__at"), F.asc("__fact")], F.floor(F.col("__at") / F.lit(block_size)),
        {out: ("max", F.when(F.col("__fact") == 1, F.col("__at")))}, split=split,
    )
    return merged.where("__fact = 0").select(*keys, "__row.*", out)


def with_halo(
    df: DataFrame,
    pos: str,
    before: int,
    after: int,
    block_rows: int = BLOCK_ROWS,
    block: str = "blk",
    owner: str = "is_owner",
    split: bool = True,
) -> DataFrame:
    """Copy border rows so that block ``b`` holds positions ``b*B - before .. (b+1)*B - 1 + after``.

    Windows over ``(keys, block)`` with frames inside ``-before .. after`` are exact for the rows where ``owner`` is
    true; drop the other rows afterwards. Row growth is ``(before + after) / block_rows``.
    """
    if not split:
        return df.withColumns({block: F.lit(0).cast("bigint"), owner: F.lit(True)})
    if max(before, after) >= block_rows:
        raise ValueError("the halo must be smaller than a block")
    p = F.col(pos)
    lo = F.greatest(F.floor((p - after) / F.lit(block_rows)), F.lit(0))
    hi = F.floor((p + before) / F.lit(block_rows))
    return df.withColumn(block, F.explode(F.sequence(lo, hi))).withColumn(
        owner, F.col(block) == F.floor(p / F.lit(block_rows))
    )


def pos_block(pos: str = "pos", block_rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(pos) / F.lit(block_rows))
