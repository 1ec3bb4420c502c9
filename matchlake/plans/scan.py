"""Sequential state machines over ordered rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def ordered_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str
) -> DataFrame:
    """Feed the rows of each key, in order, to a stateful step function.

    Only for recurrences where each row needs the state left by the row before (a filter with a gate, an occlusion
    timer). Rows of a key are streamed in Arrow batches: a task keeps one state, never a whole key, in memory.
    ``make()`` builds a fresh state per key; it returns a function from a batch of rows to output rows.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for batch in batches:
            # rows are sorted by key, so equal keys are adjacent
            change = (batch[keys] != batch[keys].shift()).any(axis=1).cumsum()
            for _, part in batch.groupby(change, sort=False):
                key = tuple(part[keys].iloc[0])
                if key != current:
                    current, step = key, make()
                out = step(part)
                if len(out):
                    yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
