"""Keyed state for streams on ``transformWithStateInPandas``: rows in order, typed state, timers, and eviction.

A processor sees the rows of a key in order of one column, a chunk at a time. What of a micro-batch fits one Arrow batch is
sorted there; more is spooled to map state, keyed by the order column, and read back in sorted chunks, so memory holds the
order values of one key and one chunk of rows, never all of its rows.

A stream with an event time also has timers: a key whose rows end is silent once the watermark has passed its last row by
``silence_ms``, and may then emit rows without any input; ``keep_ms`` later its state is evicted. Without an event time state
stays, as nothing tells the end of a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHUNK_ROWS = 10_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedProcessor(StatefulProcessor):
    """Base of the processors: subclasses say what a row and the state are, and how rows move the state on.

    ``advance`` gets the key, the state (None at first) and a sorted chunk, and returns output rows and the new state;
    ``silent`` gets the key and the state when the timer fires.
    """

    order: str
    row_columns: dict[str, str]
    state_schema: str

    def __init__(self, time_column: str | None = None, silence_ms: int = 0, keep_ms: int = 3_600_000):
        self.time_column, self.silence_ms, self.keep_ms = time_column, silence_ms, keep_ms

    def advance(self, key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def silent(self, key: tuple, state: tuple) -> tuple[pd.DataFrame, tuple]:
        return pd.DataFrame(), state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns = [*self.row_columns, *([self.time_column] if self.time_column else [])]
        kinds = [*self.row_columns.values(), *(["timestamp"] if self.time_column else [])]
        self.value = handle.getValueState("state", f"told boolean, {self.state_schema}")
        self.spool = handle.getMapState("spool", "at bigint, n bigint", ", ".join(f"{n} {t}" for n, t in zip(self.columns, kinds)))

    def _chunks(self, rows: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = self.columns
        parts = iter(rows)
        first, second = next(parts, None), next(parts, None)
        if second is None:
            if first is not None:
                yield first[columns].sort_values(self.order, kind="stable", ignore_index=True)
            return
        places, n = [], 0
        for part in (p for group in ((first, second), parts) for p in group):
            for row in part[columns].itertuples(index=False, name=None):
                places.append((int(row[0]), n))
                self.spool.updateValue(places[-1], row)
                n += 1
        places.sort()
        for at in range(0, n, CHUNK_ROWS):
            now = places[at : at + CHUNK_ROWS]
            yield pd.DataFrame([tuple(self.spool.getValue(p)) for p in now], columns=columns)
            for p in now:
                self.spool.removeKey(p)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        state = tuple(self.value.get())[1:] if self.value.exists() else None
        latest = None
        for chunk in self._chunks(rows):
            if self.time_column:
                now = int(chunk[self.time_column].max().timestamp() * 1000)
                latest = now if latest is None else max(latest, now)
            out, state = self.advance(key, state, chunk[list(self.row_columns)])
            if len(out):
                yield out
        if state is not None:
            self.value.update((False, *state))
            if latest is not None:
                self._arm(latest + self.silence_ms)

    def _arm(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.value.exists():
            return
        told, *state = self.value.get()
        if told:
            self.value.clear()
            return
        out, state = self.silent(key, tuple(state))
        self.value.update((True, *state))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
        if len(out):
            yield out

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, keys: Sequence[str], processor: OrderedProcessor, schema: str, mode: str = "append") -> DataFrame:
    """``processor`` over the rows of each key; with an event time ``stream`` needs a watermark on it. The state lies in RocksDB on local disk, its change log in the checkpoint."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = processor.time_column is not None
    columns = dict.fromkeys([*keys, *processor.row_columns, *([processor.time_column] if timed else [])])
    return stream.select(*columns).groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "EventTime" if timed else "None")
