"""Ordered state machines on Structured Streaming.

A walker takes rows of one key in order and returns output tuples; between
micro-batches its state (plain Python values) is kept in the state store. Late
rows, behind what the key has already taken, are not lost: a walker may have an
answer for them, and all others come out whole, as JSON in ``late_row``. A row
with ``closes`` set ends its key: the walker gives out what it still holds.

A micro-batch of one key is sorted in memory; its size is what the source's
``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` lets in.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from bandwatch.operators.walk import names_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedProcessor(StatefulProcessor):
    """Feeds a key's rows to its walker in the order of one column."""

    def __init__(self, make: Callable[[tuple], Any], order: str, names: Sequence[str], stall_ms: int | None):
        self.make, self.order, self.names, self.stall_ms = make, order, list(names), stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "walker", StructType([StructField("seen", LongType()), StructField("state", BinaryType())])
        )

    def _load(self, key: tuple):
        walker, seen = self.make(key), None
        if self.state.exists():
            seen, blob = self.state.get()
            walker.restore(pickle.loads(blob))
        return walker, seen

    def _table(self, key: tuple, rows: list[tuple], late: Sequence[str] = ()) -> pd.DataFrame:
        empty = (None,) * (len(self.names) - len(key) - 1)
        out = [(*key, *r, None) for r in rows] + [(*key, *empty, x) for x in late]
        return pd.DataFrame(out, columns=self.names, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        walker, seen = self._load(key)
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out: list[tuple] = []
        late: list[str] = []
        for row in batch.itertuples(index=False):
            at = int(getattr(row, self.order))
            if seen is not None and at < seen:
                answer = walker.late(row)
                out += answer
                late += [] if answer else [json.dumps(row._asdict(), default=str)]
                continue
            seen = at
            out += walker.flush() if bool(getattr(row, "closes", False)) else walker.row(row)
        if seen is not None:
            self.state.update((seen, pickle.dumps(walker.state())))
        if self.stall_ms is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall_ms)
        yield self._table(key, out, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        walker, seen = self._load(key)
        out = walker.stalled()
        self.state.update((seen, pickle.dumps(walker.state())))
        yield self._table(key, out)

    def close(self) -> None:
        pass


class Walker:
    """Base of the streaming walkers."""

    def row(self, row) -> list[tuple]:
        raise NotImplementedError

    def late(self, row) -> list[tuple]:
        """An answer for a row behind the state; without one the row is quarantined."""
        return []

    def flush(self) -> list[tuple]:
        """What is still held when the key ends."""
        return []

    def stalled(self) -> list[tuple]:
        return []

    def state(self):
        return self.__dict__

    def restore(self, saved) -> None:
        self.__dict__.update(saved)


def walk_stream(
    df: DataFrame,
    keys: dict[str, str],
    order: str,
    make: Callable[[tuple], Any],
    columns: str,
    stall_ms: int | None = None,
) -> DataFrame:
    """Run a walker per key over a stream; ``keys`` gives key columns and their types."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + f", {columns}, late_row string"
    processor = OrderedProcessor(make, order, names_of(schema), stall_ms)
    mode = "ProcessingTime" if stall_ms is not None else "None"
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", mode)
