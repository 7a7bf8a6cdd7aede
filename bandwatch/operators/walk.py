"""Walking sorted groups as a stream, inside Spark partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

Walker = Callable[[Any], list[tuple]]


def walk_groups(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    start: Callable[[tuple], Any],
    schema: str,
    names: Sequence[str],
) -> DataFrame:
    """Feed each group's rows, in order, to a walker made by ``start(key)``.

    A walker has ``row(row) -> list of output tuples`` and ``close() -> list``.
    Spark brings each group together and sorts it; batches of many small groups
    pass through one function call, and a large group is never held in memory.
    """
    keys = list(group)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, walker = None, None
        for batch in batches:
            out: list[tuple] = []
            places = [batch.columns.get_loc(k) for k in keys]
            for row in batch.itertuples(index=False):
                key = tuple(row[p] for p in places)
                if key != current:
                    if walker is not None:
                        out += walker.close()
                    current, walker = key, start(key)
                out += walker.row(row)
            yield pd.DataFrame(out, columns=list(names))
        if walker is not None:
            yield pd.DataFrame(walker.close(), columns=list(names))

    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(walk, schema)


def typed(rows: DataFrame, columns: Sequence[str]) -> str:
    """DDL of some columns of ``rows``."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def names_of(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]
