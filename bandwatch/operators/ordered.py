"""Ordered scans over long sessions, in parallel pieces.

A window over a whole session would put that session in one task, however long
it is. Here each session is cut into time chunks: windows run per chunk, and
the value a chunk needs from earlier chunks is carried in from a table with one
row per chunk. Results equal the plain window for every chunk length.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_US = 60_000_000
CHUNK = "_chunk"


def chunked(df: DataFrame, time: str, chunk_us: int = CHUNK_US) -> DataFrame:
    return df.withColumn(CHUNK, F.expr(f"{time} div {chunk_us}L"))


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add the preceding row's ``value`` (never NULL itself) within ``keys``.

    ``df`` must carry the chunk column; the order columns must rise with it.
    """
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    last = df.groupBy(*keys, CHUNK).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carry = last.select(
        *keys, CHUNK, F.last("_last", ignorenulls=True).over(_before(keys)).alias("_carried")
    )
    return (
        df.withColumn(out, F.lag(value).over(window))
        .join(carry, [*keys, CHUNK], "left")
        .withColumn(out, F.coalesce(out, "_carried"))
        .drop("_carried")
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Add running maxima over all rows up to (or strictly before) each row."""
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    window = window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    tops = df.groupBy(*keys, CHUNK).agg(*[F.max(v).alias(f"_top_{n}") for n, v in values.items()])
    carry = tops.select(
        *keys, CHUNK, *[F.max(f"_top_{n}").over(_before(keys)).alias(f"_carried_{n}") for n in values]
    )
    local = df.select("*", *[F.max(v).over(window).alias(n) for n, v in values.items()])
    joined = local.join(carry, [*keys, CHUNK], "left")
    for n in values:
        joined = joined.withColumn(n, F.greatest(n, f"_carried_{n}")).drop(f"_carried_{n}")
    return joined


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add the running sum of ``value`` up to and including each row."""
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_sum"))
    carry = sums.select(*keys, CHUNK, F.sum("_sum").over(_before(keys)).alias("_carried"))
    return (
        df.withColumn(out, F.sum(value).over(window))
        .join(carry, [*keys, CHUNK], "left")
        .withColumn(out, F.col(out) + F.coalesce("_carried", F.lit(0)))
        .drop("_carried")
    )


def group_start(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, mark: Column, out: str):
    """Label rows with the ``mark`` of the latest row that starts a group.

    ``mark`` must rise with the order, so the label is a running maximum.
    """
    return running_max(df, keys, order, {out: F.when(starts, mark)})


def greedy_starts(
    df: DataFrame, keys: Sequence[str], time: str, begin: str, test: str, limit: Column, out: str, chunk_us: int = CHUNK_US
) -> DataFrame:
    """Label rows with the ``begin`` of their segment, cut greedily: a segment ends before the first row
    whose ``test`` exceeds the segment's own ``begin`` by more than ``limit``.

    ``begin`` and ``test`` (whole numbers) must not fall within ``keys``, in the order of ``time``; ``limit``
    is one for all rows of a key. Where a segment ends depends on where it began, so cuts cannot be found row
    by row. But a chunk is a function of the segment that reaches into it: every row knows its next
    cut by search, hence the segment that is open at the chunk's end if one began at that row.
    These functions (a row per chunk, entries up to ``limit`` behind the chunk's begin) are applied one after
    the other; then each chunk is cut on its own. Rows of a chunk are held in memory, sessions are not.
    Keys that are no longer than the limit as a whole are one segment and take none of these steps.
    """
    whole = df.groupBy(*keys).agg(F.min(begin).alias("_first"), F.max(test).alias("_most"))
    placed = df.join(whole, [*keys]).withColumn("_limit", limit.cast("bigint"))
    one = F.col("_most") - F.col("_first") <= F.col("_limit")
    short = placed.where(one).withColumn(out, F.col("_first").cast("bigint")).select(*df.columns, out)
    return short.unionByName(_greedy_chunks(placed.where(~one).select(*df.columns, "_limit"), keys, time, begin, test, out, chunk_us))


def _greedy_chunks(df: DataFrame, keys: Sequence[str], time: str, begin: str, test: str, out: str, chunk_us: int) -> DataFrame:
    groups = [*keys, CHUNK]
    together = [keys[0], CHUNK]  # short keys are many: those of a chunk are handed over as one group
    rows = chunked(df, time, chunk_us)
    narrow = rows.select(*groups, F.col(begin).alias("_begin"), F.col(test).alias("_test"), "_limit")
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    named = ", ".join(f"{k} {kinds[k]}" for k in groups)

    def parts(table: pa.Table):
        """The sorted rows of a chunk, and of each key in it: where they begin, begins, tests, limit."""
        table = table.sort_by([*((k, "ascending") for k in keys), ("_begin", "ascending"), ("_test", "ascending")])
        fresh = np.zeros(table.num_rows, bool)
        fresh[:1] = True
        for k in keys[1:]:
            codes = pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices.to_numpy()
            fresh[1:] |= codes[1:] != codes[:-1]
        edges = [*np.flatnonzero(fresh).tolist(), table.num_rows]
        begins, tests, limits = (table[c].to_numpy() for c in ("_begin", "_test", "_limit"))
        return table, [(a, begins[a:b], tests[a:b], int(limits[a])) for a, b in zip(edges, edges[1:])]

    def following(begins, tests, limit):
        return np.maximum(np.arange(len(begins)) + 1, np.searchsorted(tests, begins + limit, "right"))

    def function(table: pa.Table) -> pa.Table:
        table, each = parts(table)
        entry, opened = [], []
        for _, begins, tests, limit in each:
            after, open_ = following(begins, tests, limit), begins.copy()
            for i in range(len(begins) - 1, -1, -1):
                if after[i] < len(begins):
                    open_[i] = open_[after[i]]
            entries = min(len(begins), int(np.searchsorted(tests, begins[0] + limit, "right")) + 1)
            entry.append(tests[:entries].tolist())
            opened.append(open_[:entries].tolist())
        first = table.take(pa.array([a for a, *_ in each]))
        kind = pa.list_(pa.int64())
        return pa.table({**{k: first[k] for k in groups}, "entry": pa.array(entry, kind), "open": pa.array(opened, kind), "_limit": first["_limit"]})

    # Keys within one chunk have nothing to carry; only the others become functions.
    several = rows.groupBy(*keys).agg((F.min(CHUNK) < F.max(CHUNK)).alias("_several")).where("_several").select(*keys)
    functions = narrow.join(several, [*keys], "left_semi").groupBy(*together).applyInArrow(function, f"{named}, entry array<bigint>, open array<bigint>, _limit bigint")

    def carry(batches):
        key = reached = None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if key != (own := [row[k] for k in keys]):
                    key, reached = own, None
                found.append(reached)
                if reached is None:
                    reached = row["open"][0]
                elif (at := bisect.bisect_right(row["entry"], reached + row["_limit"])) < len(row["entry"]):
                    reached = row["open"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in groups), pa.array(found, pa.int64())], names=[*groups, "_reached"])

    carried = functions.repartition(*keys).sortWithinPartitions(*groups).mapInArrow(carry, f"{named}, _reached bigint")

    def label(table: pa.Table) -> pa.Table:
        table, each = parts(table)
        reached, labels = table["_reached"].to_pylist(), table["_begin"].to_numpy().copy()
        for at, begins, tests, limit in each:
            after, i, own = following(begins, tests, limit), 0, labels[at : at + len(begins)]
            if reached[at] is not None:
                i = int(np.searchsorted(tests, reached[at] + limit, "right"))
                own[:i] = reached[at]
            while i < len(begins):
                own[i : after[i]] = begins[i]
                i = int(after[i])
        return table.drop_columns(["_begin", "_test", "_limit", "_reached"]).append_column(out, pa.array(labels, pa.int64()))

    held = rows.withColumn("_begin", F.col(begin)).withColumn("_test", F.col(test)).join(carried, groups, "left")
    schema = rows.drop("_limit").withColumn(out, F.lit(0).cast("bigint")).schema
    return held.groupBy(*together).applyInArrow(label, schema).drop(CHUNK)


def affine_scan(df: DataFrame, keys: Sequence[str], order: str, a: Column, b: Column, start: Column, out: str, block: int = 1024) -> DataFrame:
    """Add the recurrence y = a * y' + b along ``order``, from ``start``.

    Maps y' -> a y' + b compose to maps of the same kind, so the recurrence is an associative
    scan: by doubling inside blocks of ``block`` rows, then over the blocks' own maps (one row per block).
    """
    numbered = running_sum(chunked(df.withColumn("_order", F.col(order).cast("bigint")), "_order"), keys, [order], F.lit(1), "_place")
    rows = numbered.withColumn("_block", F.expr(f"(_place - 1) div {block}L")).withColumn("_map", F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))

    def scanned(d: DataFrame, window, size: int) -> DataFrame:
        step = 1
        while step < size:
            before = F.lag("_map", step).over(window)
            joined = F.struct((F.col("_map.a") * before["a"]).alias("a"), (F.col("_map.a") * before["b"] + F.col("_map.b")).alias("b"))
            d = d.withColumn("_map", F.when(before.isNull(), F.col("_map")).otherwise(joined))
            step *= 2
        return d

    inside = scanned(rows, Window.partitionBy(*keys, "_block").orderBy("_place"), block)
    blocks = inside.groupBy(*keys, "_block").agg(F.max_by("_map", "_place").alias("_map"))
    most = blocks.agg(F.max("_block")).first()[0] or 0
    whole = scanned(blocks, Window.partitionBy(*keys).orderBy("_block"), most + 1)
    carried = whole.select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_map").alias("_carried"))
    reached = F.coalesce(F.col("_carried.a") * start + F.col("_carried.b"), start)
    joined = inside.join(carried, [*keys, "_block"], "left").withColumn(out, F.col("_map.a") * reached + F.col("_map.b"))
    return joined.drop("_order", "_place", "_block", "_map", "_carried", CHUNK)


def bands(df: DataFrame, keys: Sequence[str], low: str, high: str, reach: int, out: str) -> DataFrame:
    """Label rows with the band of bins they lie in: rows of ``keys`` whose bins come within ``reach`` of
    each other, directly or through others, share a band (its lowest bin).

    Bands are found on one row per key and low bin, so their number is bounded by the grid.
    """
    edges = df.groupBy(*keys, low).agg(F.max(high).alias("_high"))
    along = Window.partitionBy(*keys).orderBy(low)
    below = F.max("_high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    starts = edges.withColumn(out, F.when(below.isNull() | (F.col(low) - below > reach), F.col(low)))
    return df.join(starts.select(*keys, low, F.max(out).over(along).alias(out)), [*keys, low])
