"""Energy events: active bins of a frame, connected from frame to frame.

Runs of adjacent active bins are found inside the frame's row. Frames are then
cut into pieces at every frame without activity and at every break in the
samples; pieces into bands of bins that no run connects, and bands at every frame
without activity of their own. What is left is independent.

Where a band has one run a frame, each touching the one before, connecting has no
choice: the runs form one chain, which is cut greedily at the segment length and
summed, in parallel however long it is. Other bands are walked in frame order as a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.functions import flags
from bandwatch.functions.power import MINIMUM_POWER
from bandwatch.operators.asof import segment_at
from bandwatch.operators.ordered import CHUNK, CHUNK_US, bands, chunked, greedy_starts, group_start, with_previous
from bandwatch.operators.walk import names_of, typed, walk_groups
from bandwatch.session import written_once

# Fixed values of the event grouping.
MAX_RUNS = 64
SEGMENT_SECONDS = 2.0
EVENT_QUALITY = flags.UNCALIBRATED | flags.BACKGROUND_UNCERTAIN
CENTER_BINS = 2


RUN_TYPE = "array<struct<low:int,high:int,sum:double,peak:double,count:bigint,quality:int>>"


def _whole_runs(bins: pa.Array, powers: pa.Array, bin_count: pa.Array, clipped: pa.Array, most: int | None) -> pa.Array:
    """The runs of a batch of frames, found and summed at once; powers are added in the order of their bins."""
    size = pc.fill_null(pc.list_value_length(bins), 0).to_numpy(zero_copy_only=False)
    owned = pc.fill_null(pc.list_value_length(powers), 0).to_numpy(zero_copy_only=False)
    if (size != np.where(size > 0, owned, 0)).any():
        raise ValueError("a frame has not as many powers as bins")
    at, values = pc.list_flatten(bins).to_numpy(), pc.list_flatten(pc.if_else(pa.array(size > 0), powers, pa.scalar(None, powers.type)))
    known = values.is_valid().to_numpy(zero_copy_only=False)
    values = pc.fill_null(values, 0.0).to_numpy()
    frame = np.repeat(np.arange(len(size)), size)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (frame[1:] != frame[:-1]) | (np.abs(at[1:] - at[:-1]) > 1)

    def gathered(fresh, sums, peaks, counts, holes):
        """What each part that starts at ``fresh`` adds up to."""
        begin, part = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        whole = [np.bincount(part, x, len(begin)) for x in (sums, counts, holes)]
        return begin, whole[0], np.maximum.reduceat(peaks, begin) if len(begin) else peaks, *(x.astype(np.int64) for x in whole[1:])

    begin, sums, peaks, counts, holes = gathered(fresh, values, np.where(known, values, -np.inf), np.ones(len(at)), ~known)
    low, high, frame = at[begin], at[np.append(begin[1:], len(at)) - 1] if len(at) else at, frame[begin]
    width = pc.fill_null(bin_count, -1).to_numpy(zero_copy_only=False)[frame]
    cut = pc.fill_null(pc.greater(clipped, 0), False).to_numpy(zero_copy_only=False)[frame]
    quality = np.where((low == 0) | (high + 1 == width), flags.BOUNDARY, 0) | np.where(cut, flags.CLIPPED, 0)
    number = np.bincount(frame, minlength=len(size))
    if most is not None and (number > most).any():
        place = np.arange(len(frame)) - np.repeat(np.cumsum(number) - number, number)
        together = -(-number // most)[frame]
        begin, sums, peaks, counts, holes = gathered(place % together == 0, sums, peaks, counts, holes)
        quality = np.where(together[begin] > 1, flags.MERGED | flags.TRUNCATED, 0) | np.bitwise_or.reduceat(quality, begin)
        low, high, frame = low[begin], high[np.append(begin[1:], len(high)) - 1], frame[begin]
        number = np.bincount(frame, minlength=len(size))
    made = pa.StructArray.from_arrays(
        [pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(sums, mask=holes > 0), pa.array(peaks, mask=holes == counts), pa.array(counts), pa.array(quality, pa.int32())],
        names=["low", "high", "sum", "peak", "count", "quality"],
    )
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32()), made)


def frame_runs(frames: DataFrame, most: int | None = MAX_RUNS) -> DataFrame:
    """Add ``runs`` to frames with ascending active ``bins`` and their linear ``powers``.

    Needs ``bin_count`` and ``clipped``. More than ``most`` runs are merged in equal
    groups, so that power and envelope are kept; None merges none.
    """

    def runs(bins: pa.Array, powers: pa.Array, bin_count: pa.Array, clipped: pa.Array) -> pa.Array:
        return _whole_runs(bins, powers, bin_count, clipped, most)

    found = F.arrow_udf(runs, RUN_TYPE)("bins", "powers", "bin_count", "clipped")
    return frames.where(F.size("bins") > 0).withColumn("runs", found)


@dataclass
class Run:
    low: int
    high: int
    sum: float
    peak: float
    count: int
    quality: int


@dataclass
class Event:
    """An open event: envelope so far, and the bins of its last frame."""

    first: int
    end: int
    low: int
    high: int
    last_low: int
    last_high: int
    sum: float
    peak: float
    count: int
    quality: int


def _adjacent(low: int, high: int, other_low: int, other_high: int) -> bool:
    return low - 1 <= other_high and other_low - 1 <= high


class EventTracks:
    """Connects the runs of successive frames into events."""

    def __init__(self, frame_samples: int, segment_samples: int) -> None:
        self.frame_samples = frame_samples
        self.segment_samples = segment_samples
        self.open: list[Event] = []
        self.split: list[tuple[int, int]] = []

    def step(self, first: int, runs: list[Run]) -> list[Event]:
        """Take one frame's runs; return the events that close."""
        # Runs and open tracks that touch, directly or through each other, form one group.
        groups: list[tuple[list[Event], list[Run]]] = []
        for r in runs:
            news, olds = [r], [t for t in self.open if _adjacent(t.last_low, t.last_high, r.low, r.high)]
            rest = []
            for g_olds, g_news in groups:
                if any(t is o for t in olds for o in g_olds):
                    olds = g_olds + [t for t in olds if not any(t is o for o in g_olds)]
                    news = g_news + news
                else:
                    rest.append((g_olds, g_news))
            groups = [*rest, (olds, news)]
        used = {id(t) for olds, _ in groups for t in olds}
        closed = [t for t in self.open if id(t) not in used]
        grown = [self._join(first, olds, news) for olds, news in groups]
        self.open, self.split = [], []
        for t in grown:
            if t.end - t.first >= self.segment_samples:
                closed.append(replace(t, quality=t.quality | flags.TRUNCATED))
                self.split.append((t.last_low, t.last_high))
            else:
                self.open.append(t)
        return closed

    def finish(self, truncated: bool) -> list[Event]:
        """Close all: plainly at a quiet frame, truncated at the end of the samples."""
        extra = flags.TRUNCATED if truncated else 0
        done = [replace(t, quality=t.quality | extra) for t in self.open]
        self.open, self.split = [], []
        return done

    def _join(self, first: int, olds: list[Event], news: list[Run]) -> Event:
        quality = EVENT_QUALITY
        for x in (*olds, *news):
            quality |= x.quality
        if len(olds) > 1 or len(news) > 1:
            quality |= flags.MERGED
        if any(_adjacent(a, b, r.low, r.high) for a, b in self.split for r in news):
            quality |= flags.TRUNCATED
        both = (*olds, *news)
        return Event(
            min([first, *(t.first for t in olds)]),
            first + self.frame_samples,
            min(x.low for x in both),
            max(x.high for x in both),
            min(r.low for r in news),
            max(r.high for r in news),
            sum(x.sum for x in both),
            max(x.peak for x in both),
            sum(x.count for x in both),
            quality,
        )


EVENT_COLUMNS = "first_sample bigint, end_sample bigint, low_bin int, high_bin int, power_sum double, peak double, cells bigint, quality int"


def event_tuple(e: Event) -> tuple:
    return (e.first, e.end, e.low, e.high, e.sum, e.peak, e.count, e.quality)


def runs_of(items) -> list[Run]:
    return [
        Run(int(r["low"]), int(r["high"]), float(r["sum"]), float(r["peak"]), int(r["count"]), int(r["quality"]))
        for r in items
    ]


GROUP = ["session_id", "run_sample", "piece", "band", "part"]


class _Walker:
    """One piece in frame order: the open tracks only."""

    def __init__(self, key: tuple) -> None:
        self.session, self.tracks, self.truncated = key[0], None, False

    def row(self, row) -> list[tuple]:
        if self.tracks is None:
            self.tracks = EventTracks(int(row.frame_samples), int(row.segment_samples))
        self.truncated = bool(row.last_of_run)
        return self._out(self.tracks.step(int(row.first_sample), runs_of(row.runs)))

    def close(self) -> list[tuple]:
        return self._out(self.tracks.finish(self.truncated))

    def _out(self, done: list[Event]) -> list[tuple]:
        return [(self.session, *event_tuple(e)) for e in done]


def event_pieces(frames: DataFrame, chunk_samples: int = 1 << 30, most: int | None = None) -> DataFrame:
    """Frames with activity, labelled with their contiguous run and independent piece.

    ``frames`` has session_id, first_sample, frame_samples, segment_samples,
    bin_count, clipped, bins and powers, for every measured frame: quiet frames
    too, with empty arrays.
    """
    keys, order = ["session_id"], ["first_sample"]
    # Scanned several times below, so the runs are written once.
    narrow = written_once(frame_runs_or_quiet(frames, most), "frame-runs")
    rows = chunked(narrow, "first_sample", chunk_samples)
    before = F.struct((F.col("first_sample") + F.col("frame_samples")).alias("end"), F.col("active").alias("active"))
    rows = with_previous(rows, keys, order, before, "prev")
    broken = F.col("prev").isNull() | (F.col("prev.end") != F.col("first_sample"))
    rows = group_start(rows, keys, order, broken, F.col("first_sample"), "run_sample")
    rows = written_once(rows, "runs")
    cut = broken | ~F.col("prev.active")
    rows = group_start(rows, keys, order, cut & F.col("active"), F.col("first_sample"), "piece")
    ends = rows.groupBy("session_id", "run_sample").agg(F.max("first_sample").alias("run_last"))
    return (
        rows.where("active")
        .join(ends, ["session_id", "run_sample"])
        .withColumn("last_of_run", F.col("first_sample") == F.col("run_last"))
        .drop("prev", CHUNK, "run_last")
    )


def frame_runs_or_quiet(frames: DataFrame, most: int | None = None) -> DataFrame:
    """Runs per frame; quiet frames stay, so that quiet and missing can be told apart."""
    keep = ["session_id", "first_sample", "frame_samples", "segment_samples"]
    active = frame_runs(frames, most).select(*keep, "runs", F.lit(True).alias("active"))
    quiet = frames.where(F.size("bins") == 0).select(*keep, F.lit(False).alias("active"))
    return active.unionByName(quiet, allowMissingColumns=True)


def event_parts(pieces: DataFrame, chunk_samples: int = 1 << 30) -> DataFrame:
    """A row per run, with its band and the part of its band; ``chain`` tells the parts without a choice."""
    rows = pieces.withColumn("r", F.explode("runs")).select(*[c for c in pieces.columns if c != "runs"], "r.*")
    rows = bands(rows, GROUP[:3], "low", "high", 1, "band")
    keys, order = GROUP[:4], ["first_sample", "low"]
    before = F.struct("first_sample", (F.col("first_sample") + F.col("frame_samples")).alias("end"), "low", "high")
    rows = with_previous(chunked(rows, "first_sample", chunk_samples), keys, order, before, "prev")
    prev, same = F.col("prev"), F.col("prev.first_sample") == F.col("first_sample")
    fresh = prev.isNull() | ~same & (prev["end"] != F.col("first_sample"))
    rows = group_start(rows, keys, order, fresh, F.col("first_sample"), "part").drop(CHUNK)
    follows = ~same & (F.col("low") - 1 <= prev["high"]) & (prev["low"] - 1 <= F.col("high"))
    rows = written_once(rows.withColumn("starts", fresh).withColumn("follows", fresh | follows).drop("prev"), "event-parts")
    chains = rows.groupBy(*GROUP).agg(F.bool_and("follows").alias("chain"))
    return rows.drop("follows").join(chains, GROUP)


def chain_events(rows: DataFrame, chunk_samples: int = 1 << 30) -> DataFrame:
    """Events of the chains: cut at the segment length, summed in partial sums."""
    narrow = rows.withColumn("after", F.when(F.col("starts"), F.col("first_sample")).otherwise(F.col("first_sample") + 1))  # at the length, not beyond
    cut = greedy_starts(narrow, GROUP, "first_sample", "first_sample", "after", F.col("segment_samples"), "event", chunk_samples)
    summed = cut.groupBy(*GROUP, "event").agg(
        F.min("first_sample").alias("first_sample"), F.max(F.col("first_sample") + F.col("frame_samples")).alias("end_sample"),
        F.min("low").cast("int").alias("low_bin"), F.max("high").cast("int").alias("high_bin"), F.sum("sum").alias("power_sum"), F.max("peak").alias("peak"),
        F.sum("count").alias("cells"), F.bit_or("quality").alias("quality"), F.max("segment_samples").alias("segment"),
        F.bool_or("starts").alias("starts"), F.bool_or("last_of_run").alias("ends"),
    )
    cut_off = (F.col("end_sample") - F.col("first_sample") >= F.col("segment")) | F.col("ends") | ~F.col("starts")
    quality = F.col("quality").bitwiseOR(F.lit(EVENT_QUALITY)).bitwiseOR(flags.flag(cut_off, flags.TRUNCATED)).cast("int")
    return summed.withColumn("quality", quality).select("session_id", *names_of(EVENT_COLUMNS))


def find_events(frames: DataFrame, chunk_samples: int = 1 << 30, most: int | None = None) -> DataFrame:
    """Energy events of a table of frames; ``most`` merges the runs of a frame beyond that number."""
    rows = event_parts(event_pieces(frames, chunk_samples, most), chunk_samples)
    schema = f"{typed(rows, ['session_id'])}, {EVENT_COLUMNS}"
    frame = ["first_sample", "frame_samples", "segment_samples", "last_of_run"]
    runs = F.sort_array(F.collect_list(F.struct("low", "high", "sum", "peak", "count", "quality"))).alias("runs")
    mixed = rows.where(~F.col("chain")).groupBy(*GROUP, *frame).agg(runs)
    walked = walk_groups(mixed, GROUP, ["first_sample"], _Walker, schema, ["session_id", *names_of(EVENT_COLUMNS)])
    return chain_events(rows.where("chain"), chunk_samples).unionByName(walked)


def event_levels(events: DataFrame) -> DataFrame:
    """Mean and peak level of events from their power sums."""
    floor = F.lit(MINIMUM_POWER)
    return events.withColumn(
        "mean_dbfs", 10.0 * F.log10(F.greatest(F.col("power_sum") / F.col("cells"), floor))
    ).withColumn("peak_dbfs", 10.0 * F.log10(F.greatest(F.col("peak"), floor)))


def mark_center(events: DataFrame, acquisitions: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Flag events whose band comes within two bins of the receiver center at their start."""
    placed = segment_at(events, acquisitions, "start_us", chunk_us).withColumnRenamed("segment_id", "acq_id")
    config = acquisitions.select("session_id", "acq_id", "center_hz", "bin_width_hz")
    reach = CENTER_BINS * F.col("bin_width_hz")
    near = (F.col("lower_hz") <= F.col("center_hz") + reach) & (F.col("upper_hz") >= F.col("center_hz") - reach)
    return placed.join(config, ["session_id", "acq_id"]).withColumn(
        "quality", F.col("quality").bitwiseOR(flags.flag(near, flags.DC_SUSPECT))
    )
