"""Candidate bursts: activity in a tile, associated over time.

Step 1 finds the components of each tile inside the tile's row, in Spark
expressions. Step 2 cuts the components of a session into independent pieces:
a new piece starts after a coverage break, a grid change, or 40 ms without
activity, separately for the receiver-center guard, whose class never mixes
with the rest. Each piece is cut again into bands of bins that no component
connects (a track never leaves the bins of its components), and each band at 40 ms
of its own quiet. So a carrier that is always active keeps no other burst waiting.

Step 3: where a band has one component at a time, each within reach of the one before,
association has no choice: the components form one chain, which is cut greedily at
ten seconds and summed, in parallel however long it is. All other bands are walked in
time order, as a stream of batches that holds the open tracks.

There is no bound on open tracks: a piece holds what was active within 40 ms.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.functions import flags
from bandwatch.functions.binding import bound
from bandwatch.operators.ordered import CHUNK, CHUNK_US, bands, chunked, greedy_starts, group_start, running_max, with_previous
from bandwatch.operators.select import GUARD_SLACK_HZ, selected_tiles
from bandwatch.operators.sequences import with_run_start
from bandwatch.operators.walk import names_of, typed, walk_groups
from bandwatch.plans.query import SurveyQuery
from bandwatch.session import written_once

# Grouping version 1.
SEED_FRAMES = 2
BRIDGE_BINS = 3
QUIET_US = 40_000
SEGMENT_US = 10_000_000
PADDING_BINS = 2


def with_components(selected: DataFrame) -> DataFrame:
    """Add ``components`` to each tile: runs of bins seen in two or more frames.

    Up to two empty bins are bridged, the guard edge never. Works on the tile's
    sorted active bins, so the cost follows the active cells.
    """
    lo, hi, glo, ghi = (F.col(c) for c in ("bin_lo", "bin_hi", "guard_lo", "guard_hi"))
    length, n = F.col("end_us") - F.col("start_us"), F.col("frame_count")

    def frame(bins, i):
        return F.struct(
            i.alias("frame"),
            F.greatest(F.col("from_us"), F.col("start_us") + F.floor(length * i / n)).alias("f0"),
            F.least(F.col("to_us"), F.col("start_us") + F.floor(length * (i + 1) / n)).alias("f1"),
            F.filter(bins, lambda b: (b >= lo) & (b < hi)).alias("bins"),
        )

    def guarded(b):
        return b.between(glo, ghi)

    def apart(a, b):
        return (b - a > BRIDGE_BINS) | (guarded(a) != guarded(b))

    def numbered(array):
        return F.transform(array, lambda b, i: F.struct(b.alias("b"), i.alias("i")))

    def component(start, end, seeds, frames):
        own = F.slice(seeds, start["i"] + 1, end["i"] - start["i"] + 1)
        center = guarded(start["b"])
        clipped = (F.col("from_us") > F.col("start_us")) | (F.col("to_us") < F.col("end_us"))
        edge = clipped | (start["b"] == lo) | (end["b"] + 1 == hi)
        return bound(
            F.filter(frames, lambda f: F.arrays_overlap(f["bins"], own)),
            lambda hit: F.struct(
                start["b"].alias("low_bin"),
                end["b"].alias("high_bin"),
                center.alias("center_region"),
                (F.size(own) < end["b"] - start["b"] + 1).alias("ambiguous"),
                F.array_min(F.transform(hit, lambda f: f["f0"])).alias("first_us"),
                F.array_max(F.transform(hit, lambda f: f["f1"])).alias("last_us"),
                F.aggregate(hit, F.lit(0).cast("bigint"), lambda a, f: a + f["f1"] - f["f0"]).alias("active_us"),
                F.transform(hit, lambda f: f["frame"]).alias("frames"),
                F.array_max(F.slice(F.col("peak_dbfs"), start["b"] + 1, end["b"] - start["b"] + 1)).alias("peak_dbfs"),
                F.col("quality")
                .bitwiseOR(flags.flag(center, flags.DC_SUSPECT))
                .bitwiseOR(flags.flag(edge, flags.BOUNDARY))
                .alias("quality"),
            ),
        )

    def of_seeds(seeds, frames):
        def starts_here(x):
            return (x["i"] == 0) | apart(F.get(seeds, x["i"] - 1), x["b"])

        def ends_here(x):
            return (x["i"] == F.size(seeds) - 1) | apart(x["b"], F.get(seeds, x["i"] + 1))

        return F.zip_with(
            F.filter(numbered(seeds), starts_here),
            F.filter(numbered(seeds), ends_here),
            lambda start, end: component(start, end, seeds, frames),
        )

    def of_frames(frames):
        every = F.array_sort(F.flatten(F.transform(frames, lambda f: f["bins"])))
        repeated = bound(
            every, lambda x: F.array_distinct(F.filter(x, lambda b, i: (i > 0) & (F.get(x, i - 1) == b)))
        )
        return bound(repeated, lambda seeds: of_seeds(seeds, frames))

    active = F.filter(F.transform("activity", frame), lambda f: (f["f1"] > f["f0"]) & (F.size(f["bins"]) > 0))
    return selected.withColumn("components", bound(active, of_frames))


def component_rows(selected: DataFrame) -> DataFrame:
    """One row per tile component."""
    return (
        with_components(selected)
        .select("session_id", "acq_id", "tile_id", "first_center_hz", "bin_width_hz", F.explode("components").alias("c"))
        .select("session_id", "acq_id", "tile_id", "first_center_hz", "bin_width_hz", "c.*")
        .withColumn("lower_hz", F.col("first_center_hz") + (F.col("low_bin") - 0.5) * F.col("bin_width_hz"))
        .withColumn("upper_hz", F.col("first_center_hz") + (F.col("high_bin") + 0.5) * F.col("bin_width_hz"))
    )


@dataclass
class Track:
    """An open burst and the band of its latest component."""

    first_us: int
    last_us: int
    lower_hz: float
    upper_hz: float
    active_us: int
    peak_dbfs: float
    quality: int
    ambiguous: bool
    limited: bool = False
    components: int = 1
    band: tuple[float, float] = field(default=(0.0, 0.0))


@dataclass
class Part:
    """A tile component as seen by the association."""

    first_us: int
    last_us: int
    lower_hz: float
    upper_hz: float
    active_us: int
    peak_dbfs: float
    quality: int
    ambiguous: bool
    frames: dict[int, tuple[int, int]]


class BurstTracks:
    """Associates the components of successive tiles of one guard class."""

    def __init__(self) -> None:
        self.open: list[Track] = []

    def expire(self, now_us: int) -> list[Track]:
        done = [t for t in self.open if now_us - t.last_us > QUIET_US]
        self.open = [t for t in self.open if now_us - t.last_us <= QUIET_US]
        return done

    def step(self, from_us: int, parts: list[Part], width_hz: float) -> list[Track]:
        """Take one tile's components; return the bursts that close."""
        closed = self.expire(from_us)
        pad = PADDING_BINS * width_hz + GUARD_SLACK_HZ
        owners = [self._owners(p, pad) for p in parts]
        claims: dict[int, list[int]] = {}
        for i, own in enumerate(owners):
            for j in own:
                claims.setdefault(j, []).append(i)
        merged: dict[int, Part] = {}
        gone: set[int] = set()
        for j, members in claims.items():
            if len(members) > 1:
                sweep = self._sweep(self.open[j], [parts[i] for i in members], [owners[i] for i in members], pad)
                if sweep is not None:
                    merged[members[0]] = sweep
                    gone.update(members[1:])
                    claims[j] = members[:1]
        fresh: list[Track] = []
        retired: set[int] = set()
        for i, original in enumerate(parts):
            if i in gone:
                continue
            part, own = merged.get(i, original), owners[i]
            if len(own) == 1 and len(claims[own[0]]) == 1:
                self._extend(self.open[own[0]], part)
                continue
            for j in own:
                self.open[j].ambiguous = True
                retired.add(j)
            fresh.append(self._start(part, bool(own)))
        closed += [t for j, t in enumerate(self.open) if j in retired]
        self.open = [t for j, t in enumerate(self.open) if j not in retired] + fresh
        for t in self.open:
            if t.last_us - t.first_us >= SEGMENT_US:
                t.limited = True
                closed.append(t)
        self.open = [t for t in self.open if not t.limited]
        return closed

    def finish(self, last_tile_us: int) -> list[Track]:
        """Close what is open; limited unless a later tile proved it quiet."""
        for t in self.open:
            t.limited = t.limited or last_tile_us - t.last_us <= QUIET_US
        done, self.open = self.open, []
        return done

    def _owners(self, p: Part, pad: float) -> list[int]:
        return [
            j
            for j, t in enumerate(self.open)
            if p.first_us - t.last_us <= QUIET_US and p.lower_hz <= t.band[1] + pad and p.upper_hz >= t.band[0] - pad
        ]

    @staticmethod
    def _sweep(track: Track, parts: list[Part], owners: list[list[int]], pad: float) -> Part | None:
        """Pieces of one sweep: inside the track's band, its alone, hardly ever simultaneous."""
        for p, own in zip(parts, owners):
            if len(own) != 1 or p.lower_hz < track.lower_hz - pad or p.upper_hz > track.upper_hz + pad:
                return None
        union: dict[int, tuple[int, int]] = {}
        shared: set[int] = set()
        for p in parts:
            shared |= union.keys() & p.frames.keys()
            union.update(p.frames)
        if 4 * len(shared) > len(union):
            return None
        quality = 0
        for p in parts:
            quality |= p.quality
        return Part(
            min(a for a, _ in union.values()),
            max(b for _, b in union.values()),
            min(p.lower_hz for p in parts),
            max(p.upper_hz for p in parts),
            sum(b - a for a, b in union.values()),
            max(p.peak_dbfs for p in parts),
            quality,
            True,
            union,
        )

    @staticmethod
    def _extend(t: Track, p: Part) -> None:
        t.last_us = p.last_us
        t.lower_hz, t.upper_hz = min(t.lower_hz, p.lower_hz), max(t.upper_hz, p.upper_hz)
        t.active_us += p.active_us
        t.components += 1
        t.peak_dbfs = max(t.peak_dbfs, p.peak_dbfs)
        t.quality |= p.quality
        t.ambiguous = t.ambiguous or p.ambiguous
        t.band = (p.lower_hz, p.upper_hz)

    @staticmethod
    def _start(p: Part, contested: bool) -> Track:
        return Track(
            p.first_us, p.last_us, p.lower_hz, p.upper_hz, p.active_us, p.peak_dbfs, p.quality,
            p.ambiguous or contested, band=(p.lower_hz, p.upper_hz),
        )


BURST_COLUMNS = (
    "start_us bigint, end_us bigint, lower_hz double, upper_hz double, active_us bigint, peak_dbfs double, "
    "quality int, components int, ambiguous boolean, limited boolean"
)


def burst_tuple(t: Track) -> tuple:
    return (
        t.first_us, t.last_us, t.lower_hz, t.upper_hz, t.active_us, t.peak_dbfs, t.quality, t.components,
        t.ambiguous, t.limited,
    )


def part_of(row) -> Part:
    """A component row (with its tile's frame timing) as a Part."""
    frames = {}
    length = row.tile_end_us - row.tile_start_us
    for f in row.frames:
        a = max(row.from_us, row.tile_start_us + length * int(f) // row.frame_count)
        b = min(row.to_us, row.tile_start_us + length * (int(f) + 1) // row.frame_count)
        frames[int(f)] = (a, b)
    return Part(
        int(row.first_us), int(row.last_us), float(row.lower_hz), float(row.upper_hz), int(row.active_us),
        float(row.peak_dbfs), int(row.quality), bool(row.ambiguous), frames,
    )


GROUP = ["session_id", "acq_id", "run_us", "center_region", "piece_us", "band", "part_us"]


class _Walker:
    """One piece in time order: the current tile's parts and the open tracks."""

    def __init__(self, key: tuple) -> None:
        self.prefix = (key[0], key[1], key[3])
        self.tracks = BurstTracks()
        self.now, self.parts, self.width, self.last_tile = None, [], 0.0, 0

    def row(self, row) -> list[tuple]:
        done = self._step() if self.now is not None and row.from_us != self.now else []
        self.now, self.width, self.last_tile = int(row.from_us), float(row.bin_width_hz), int(row.run_last_us)
        self.parts.append(part_of(row))
        return done

    def close(self) -> list[tuple]:
        return self._step() + self._out(self.tracks.finish(self.last_tile))

    def _step(self) -> list[tuple]:
        parts, self.parts = self.parts, []
        return self._out(self.tracks.step(self.now, parts, self.width))

    def _out(self, done: list[Track]) -> list[tuple]:
        return [(*self.prefix, *burst_tuple(t)) for t in done]


def pieces(selected: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Component rows with their independent piece, ready to be walked in time order."""
    tiles = with_components(selected).select(
        "session_id", "acq_id", "tile_id", "from_us", "to_us", "first_center_hz", "bin_width_hz", "bin_count",
        F.col("start_us").alias("tile_start_us"), F.col("end_us").alias("tile_end_us"), "frame_count", "components",
    )
    # Used several times below, so it is written once: narrow rows, without power or bitmaps.
    labelled = written_once(with_run_start(written_once(tiles, "components"), chunk_us), "runs")
    last = labelled.groupBy("session_id", "run_us").agg(F.max("from_us").alias("run_last_us"))
    rows = (
        labelled.withColumn("c", F.explode("components"))
        .select(*[c for c in labelled.columns if c != "components"], "c.*")
        .withColumn("lower_hz", F.col("first_center_hz") + (F.col("low_bin") - 0.5) * F.col("bin_width_hz"))
        .withColumn("upper_hz", F.col("first_center_hz") + (F.col("high_bin") + 0.5) * F.col("bin_width_hz"))
        .join(last, ["session_id", "run_us"])
    )
    keys = ["session_id", "run_us", "center_region"]
    order = ["from_us", "low_bin"]
    rows = running_max(chunked(rows, "from_us", chunk_us), keys, order, {"reach": F.col("last_us")}, inclusive=False)
    fresh = F.col("reach").isNull() | (F.col("from_us") - F.col("reach") > QUIET_US)
    return group_start(rows, keys, order, fresh, F.col("from_us"), "piece_us").drop(CHUNK, "reach")


def parts(rows: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Pieces cut into bands and at each band's own quiet; ``chain`` tells the parts without a choice."""
    keys, order = GROUP[:-1], ["from_us", "low_bin"]
    rows = bands(rows, GROUP[:-2], "low_bin", "high_bin", PADDING_BINS + 1, "band")
    rows = running_max(chunked(rows, "from_us", chunk_us), keys, order, {"reach": F.col("last_us")}, inclusive=False)
    fresh = F.col("reach").isNull() | (F.col("from_us") - F.col("reach") > QUIET_US)
    rows = group_start(rows, keys, order, fresh, F.col("from_us"), "part_us").drop("reach")
    before = F.struct("from_us", "last_us", "lower_hz", "upper_hz")
    rows = with_previous(rows, GROUP, order, before, "prev").drop(CHUNK)
    pad, prev = PADDING_BINS * F.col("bin_width_hz") + GUARD_SLACK_HZ, F.col("prev")
    follows = (
        (prev["from_us"] < F.col("from_us")) & (F.col("first_us") - prev["last_us"] <= QUIET_US)
        & (F.col("lower_hz") <= prev["upper_hz"] + pad) & (F.col("upper_hz") >= prev["lower_hz"] - pad)
    )
    rows = written_once(rows.withColumn("follows", prev.isNull() | follows), "parts")
    chains = rows.groupBy(*GROUP).agg(F.bool_and("follows").alias("chain"))
    return rows.drop("follows").join(chains, GROUP)


def chain_bursts(rows: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Bursts of the chains: cut after ten seconds, summed in partial sums."""
    test = rows.withColumn("ended_us", F.coalesce(F.col("prev.last_us"), F.col("first_us") - 1) + 1)  # at ten seconds, not beyond
    narrow = test.select(
        *GROUP, "from_us", "first_us", "last_us", "ended_us", "lower_hz", "upper_hz", "active_us", "peak_dbfs", "quality", "ambiguous", "run_last_us"
    )
    cut = greedy_starts(narrow, GROUP, "from_us", "first_us", "ended_us", F.lit(SEGMENT_US), "burst", chunk_us)
    summed = cut.groupBy(*GROUP, "burst").agg(
        F.min("first_us").alias("start_us"), F.max("last_us").alias("end_us"), F.min("lower_hz").alias("lower_hz"), F.max("upper_hz").alias("upper_hz"),
        F.sum("active_us").alias("active_us"), F.max("peak_dbfs").alias("peak_dbfs"), F.bit_or("quality").cast("int").alias("quality"),
        F.count("*").cast("int").alias("components"), F.bool_or("ambiguous").alias("ambiguous"), F.max("run_last_us").alias("run_last_us"),
    )
    limited = (F.col("end_us") - F.col("start_us") >= SEGMENT_US) | (F.col("run_last_us") - F.col("end_us") <= QUIET_US)
    return summed.select("session_id", "acq_id", "center_region", *names_of(BURST_COLUMNS)[:-1], limited.alias("limited"))


def find_bursts(
    tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery, chunk_us: int = CHUNK_US
) -> DataFrame:
    """Candidate bursts of a selection."""
    rows = parts(pieces(selected_tiles(tiles, acquisitions, q), chunk_us), chunk_us)
    lead = ["session_id", "acq_id", "center_region"]
    schema = f"{typed(rows, lead)}, {BURST_COLUMNS}"
    mixed = rows.where(~F.col("chain")).drop("prev", "chain")
    walked = walk_groups(mixed, GROUP, ["from_us", "low_bin"], _Walker, schema, [*lead, *names_of(BURST_COLUMNS)])
    return chain_bursts(rows.where("chain"), chunk_us).unionByName(walked)
