"""Coverage-aware occupancy: union busy time over observed time.

Unobserved is never quiet: every ratio is NULL where nothing was observed.
Observed time is the same for all bins of an acquisition, so it is summed once
per tile, not once per tile and bin; busy time comes from active cells only;
only power needs one value per tile and bin, and that combines on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwatch.functions import flags
from bandwatch.functions.power import dbfs_or_null, linear, percent, ratio, seconds
from bandwatch.operators.frames import active_cells, band_power, frame_activity, time_in, with_frame_states
from bandwatch.operators.select import clip_time, in_region, overlapping_tiles, selected_tiles, time_extent
from bandwatch.plans.query import SurveyQuery

ACQ = ["session_id", "acq_id"]


def power_support(q: SurveyQuery) -> dict[str, Column]:
    """Interval a tile's power describes, and whether it reaches beyond the selection."""
    own = F.col("power_end_us") > F.col("power_start_us")
    start = F.when(own, F.col("power_start_us")).otherwise(F.col("start_us"))
    end = F.when(own, F.col("power_end_us")).otherwise(F.col("end_us"))
    partial = (start < F.greatest(F.lit(q.start_us), F.col("acq_start_us"))) | (
        end > F.least(F.lit(q.end_us), F.col("acq_end_us"))
    )
    if q.geographic:
        partial = partial | (F.col("quality").bitwiseAND(flags.POWER_AGGREGATED) != 0)
    return {"support_start_us": start, "support_end_us": end, "partial": partial}


def fix_bounds() -> list[Column]:
    """Aggregates: bounding box over start and end fixes."""
    return [
        F.min(F.least("fix_start.latitude", "fix_end.latitude")).alias("south"),
        F.max(F.greatest("fix_start.latitude", "fix_end.latitude")).alias("north"),
        F.min(F.least("fix_start.longitude", "fix_end.longitude")).alias("west"),
        F.max(F.greatest("fix_start.longitude", "fix_end.longitude")).alias("east"),
    ]


def exposure(selected: DataFrame, keys: Sequence[str], q: SurveyQuery, extra: Sequence[Column] = ()) -> DataFrame:
    """Per key: observed time, support, missing position, quality, noise and fix bounds of tiles."""
    d = F.col("to_us") - F.col("from_us")
    missing = F.col("fix_end").isNull()
    quality = (
        F.col("quality")
        .bitwiseOR(flags.flag(F.col("partial"), flags.BOUNDARY))
        .bitwiseOR(flags.flag(missing, flags.POSITION_MISSING))
    )
    return (
        selected.withColumns(power_support(q))
        .groupBy(*keys)
        .agg(
            F.sum(d).alias("observed_us"),
            F.sum(F.when(F.col("partial"), d).otherwise(0)).alias("partial_power_us"),
            F.sum(F.when(missing, d).otherwise(0)).alias("missing_position_us"),
            F.max(F.col("support_end_us") - F.col("support_start_us")).alias("max_power_support_us"),
            F.sum(linear(F.col("background_dbfs")) * d).alias("noise_power_us"),
            F.bit_or(quality).alias("quality"),
            *fix_bounds(),
            *extra,
        )
    )


def per_bin(selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and bin: linear power x time, peak power, busy and outside-guard busy time.

    Power rows and busy rows (two reads of the tiles) meet in one aggregation,
    hence one shuffle of partial sums and no join.
    """
    d = F.col("to_us") - F.col("from_us")
    chosen = F.slice(
        F.arrays_zip(F.col("mean_dbfs"), F.col("peak_dbfs")), F.col("bin_lo") + 1, F.col("bin_hi") - F.col("bin_lo")
    )
    power = selected.select(*keys, "bin_lo", d.alias("d"), F.posexplode(chosen).alias("i", "p")).select(
        *keys,
        (F.col("bin_lo") + F.col("i")).alias("bin"),
        (linear(F.col("p.mean_dbfs")) * F.col("d")).alias("power_us"),
        linear(F.col("p.peak_dbfs")).alias("peak"),
    )
    carried = [k for k in keys if k not in ACQ]
    cell_us = F.col("f1_us") - F.col("f0_us")
    busy = active_cells(selected, *carried).select(
        *keys, "bin", cell_us.alias("busy_us"), F.when(F.col("guarded"), 0).otherwise(cell_us).alias("outside_busy_us")
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("busy_us", "outside_busy_us")]
    return (
        power.unionByName(busy, allowMissingColumns=True)
        .groupBy(*keys, "bin")
        .agg(F.sum("power_us").alias("power_us"), F.max("peak").alias("peak"), *sums)
        .where("power_us is not null")
    )


def grid_columns() -> list[Column]:
    """Aggregates: the one frequency grid, bin range and guard of an acquisition."""
    names = ("first_center_hz", "bin_width_hz", "bin_lo", "bin_hi", "guard_lo", "guard_hi")
    return [F.min(c).alias(c) for c in names]


def grids(selected: DataFrame) -> DataFrame:
    """Per acquisition: its one frequency grid, selected bins and guard."""
    return selected.groupBy(*ACQ).agg(*grid_columns())


def bin_edges(df: DataFrame) -> DataFrame:
    center = F.col("first_center_hz") + F.col("bin") * F.col("bin_width_hz")
    return (
        df.withColumn("center_hz", center)
        .withColumn("lower_hz", F.col("first_center_hz") + (F.col("bin") - 0.5) * F.col("bin_width_hz"))
        .withColumn("upper_hz", F.col("first_center_hz") + (F.col("bin") + 0.5) * F.col("bin_width_hz"))
        .withColumn("guarded", F.col("bin").between(F.col("guard_lo"), F.col("guard_hi")))
    )


def frequency_summary(tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """One row per acquisition and bin; grids of different acquisitions stay apart."""
    sel = selected_tiles(tiles, acquisitions, q)
    common = exposure(sel, ACQ, q, grid_columns())
    return measures(bin_edges(per_bin(sel, ACQ).join(common, ACQ)), F.col("guarded"))


def measures(df: DataFrame, guarded: Column) -> DataFrame:
    """Turn accumulated time and power into occupancy, levels and seconds."""
    outside = F.when(~guarded, F.col("outside_busy_us"))
    return (
        df.withColumn("occupancy_pct", percent(F.col("busy_us"), F.col("observed_us")))
        .withColumn("outside_busy_us", outside)
        .withColumn("outside_pct", percent(F.col("outside_busy_us"), F.col("observed_us")))
        .withColumn("mean_dbfs", dbfs_or_null(ratio(F.col("power_us"), F.col("observed_us"))))
        .withColumn("peak_dbfs", dbfs_or_null(F.col("peak")))
        .withColumn("background_dbfs", dbfs_or_null(ratio(F.col("noise_power_us"), F.col("observed_us"))))
    )


# -- time groups --------------------------------------------------------------


def split_buckets(df: DataFrame, anchor: Column, width: Column) -> DataFrame:
    """Split ``[from_us, to_us)`` at fixed bucket edges; exposure is conserved exactly."""
    first = F.floor((F.col("from_us") - anchor) / width)
    last = F.floor((F.col("to_us") - 1 - anchor) / width)
    edge = anchor + F.col("bucket") * width
    return (
        df.where("to_us > from_us")
        .withColumn("bucket", F.explode(F.sequence(first, last)))
        .withColumn("edge_us", edge)
        .withColumn("piece_start_us", F.greatest(F.col("from_us"), edge))
        .withColumn("piece_end_us", F.least(F.col("to_us"), edge + width))
    )


def _pieces(selected: DataFrame, anchor: Column, width: Column) -> DataFrame:
    """Tile pieces per bucket with busy times and band-summed power, all inside the row."""
    measured = (
        with_frame_states(selected)
        .withColumn("band_mean", band_power("mean_dbfs"))
        .withColumn("band_peak", band_power("peak_dbfs"))
        .drop("mean_dbfs", "peak_dbfs", "activity")
    )
    pieces = split_buckets(measured, anchor, width)
    a, b = F.col("piece_start_us"), F.col("piece_end_us")
    for name in ("busy", "center", "outside"):
        pieces = pieces.withColumn(f"{name}_us", time_in(name, a, b))
    return pieces.drop("states").withColumn("d", b - a)


def outside_available() -> Column:
    """Some selected bin lies outside the center guard."""
    return (F.col("bin_lo") < F.col("guard_lo")) | (F.col("bin_hi") - 1 > F.col("guard_hi"))


def time_summary(tiles: DataFrame, acquisitions: DataFrame, gaps: DataFrame, q: SurveyQuery) -> DataFrame:
    """Union occupancy per acquisition and time bucket; empty buckets appear with NULL occupancy."""
    sel = selected_tiles(tiles, acquisitions, q)
    anchor = F.greatest(F.lit(q.start_us), F.col("acq_start_us"))
    width = F.lit(q.bucket_us)
    support = power_support(q)
    pieces = _pieces(sel.withColumns(support), anchor, width)
    partial = (
        F.col("partial")
        | (F.col("support_start_us") < F.col("edge_us"))
        | (F.col("support_end_us") > F.col("edge_us") + width)
    )
    missing = F.col("fix_end").isNull()
    d = F.col("d")
    quality = (
        F.col("quality")
        .bitwiseOR(flags.flag(partial, flags.BOUNDARY))
        .bitwiseOR(flags.flag(missing, flags.POSITION_MISSING))
    )
    found = pieces.groupBy(*ACQ, "bucket").agg(
        F.sum(d).alias("observed_us"),
        F.sum("busy_us").alias("busy_us"),
        F.sum("outside_us").alias("outside_busy_us"),
        F.sum(F.col("band_mean") * d).alias("power_us"),
        F.max("band_peak").alias("peak"),
        F.sum(linear(F.col("background_dbfs")) * (F.col("bin_hi") - F.col("bin_lo")) * d).alias("noise_power_us"),
        F.max(F.col("support_end_us") - F.col("support_start_us")).alias("max_power_support_us"),
        F.sum(F.when(partial, d).otherwise(0)).alias("partial_power_us"),
        F.sum(F.when(missing, d).otherwise(0)).alias("missing_position_us"),
        F.bit_or(quality).alias("quality"),
        *fix_bounds(),
    )
    extent = acquisition_extent(tiles, acquisitions, gaps, q)
    calendar = (
        extent.withColumn("anchor_us", anchor)
        .withColumn(
            "bucket",
            F.explode(
                F.sequence(
                    F.floor((F.col("earliest_us") - F.col("anchor_us")) / width),
                    F.floor((F.col("latest_us") - 1 - F.col("anchor_us")) / width),
                )
            ),
        )
        .withColumn("elapsed_start_us", F.greatest(F.col("earliest_us"), F.col("anchor_us") + F.col("bucket") * width))
        .withColumn(
            "elapsed_end_us", F.least(F.col("latest_us"), F.col("anchor_us") + (F.col("bucket") + 1) * width)
        )
    )
    rows = calendar.join(found, [*ACQ, "bucket"], "left").fillna(
        0,
        [
            "observed_us", "busy_us", "outside_busy_us", "max_power_support_us", "partial_power_us",
            "missing_position_us", "quality",
        ],
    )
    return measures(rows, ~F.col("outside_available"))


def acquisition_extent(tiles: DataFrame, acquisitions: DataFrame, gaps: DataFrame, q: SurveyQuery) -> DataFrame:
    """Per acquisition with selected data: first and last recorded time (tiles and gaps), grid, gap time."""
    overlapping = overlapping_tiles(tiles, acquisitions, q)
    spans = overlapping.groupBy(*ACQ, "acq_start_us", "acq_end_us").agg(
        F.min("from_us").alias("t0"),
        F.max("to_us").alias("t1"),
        F.min("first_center_hz").alias("first_center_hz"),
        F.min("bin_width_hz").alias("bin_width_hz"),
        F.min("bin_lo").alias("bin_lo"),
        F.max("bin_hi").alias("bin_hi"),
        F.bool_or(outside_available()).alias("outside_available"),
        F.min(F.col("utc_start_us") - F.col("start_us")).alias("utc_anchor_us"),
        F.sum(F.when(F.col("fix_end").isNull(), F.col("to_us") - F.col("from_us")).otherwise(0)).alias("no_fix_us"),
        F.bool_or(F.coalesce(in_region("fix_end", q), F.lit(False))).alias("kept"),
    )
    rejected = F.col("no_fix_us") if q.geographic else F.lit(0).cast("bigint")
    clipped = gap_time_by_acquisition(gaps, acquisitions, q)
    return (
        spans.where("kept")
        .join(clipped, ACQ, "left")
        .select(
            *ACQ, "acq_start_us", "acq_end_us", "first_center_hz", "bin_width_hz", "bin_lo", "bin_hi",
            "outside_available", "utc_anchor_us",
            F.least("t0", "gap_t0").alias("earliest_us"),
            F.greatest("t1", "gap_t1").alias("latest_us"),
            F.coalesce("gap_us", F.lit(0)).alias("gap_us"),
            F.coalesce("gap_count", F.lit(0)).alias("gap_count"),
            rejected.alias("excluded_missing_gps_us"),
            (F.col("first_center_hz") + (F.col("bin_lo") - 0.5) * F.col("bin_width_hz")).alias("covered_lower_hz"),
            (F.col("first_center_hz") + (F.col("bin_hi") - 0.5) * F.col("bin_width_hz")).alias("covered_upper_hz"),
        )
    )


#: Width of the time slots in which gaps meet acquisitions.
SLOT_US = 3_600_000_000


def gap_time_by_acquisition(gaps: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """Gap time clipped to each acquisition's part of the selection (all locations).

    Both sides are cut into time slots and meet by session and slot, so a long
    session's gaps are not compared with all its acquisitions; a pair counts in
    the slot where its overlap begins.
    """

    def slots(start: str, end: str) -> Column:
        last = F.greatest(F.floor((F.col(end) - 1) / SLOT_US), F.floor(F.col(start) / SLOT_US))
        return F.explode(F.sequence(F.floor(F.col(start) / SLOT_US), last)).alias("slot")

    config = acquisitions.select(
        "session_id", "acq_id", F.col("start_us").alias("acq_start_us"), F.col("end_us").alias("acq_end_us")
    )
    clipped = (
        clip_time(gaps, q)
        .select("*", slots("from_us", "to_us"))
        .join(config.select("*", slots("acq_start_us", "acq_end_us")), ["session_id", "slot"])
        .withColumn("from_us", F.greatest("from_us", "acq_start_us"))
        .withColumn("to_us", F.least("to_us", "acq_end_us"))
        .where((F.col("to_us") > F.col("from_us")) & (F.floor(F.col("from_us") / SLOT_US) == F.col("slot")))
    )
    return clipped.groupBy(*ACQ).agg(
        F.count("*").alias("gap_count"),
        F.sum(F.col("to_us") - F.col("from_us")).alias("gap_us"),
        F.min("from_us").alias("gap_t0"),
        F.max("to_us").alias("gap_t1"),
    )


def observations(tiles: DataFrame, acquisitions: DataFrame, gaps: DataFrame, q: SurveyQuery) -> DataFrame:
    """Display buckets per session; where ``max_observations`` is set, the width grows to fit it."""
    extent = time_extent(tiles, gaps, q).select("session_id", "resolved_start_us", "resolved_end_us")
    span = F.col("resolved_end_us") - F.col("resolved_start_us")
    fitted = F.ceil(span / q.max_observations) if q.max_observations else F.lit(0)
    extent = extent.withColumn("width_us", F.greatest(F.lit(q.bucket_us), fitted).cast("bigint"))
    sel = selected_tiles(tiles, acquisitions, q).join(extent, "session_id")
    clipped = (F.col("from_us") > F.col("start_us")) | (F.col("to_us") < F.col("end_us"))
    wide = (F.col("quality").bitwiseAND(flags.POWER_AGGREGATED) != 0) & (
        F.lit(q.geographic)
        | (F.col("resolved_start_us") > F.col("power_start_us"))
        | (F.col("resolved_end_us") < F.col("power_end_us"))
    )
    missing = F.col("fix_end").isNull()
    sel = sel.withColumn(
        "quality",
        F.col("quality")
        .bitwiseOR(flags.flag(missing, flags.POSITION_MISSING))
        .bitwiseOR(flags.flag(clipped | wide, flags.BOUNDARY)),
    )
    pieces = _pieces(sel, F.col("resolved_start_us"), F.col("width_us")).withColumn(
        "has_outside", outside_available()
    )
    spot = F.struct("fix_end.latitude", "fix_end.longitude")
    previous = F.lag(F.when(F.col("fix_end").isNotNull(), spot)).over(
        Window.partitionBy("session_id", "bucket").orderBy("start_us")
    )
    bucket_end = F.least(F.col("edge_us") + F.col("width_us"), F.col("resolved_end_us"))
    pieces = pieces.withColumn("moved", F.coalesce((previous != spot) & F.col("fix_end").isNotNull(), F.lit(False)))
    quality = (
        F.col("quality")
        .bitwiseOR(flags.flag(F.col("moved"), flags.MERGED))
        .bitwiseOR(
            flags.flag(
                (F.col("edge_us") > F.col("power_start_us")) | (bucket_end < F.col("power_end_us")), flags.BOUNDARY
            )
        )
    )
    d = F.col("d")
    bins = F.col("bin_hi") - F.col("bin_lo")
    found = pieces.groupBy("session_id", "bucket").agg(
        F.min("piece_start_us").alias("elapsed_start_us"),
        F.max("piece_end_us").alias("elapsed_end_us"),
        F.sum(d).alias("observed_us"),
        F.sum("busy_us").alias("busy_us"),
        F.sum("center_us").alias("center_busy_us"),
        F.sum("outside_us").alias("outside_busy_us"),
        F.sum(F.when(F.col("has_outside"), d).otherwise(0)).alias("outside_observed_us"),
        F.bit_or(quality).alias("quality"),
        F.sum(F.col("band_mean") * d).alias("_power"),
        F.sum(linear(F.col("background_dbfs")) * bins * d).alias("_noise"),
        F.max("band_peak").alias("_peak"),
        F.max_by("fix_end", "start_us").alias("fix"),
    )
    return (
        found.withColumn("mean_dbfs", dbfs_or_null(F.col("_power") / F.col("observed_us")))
        .withColumn("peak_dbfs", dbfs_or_null(F.col("_peak")))
        .withColumn("background_dbfs", dbfs_or_null(F.col("_noise") / F.col("observed_us")))
        .drop("_power", "_noise", "_peak")
    )


# -- totals -------------------------------------------------------------------


def totals(tiles: DataFrame, acquisitions: DataFrame, gaps: DataFrame, q: SurveyQuery) -> DataFrame:
    """Per session: tiles, observed, union busy, center and outside busy, missing positions, quality."""
    extent = time_extent(tiles, gaps, q).select("session_id", "resolved_start_us", "resolved_end_us")
    sel = with_frame_states(selected_tiles(tiles, acquisitions, q).join(extent, "session_id"))
    d = F.col("to_us") - F.col("from_us")
    clipped = (F.col("from_us") > F.col("start_us")) | (F.col("to_us") < F.col("end_us"))
    wide = (F.col("quality").bitwiseAND(flags.POWER_AGGREGATED) != 0) & (
        F.lit(q.geographic)
        | (F.col("resolved_start_us") > F.col("power_start_us"))
        | (F.col("resolved_end_us") < F.col("power_end_us"))
    )
    quality = (
        F.col("quality")
        .bitwiseOR(flags.flag(F.col("fix_end").isNull(), flags.POSITION_MISSING))
        .bitwiseOR(flags.flag(clipped | wide, flags.BOUNDARY))
    )
    lo, hi = F.col("from_us"), F.col("to_us")
    return sel.groupBy("session_id").agg(
        F.count("*").alias("tile_count"),
        F.sum(d).alias("observed_us"),
        F.sum(time_in("busy", lo, hi)).alias("busy_us"),
        F.sum(time_in("center", lo, hi)).alias("center_busy_us"),
        F.sum(time_in("outside", lo, hi)).alias("outside_busy_us"),
        F.sum(F.when(outside_available(), d).otherwise(0)).alias("outside_observed_us"),
        F.sum(F.when(F.col("fix_start").isNull(), d).otherwise(0)).alias("missing_start_us"),
        F.sum(F.when(F.col("fix_end").isNull(), d).otherwise(0)).alias("missing_end_us"),
        F.bit_or(quality).alias("quality"),
    )


def missing_positions(tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """Per session: exposure without a start fix and without an end fix, independently."""
    d = F.col("to_us") - F.col("from_us")
    return (
        selected_tiles(tiles, acquisitions, q)
        .groupBy("session_id")
        .agg(
            F.sum(F.when(F.col("fix_start").isNull(), d).otherwise(0)).alias("missing_start_us"),
            F.sum(F.when(F.col("fix_end").isNull(), d).otherwise(0)).alias("missing_end_us"),
        )
    )


def frame_union(tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """Per acquisition: frames and time with any selected bin busy, in and outside the guard."""
    d = F.col("f1_us") - F.col("f0_us")
    return (
        frame_activity(selected_tiles(tiles, acquisitions, q))
        .groupBy(*ACQ)
        .agg(
            F.count("*").alias("frames"),
            F.count_if("busy").alias("busy_frames"),
            F.sum(F.when(F.col("busy"), d).otherwise(0)).alias("busy_us"),
            F.sum(F.when(F.col("center_busy"), d).otherwise(0)).alias("center_busy_us"),
            F.sum(F.when(F.col("outside_busy"), d).otherwise(0)).alias("outside_busy_us"),
        )
    )


def cell_time(tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """Per acquisition and bin: clipped busy time from active cells."""
    d = F.col("f1_us") - F.col("f0_us")
    return (
        active_cells(selected_tiles(tiles, acquisitions, q))
        .groupBy(*ACQ, "bin")
        .agg(F.count("*").alias("cells"), F.sum(d).alias("busy_us"), F.bool_or("guarded").alias("guarded"))
    )


def grid_exposure(tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """Every selected bin with its acquisition's observed time.

    Exposure is summed per acquisition, then joined to the grid; tiles are
    never multiplied by bins.
    """
    sel = selected_tiles(tiles, acquisitions, q)
    observed = sel.groupBy(*ACQ).agg(
        F.sum(F.col("to_us") - F.col("from_us")).alias("observed_us"), F.count("*").alias("tiles"), *grid_columns()
    )
    return bin_edges(observed.withColumn("bin", F.explode(F.sequence(F.col("bin_lo"), F.col("bin_hi") - 1))))


def bins_by_frequency(tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """Per session and exact (center, width): active and observed time, mean and peak, over acquisitions."""
    sel = selected_tiles(tiles, acquisitions, q)
    observed = sel.groupBy(*ACQ).agg(
        F.sum(F.col("to_us") - F.col("from_us")).alias("observed_us"), *grid_columns()
    )
    rows = bin_edges(per_bin(sel, ACQ).join(observed, ACQ))
    return merge_bin_totals(
        rows.select(
            "session_id",
            "center_hz",
            F.col("bin_width_hz").alias("width_hz"),
            "observed_us",
            F.col("busy_us").alias("active_us"),
            "power_us",
            "peak",
        )
    )


def merge_bin_totals(partials: DataFrame) -> DataFrame:
    """Merge partial per-bin totals (from acquisitions, resumes or batches); the mean is re-derived."""
    return (
        partials.groupBy("session_id", "center_hz", "width_hz")
        .agg(
            F.sum("observed_us").alias("observed_us"),
            F.sum("active_us").alias("active_us"),
            F.sum("power_us").alias("power_us"),
            F.max("peak").alias("peak"),
        )
        .withColumn("mean_dbfs", dbfs_or_null(ratio(F.col("power_us"), F.col("observed_us"))))
        .withColumn("peak_dbfs", dbfs_or_null(F.col("peak")))
    )


# -- findings over the summaries ------------------------------------------------


def active_ranges(frequency: DataFrame) -> DataFrame:
    """Adjacent active bins as ranges, split where the guard begins or ends."""
    order = Window.partitionBy(*ACQ).orderBy("bin")
    busy = frequency.where("observed_us > 0 and busy_us > 0")
    starts = (F.col("bin") - F.lag("bin").over(order) > 1) | (F.col("guarded") != F.lag("guarded").over(order))
    marked = busy.withColumn("starts", F.coalesce(starts, F.lit(True)).cast("int"))
    return (
        marked.withColumn("range_id", F.sum("starts").over(order))
        .groupBy(*ACQ, "range_id", "guarded")
        .agg(
            F.min("lower_hz").alias("lower_hz"),
            F.max("upper_hz").alias("upper_hz"),
            F.sum("bin_width_hz").alias("span_hz"),
            F.count("*").alias("bins"),
            F.min("observed_us").alias("min_observed_us"),
            (100.0 * F.sum("busy_us") / F.sum("observed_us")).alias("mean_occupancy_pct"),
            (100.0 * F.max(F.col("busy_us") / F.col("observed_us"))).alias("max_occupancy_pct"),
        )
    )


def headline(tiles: DataFrame, acquisitions: DataFrame, gaps: DataFrame, q: SurveyQuery) -> DataFrame:
    """Per acquisition: exposure, any-bin occupancy, mean bin occupancy, gaps, missing GPS, center note."""
    sel = with_frame_states(selected_tiles(tiles, acquisitions, q))
    lo, hi = F.col("from_us"), F.col("to_us")
    d = hi - lo
    union = sel.groupBy(*ACQ).agg(
        F.sum(d).alias("observed_us"),
        F.sum(time_in("busy", lo, hi)).alias("busy_us"),
        F.sum(time_in("outside", lo, hi)).alias("outside_busy_us"),
        F.sum(F.when(F.col("fix_end").isNull(), d).otherwise(0)).alias("missing_position_us"),
    )
    cells = cell_time(tiles, acquisitions, q)
    bins = cells.groupBy(*ACQ).agg(F.sum("busy_us").alias("bin_busy_us"), F.count("*").alias("active_bins"))
    extent = acquisition_extent(tiles, acquisitions, gaps, q)
    start = F.greatest(F.lit(q.start_us), F.col("acq_start_us"))
    end = F.least(F.lit(q.end_us), F.col("acq_end_us"))
    n = F.col("bin_hi") - F.col("bin_lo")
    dominated = (F.col("busy_us") / F.col("observed_us") > 0.95) & (
        F.col("outside_busy_us") / F.col("observed_us") < 0.5
    )
    return (
        extent.join(union, ACQ)
        .join(bins, ACQ, "left")
        .select(
            *ACQ,
            "observed_us",
            percent(F.col("observed_us"), end - start).alias("exposure_pct"),
            percent(F.col("busy_us"), F.col("observed_us")).alias("any_bin_pct"),
            F.when(F.col("outside_available"), percent(F.col("outside_busy_us"), F.col("observed_us"))).alias(
                "outside_pct"
            ),
            percent(F.coalesce("bin_busy_us", F.lit(0)), F.col("observed_us") * n).alias("mean_bin_pct"),
            F.coalesce("active_bins", F.lit(0)).alias("active_bins"),
            n.cast("bigint").alias("bins"),
            "gap_count",
            "gap_us",
            "missing_position_us",
            "excluded_missing_gps_us",
            dominated.alias("center_dominated"),
        )
    )


def measurement_state(frequency: DataFrame) -> DataFrame:
    """Tell observed-quiet from not observed. The three labels are fixed values."""
    return frequency.withColumn(
        "measurement",
        F.when(F.coalesce("observed_us", F.lit(0)) <= 0, "Not measured")
        .when(F.col("busy_us") > 0, "Activity detected")
        .otherwise("No activity above threshold"),
    )


def displayed_ratio(frequency: DataFrame, hide_guard: bool) -> DataFrame:
    """Busy ratio shown per bin: NULL where the guard hides it or nothing was observed."""
    shown = ratio(F.col("busy_us"), F.col("observed_us"))
    if hide_guard:
        shown = F.when(~F.col("guarded"), shown)
    return frequency.withColumn("shown_ratio", shown)


def frame_patterns(tiles: DataFrame, acquisitions: DataFrame, ranges: list[tuple[str, float, float]]) -> DataFrame:
    """Independent audit: group equal frame patterns, then test each against named ranges.

    ``ranges`` is a short list given by the caller; every pattern is tested
    against all of them inside its row.
    """
    every = selected_tiles(tiles, acquisitions, SurveyQuery())
    patterns = (
        every.select(
            *ACQ, "first_center_hz", "bin_width_hz", "bin_count", "guard_lo", "guard_hi",
            ((F.col("end_us") - F.col("start_us")) / F.col("frame_count")).cast("bigint").alias("frame_us"),
            F.explode("activity").alias("pattern"),
        )
        .groupBy(*ACQ, "first_center_hz", "bin_width_hz", "bin_count", "guard_lo", "guard_hi", "frame_us", "pattern")
        .count()
    )
    named = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, a, b in ranges]
    )
    tested = patterns.withColumn("r", F.explode(named))
    center = lambda b: F.col("first_center_hz") + b * F.col("bin_width_hz")
    half = F.col("bin_width_hz") / 2
    chosen = F.filter(
        "pattern", lambda b: (center(b) + half > F.col("r.low")) & (center(b) - half < F.col("r.high"))
    )
    tested = tested.withColumn("chosen", chosen)
    guarded = lambda b: b.between(F.col("guard_lo"), F.col("guard_hi"))
    n, t = F.col("count"), F.col("frame_us")
    return tested.groupBy(*ACQ, F.col("r.name").alias("range_name")).agg(
        F.sum(n).alias("frames"),
        F.sum(n * t).alias("observed_us"),
        F.sum(F.when(F.size("chosen") > 0, n * t).otherwise(0)).alias("busy_us"),
        F.sum(F.when(F.exists("chosen", guarded), n * t).otherwise(0)).alias("center_us"),
        F.sum(F.when(F.exists("chosen", lambda b: ~guarded(b)), n * t).otherwise(0)).alias("outside_us"),
    )


def seconds_columns(df: DataFrame) -> DataFrame:
    """Report form: every ``*_us`` column as ``*_s`` in seconds."""
    return df.select(
        *[seconds(F.col(c)).alias(c[:-3] + "_s") if c.endswith("_us") else F.col(c) for c in df.columns]
    )
