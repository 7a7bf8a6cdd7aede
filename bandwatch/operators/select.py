"""Selections over the survey tables. All are row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwatch.functions import flags
from bandwatch.plans.query import SurveyQuery

GUARD_SLACK_HZ = 1e-5
RSSI_HALF_FILTER_HZ = 117_150


def in_region(fix: str, q: SurveyQuery) -> Column:
    """The fix lies in the query's rectangle; always true without one."""
    if not q.geographic:
        return F.lit(True)
    return F.coalesce(
        F.col(f"{fix}.latitude").between(q.south, q.north) & F.col(f"{fix}.longitude").between(q.west, q.east),
        F.lit(False),
    )


def bin_range(df: DataFrame, lower_hz: float, upper_hz: float) -> DataFrame:
    """First and past-the-last bin of the tile grid that intersect a frequency range."""
    first, width, n = F.col("first_center_hz"), F.col("bin_width_hz"), F.col("bin_count")
    lo, hi = F.lit(0), n
    if lower_hz > 0:
        lo = F.greatest(lo, F.least(n, (F.floor((lower_hz - first) / width - 0.5) + 1).cast("int")))
    if upper_hz > 0:
        hi = F.least(n, F.greatest(F.lit(0), F.ceil((upper_hz - first) / width + 0.5).cast("int")))
    return df.withColumn("bin_lo", lo).withColumn("bin_hi", hi)


def guard_range(df: DataFrame) -> DataFrame:
    """First and last bin within two bin widths of the receiver center."""
    offset, width = F.col("center_hz") - F.col("first_center_hz"), F.col("bin_width_hz")
    reach = 2 * width + GUARD_SLACK_HZ
    return df.withColumn("guard_lo", F.ceil((offset - reach) / width).cast("int")).withColumn(
        "guard_hi", F.floor((offset + reach) / width).cast("int")
    )


def with_center(tiles: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Add the acquisition's receiver center and start to each tile.

    The join strategy is left to AQE: acquisitions are broadcast while they are
    small, and shuffled with skew splitting once they are not.
    """
    config = acquisitions.select(
        "session_id",
        "acq_id",
        "center_hz",
        F.col("start_us").alias("acq_start_us"),
        F.col("end_us").alias("acq_end_us"),
    )
    return tiles.join(config, ["session_id", "acq_id"])


def clip_time(df: DataFrame, q: SurveyQuery, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Keep rows that overlap the time range; ``from_us``/``to_us`` are clipped.

    The comparison on the raw columns reaches the parquet scan.
    """
    if q.start_us > 0:
        df = df.where(F.col(end) > q.start_us)
    if q.elapsed_end > 0:
        df = df.where(F.col(start) < q.end_us)
    return df.withColumn("from_us", F.greatest(F.col(start), F.lit(q.start_us))).withColumn(
        "to_us", F.least(F.col(end), F.lit(q.end_us))
    )


def overlapping_tiles(tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """Tiles that overlap the time range and share a bin with the frequency range."""
    df = with_center(clip_time(tiles, q), acquisitions)
    return guard_range(bin_range(df, q.lower_hz, q.upper_hz)).where("bin_lo < bin_hi")


def selected_tiles(tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """Tiles of a selection, with clipped times, bin range and guard range."""
    return overlapping_tiles(tiles, acquisitions, q).where(in_region("fix_end", q))


def time_extent(tiles: DataFrame, gaps: DataFrame, q: SurveyQuery) -> DataFrame:
    """Per session: the query's time range clamped to what was recorded (tiles and gaps)."""
    spans = tiles.select("session_id", "start_us", "end_us").unionByName(
        gaps.select("session_id", "start_us", "end_us")
    )
    recorded = spans.groupBy("session_id").agg(F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))
    start = F.least(F.greatest(F.lit(q.start_us), F.col("first_us")), F.col("last_us"))
    end = F.least(F.greatest(F.lit(q.end_us), F.col("resolved_start_us")), F.col("last_us"))
    return recorded.withColumn("resolved_start_us", start).withColumn("resolved_end_us", end)


def covered_edges(tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """Per session: outer edges of the selected bins."""
    sel = selected_tiles(tiles, acquisitions, q)
    low = F.col("first_center_hz") + (F.col("bin_lo") - 0.5) * F.col("bin_width_hz")
    high = F.col("first_center_hz") + (F.col("bin_hi") - 0.5) * F.col("bin_width_hz")
    return sel.groupBy("session_id").agg(F.min(low).alias("covered_lower_hz"), F.max(high).alias("covered_upper_hz"))


def default_range(acquisitions: DataFrame) -> DataFrame:
    """Per session: the usable range over all its acquisitions."""
    half = F.col("span_hz") / 2.0
    return acquisitions.groupBy("session_id").agg(
        F.min(F.col("center_hz") - half).alias("usable_lower_hz"),
        F.max(F.col("center_hz") + half).alias("usable_upper_hz"),
    )


def selected_events(events: DataFrame, edges: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """Energy events that overlap the covered band and the raw time range.

    Where no bin was selected the requested range itself is used.
    """
    usable = default_range(acquisitions)
    low = F.coalesce("covered_lower_hz", F.lit(q.lower_hz) if q.lower_hz > 0 else F.col("usable_lower_hz"))
    high = F.coalesce("covered_upper_hz", F.lit(q.upper_hz) if q.upper_hz > 0 else F.col("usable_upper_hz"))
    return (
        events.where((F.col("end_us") > q.start_us) & (F.col("start_us") < q.end_us) & in_region("fix_end", q))
        .join(edges, "session_id", "left")
        .join(usable, "session_id", "left")
        .where((F.col("upper_hz") > low) & (F.col("lower_hz") < high))
        .select(*events.columns)
    )


def in_band_at(df: DataFrame, usable: DataFrame, q: SurveyQuery, center: str, width: str, at: str) -> DataFrame:
    """Point-in-time rows whose band footprint overlaps the frequency range."""
    low = F.lit(q.lower_hz) if q.lower_hz > 0 else F.col("usable_lower_hz")
    high = F.lit(q.upper_hz) if q.upper_hz > 0 else F.col("usable_upper_hz")
    half = F.col(width) / 2.0
    return (
        df.where((F.col(at) >= q.start_us) & (F.col(at) < q.end_us) & in_region("fix", q))
        .join(usable, "session_id")
        .where((F.col(center) + half > low) & (F.col(center) - half < high))
        .select(*df.columns)
    )


def selected_gaps(gaps: DataFrame, q: SurveyQuery) -> DataFrame:
    """Gaps in the time range; gaps have no position, so none under a rectangle."""
    if q.geographic:
        return gaps.where(F.lit(False))
    return gaps.where((F.col("end_us") > q.start_us) & (F.col("start_us") < q.end_us))


def selected_scans(scans: DataFrame, lower_hz: float, upper_hz: float, q: SurveyQuery) -> DataFrame:
    """Histograms whose filter skirt overlaps; partial overlap keeps the whole histogram, flagged."""
    low, high = F.col("frequency_hz") - RSSI_HALF_FILTER_HZ, F.col("frequency_hz") + RSSI_HALF_FILTER_HZ
    partial = (
        (low < lower_hz) | (high > upper_hz) | (F.col("start_us") < q.start_us) | (F.col("end_us") > q.end_us)
    )
    return scans.where(
        (high > lower_hz)
        & (low < upper_hz)
        & (F.col("end_us") > q.start_us)
        & (F.col("start_us") < q.end_us)
        & in_region("fix", q)
    ).withColumn("boundary", partial)


def search_receptions(receptions: DataFrame, text: str) -> DataFrame:
    """Classified receptions whose lane or classification contains a text, in any case."""
    found = F.lower(F.concat_ws(" ", "lane_label", "classification")).contains(text.lower())
    return receptions.where((F.col("status") == flags.STATUS_CLASSIFIED) & found)


def snap_to_bins(bins: DataFrame, lower_hz: float, upper_hz: float) -> DataFrame:
    """Per session: outer edges of the recorded bins a dragged range touches."""
    low, high = F.col("center_hz") - F.col("width_hz") / 2, F.col("center_hz") + F.col("width_hz") / 2
    return (
        bins.where((high > lower_hz) & (low < upper_hz))
        .groupBy("session_id")
        .agg(F.min(low).alias("lower_hz"), F.max(high).alias("upper_hz"))
    )


def fixed_width_range(extent: DataFrame, at_hz: float, width_hz: float) -> DataFrame:
    """A range of fixed width around a clicked frequency, clamped inside the extent."""
    low = F.greatest(
        F.col("lower_hz"), F.least(F.lit(at_hz - width_hz / 2), F.col("upper_hz") - F.lit(width_hz))
    )
    return extent.select(
        "session_id", low.alias("lower_hz"), F.least(F.col("upper_hz"), low + width_hz).alias("upper_hz")
    )


def region_around(observations: DataFrame, degrees: float = 0.001) -> DataFrame:
    """The rectangle of +-``degrees`` around an observation's receiver position."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return observations.where(lat.isNotNull()).select(
        "*",
        F.greatest(F.lit(-90.0), lat - degrees).alias("south"),
        F.least(F.lit(90.0), lat + degrees).alias("north"),
        F.greatest(F.lit(-180.0), lon - degrees).alias("west"),
        F.least(F.lit(180.0), lon + degrees).alias("east"),
    )


def stamp_quality(tiles: DataFrame, sessions: DataFrame) -> DataFrame:
    """Quality bits every recorded tile gets from its session and its fixes."""
    synthetic = sessions.select("session_id", (F.col("source") == "synthetic").alias("synthetic"))
    stamped = (
        F.col("quality")
        .bitwiseOR(F.lit(flags.UNCALIBRATED))
        .bitwiseOR(flags.flag(~F.col("synthetic"), flags.UPSTREAM_LOSS_UNKNOWN))
        .bitwiseOR(
            flags.flag(F.col("fix_start").isNull() | F.col("fix_end").isNull(), flags.POSITION_MISSING)
        )
    )
    return tiles.join(synthetic, "session_id").withColumn("quality", stamped).drop("synthetic")
