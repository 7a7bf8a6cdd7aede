"""Composite report products over a survey's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwatch.functions.power import seconds
from bandwatch.operators import bursts, geo, rssi, sessions, topk
from bandwatch.operators import occupancy as occ
from bandwatch.operators import select as sel
from bandwatch.operators.frames import time_in, with_frame_states
from bandwatch.plans.query import SurveyQuery
from bandwatch.session import written_once
from bandwatch.sources import sinks

KINDS = ["frequency", "time", "geographic", "waveforms", "track", "analysis"]


def analyze(survey, q: SurveyQuery) -> dict[str, DataFrame]:
    """The analysis bundle of one selection. Bursts and acquisitions are written when called (see ``findings``); the rest is lazy."""
    t, a, g = survey.tiles, written_once(survey.acquisitions, "acquisitions"), survey.coverage_gaps
    usable = sel.default_range(a)
    edges = sel.covered_edges(t, a, q)
    events = sel.selected_events(survey.events_energy, edges, a, q)
    waves = sel.in_band_at(survey.waveforms, usable, q, "center_hz", "bandwidth_hz", "delimiter_us")

    def listed(df: DataFrame, order: Column) -> DataFrame:
        """All rows, or the first ones of each session where a display asks for a bound."""
        return topk.capped_with_total(df, ["session_id"], order, q.max_events) if q.max_events else df

    return {
        "totals": occ.totals(t, a, g, q),
        "bins": occ.bins_by_frequency(t, a, q),
        "observations": occ.observations(t, a, g, q),
        "bursts": listed(bursts.find_bursts(t, a, q), F.struct("start_us", "lower_hz")),
        "events": listed(events, F.col("event_id")),
        "waveforms": listed(waves, F.struct(-F.col("waveform_id"), -F.col("version"))),
        "gaps": sel.selected_gaps(g, q),
    }


def report(
    kind: str,
    survey,
    q: SurveyQuery,
    cell_m: float = 100.0,
    include_positions: bool = False,
    decimals: int = 4,
) -> DataFrame:
    """A data report. Acquisitions are scoped by a column, not by a loop."""
    t, a, g = survey.tiles, survey.acquisitions, survey.coverage_gaps
    if kind == "frequency":
        d = occ.frequency_summary(t, a, q).join(_scope(t, a, g, q), occ.ACQ)
    elif kind == "time":
        d = occ.time_summary(t, a, g, q)
    elif kind == "geographic":
        sinks.require_positions(include_positions)
        d = geo.geographic_summary(t, a, q, cell_m, decimals)
    elif kind == "waveforms":
        return waveform_report(survey, q, include_positions, decimals)
    elif kind == "track":
        sinks.require_positions(include_positions)
        track = geo.receiver_track(survey.positions, t, q)
        return sinks.private_positions(track, ["latitude", "longitude"], True, decimals)
    elif kind == "analysis":
        return analysis_report(survey, q, cell_m, include_positions, decimals)
    else:
        raise ValueError(f"unknown report {kind}; one of {', '.join(KINDS)}")
    return sinks.private_positions(d, ["south", "north", "west", "east"], include_positions, decimals)


def _scope(tiles: DataFrame, acquisitions: DataFrame, gaps: DataFrame, q: SurveyQuery) -> DataFrame:
    """Extent, gap time and excluded exposure of each acquisition in the selection."""
    extent = occ.acquisition_extent(tiles, acquisitions, gaps, q)
    return extent.select(*occ.ACQ, "earliest_us", "latest_us", "utc_anchor_us", "gap_us", "excluded_missing_gps_us")


def waveform_report(survey, q: SurveyQuery, include_positions: bool, decimals: int) -> DataFrame:
    usable = sel.default_range(survey.acquisitions)
    w = sel.in_band_at(survey.waveforms, usable, q, "center_hz", "bandwidth_hz", "delimiter_us")
    w = w.withColumn("latitude", F.col("fix.latitude")).withColumn("longitude", F.col("fix.longitude")).drop("fix")
    return sinks.private_positions(w, ["latitude", "longitude"], include_positions, decimals)


def findings(survey, q: SurveyQuery, cell_m: float = 100.0, include_positions: bool = False) -> dict[str, DataFrame]:
    """The tables behind an analysis report.

    Acquisitions meet the tiles in most of them. They are written once, so that Spark knows their size
    and moves them, not the tiles with their power arrays, where they are small.
    """
    t, a, g = survey.tiles, written_once(survey.acquisitions, "acquisitions"), survey.coverage_gaps
    usable = sel.default_range(a)
    frequency = occ.frequency_summary(t, a, q)
    waves = sel.in_band_at(survey.waveforms, usable, q, "center_hz", "bandwidth_hz", "delimiter_us")
    heard = sel.in_band_at(survey.receptions, usable, q, "frequency_hz", "bandwidth_hz", "elapsed_us")
    out = {
        "headline": occ.headline(t, a, g, q),
        "ranges": occ.active_ranges(frequency),
        "busiest_bin": topk.busiest_bin(frequency),
        "bins": occ.measurement_state(frequency),
        "times": topk.busiest_times(occ.time_summary(t, a, g, q)),
        "waveform_groups": sessions.waveform_groups(waves),
        "receptions": sessions.reception_counts(heard),
    }
    if include_positions:
        out["cells"] = topk.busiest_cells(geo.geographic_summary(t, a, q, cell_m))
    return out


def analysis_report(survey, q: SurveyQuery, cell_m: float = 100.0, include_positions: bool = False, decimals: int = 4) -> DataFrame:
    """The findings as one table: (part, session_id, record), the record in JSON."""
    out = None
    for part, df in findings(survey, q, cell_m, include_positions).items():
        df = sinks.private_positions(df, [c for c in ("south", "north", "west", "east") if c in df.columns], include_positions, decimals)
        rows = df.select(F.lit(part).alias("part"), "session_id", F.to_json(F.struct("*")).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


def rssi_report(scans: DataFrame, lower_hz: float, upper_hz: float, q: SurveyQuery) -> dict[str, DataFrame]:
    """Histogram reports: per frequency, per scan, per board."""
    chosen = sel.selected_scans(scans, lower_hz, upper_hz, q)
    frequency = rssi.frequency_summary(chosen)
    return {"frequency": frequency, "scans": rssi.scan_rows(chosen), "boards": rssi.board_rollup(frequency)}


def archive_records(survey) -> dict[str, DataFrame]:
    """All record types of the detailed archive, each with its clock in ``elapsed_us``."""

    def clocked(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("elapsed_us", F.col(column))

    power_free = [c for c in survey.tiles.columns if c not in ("mean_dbfs", "peak_dbfs", "activity")]
    return {
        "session": survey.sessions,
        "acquisition_segment": clocked(survey.acquisitions, "start_us"),
        "spectrum_tile": clocked(survey.tiles.select(*power_free), "start_us"),
        "spectrum_event": clocked(survey.events_energy.drop("mean_dbfs", "peak_dbfs"), "start_us"),
        "coverage_gap": clocked(survey.coverage_gaps, "start_us"),
        "reception": survey.receptions.drop("status"),
        "waveform": clocked(survey.waveforms, "delimiter_us"),
        "receiver_position": clocked(survey.positions, "monotonic_us"),
        "rssi_scan": clocked(survey.rssi_scans, "start_us"),
    }


def tile_features(tiles: DataFrame, decimals: int) -> DataFrame:
    """GeoJSON features, one per tile: observed and busy time, mean and peak of the whole band, quality."""
    whole = (
        tiles.withColumn("bin_lo", F.lit(0))
        .withColumn("bin_hi", F.col("bin_count"))
        .withColumn("guard_lo", F.lit(-2))
        .withColumn("guard_hi", F.lit(-1))
        .withColumn("from_us", F.col("start_us"))
        .withColumn("to_us", F.col("end_us"))
    )

    def band(array: str):
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x / 10.0))

    rows = with_frame_states(whole).select(
        "session_id",
        "tile_id",
        seconds(F.col("end_us") - F.col("start_us")).alias("observed_s"),
        seconds(time_in("busy", F.col("start_us"), F.col("end_us"))).alias("busy_s"),
        (10.0 * F.log10(band("mean_dbfs"))).alias("mean_dbfs"),
        (10.0 * F.log10(band("peak_dbfs"))).alias("peak_dbfs"),
        "quality",
        F.col("fix_end.latitude").alias("latitude"),
        F.col("fix_end.longitude").alias("longitude"),
    )
    properties = ["session_id", "tile_id", "observed_s", "busy_s", "mean_dbfs", "peak_dbfs", "quality"]
    return sinks.geojson_features(rows, "latitude", "longitude", properties, decimals)


def acquisition_scope(tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery) -> DataFrame:
    """Acquisitions a report covers: overlapping in time and band, with selected data.

    Each keeps its own part of the time range, its grid, guard and rate.
    """
    half = F.col("span_hz") / 2.0
    owners = sel.selected_tiles(tiles, acquisitions, q).select(*occ.ACQ)
    a = acquisitions.where((F.col("end_us") > q.start_us) & (F.col("start_us") < q.end_us))
    if q.lower_hz > 0:
        a = a.where(F.col("center_hz") + half > q.lower_hz)
    if q.upper_hz > 0:
        a = a.where(F.col("center_hz") - half < q.upper_hz)
    return (
        a.withColumn("scope_start_us", F.greatest(F.lit(q.start_us), F.col("start_us")))
        .withColumn("scope_end_us", F.least(F.lit(q.end_us), F.col("end_us")))
        .join(owners, occ.ACQ, "left_semi")
    )
