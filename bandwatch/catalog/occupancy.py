"""Occupancy queries: totals, bins, time groups, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwatch.catalog.prelude import (
    SEL_HI_US,
    SEL_LO_US,
    SEL_LOWER_HZ,
    SEL_UPPER_HZ,
    db6,
    pct,
    r6,
)
from bandwatch.catalog.registry import query
from bandwatch.functions import flags
from bandwatch.functions.power import micro, percent, ratio, seconds
from bandwatch.operators import occupancy as occ
from bandwatch.operators import select as sel_ops
from bandwatch.plans.query import SurveyQuery
from bandwatch.sources.testbed import Testbed

SEL = SurveyQuery(
    lower_hz=SEL_LOWER_HZ, upper_hz=SEL_UPPER_HZ, elapsed_start=SEL_LO_US / 1e6, elapsed_end=SEL_HI_US / 1e6,
    time_bucket_s=0.75,
)
RECT = SEL.with_rectangle(40.002, 40.012, -74.9985, -74.992)
RECT_SQL = "end_lat BETWEEN 40.002 AND 40.012 AND end_lon BETWEEN -74.9985 AND -74.992"


def s(name: str, out: str | None = None) -> Column:
    return seconds(F.col(f"{name}_us")).alias(out or f"{name}_s")


def m(name: str) -> Column:
    return micro(F.col(name)).alias(name)


COMMON = """
  SELECT session_id, acq_id, sum(b - a) AS observed_us,
    sum(CASE WHEN end_lat IS NULL THEN b - a ELSE 0 END) AS missing_us,
    sum(CASE WHEN start_us < greatest({lo}, acq_start_us) OR end_us > least({hi}, acq_end_us) THEN b - a ELSE 0 END) AS partial_us,
    sum(power(10.0::DOUBLE, background_dbfs / 10.0::DOUBLE) * (b - a)) AS noise,
    bit_or(quality | CASE WHEN end_lat IS NULL THEN 8 ELSE 0 END
      | CASE WHEN start_us < greatest({lo}, acq_start_us) OR end_us > least({hi}, acq_end_us) THEN 16 ELSE 0 END) AS quality,
    min(least(start_lat, end_lat)) AS south, max(greatest(start_lat, end_lat)) AS north,
    min(least(start_lon, end_lon)) AS west, max(greatest(start_lon, end_lon)) AS east
  FROM sel {where} GROUP BY ALL""".replace("{lo}", str(SEL_LO_US)).replace("{hi}", str(SEL_HI_US))


def frequency_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id", "acq_id", "bin", "lower_hz", "upper_hz", s("observed"), s("busy"), m("occupancy_pct"),
        s("outside_busy"), m("outside_pct"), m("mean_dbfs"), m("peak_dbfs"), m("background_dbfs"),
        s("max_power_support"), s("partial_power"), s("missing_position"), "quality",
        flags.quality_names(F.col("quality")).alias("quality_names"), "south", "north", "west", "east",
    )


QUALITY_SQL = """concat_ws(';', CASE WHEN quality & 1 <> 0 THEN 'uncalibrated' END,
  CASE WHEN quality & 2 <> 0 THEN 'upstream_loss_unknown' END, CASE WHEN quality & 4 <> 0 THEN 'clipped' END,
  CASE WHEN quality & 8 <> 0 THEN 'position_missing' END, CASE WHEN quality & 16 <> 0 THEN 'measurement_boundary' END,
  CASE WHEN quality & 32 <> 0 THEN 'truncated' END, CASE WHEN quality & 64 <> 0 THEN 'merged' END,
  CASE WHEN quality & 128 <> 0 THEN 'background_uncertain' END,
  CASE WHEN quality & 256 <> 0 THEN 'possible_receiver_center_artifact' END,
  CASE WHEN quality & 512 <> 0 THEN 'power_time_aggregated' END)"""


def frequency_sql(where: str = "") -> str:
    keep = f"(SELECT session_id, tile_id FROM sel {where})"
    return f"""
WITH common AS ({COMMON.replace("{where}", where)}),
pw AS (SELECT session_id, acq_id, bin, sum(mean_p * (b - a)) AS p, max(peak_p) AS peak FROM selpower
  WHERE (session_id, tile_id) IN {keep} GROUP BY ALL),
busy AS (SELECT session_id, acq_id, bin, sum(f1 - f0) AS busy_us FROM selcell
  WHERE (session_id, tile_id) IN {keep} GROUP BY ALL)
SELECT pw.session_id, pw.acq_id, CAST(pw.bin AS INTEGER) AS bin, lower_hz, upper_hz, observed_us / 1e6 AS observed_s,
  coalesce(busy_us, 0) / 1e6 AS busy_s, {pct("coalesce(busy_us, 0)", "observed_us")} AS occupancy_pct,
  CASE WHEN NOT guarded THEN coalesce(busy_us, 0) / 1e6 END AS outside_busy_s,
  CASE WHEN NOT guarded THEN {pct("coalesce(busy_us, 0)", "observed_us")} END AS outside_pct,
  {db6("p / observed_us")} AS mean_dbfs, {db6("peak")} AS peak_dbfs, {db6("noise / observed_us")} AS background_dbfs,
  0.02::DOUBLE AS max_power_support_s, partial_us / 1e6 AS partial_power_s, missing_us / 1e6 AS missing_position_s,
  CAST(quality AS INTEGER) AS quality, {QUALITY_SQL} AS quality_names, south, north, west, east
FROM pw JOIN common USING (session_id, acq_id) JOIN selbin USING (acq_id, bin)
LEFT JOIN busy USING (session_id, acq_id, bin)"""


@query("q_ag1_frequency_summary", frequency_sql())
def ag1(t: Testbed) -> DataFrame:
    return frequency_columns(occ.frequency_summary(t.tiles, t.acquisitions, SEL))


@query("q_fp4_rectangle_frequency_summary", frequency_sql(f"WHERE {RECT_SQL}"))
def fp4(t: Testbed) -> DataFrame:
    return frequency_columns(occ.frequency_summary(t.tiles, t.acquisitions, RECT))


@query(
    "q_ag4_survey_totals",
    """
SELECT t.session_id, tile_count, observed_us / 1e6 AS observed_s, busy_us / 1e6 AS busy_s, center_us / 1e6 AS center_busy_s,
  outside_us / 1e6 AS outside_busy_s, observed_us / 1e6 AS outside_observed_s, ms / 1e6 AS missing_start_s,
  me / 1e6 AS missing_end_s, quality
FROM (SELECT session_id, count(*) AS tile_count, sum(b - a) AS observed_us,
    sum(CASE WHEN start_lat IS NULL THEN b - a ELSE 0 END) AS ms, sum(CASE WHEN end_lat IS NULL THEN b - a ELSE 0 END) AS me,
    CAST(bit_or(quality | CASE WHEN end_lat IS NULL THEN 8 ELSE 0 END | CASE WHEN a > start_us OR b < end_us THEN 16 ELSE 0 END) AS INTEGER) AS quality
  FROM sel GROUP BY ALL) t
JOIN (SELECT session_id, sum(CASE WHEN busy THEN f1 - f0 ELSE 0 END) AS busy_us, sum(CASE WHEN center THEN f1 - f0 ELSE 0 END) AS center_us,
    sum(CASE WHEN outside THEN f1 - f0 ELSE 0 END) AS outside_us FROM selunion GROUP BY ALL) u USING (session_id)""",
)
def ag4(t: Testbed) -> DataFrame:
    d = occ.totals(t.tiles, t.acquisitions, t.coverage_gaps, SEL)
    return d.select(
        "session_id", "tile_count", s("observed"), s("busy"), s("center_busy"), s("outside_busy"),
        s("outside_observed"), s("missing_start"), s("missing_end"), "quality",
    )


@query(
    "q_ag24_missing_position",
    """
SELECT session_id, sum(CASE WHEN start_lat IS NULL THEN b - a ELSE 0 END) / 1e6 AS missing_start_s,
  sum(CASE WHEN end_lat IS NULL THEN b - a ELSE 0 END) / 1e6 AS missing_end_s FROM sel GROUP BY ALL""",
)
def ag24(t: Testbed) -> DataFrame:
    d = occ.missing_positions(t.tiles, t.acquisitions, SEL)
    return d.select("session_id", s("missing_start"), s("missing_end"))


BINS_SQL = f"""
SELECT pw.session_id, bin_center_hz AS center_hz, 200.0::DOUBLE AS width_hz, sum(o) / 1e6 AS observed_s, sum(coalesce(busy, 0)) / 1e6 AS active_s,
  {db6("sum(p) / sum(o)")} AS mean_dbfs, {db6("max(peak)")} AS peak_dbfs
FROM (SELECT session_id, acq_id, bin, sum(mean_p * (b - a)) AS p, max(peak_p) AS peak, sum(b - a) AS o FROM selpower GROUP BY ALL) pw
JOIN selbin USING (acq_id, bin)
LEFT JOIN (SELECT session_id, acq_id, bin, sum(f1 - f0) AS busy FROM selcell GROUP BY ALL) USING (session_id, acq_id, bin)
GROUP BY ALL"""


def bins_columns(d: DataFrame) -> DataFrame:
    return d.select(
        "session_id", "center_hz", "width_hz", s("observed"), s("active"), m("mean_dbfs"), m("peak_dbfs")
    )


@query("q_ag5_bins_by_frequency", BINS_SQL)
def ag5(t: Testbed) -> DataFrame:
    return bins_columns(occ.bins_by_frequency(t.tiles, t.acquisitions, SEL))


@query("q_ag9_merged_bin_totals", BINS_SQL)
def ag9(t: Testbed) -> DataFrame:
    """Totals of each half of the session merged again, as after a resume."""
    half = SEL_LO_US + 20_000_000
    parts = []
    for lo, hi in ((SEL_LO_US, half), (half, SEL_HI_US)):
        q = SurveyQuery(SEL_LOWER_HZ, SEL_UPPER_HZ, lo / 1e6, hi / 1e6)
        parts.append(occ.bins_by_frequency(t.tiles, t.acquisitions, q))
    return bins_columns(occ.merge_bin_totals(parts[0].unionByName(parts[1])))


@query(
    "q_ag6_frame_union",
    """
SELECT session_id, acq_id, count(*) AS frames, count(*) FILTER (WHERE busy) AS busy_frames,
  sum(CASE WHEN busy THEN f1 - f0 ELSE 0 END) / 1e6 AS busy_s, sum(CASE WHEN center THEN f1 - f0 ELSE 0 END) / 1e6 AS center_busy_s,
  sum(CASE WHEN outside THEN f1 - f0 ELSE 0 END) / 1e6 AS outside_busy_s
FROM selunion GROUP BY ALL""",
)
def ag6(t: Testbed) -> DataFrame:
    d = occ.frame_union(t.tiles, t.acquisitions, SEL)
    return d.select("session_id", "acq_id", "frames", "busy_frames", s("busy"), s("center_busy"), s("outside_busy"))


@query(
    "q_jn8_cell_time",
    "SELECT session_id, acq_id, CAST(bin AS INTEGER) AS bin, count(*) AS cells, sum(f1 - f0) / 1e6 AS busy_s, bool_or(guarded) AS guarded "
    "FROM selcell GROUP BY ALL",
)
def jn8(t: Testbed) -> DataFrame:
    return occ.cell_time(t.tiles, t.acquisitions, SEL).select("session_id", "acq_id", "bin", "cells", s("busy"), "guarded")


@query(
    "q_jn7_grid_exposure",
    """
SELECT session_id, acq_id, CAST(bin AS INTEGER) AS bin, bin_center_hz AS center_hz, guarded, observed_us / 1e6 AS observed_s
FROM (SELECT session_id, acq_id, sum(b - a) AS observed_us FROM sel GROUP BY ALL) JOIN selbin USING (acq_id)""",
)
def jn7(t: Testbed) -> DataFrame:
    d = occ.grid_exposure(t.tiles, t.acquisitions, SEL)
    return d.select("session_id", "acq_id", "bin", "center_hz", "guarded", s("observed"))


@query(
    "q_fp1_selected_bins",
    """
SELECT session_id, acq_id, min(bin) AS bin_lo, max(bin) + 1 AS bin_hi, min(lower_hz) AS lower_hz, max(upper_hz) AS upper_hz
FROM (SELECT DISTINCT session_id, acq_id FROM sel) JOIN selbin USING (acq_id) GROUP BY ALL""",
)
def fp1(t: Testbed) -> DataFrame:
    g = occ.grids(sel_ops.selected_tiles(t.tiles, t.acquisitions, SEL))
    edge = lambda b: F.col("first_center_hz") + (F.col(b) - 0.5) * F.col("bin_width_hz")
    return g.select(
        "session_id", "acq_id", F.col("bin_lo").cast("bigint"), F.col("bin_hi").cast("bigint"),
        edge("bin_lo").alias("lower_hz"), edge("bin_hi").alias("upper_hz"),
    )


@query(
    "q_fp2_clipped_time",
    "SELECT session_id, tile_id, (b - a) / 1e6 AS exposure_s, a > start_us OR b < end_us AS clipped FROM sel",
)
def fp2(t: Testbed) -> DataFrame:
    d = sel_ops.clip_time(t.tiles, SEL)
    clipped = (F.col("from_us") > F.col("start_us")) | (F.col("to_us") < F.col("end_us"))
    return d.select(
        "session_id", "tile_id", seconds(F.col("to_us") - F.col("from_us")).alias("exposure_s"), clipped.alias("clipped")
    )


@query(
    "q_fp3_time_extent",
    f"""
SELECT session_id, min(start_us) / 1e6 AS first_s, max(end_us) / 1e6 AS last_s,
  least(greatest({SEL_LO_US}, min(start_us)), max(end_us)) / 1e6 AS resolved_start_s,
  least(greatest({SEL_HI_US}, min(start_us)), max(end_us)) / 1e6 AS resolved_end_s
FROM ev GROUP BY ALL""",
)
def fp3(t: Testbed) -> DataFrame:
    d = sel_ops.time_extent(t.tiles, t.coverage_gaps, SEL)
    return d.select("session_id", s("first"), s("last"), s("resolved_start"), s("resolved_end"))


TIME_SQL = f"""
WITH bounds AS (SELECT session_id, acq_id, greatest({SEL_LO_US}, acq_start_us) AS anchor, acq_start_us, acq_end_us FROM acqs
  WHERE acq_end_us > {SEL_LO_US} AND acq_start_us < {SEL_HI_US}),
spans AS (SELECT session_id, acq_id, a, b FROM sel UNION ALL
  SELECT session_id, acq_id, greatest(start_us, {SEL_LO_US}), least(end_us, {SEL_HI_US}) FROM gap
  WHERE end_us > {SEL_LO_US} AND start_us < {SEL_HI_US}),
ext AS (SELECT session_id, acq_id, anchor, min(a) AS e0, max(b) AS e1 FROM spans JOIN bounds USING (session_id, acq_id) GROUP BY ALL),
cal AS (SELECT session_id, acq_id, anchor, e0, e1, unnest(range((e0 - anchor) // 750000, (e1 - 1 - anchor) // 750000 + 1)) AS bucket FROM ext),
edges AS (SELECT *, greatest(e0, anchor + bucket * 750000) AS s0, least(e1, anchor + (bucket + 1) * 750000) AS s1 FROM cal),
nb AS (SELECT acq_id, count(*) AS bins, bool_or(NOT guarded) AS has_outside FROM selbin GROUP BY ALL),
band AS (SELECT session_id, tile_id, sum(mean_p) AS mp, sum(peak_p) AS pp FROM selpower GROUP BY ALL),
piece AS (SELECT e.session_id, e.acq_id, bucket, least(b, anchor + (bucket + 1) * 750000) - greatest(a, anchor + bucket * 750000) AS d,
    mp, pp, power(10.0::DOUBLE, background_dbfs / 10.0::DOUBLE) * bins AS np, quality, end_lat, start_lat, start_lon, end_lon,
    start_us < greatest({SEL_LO_US}, t.acq_start_us) OR end_us > least({SEL_HI_US}, t.acq_end_us)
      OR start_us < anchor + bucket * 750000 OR end_us > anchor + (bucket + 1) * 750000 AS part
  FROM sel t JOIN edges e ON e.session_id = t.session_id AND e.acq_id = t.acq_id
    AND a < anchor + (bucket + 1) * 750000 AND b > anchor + bucket * 750000
  JOIN band ON band.session_id = t.session_id AND band.tile_id = t.tile_id JOIN nb ON nb.acq_id = t.acq_id),
agg AS (SELECT session_id, acq_id, bucket, sum(d) AS o, sum(mp * d) AS p, max(pp) AS pk, sum(np * d) AS np,
    sum(CASE WHEN part THEN d ELSE 0 END) AS partial_us, sum(CASE WHEN end_lat IS NULL THEN d ELSE 0 END) AS missing_us,
    bit_or(quality | CASE WHEN part THEN 16 ELSE 0 END | CASE WHEN end_lat IS NULL THEN 8 ELSE 0 END) AS quality,
    min(least(start_lat, end_lat)) AS south, max(greatest(start_lon, end_lon)) AS east
  FROM piece GROUP BY ALL),
busy AS (SELECT u.session_id, u.acq_id, bucket,
    sum(CASE WHEN busy THEN least(f1, anchor + (bucket + 1) * 750000) - greatest(f0, anchor + bucket * 750000) ELSE 0 END) AS busy_us,
    sum(CASE WHEN outside THEN least(f1, anchor + (bucket + 1) * 750000) - greatest(f0, anchor + bucket * 750000) ELSE 0 END) AS outside_us
  FROM selunion u JOIN edges e ON e.session_id = u.session_id AND e.acq_id = u.acq_id
    AND f0 < anchor + (bucket + 1) * 750000 AND f1 > anchor + bucket * 750000 GROUP BY ALL)
SELECT e.session_id, e.acq_id, e.bucket, s0 / 1e6 AS elapsed_start_s, s1 / 1e6 AS elapsed_end_s, coalesce(o, 0) / 1e6 AS observed_s,
  coalesce(busy_us, 0) / 1e6 AS busy_s, {pct("busy_us", "o")} AS occupancy_pct,
  CASE WHEN has_outside THEN coalesce(outside_us, 0) / 1e6 END AS outside_busy_s,
  CASE WHEN has_outside THEN {pct("outside_us", "o")} END AS outside_pct,
  {db6("p / o")} AS mean_dbfs, {db6("pk")} AS peak_dbfs, {db6("np / o")} AS background_dbfs,
  coalesce(partial_us, 0) / 1e6 AS partial_power_s, coalesce(missing_us, 0) / 1e6 AS missing_position_s,
  CAST(coalesce(quality, 0) AS INTEGER) AS quality, south, east
FROM edges e JOIN nb USING (acq_id) LEFT JOIN agg USING (session_id, acq_id, bucket) LEFT JOIN busy USING (session_id, acq_id, bucket)"""


@query("q_ag2_time_summary", TIME_SQL)
def ag2(t: Testbed) -> DataFrame:
    d = occ.time_summary(t.tiles, t.acquisitions, t.coverage_gaps, SEL)
    return d.select(
        "session_id", "acq_id", "bucket", s("elapsed_start"), s("elapsed_end"), s("observed"), s("busy"),
        m("occupancy_pct"), s("outside_busy"), m("outside_pct"), m("mean_dbfs"), m("peak_dbfs"), m("background_dbfs"),
        s("partial_power"), s("missing_position"), "quality", "south", "east",
    )


# Display buckets: at most 40, so the width grows. Widths per session, in whole microseconds.
OBS = SurveyQuery(
    lower_hz=SEL_LOWER_HZ, upper_hz=SEL_UPPER_HZ, elapsed_start=SEL_LO_US / 1e6, elapsed_end=SEL_HI_US / 1e6,
    time_bucket_s=0.75, max_observations=40,
)


@query(
    "q_ag7_display_observations",
    f"""
WITH ext AS (SELECT session_id, least(greatest({SEL_LO_US}, min(start_us)), max(end_us)) AS r0,
    least(greatest({SEL_HI_US}, min(start_us)), max(end_us)) AS r1 FROM ev GROUP BY ALL),
w AS (SELECT *, greatest(750000, (r1 - r0 + 39) // 40) AS w FROM ext),
nb AS (SELECT acq_id, count(*) AS bins FROM selbin GROUP BY ALL),
band AS (SELECT session_id, tile_id, sum(mean_p) AS mp, sum(peak_p) AS pp FROM selpower GROUP BY ALL),
piece AS (SELECT t.session_id, t.acq_id, t.tile_id, t.start_us, unnest(range((a - r0) // w, (b - 1 - r0) // w + 1)) AS bucket, r0, r1, w, a, b, t.end_us, mp, pp,
    power(10.0::DOUBLE, background_dbfs / 10.0::DOUBLE) * bins AS np, end_lat, end_lon,
    quality | CASE WHEN end_lat IS NULL THEN 8 ELSE 0 END | CASE WHEN a > t.start_us OR b < t.end_us THEN 16 ELSE 0 END AS q
  FROM sel t JOIN w ON w.session_id = t.session_id JOIN band ON band.session_id = t.session_id AND band.tile_id = t.tile_id
  JOIN nb ON nb.acq_id = t.acq_id),
cut AS (SELECT *, greatest(a, r0 + bucket * w) AS p0, least(b, r0 + (bucket + 1) * w) AS p1,
    lag(end_lat) OVER win AS plat, lag(end_lon) OVER win AS plon
  FROM piece WINDOW win AS (PARTITION BY session_id, bucket ORDER BY start_us)),
agg AS (SELECT session_id, bucket, min(p0) AS e0, max(p1) AS e1, sum(p1 - p0) AS o, sum(mp * (p1 - p0)) AS p, max(pp) AS pk,
    sum(np * (p1 - p0)) AS np, arg_max(struct_pack(lat := end_lat, lon := end_lon), start_us) AS fix,
    bit_or(q | CASE WHEN plat IS NOT NULL AND end_lat IS NOT NULL AND (plat <> end_lat OR plon <> end_lon) THEN 64 ELSE 0 END
      | CASE WHEN r0 + bucket * w > start_us OR least(r0 + (bucket + 1) * w, r1) < end_us THEN 16 ELSE 0 END) AS quality
  FROM cut GROUP BY ALL),
busy AS (SELECT u.session_id, bucket,
    sum(CASE WHEN busy THEN least(f1, r0 + (bucket + 1) * w) - greatest(f0, r0 + bucket * w) ELSE 0 END) AS busy_us,
    sum(CASE WHEN center THEN least(f1, r0 + (bucket + 1) * w) - greatest(f0, r0 + bucket * w) ELSE 0 END) AS center_us,
    sum(CASE WHEN outside THEN least(f1, r0 + (bucket + 1) * w) - greatest(f0, r0 + bucket * w) ELSE 0 END) AS outside_us
  FROM (SELECT u.*, r0, w, unnest(range((f0 - r0) // w, (f1 - 1 - r0) // w + 1)) AS bucket FROM selunion u JOIN w USING (session_id)) u
  GROUP BY ALL)
SELECT session_id, bucket, e0 / 1e6 AS elapsed_start_s, e1 / 1e6 AS elapsed_end_s, o / 1e6 AS observed_s, busy_us / 1e6 AS busy_s,
  center_us / 1e6 AS center_busy_s, outside_us / 1e6 AS outside_busy_s, CAST(quality AS INTEGER) AS quality,
  {db6("p / o")} AS mean_dbfs, {db6("pk")} AS peak_dbfs, {db6("np / o")} AS background_dbfs, fix.lat AS latitude, fix.lon AS longitude
FROM agg JOIN busy USING (session_id, bucket)""",
)
def ag7(t: Testbed) -> DataFrame:
    d = occ.observations(t.tiles, t.acquisitions, t.coverage_gaps, OBS)
    return d.select(
        "session_id", "bucket", s("elapsed_start"), s("elapsed_end"), s("observed"), s("busy"), s("center_busy"),
        s("outside_busy"), "quality", m("mean_dbfs"), m("peak_dbfs"), m("background_dbfs"),
        F.col("fix.latitude").alias("latitude"), F.col("fix.longitude").alias("longitude"),
    )


# Busy time per bin, used by the findings below.
FREQ_SQL = """
freq AS (SELECT session_id, acq_id, bin, guarded, lower_hz, upper_hz, observed_us, coalesce(busy_us, 0) AS busy_us
  FROM (SELECT session_id, acq_id, sum(b - a) AS observed_us FROM sel GROUP BY ALL) JOIN selbin USING (acq_id)
  LEFT JOIN (SELECT session_id, acq_id, bin, sum(f1 - f0) AS busy_us FROM selcell GROUP BY ALL) USING (session_id, acq_id, bin))"""


@query(
    "q_ag17_active_ranges",
    f"""
WITH {FREQ_SQL},
marked AS (SELECT *, CASE WHEN lag(bin) OVER w IS NULL OR bin - lag(bin) OVER w > 1 OR guarded <> lag(guarded) OVER w THEN 1 ELSE 0 END AS st
  FROM freq WHERE busy_us > 0 WINDOW w AS (PARTITION BY session_id, acq_id ORDER BY bin)),
run AS (SELECT *, sum(st) OVER (PARTITION BY session_id, acq_id ORDER BY bin) AS rid FROM marked)
SELECT session_id, acq_id, CAST(rid AS BIGINT) AS range_id, guarded, min(lower_hz) AS lower_hz, max(upper_hz) AS upper_hz,
  count(*) * 200.0::DOUBLE AS span_hz, count(*) AS bins, min(observed_us) / 1e6 AS min_observed_s,
  {r6("100.0::DOUBLE * sum(busy_us) / sum(observed_us)")} AS mean_occupancy_pct,
  {r6("100.0::DOUBLE * max(CAST(busy_us AS DOUBLE) / observed_us)")} AS max_occupancy_pct
FROM run GROUP BY ALL""",
)
def ag17(t: Testbed) -> DataFrame:
    d = occ.active_ranges(occ.frequency_summary(t.tiles, t.acquisitions, SEL))
    return d.select(
        "session_id", "acq_id", "range_id", "guarded", "lower_hz", "upper_hz", "span_hz", "bins", s("min_observed"),
        m("mean_occupancy_pct"), m("max_occupancy_pct"),
    )


@query(
    "q_ag18_headline",
    f"""
WITH {FREQ_SQL},
u AS (SELECT session_id, acq_id, sum(CASE WHEN busy THEN f1 - f0 ELSE 0 END) AS busy_us,
    sum(CASE WHEN outside THEN f1 - f0 ELSE 0 END) AS outside_us FROM selunion GROUP BY ALL),
o AS (SELECT session_id, acq_id, acq_start_us, acq_end_us, sum(b - a) AS o,
    sum(CASE WHEN end_lat IS NULL THEN b - a ELSE 0 END) AS miss FROM sel GROUP BY ALL),
fb AS (SELECT session_id, acq_id, sum(busy_us) AS bb, sum(observed_us) AS bo, count(*) AS bins,
    count(*) FILTER (WHERE busy_us > 0) AS active FROM freq GROUP BY ALL),
g AS (SELECT session_id, acq_id, count(*) AS n, sum(least(end_us, {SEL_HI_US}) - greatest(start_us, {SEL_LO_US})) AS us
  FROM gap WHERE end_us > {SEL_LO_US} AND start_us < {SEL_HI_US} GROUP BY ALL)
SELECT session_id, acq_id, o / 1e6 AS observed_s,
  {pct("o", f"(least({SEL_HI_US}, acq_end_us) - greatest({SEL_LO_US}, acq_start_us))")} AS exposure_pct,
  {pct("busy_us", "o")} AS any_bin_pct, {pct("outside_us", "o")} AS outside_pct, {pct("bb", "bo")} AS mean_bin_pct,
  active AS active_bins, bins, coalesce(n, 0) AS gap_count, coalesce(us, 0) / 1e6 AS gap_s, miss / 1e6 AS missing_position_s,
  CAST(busy_us AS DOUBLE) / o > 0.95 AND CAST(outside_us AS DOUBLE) / o < 0.5 AS center_dominated
FROM o JOIN u USING (session_id, acq_id) JOIN fb USING (session_id, acq_id) LEFT JOIN g USING (session_id, acq_id)""",
)
def ag18(t: Testbed) -> DataFrame:
    d = occ.headline(t.tiles, t.acquisitions, t.coverage_gaps, SEL)
    return d.select(
        "session_id", "acq_id", s("observed"), m("exposure_pct"), m("any_bin_pct"), m("outside_pct"),
        m("mean_bin_pct"), "active_bins", "bins", "gap_count", s("gap"), s("missing_position"), "center_dominated",
    )


@query(
    "q_ag19_frame_pattern_audit",
    """
WITH r(range_name, lo, hi) AS (VALUES ('low edge', 906868000.0::DOUBLE, 906870100.0::DOUBLE), ('middle', 906873000.0::DOUBLE, 906884000.0::DOUBLE)),
hit AS (SELECT session_id, acq_id, tile_id, f, range_name, bool_or(guarded) AS c, bool_or(NOT guarded) AS o
  FROM (SELECT cell.*, start_us // 20000 AS tile_id FROM cell) cell JOIN r ON bin_center_hz + 100 > lo AND bin_center_hz - 100 < hi GROUP BY ALL),
allf AS (SELECT session_id, acq_id, range_name, count(*) * 4 AS frames FROM tile, r GROUP BY ALL)
SELECT session_id, acq_id, range_name, frames, frames * 5000 / 1e6 AS observed_s, coalesce(h.busy, 0) * 5000 / 1e6 AS busy_s,
  coalesce(h.center, 0) * 5000 / 1e6 AS center_s, coalesce(h.outside, 0) * 5000 / 1e6 AS outside_s
FROM allf LEFT JOIN (SELECT session_id, acq_id, range_name, count(*) AS busy, count(*) FILTER (WHERE c) AS center,
  count(*) FILTER (WHERE o) AS outside FROM hit GROUP BY ALL) h USING (session_id, acq_id, range_name)""".replace(
        "SELECT cell.*, start_us // 20000 AS tile_id FROM cell", "SELECT session_id, acq_id, f, guarded, bin_center_hz, start_us // 20000 AS tile_id FROM cell"
    ),
)
def ag19(t: Testbed) -> DataFrame:
    ranges = [("low edge", 906_868_000.0, 906_870_100.0), ("middle", 906_873_000.0, 906_884_000.0)]
    d = occ.frame_patterns(t.tiles, t.acquisitions, ranges)
    return d.select(
        "session_id", "acq_id", "range_name", "frames", s("observed"), s("busy"), s("center"), s("outside")
    )


@query(
    "q_ag27_measurement_state",
    f"""
WITH {FREQ_SQL} SELECT session_id, acq_id, CAST(bin AS INTEGER) AS bin, CASE WHEN observed_us <= 0 THEN 'Not measured'
  WHEN busy_us > 0 THEN 'Activity detected' ELSE 'No activity above threshold' END AS measurement FROM freq""",
)
def ag27(t: Testbed) -> DataFrame:
    d = occ.measurement_state(occ.frequency_summary(t.tiles, t.acquisitions, SEL))
    return d.select("session_id", "acq_id", "bin", "measurement")


@query(
    "q_wn12_displayed_ratio",
    f"""
WITH {FREQ_SQL} SELECT session_id, acq_id, CAST(bin AS INTEGER) AS bin,
  CASE WHEN NOT guarded THEN {r6("CAST(busy_us AS DOUBLE) / observed_us")} END AS shown_ratio FROM freq""",
)
def wn12(t: Testbed) -> DataFrame:
    d = occ.displayed_ratio(occ.frequency_summary(t.tiles, t.acquisitions, SEL), hide_guard=True)
    return d.select("session_id", "acq_id", "bin", m("shown_ratio"))


@query(
    "q_wn1_split_buckets",
    f"""
SELECT session_id, bucket, sum(least(b, (bucket + 1) * 35000) - greatest(a, bucket * 35000)) / 1e6 AS observed_s, count(*) AS pieces
FROM (SELECT session_id, a, b, unnest(range(a // 35000, (b - 1) // 35000 + 1)) AS bucket FROM sel) GROUP BY ALL""",
)
def wn1(t: Testbed) -> DataFrame:
    d = occ.split_buckets(sel_ops.clip_time(t.tiles, SEL), F.lit(0), F.lit(35_000))
    length = F.col("piece_end_us") - F.col("piece_start_us")
    return d.groupBy("session_id", "bucket").agg(
        seconds(F.sum(length)).alias("observed_s"), F.count("*").alias("pieces")
    )


@query(
    "q_ag25_fix_bounds",
    """
SELECT session_id, min(least(start_lat, end_lat)) AS south, max(greatest(start_lat, end_lat)) AS north,
  min(least(start_lon, end_lon)) AS west, max(greatest(start_lon, end_lon)) AS east FROM sel GROUP BY ALL""",
)
def ag25(t: Testbed) -> DataFrame:
    return sel_ops.clip_time(t.tiles, SEL).groupBy("session_id").agg(*occ.fix_bounds())


@query(
    "q_fp5_selected_events",
    f"""
WITH edge AS (SELECT session_id, min(lower_hz) AS lo, max(upper_hz) AS hi
  FROM (SELECT DISTINCT session_id, acq_id FROM sel WHERE {RECT_SQL}) JOIN selbin USING (acq_id) GROUP BY ALL)
SELECT n.session_id, event_id, n.lower_hz, n.upper_hz FROM nrg n LEFT JOIN edge USING (session_id)
WHERE end_us > {SEL_LO_US} AND start_us < {SEL_HI_US} AND {RECT_SQL}
  AND n.upper_hz > coalesce(lo, {SEL_LOWER_HZ}) AND n.lower_hz < coalesce(hi, {SEL_UPPER_HZ})
  AND session_id IN (SELECT session_id FROM acqs)""",
)
def fp5(t: Testbed) -> DataFrame:
    edges = sel_ops.covered_edges(t.tiles, t.acquisitions, RECT)
    d = sel_ops.selected_events(t.events_energy, edges, t.acquisitions, RECT)
    known = t.acquisitions.select("session_id").distinct()
    return d.join(known, "session_id", "left_semi").select("session_id", "event_id", "lower_hz", "upper_hz")


WAVE_SEL = f"""center_hz + bandwidth_hz / 2.0::DOUBLE > {SEL_LOWER_HZ} AND center_hz - bandwidth_hz / 2.0::DOUBLE < {SEL_UPPER_HZ}
  AND {{at}} >= {SEL_LO_US} AND {{at}} < {SEL_HI_US} AND session_id IN (SELECT session_id FROM acqs)"""


@query("q_fp6_selected_waveforms", f"SELECT session_id, waveform_id, version, center_hz FROM wave WHERE {WAVE_SEL.format(at='delimiter_us')}")
def fp6(t: Testbed) -> DataFrame:
    usable = sel_ops.default_range(t.acquisitions)
    d = sel_ops.in_band_at(t.waveforms, usable, SEL, "center_hz", "bandwidth_hz", "delimiter_us")
    return d.select("session_id", "waveform_id", "version", "center_hz")


@query(
    "q_fp7_selected_gaps",
    f"SELECT session_id, gap_id, reason FROM gap WHERE end_us > {SEL_LO_US} AND start_us < {SEL_HI_US}",
)
def fp7(t: Testbed) -> DataFrame:
    return sel_ops.selected_gaps(t.coverage_gaps, SEL).select("session_id", "gap_id", "reason")


@query(
    "q_fp9_reception_search",
    """SELECT session_id, reception_id, lane_label, classification FROM rec
WHERE status = 0 AND contains(lower(lane_label || ' ' || classification), 'lane 2 likely')""",
)
def fp9(t: Testbed) -> DataFrame:
    d = sel_ops.search_receptions(t.receptions, "Lane 2 LIKELY")
    return d.select("session_id", "reception_id", "lane_label", "classification")


@query(
    "q_fp10_snapped_range",
    f"""
WITH r AS (SELECT session_id, min(lower_hz) AS lower_hz, max(upper_hz) AS upper_hz
  FROM (SELECT DISTINCT session_id, acq_id FROM sel) JOIN selbin USING (acq_id)
  WHERE upper_hz > 906872345 AND lower_hz < 906879876 GROUP BY ALL)
SELECT session_id, lower_hz, upper_hz, greatest(lower_hz, least(906875000 - 600.0::DOUBLE, upper_hz - 1200)) AS click_lower_hz,
  least(upper_hz, greatest(lower_hz, least(906875000 - 600.0::DOUBLE, upper_hz - 1200)) + 1200) AS click_upper_hz FROM r""",
)
def fp10(t: Testbed) -> DataFrame:
    bins = occ.grid_exposure(t.tiles, t.acquisitions, SEL).withColumn("width_hz", F.col("bin_width_hz"))
    snapped = sel_ops.snap_to_bins(bins, 906_872_345, 906_879_876)
    click = sel_ops.fixed_width_range(snapped, 906_875_000, 1_200).select(
        "session_id", F.col("lower_hz").alias("click_lower_hz"), F.col("upper_hz").alias("click_upper_hz")
    )
    return snapped.join(click, "session_id")


@query(
    "q_fp13_stamped_quality",
    """SELECT session_id, tile_id, CAST(quality | 1 | CASE WHEN session_id % 2 <> 0 THEN 2 ELSE 0 END
  | CASE WHEN start_lat IS NULL OR end_lat IS NULL THEN 8 ELSE 0 END AS INTEGER) AS quality FROM tile""",
)
def fp13(t: Testbed) -> DataFrame:
    return sel_ops.stamp_quality(t.tiles, t.sessions).select("session_id", "tile_id", "quality")
