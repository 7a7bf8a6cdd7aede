"""Geographic and sampled-RSSI queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.catalog.occupancy import OBS, QUALITY_SQL, RECT_SQL, SEL, m, s
from bandwatch.catalog.prelude import SEL_HI_US, SEL_LO_US, db6, pct, r6
from bandwatch.catalog.registry import query
from bandwatch.functions import flags
from bandwatch.functions.power import micro, round_half_away, seconds
from bandwatch.operators import geo, rssi, topk
from bandwatch.operators import occupancy as occ
from bandwatch.operators import select as sel_ops
from bandwatch.plans.query import SurveyQuery
from bandwatch.sources.testbed import Testbed

CELL_M = 250.0
RAD = "0.017453292519943295::DOUBLE"
STEP = f"({CELL_M}::DOUBLE / (6371008.8::DOUBLE * {RAD}))"


def cell_sql(lat: str, lon: str) -> tuple[str, str]:
    """Row and column of the metric cell of a position."""
    row = f"CAST(least(ceil(180 / {STEP}) - 1, greatest(0, floor(({lat} + 90) / {STEP}))) AS BIGINT)"
    south = f"(-90 + {row} * {STEP})"
    mid = f"(({south} + least(90.0::DOUBLE, {south} + {STEP})) / 2 * {RAD})"
    columns = f"greatest(1, CAST(ceil(2 * pi() * 6371008.8::DOUBLE * cos{mid} / {CELL_M}::DOUBLE) AS BIGINT))"
    folded = f"(CASE WHEN {lon} = 180 THEN -180.0::DOUBLE ELSE {lon} END)"
    column = f"CAST(least({columns} - 1, greatest(0, floor(({folded} + 180) / 360 * {columns}))) AS BIGINT)"
    return f"CASE WHEN {lat} IS NOT NULL THEN {row} END", f"CASE WHEN {lat} IS NOT NULL THEN {column} END"


ER, EC = cell_sql("end_lat", "end_lon")
SR, SC = cell_sql("start_lat", "start_lon")
PLACED = f"""
placed AS (SELECT *, {ER} AS cell_row, {EC} AS cell_column,
  ({ER}) IS DISTINCT FROM ({SR}) OR ({EC}) IS DISTINCT FROM ({SC}) AS crossing FROM sel)"""


@query(
    "q_ge1_metric_cells",
    f"""
WITH p AS (SELECT session_id, seq, {cell_sql('latitude', 'longitude')[0]} AS cell_row, {cell_sql('latitude', 'longitude')[1]} AS cell_column FROM pos)
SELECT session_id, seq, cell_row, cell_column, {r6(f'-90 + cell_row * {STEP}')} AS south FROM p""",
)
def ge1(t: Testbed) -> DataFrame:
    d = t.positions.withColumn("cell", geo.metric_cell(F.col("latitude"), F.col("longitude"), CELL_M))
    return d.select(
        "session_id", "seq", F.col("cell.row").alias("cell_row"), F.col("cell.column").alias("cell_column"),
        micro(F.col("cell.south")).alias("south"),
    )


@query(
    "q_ge2_cell_crossings",
    f"""
WITH {PLACED} SELECT session_id, acq_id, cell_row, cell_column, sum(b - a) / 1e6 AS observed_s,
  sum(CASE WHEN crossing THEN b - a ELSE 0 END) / 1e6 AS crossing_s FROM placed GROUP BY ALL""",
)
def ge2(t: Testbed) -> DataFrame:
    return occ.seconds_columns(geo.crossings(t.tiles, t.acquisitions, SEL, CELL_M))


GEO_SQL = f"""
WITH {PLACED},
c AS (SELECT session_id, acq_id, cell_row, cell_column, sum(b - a) AS o, sum(CASE WHEN crossing THEN b - a ELSE 0 END) AS x,
    sum(CASE WHEN end_lat IS NULL THEN b - a ELSE 0 END) AS miss,
    bit_or(quality | CASE WHEN end_lat IS NULL THEN 8 ELSE 0 END
      | CASE WHEN crossing OR start_us < greatest({SEL_LO_US}, acq_start_us) OR end_us > least({SEL_HI_US}, acq_end_us) THEN 16 ELSE 0 END) AS quality
  FROM placed GROUP BY ALL),
pw AS (SELECT p.session_id, p.acq_id, cell_row, cell_column, bin, sum(mean_p * (p.b - p.a)) AS p, max(peak_p) AS pk
  FROM placed p JOIN selpower s ON s.session_id = p.session_id AND s.tile_id = p.tile_id GROUP BY ALL),
bz AS (SELECT p.session_id, p.acq_id, cell_row, cell_column, bin, sum(f1 - f0) AS busy
  FROM placed p JOIN selcell s ON s.session_id = p.session_id AND s.tile_id = p.tile_id GROUP BY ALL),
geo AS (SELECT pw.session_id, pw.acq_id, pw.cell_row, pw.cell_column, pw.bin, guarded, lower_hz, o, x, miss, quality, p, pk, coalesce(busy, 0) AS busy
  FROM pw JOIN c ON c.session_id = pw.session_id AND c.acq_id = pw.acq_id AND c.cell_row IS NOT DISTINCT FROM pw.cell_row AND c.cell_column IS NOT DISTINCT FROM pw.cell_column
  LEFT JOIN bz ON bz.session_id = pw.session_id AND bz.acq_id = pw.acq_id AND bz.cell_row IS NOT DISTINCT FROM pw.cell_row AND bz.cell_column IS NOT DISTINCT FROM pw.cell_column AND bz.bin = pw.bin
  JOIN selbin ON selbin.acq_id = pw.acq_id AND selbin.bin = pw.bin)"""


@query(
    "q_ag3_geographic_summary",
    GEO_SQL
    + f"""
SELECT session_id, acq_id, cell_row, cell_column, CAST(bin AS INTEGER) AS bin, cell_row IS NOT NULL AS located, o / 1e6 AS observed_s, busy / 1e6 AS busy_s,
  {pct('busy', 'o')} AS occupancy_pct, CASE WHEN NOT guarded THEN {pct('busy', 'o')} END AS outside_pct, {db6('p / o')} AS mean_dbfs, {db6('pk')} AS peak_dbfs,
  x / 1e6 AS crossing_s, miss / 1e6 AS missing_position_s, CAST(quality AS INTEGER) AS quality FROM geo""",
)
def ag3(t: Testbed) -> DataFrame:
    d = geo.geographic_summary(t.tiles, t.acquisitions, SEL, CELL_M)
    return d.select(
        "session_id", "acq_id", "cell_row", "cell_column", "bin", "located", s("observed"), s("busy"), m("occupancy_pct"),
        m("outside_pct"), m("mean_dbfs"), m("peak_dbfs"), s("crossing"), s("missing_position"), "quality",
    )


@query(
    "q_tk3_busiest_cells",
    GEO_SQL
    + f""",
best AS (SELECT session_id, acq_id, cell_row, cell_column, bin, lower_hz + 100 AS center_hz, busy, o, x FROM geo WHERE cell_row IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_id, acq_id, cell_row, cell_column ORDER BY busy DESC, bin) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, acq_id ORDER BY CAST(busy AS DOUBLE) / o DESC, cell_row, cell_column) AS rank FROM best)
SELECT session_id, acq_id, CAST(rank AS INTEGER) AS rank, cell_row, cell_column, CAST(bin AS INTEGER) AS bin, center_hz,
  {r6('100.0::DOUBLE * (CAST(busy AS DOUBLE) / o)')} AS occupancy_pct, o / 1e6 AS observed_s, x / 1e6 AS crossing_s FROM r WHERE rank <= 20""",
)
def tk3(t: Testbed) -> DataFrame:
    d = topk.busiest_cells(geo.geographic_summary(t.tiles, t.acquisitions, SEL, CELL_M), 20)
    return d.select(
        "session_id", "acq_id", "rank", "cell_row", "cell_column", "bin", "center_hz", m("occupancy_pct"), s("observed"),
        s("crossing"),
    )


# Positions moved to the date line, so that extents have to cut the circle.
FAR = "(CASE WHEN session_id % 2 = 0 THEN longitude ELSE ((longitude + 75) * 40 + 359.9::DOUBLE) % 360 - CASE WHEN ((longitude + 75) * 40 + 359.9::DOUBLE) % 360 > 180 THEN 360 ELSE 0 END END)"


def far(t: Testbed) -> DataFrame:
    moved = ((F.col("longitude") + 75) * 40 + 359.9) % 360
    moved = moved - F.when(moved > 180, 360).otherwise(0)
    return t.positions.withColumn("longitude", F.when(F.col("session_id") % 2 == 0, F.col("longitude")).otherwise(moved))


EXTENT_SQL = f"""
fp AS (SELECT session_id, seq, latitude, {FAR} AS longitude FROM pos WHERE valid),
lons AS (SELECT DISTINCT session_id, CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END AS lon FROM fp),
nx AS (SELECT session_id, lon, coalesce(lead(lon) OVER w, first_value(lon) OVER w + 360) AS nx FROM lons WINDOW w AS (PARTITION BY session_id ORDER BY lon ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cut AS (SELECT session_id, nx - lon AS g, nx FROM nx QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY nx - lon DESC, nx) = 1),
sp AS (SELECT session_id, min(latitude) AS south, max(latitude) AS north, count(*) AS fixes FROM fp GROUP BY ALL),
ext0 AS (SELECT session_id, south, north, fixes, 360 - g AS arc, (nx % 360 + (360 - g) / 2 + 180) % 360 - 180 AS rlon, (south + north) / 2 AS rlat FROM sp JOIN cut USING (session_id))"""


@query(
    "q_ge3_extent",
    f"""
WITH {EXTENT_SQL} SELECT session_id, fixes, {r6('rlat')} AS reference_latitude, {r6('rlon')} AS reference_longitude,
  {r6(f'arc * cos(rlat * {RAD}) * 6371008.8::DOUBLE * {RAD}')} AS east_west_m, {r6(f'(north - south) * 6371008.8::DOUBLE * {RAD}')} AS north_south_m FROM ext0""",
)
def ge3(t: Testbed) -> DataFrame:
    d = geo.extent(far(t))
    return d.select("session_id", "fixes", m("reference_latitude"), m("reference_longitude"), m("east_west_m"), m("north_south_m"))


@query(
    "q_ge4_mean_position",
    f"""
WITH {EXTENT_SQL} SELECT session_id, {r6('avg(latitude)')} AS mean_latitude,
  {r6('((rlon + avg((longitude - rlon + 540) % 360 - 180)) + 540) % 360 - 180')} AS mean_longitude FROM fp JOIN ext0 USING (session_id) GROUP BY session_id, rlon""",
)
def ge4(t: Testbed) -> DataFrame:
    d = geo.mean_position(far(t), geo.extent(far(t)))
    return d.select("session_id", m("mean_latitude"), m("mean_longitude"))


@query(
    "q_ge5_projection",
    f"""
WITH {EXTENT_SQL} SELECT session_id, seq, floor(((longitude - rlon + 540) % 360 - 180) * cos(rlat * {RAD}) * 6371008.8::DOUBLE * {RAD} * 1e3 + 0.5) / 1e3 AS east_m,
  floor((latitude - rlat) * 6371008.8::DOUBLE * {RAD} * 1e3 + 0.5) / 1e3 AS north_m FROM fp JOIN ext0 USING (session_id)""",
)
def ge5(t: Testbed) -> DataFrame:
    d = geo.projected(far(t), geo.extent(far(t)))
    mm = [(F.floor(F.col(c) * 1e3 + 0.5) / 1e3).alias(c) for c in ("east_m", "north_m")]
    return d.select("session_id", "seq", *mm)


@query(
    "q_ge6_scale_length",
    """
WITH q AS (SELECT session_id, event_id, (upper_hz - lower_hz) * event_id / 4 AS x FROM nrg), d AS (SELECT *, power(10.0::DOUBLE, floor(log10(x))) AS dec FROM q)
SELECT session_id, event_id, CASE WHEN x / dec >= 5 THEN 5.0::DOUBLE WHEN x / dec >= 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * dec AS scale_m FROM d""",
)
def ge6(t: Testbed) -> DataFrame:
    width = (F.col("upper_hz") - F.col("lower_hz")) * F.col("event_id")
    return t.events_energy.select("session_id", "event_id", geo.scale_length(width).alias("scale_m"))


TRACK = SurveyQuery(elapsed_start=SEL_LO_US / 1e6, elapsed_end=SEL_HI_US / 1e6).with_rectangle(40.002, 40.012, -74.9985, -74.992)


@query(
    "q_ge7_receiver_track",
    f"""
WITH a AS (SELECT session_id, arg_min(utc_start_us - start_us, tile_id) AS anchor FROM tile GROUP BY ALL)
SELECT session_id, seq, (utc_us - anchor) / 1e6 AS elapsed_s, latitude, longitude FROM pos JOIN a USING (session_id)
WHERE valid AND utc_us - anchor >= {SEL_LO_US} AND utc_us - anchor < {SEL_HI_US} AND {RECT_SQL.replace('end_lat', 'latitude').replace('end_lon', 'longitude')}""",
)
def ge7(t: Testbed) -> DataFrame:
    d = geo.receiver_track(t.positions, t.tiles, TRACK)
    return d.select("session_id", "seq", s("elapsed"), "latitude", "longitude")


@query(
    "q_fp11_region_around_observation",
    None,
)
def fp11(t: Testbed) -> DataFrame:
    """Exposure within 0.001 degrees of each session's busiest located observation."""
    obs = occ.observations(t.tiles, t.acquisitions, t.coverage_gaps, OBS).where("fix is not null")
    top = obs.groupBy("session_id").agg(
        F.max(F.struct(F.col("busy_us") / F.col("observed_us"), (-F.col("bucket")).alias("b"), "fix.latitude", "fix.longitude")).alias("o")
    )
    box = sel_ops.region_around(top.select("session_id", "o.latitude", "o.longitude"))
    inside = F.col("fix_end.latitude").between(F.col("south"), F.col("north")) & F.col("fix_end.longitude").between(
        F.col("west"), F.col("east")
    )
    return (
        sel_ops.clip_time(t.tiles, SEL)
        .join(box.select("session_id", "south", "north", "west", "east"), "session_id")
        .where(inside)
        .groupBy("session_id", "south", "north", "west", "east")
        .agg(seconds(F.sum(F.col("to_us") - F.col("from_us"))).alias("observed_s"), F.count("*").alias("tiles"))
    )


# -- RSSI -----------------------------------------------------------------------------

SCAN_LO, SCAN_HI = 903_000_000, 918_500_000
SCAN_Q = SurveyQuery(lower_hz=SCAN_LO, upper_hz=SCAN_HI, elapsed_start=1.02, elapsed_end=200.01)
SCAN_SQL = f"""
ss AS (SELECT *, frequency_hz - 117150 < {SCAN_LO} OR frequency_hz + 117150 > {SCAN_HI} OR start_us < 1020000 OR end_us > 200010000 AS boundary FROM scan
  WHERE frequency_hz + 117150 > {SCAN_LO} AND frequency_hz - 117150 < {SCAN_HI} AND end_us > 1020000 AND start_us < 200010000)"""


def selected_scans(t: Testbed) -> DataFrame:
    return sel_ops.selected_scans(t.rssi_scans, SCAN_LO, SCAN_HI, SCAN_Q)


@query("q_fp8_selected_scans", f"WITH {SCAN_SQL} SELECT session_id, scan_id, board, frequency_hz, boundary FROM ss")
def fp8(t: Testbed) -> DataFrame:
    return selected_scans(t).select("session_id", "scan_id", "board", "frequency_hz", "boundary")


@query(
    "q_ag13_rssi_frequency_summary",
    f"""
WITH {SCAN_SQL}, hs AS (SELECT session_id, board, frequency_hz, string_agg(CAST(c AS VARCHAR), ';' ORDER BY i) AS histogram FROM (
    SELECT session_id, board, frequency_hz, b.range AS i, coalesce(sum(n), 0) AS c FROM ss CROSS JOIN range(33) b
    LEFT JOIN hist h ON h.l_orderkey = ss.l_orderkey AND h.hbin = b.range GROUP BY ALL) GROUP BY ALL)
SELECT session_id, board, frequency_hz, scans, samples, above, first_s, last_s, boundary_scans, scans_without_fix, fix.lat AS latitude, histogram,
  {pct('above', 'samples')} AS exceedance_pct FROM (
  SELECT session_id, board, frequency_hz, count(*) AS scans, CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(above) AS BIGINT) AS above, min(start_us) / 1e6 AS first_s,
    max(end_us) / 1e6 AS last_s, count(*) FILTER (WHERE boundary) AS boundary_scans, count(*) FILTER (WHERE latitude IS NULL) AS scans_without_fix,
    arg_max(struct_pack(lat := latitude), scan_id) FILTER (WHERE latitude IS NOT NULL) AS fix
  FROM ss GROUP BY ALL) JOIN hs USING (session_id, board, frequency_hz)""",
)
def ag13(t: Testbed) -> DataFrame:
    d = rssi.frequency_summary(selected_scans(t))
    return d.select(
        "session_id", "board", "frequency_hz", "scans", "samples", "above", s("first"), s("last"), "boundary_scans",
        "scans_without_fix", F.col("last_fix.latitude").alias("latitude"), m("exceedance_pct"),
        F.concat_ws(";", F.transform("counts", lambda c: c.cast("string"))).alias("histogram"),
    )


@query(
    "q_ag14_exceedance",
    f"""
SELECT session_id, scan_id, above, {r6('CAST(above AS DOUBLE) / samples')} AS fraction_87,
  {r6('CAST(a91 AS DOUBLE) / samples')} AS fraction_91 FROM scan JOIN (SELECT l_orderkey, coalesce(sum(n) FILTER (WHERE hbin <= 20), 0) AS a91 FROM hist GROUP BY ALL) USING (l_orderkey)""",
)
def ag14(t: Testbed) -> DataFrame:
    return t.rssi_scans.select(
        "session_id", "scan_id", rssi.samples_above(-87.0).alias("above"),
        micro(rssi.fraction_above(-87.0)).alias("fraction_87"), micro(rssi.fraction_above(-91.0)).alias("fraction_91"),
    )


@query(
    "q_ag15_board_rollup",
    f"""
WITH {SCAN_SQL}, f AS (SELECT session_id, board, frequency_hz, sum(samples) AS samples, sum(above) AS above, count(*) AS scans, min(start_us) AS t0, max(end_us) AS t1 FROM ss GROUP BY ALL)
SELECT session_id, board, count(*) AS centers, count(*) FILTER (WHERE above > 0) AS active_centers, CAST(sum(scans) AS BIGINT) AS scans,
  CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(above) AS BIGINT) AS above, min(t0) / 1e6 AS first_s, max(t1) / 1e6 AS last_s,
  min(frequency_hz) - 117150 AS lower_hz, max(frequency_hz) + 117150 AS upper_hz FROM f GROUP BY ALL""",
)
def ag15(t: Testbed) -> DataFrame:
    d = rssi.board_rollup(rssi.frequency_summary(selected_scans(t)))
    return d.select(
        "session_id", "board", "centers", "active_centers", "scans", "samples", "above", s("first"), s("last"), "lower_hz", "upper_hz"
    )


@query(
    "q_ag16_rssi_scan_rows",
    f"""
WITH {SCAN_SQL} SELECT session_id, board, scan_id, frequency_hz, samples, {r6('100.0::DOUBLE * (CAST(above AS DOUBLE) / samples)')} AS exceedance_pct,
  start_us / 1e6 AS start_s, end_us / 1e6 AS end_s, boundary FROM ss""",
)
def ag16(t: Testbed) -> DataFrame:
    d = rssi.scan_rows(selected_scans(t))
    return d.select(
        "session_id", "board", "scan_id", "frequency_hz", "samples", m("exceedance_pct"), s("start"), s("end"), "boundary"
    )


@query(
    "q_wn7_latest_scan_cells",
    f"""
SELECT session_id, board, frequency_hz, scan_id, {r6('CAST(above AS DOUBLE) / samples')} AS exceedance, frequency_hz - 100000.0::DOUBLE AS lower_hz,
  frequency_hz + 100000.0::DOUBLE AS upper_hz FROM scan QUALIFY row_number() OVER (PARTITION BY session_id, board, frequency_hz ORDER BY scan_id DESC) = 1""",
)
def wn7(t: Testbed) -> DataFrame:
    d = rssi.latest_cells(t.rssi_scans, 200_000)
    return d.select("session_id", "board", "frequency_hz", "scan_id", m("exceedance"), "lower_hz", "upper_hz")


@query(
    "q_jn11_off_plan_scans",
    """
WITH p AS (SELECT session_id, frequency_hz, row_number() OVER (PARTITION BY session_id ORDER BY frequency_hz) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n
  FROM (SELECT DISTINCT session_id, frequency_hz FROM scan)),
o AS (SELECT session_id, frequency_hz, CASE WHEN i >= n // 2 THEN 1 ELSE 0 END AS owner FROM p)
SELECT scan.session_id, scan_id, board, scan.frequency_hz FROM scan JOIN o USING (session_id, frequency_hz) WHERE board <> owner""",
)
def jn11(t: Testbed) -> DataFrame:
    points = t.rssi_scans.select("session_id", "frequency_hz").distinct()
    return rssi.off_plan(t.rssi_scans, rssi.sweep_plan(points, 2)).select("session_id", "scan_id", "board", "frequency_hz")


@query(
    "q_sf13_histogram_labels",
    """
SELECT CAST(hbin AS INTEGER) AS histogram_bin, CASE WHEN hbin = 0 THEN '>= -11' WHEN hbin = 32 THEN '< -135' ELSE '[' || (-11 - 4 * hbin) || ', ' || (-7 - 4 * hbin) || ')' END AS label,
  CASE WHEN hbin < 32 THEN -11.0::DOUBLE - 4.0::DOUBLE * hbin END AS lower_dbm, CAST(sum(n) AS BIGINT) AS samples FROM hist GROUP BY ALL""",
)
def sf13(t: Testbed) -> DataFrame:
    bins = t.rssi_scans.select(F.posexplode("counts").alias("histogram_bin", "n")).where("n > 0")
    return bins.groupBy("histogram_bin").agg(F.sum("n").alias("samples")).select(
        "histogram_bin", rssi.bin_label(F.col("histogram_bin")).alias("label"),
        rssi.bin_lower_dbm(F.col("histogram_bin"), F.lit(-11.0)).alias("lower_dbm"), "samples",
    )


@query(
    "q_sk5_private_positions",
    "SELECT session_id, seq, floor(latitude * 1000 + 0.5) / 1000 AS latitude, -floor(-longitude * 1000 + 0.5) / 1000 AS longitude FROM pos",
)
def sk5(t: Testbed) -> DataFrame:
    return t.positions.select(
        "session_id", "seq", round_half_away(F.col("latitude"), 3).alias("latitude"), round_half_away(F.col("longitude"), 3).alias("longitude")
    )


@query(
    "q_sf4_quality_names",
    f"SELECT CAST(quality AS INTEGER) AS quality, {QUALITY_SQL} AS names, count(*) AS events FROM nrg GROUP BY ALL",
)
def sf4(t: Testbed) -> DataFrame:
    d = t.events_energy.groupBy("quality").agg(F.count("*").alias("events"))
    return d.select(F.col("quality").cast("int").alias("quality"), flags.quality_names(F.col("quality")).alias("names"), "events")
