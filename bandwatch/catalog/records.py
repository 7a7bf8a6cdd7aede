"""Sources, sinks, encodings, scalar functions and data-quality queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.catalog.occupancy import SEL, m, s
from bandwatch.catalog.prelude import r6
from bandwatch.catalog.registry import query
from bandwatch.functions import codecs, flags, power
from bandwatch.functions.power import micro, round_half_away
from bandwatch.operators import quality as dq
from bandwatch.operators.geo import wrap_positive, wrap_signed
from bandwatch.sources import nmea, sinks
from bandwatch.sources.testbed import Testbed

CHUNK_US = 7_000_000

# -- sources ---------------------------------------------------------------------------


@query(
    "q_sc10_nmea_fixes",
    f"""
WITH p AS (SELECT *, seq % 2 = 0 AS rmc, seq % 7 = 0 AS broken FROM pos)
SELECT session_id, seq, CASE WHEN broken THEN 'rejected' WHEN NOT valid THEN 'invalid' ELSE 'fix' END AS outcome,
  CASE WHEN NOT broken AND NOT valid THEN CASE WHEN rmc THEN 'position marked void' ELSE 'no position yet' END END AS reason,
  CASE WHEN NOT broken THEN CAST(utc_us // 1000000 AS DOUBLE) END AS utc_s,
  CASE WHEN valid AND NOT broken THEN {r6('latitude')} END AS latitude, CASE WHEN valid AND NOT broken THEN {r6('longitude')} END AS longitude,
  CASE WHEN valid AND NOT broken AND NOT rmc THEN satellites END AS satellites FROM p""",
)
def sc10(t: Testbed) -> DataFrame:
    d = nmea.parse(t.nmea_sentences)
    return d.select("session_id", "seq", "outcome", "reason", "utc_s", m("latitude"), m("longitude"), "satellites")


@query("q_sc8_snapshot_passes", "SELECT session_id, count(*) AS tiles, sum(end_us - start_us) / 1e6 AS observed_s FROM tile GROUP BY ALL")
def sc8(t: Testbed) -> DataFrame:
    """Two passes over one written revision see the same rows."""
    from bandwatch.session import written_once

    revision = written_once(t.tiles.select("session_id", "tile_id", "start_us", "end_us"), "snapshot")
    first = revision.groupBy("session_id").agg(F.count("*").alias("tiles"))
    second = revision.groupBy("session_id").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("observed_us"))
    return first.join(second, "session_id").select("session_id", "tiles", s("observed"))


# -- sinks -------------------------------------------------------------------------------


@query(
    "q_sk1_csv_report",
    "SELECT session_id, reception_id, lane_label, classification FROM rec",
)
def sk1(t: Testbed) -> DataFrame:
    """A CSV report, read back."""
    from bandwatch.session import shared_folder

    path = shared_folder(t.spark, "csv")
    report = t.receptions.select("session_id", "reception_id", "lane_label", "classification")
    sinks.write_csv(report, path)
    schema = "session_id bigint, reception_id bigint, lane_label string, classification string"
    return t.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


SK2_SQL = """
WITH x AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '=' WHEN 1 THEN '  -' WHEN 2 THEN chr(9) WHEN 3 THEN '@' WHEN 4 THEN chr(10) ELSE '' END || text AS v FROM documents)
SELECT doc_id, md5(CASE WHEN regexp_matches(v, '^[\\x00-\\x20]*[=+@-]') OR regexp_matches(v, '^[\\t\\r\\n]') THEN '''' || v ELSE v END) AS safe FROM x"""


@query("q_sk2_formula_safe_text", SK2_SQL)
def sk2(t: Testbed) -> DataFrame:
    k = F.col("doc_id") % 6
    lead = F.when(k == 0, "=").when(k == 1, "  -").when(k == 2, "\t").when(k == 3, "@").when(k == 4, "\n").otherwise("")
    d = t.raw("documents").select("doc_id", F.concat(lead, F.col("text")).alias("v"))
    return d.select("doc_id", F.md5(sinks.csv_safe(F.col("v")).cast("binary")).alias("safe"))


@query(
    "q_sk3_archive",
    """
SELECT record_type, session_id, count(*) AS records, min(elapsed_us) / 1e6 AS first_s, max(elapsed_us) / 1e6 AS last_s FROM (
  SELECT 'session' AS record_type, session_id, max(end_us) AS elapsed_us FROM ev GROUP BY session_id
  UNION ALL SELECT 'acquisition_segment', session_id, acq_start_us FROM acqs
  UNION ALL SELECT 'spectrum_tile', session_id, start_us FROM tile
  UNION ALL SELECT 'spectrum_event', session_id, start_us FROM nrg
  UNION ALL SELECT 'coverage_gap', session_id, start_us FROM gap
  UNION ALL SELECT 'reception', session_id, elapsed_us FROM rec
  UNION ALL SELECT 'waveform', session_id, delimiter_us FROM wave
  UNION ALL SELECT 'receiver_position', session_id, monotonic_us FROM pos
  UNION ALL SELECT 'rssi_scan', session_id, start_us FROM scan) GROUP BY ALL""",
)
def sk3(t: Testbed) -> DataFrame:
    """The archive, written partitioned by record type and read back."""
    from bandwatch.plans.reports import archive_records
    from bandwatch.session import shared_folder

    path = shared_folder(t.spark, "archive")
    sinks.write_archive(archive_records(t), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("record_type", "session_id").agg(
        F.count("*").alias("records"),
        power.seconds(F.min("elapsed_us")).alias("first_s"),
        power.seconds(F.max("elapsed_us")).alias("last_s"),
    )


@query(
    "q_sk4_geojson",
    """
SELECT count(*) AS features, count(*) FILTER (WHERE end_lat IS NULL) AS without_geometry, CAST(sum(busy) * 5000 AS BIGINT) / 1e6 AS busy_s
FROM (SELECT t.*, (SELECT count(DISTINCT f) FROM cell c WHERE c.session_id = t.session_id AND c.start_us = t.start_us) AS busy FROM tile t)""",
)
def sk4(t: Testbed) -> DataFrame:
    from bandwatch.plans.reports import tile_features

    text = tile_features(t.tiles, 4)
    schema = "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<busy_s:double>"
    read = text.select(F.from_json("value", schema).alias("f"))
    return read.agg(
        F.count("*").alias("features"),
        F.count_if(F.col("f.geometry").isNull()).alias("without_geometry"),
        F.sum("f.properties.busy_s").alias("busy_sum"),
    ).select("features", "without_geometry", (F.floor(F.col("busy_sum") * 1e6 + 0.5) / 1e6).alias("busy_s"))


@query(
    "q_sk6_metadata_copy",
    "SELECT session_id, reception_id, frequency_hz, CAST(NULL AS VARCHAR) AS classification, CAST(NULL AS INTEGER) AS evidence_port, lane_label FROM rec",
)
def sk6(t: Testbed) -> DataFrame:
    keep = ["session_id", "reception_id", "frequency_hz", "lane_label"]
    copy = sinks.metadata_copy({"receptions": t.receptions}, {"receptions": keep})["receptions"]
    return copy.select("session_id", "reception_id", "frequency_hz", "classification", "evidence_port", "lane_label")


@query(
    "q_sk7_activity_runs",
    """
WITH p AS (SELECT session_id, tile_id, v, g, CASE WHEN list_transform(range(64), lambda b: v[b + 1] >= 0.3) = list_transform(range(64), lambda b: v[(b + 16) % 64 + 1] >= 0.3) THEN 1 ELSE 0 END AS same
  FROM tile, range(2) t(g)),
k AS (SELECT * FROM p WHERE g = 0 OR same = 0)
SELECT session_id, tile_id, CAST(g * 2 AS INTEGER) AS frame_start, CAST(CASE WHEN same = 1 THEN 4 ELSE 2 END AS INTEGER) AS frame_count,
  string_agg(printf('%02x', (SELECT CAST(coalesce(sum(1 << (b % 8)), 0) AS INTEGER) FROM range(64) r(b) WHERE b // 8 = o AND v[(b + 16 * g) % 64 + 1] >= 0.3)), '' ORDER BY o) AS mask_hex
FROM k, range(8) q(o) GROUP BY session_id, tile_id, g, same""",
)
def sk7(t: Testbed) -> DataFrame:
    return sinks.activity_runs(t.tiles)


@query(
    "q_sk10_deduplicated_fixes",
    """
SELECT session_id, latitude, longitude, count(*) AS uses FROM (SELECT *, monotonic_us // 1000000 AS sec FROM pos)
GROUP BY session_id, latitude, longitude, altitude_m, manual, sec, source, hdop, satellites""",
)
def sk10(t: Testbed) -> DataFrame:
    """Fixes whose clocks are cut to whole seconds, so that repeats occur."""
    coarse = t.positions.withColumn("monotonic_us", F.expr("monotonic_us div 1000000")).withColumn("utc_us", F.expr("utc_us div 1000000"))
    return sinks.deduplicated_fixes(coarse).select("session_id", "latitude", "longitude", "uses")


# -- encodings ---------------------------------------------------------------------------


@query(
    "q_c1_centi_db",
    """
WITH x AS (SELECT session_id, tile_id, i.range AS i, -80.0::DOUBLE + 60.0::DOUBLE * v[i.range + 1] AS y FROM tile, range(64) i)
SELECT session_id, tile_id, CAST(i AS INTEGER) AS bin, sign(y) * floor(abs(y) * 100 + 0.5) / 100.0::DOUBLE AS level FROM x""",
)
def c1(t: Testbed) -> DataFrame:
    packed = t.tiles.select("session_id", "tile_id", codecs.centi_db_encode(F.col("mean_dbfs")).alias("blob"))
    return packed.select("session_id", "tile_id", F.posexplode(codecs.centi_db_decode(F.col("blob"))).alias("bin", "level"))


def packed_masks(t: Testbed) -> DataFrame:
    masks = t.tiles.select(
        "session_id", "tile_id", "frame_count", "bin_count", codecs.bitmap(F.col("activity"), F.col("bin_count")).alias("mask")
    )
    return masks.withColumn("packed", codecs.runs_encode(F.col("mask")))


@query(
    "q_c2_mask_codec",
    """
SELECT session_id, tile_id, CAST(32 AS INTEGER) AS raw_bytes, true AS same FROM tile""",
)
def c2(t: Testbed) -> DataFrame:
    """Every mask packed and unpacked again equals the tile's activity."""
    decoded = codecs.decode_activity(packed_masks(t), ["session_id", "tile_id"])
    d = decoded.join(packed_masks(t).select("session_id", "tile_id", F.octet_length("mask").alias("raw_bytes")), ["session_id", "tile_id"])
    tiles = t.tiles.select("session_id", "tile_id", F.col("activity").alias("original"))
    return d.join(tiles, ["session_id", "tile_id"]).select(
        "session_id", "tile_id", "raw_bytes", (F.col("activity") == F.col("original")).alias("same")
    )


@query(
    "q_c3_sparse_cells",
    "SELECT session_id, start_us // 20000 + 1 AS tile_id, CAST(f AS INTEGER) AS frame, CAST(bin AS INTEGER) AS bin FROM cell",
)
def c3(t: Testbed) -> DataFrame:
    decoded = codecs.decode_activity(packed_masks(t), ["session_id", "tile_id"])
    return codecs.explode_cells(decoded, ["session_id", "tile_id"])


@query(
    "q_c4_histogram_codec",
    "SELECT l_orderkey // 5000 AS session_id, l_orderkey % 5000 + 1 AS scan_id, CAST(hbin AS INTEGER) AS bin, n FROM hist",
)
def c4(t: Testbed) -> DataFrame:
    packed = t.rssi_scans.select("session_id", "scan_id", codecs.histogram_encode(F.col("counts")).alias("blob"))
    d = packed.select("session_id", "scan_id", F.posexplode(codecs.histogram_decode(F.col("blob"))).alias("bin", "n"))
    return d.where("n > 0")


@query(
    "q_c5_compact_equals_detailed",
    """
WITH o AS (SELECT session_id, acq_id, count(*) * 20000 AS observed FROM tile GROUP BY ALL),
b AS (SELECT session_id, acq_id, bin, count(*) * 5000 AS busy FROM cell GROUP BY ALL)
SELECT o.session_id, o.acq_id, CAST(binof.bin AS INTEGER) AS bin, coalesce(busy, 0) / 1e6 AS busy_s, observed / 1e6 AS observed_s, true AS same_busy, true AS mean_close, true AS peak_close
FROM o CROSS JOIN binof LEFT JOIN b ON b.session_id = o.session_id AND b.acq_id = o.acq_id AND b.bin = binof.bin""",
)
def c5(t: Testbed) -> DataFrame:
    """Whole acquisitions give the same busy time and, to quantization, the same power in the compact layout."""
    from bandwatch.catalog.sequences import compact_of
    from bandwatch.operators.compact import expand
    from bandwatch.operators.occupancy import frequency_summary
    from bandwatch.plans.query import SurveyQuery
    from bandwatch.session import written_once

    columns = ["busy_us", "observed_us", "mean_dbfs", "peak_dbfs"]
    keys = ["session_id", "acq_id", "bin"]
    acquisitions = written_once(t.acquisitions, "acquisitions")  # of known size: tiles need not move to meet them
    fine = frequency_summary(t.tiles_by_chunk(CHUNK_US), acquisitions, SurveyQuery()).select(*keys, *columns)
    coarse = frequency_summary(expand(*compact_of(t)), acquisitions, SurveyQuery()).select(*keys, *[F.col(c).alias(f"c_{c}") for c in columns])
    close = lambda c: F.abs(F.col(c) - F.col(f"c_{c}")) < 0.011
    return fine.join(coarse, keys).select(
        *keys, (F.col("c_busy_us") / 1e6).alias("busy_s"), (F.col("c_observed_us") / 1e6).alias("observed_s"),
        ((F.col("busy_us") == F.col("c_busy_us")) & (F.col("observed_us") == F.col("c_observed_us"))).alias("same_busy"),
        close("mean_dbfs").alias("mean_close"), close("peak_dbfs").alias("peak_close"),
    )


# -- archive under a policy ----------------------------------------------------------------

NO = "CAST(NULL AS DOUBLE)"


def archive_sql(lat) -> str:
    """Every record as (type, session, id, clock, latitude); ``lat`` gives what the policy makes of a latitude."""
    return f"""
SELECT 'session' AS record_type, session_id, '' AS record_id, {NO} AS elapsed_s, {NO} AS latitude FROM (SELECT DISTINCT session_id FROM ev)
UNION ALL SELECT 'acquisition_segment', session_id, CAST(acq_id AS VARCHAR), acq_start_us / 1e6, {NO} FROM acqs
UNION ALL SELECT 'spectrum_tile', session_id, CAST(tile_id AS VARCHAR), start_us / 1e6, {lat("end_lat")} FROM tile
UNION ALL SELECT 'spectrum_event', session_id, CAST(event_id AS VARCHAR), start_us / 1e6, {lat("end_lat")} FROM nrg
UNION ALL SELECT 'coverage_gap', session_id, CAST(gap_id AS VARCHAR), start_us / 1e6, {NO} FROM gap
UNION ALL SELECT 'reception', session_id, CAST(reception_id AS VARCHAR), elapsed_us / 1e6, {lat("latitude")} FROM rec
UNION ALL SELECT 'waveform_observation', session_id, waveform_id || '/' || version, delimiter_us / 1e6, {lat("latitude")} FROM wave
UNION ALL SELECT 'discovery_band', session_id, '1/' || subband, {NO}, {NO} FROM dband
UNION ALL SELECT 'discovery_gap', session_id, CAST(gap_id AS VARCHAR), {NO}, {NO} FROM dgap
UNION ALL SELECT 'rssi_scan', session_id, CAST(scan_id AS VARCHAR), start_us / 1e6, {lat("latitude")} FROM scan"""


ARCHIVED = [
    "session", "acquisition_segment", "spectrum_tile", "spectrum_event", "coverage_gap", "reception", "waveform_observation", "discovery_band",
    "discovery_gap", "rssi_scan",
]
ROUNDED = "floor({0} * 1000 + 0.5) / 1000"


def archived(t: Testbed, positions: bool) -> DataFrame:
    from bandwatch.plans.archive import ExportPolicy, records
    from bandwatch.session import shared_folder

    path = shared_folder(t.spark, "archive")
    types = ARCHIVED + (["spectrum_tile_start_position", "receiver_position"] if positions else [])
    sinks.write_archive(records(t, ExportPolicy(positions, decimals=3), types), path)
    return t.spark.read.parquet(path).select("record_type", "session_id", F.coalesce("record_id", F.lit("")).alias("record_id"), (F.col("elapsed_us") / 1e6).alias("elapsed_s"), "latitude")


@query("q_sk3_archive_rows", archive_sql(lambda c: ROUNDED.format(c)) + f"""
UNION ALL SELECT 'spectrum_tile_start_position', session_id, CAST(tile_id AS VARCHAR), start_us / 1e6, {ROUNDED.format("start_lat")} FROM tile WHERE start_lat IS NOT NULL
UNION ALL SELECT 'receiver_position', session_id, CAST(seq AS VARCHAR), monotonic_us / 1e6, {ROUNDED.format("latitude")} FROM pos""")  # fmt: skip
def sk3_rows(t: Testbed) -> DataFrame:
    """The archive with positions asked for, record by record, written and read back."""
    return archived(t, True)


@query("q_sk5_archive_without_positions", archive_sql(lambda c: NO))
def sk5_archive(t: Testbed) -> DataFrame:
    """The same archive without the opt-in: no coordinate, and no record that is nothing but a position."""
    return archived(t, False)


@query(
    "q_sk4_features",
    f"""
SELECT 'spectrum_tile' AS record_type, session_id, CAST(tile_id AS VARCHAR) AS record_id, {ROUNDED.format("end_lat")} AS latitude FROM tile
UNION ALL SELECT 'receiver_position', session_id, CAST(seq AS VARCHAR), {ROUNDED.format("latitude")} FROM pos
UNION ALL SELECT 'discovery_gap', session_id, CAST(gap_id AS VARCHAR), {NO} FROM dgap
UNION ALL SELECT 'rssi_histogram', session_id, CAST(scan_id AS VARCHAR) || '/' || b, {NO} FROM scan, range(33) r(b)""",
)
def sk4_features(t: Testbed) -> DataFrame:
    """Features of placed and of placeless records, read back from their text."""
    from bandwatch.plans.archive import ExportPolicy, feature_rows

    text = feature_rows(t, ExportPolicy(True, decimals=3), ["spectrum_tile", "receiver_position", "discovery_gap", "rssi_histogram"])
    read = text.select("record_type", "session_id", F.from_json("value", "geometry struct<coordinates:array<double>>, properties struct<record_id:string>").alias("f"))
    return read.select("record_type", "session_id", F.col("f.properties.record_id").alias("record_id"), F.get("f.geometry.coordinates", F.lit(1)).alias("latitude"))


# -- scalar functions -----------------------------------------------------------------------


@query(
    "q_sf1_levels",
    f"""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 0.0::DOUBLE ELSE o_totalprice * 1e-9 END AS p FROM orders)
SELECT o_orderkey, {r6('10.0::DOUBLE * log10(greatest(p, 1e-18::DOUBLE))')} AS level, CASE WHEN p > 0 THEN {r6('10.0::DOUBLE * log10(p)')} END AS report_level,
  {r6('power(10.0::DOUBLE, o_orderkey % 40 / 10.0::DOUBLE)')} AS linear FROM x""",
)
def sf1(t: Testbed) -> DataFrame:
    p = F.when(F.col("o_orderkey") % 50 == 0, 0.0).otherwise(F.col("o_totalprice") * 1e-9)
    return t.raw("orders").select(
        "o_orderkey", micro(power.dbfs(p)).alias("level"), micro(power.dbfs_or_null(p)).alias("report_level"),
        micro(power.linear(F.col("o_orderkey") % 40)).alias("linear"),
    )


@query(
    "q_sf2_percent",
    f"""SELECT o_orderkey, CASE WHEN o_custkey % 10 > 0 THEN {r6('100.0::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (o_orderkey % 7 - 1) / CAST(o_custkey % 10 AS DOUBLE)))')} END AS pct FROM orders""",
)
def sf2(t: Testbed) -> DataFrame:
    return t.raw("orders").select(
        "o_orderkey", micro(power.percent(F.col("o_orderkey") % 7 - 1, F.col("o_custkey") % 10)).alias("pct")
    )


@query(
    "q_sf3_rounding",
    "SELECT c_custkey, sign(c_acctbal) * floor(abs(c_acctbal) * 10 + 0.5) / 10 AS one, sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) AS zero FROM customer",
)
def sf3(t: Testbed) -> DataFrame:
    return t.raw("customer").select(
        "c_custkey", round_half_away(F.col("c_acctbal"), 1).alias("one"), round_half_away(F.col("c_acctbal"), 0).alias("zero")
    )


@query(
    "q_sf5_display_scales",
    f"""WITH x AS (SELECT o_orderkey, o_totalprice / 1e7 * (o_orderkey % 30) AS r FROM orders)
SELECT o_orderkey, {r6('ln(1 + least(1.0::DOUBLE, greatest(0.0::DOUBLE, r)) * 1e6) / ln(1 + 1e6::DOUBLE)')} AS log_height, {r6('least(1.0::DOUBLE, greatest(0.0::DOUBLE, r))')} AS linear_height FROM x""",
)
def sf5(t: Testbed) -> DataFrame:
    r = F.col("o_totalprice") / 1e7 * (F.col("o_orderkey") % 30)
    return t.raw("orders").select("o_orderkey", micro(power.log_scale(r)).alias("log_height"), micro(power.linear_scale(r)).alias("linear_height"))


@query(
    "q_sf6_utc_text",
    "SELECT session_id, tile_id, strftime(make_timestamp(utc_start_us), '%Y-%m-%d %H:%M:%S UTC') AS utc FROM tile",
)
def sf6(t: Testbed) -> DataFrame:
    from bandwatch.functions.text import utc_text

    return t.tiles.select("session_id", "tile_id", utc_text(F.col("utc_start_us")).alias("utc"))


@query(
    "q_sf7_longitude_wrap",
    f"""WITH x AS (SELECT o_orderkey, o_totalprice / 500 - 500 AS d FROM orders)
SELECT o_orderkey, {r6('((d % 360) + 360) % 360')} AS positive, {r6('((d + 180) % 360 + 360) % 360 - 180')} AS signed FROM x""",
)
def sf7(t: Testbed) -> DataFrame:
    d = F.col("o_totalprice") / 500 - 500
    return t.raw("orders").select("o_orderkey", micro(wrap_positive(d)).alias("positive"), micro(wrap_signed(d)).alias("signed"))


@query(
    "q_sf8_json_text",
    "SELECT doc_id, length(text) AS characters, true AS same FROM documents",
)
def sf8(t: Testbed) -> DataFrame:
    """Any text survives JSON escaping unchanged."""
    d = t.raw("documents").withColumn("j", F.to_json(F.struct("text")))
    back = F.from_json("j", "text string")["text"]
    return d.select("doc_id", F.length("text").cast("bigint").alias("characters"), (back == F.col("text")).alias("same"))


@query("q_sf9_hex", "SELECT doc_id, md5(lower(hex(encode(text)))) AS hex_digest FROM documents")
def sf9(t: Testbed) -> DataFrame:
    return t.raw("documents").select("doc_id", F.md5(F.lower(F.hex(F.encode("text", "UTF-8"))).cast("binary")).alias("hex_digest"))


@query(
    "q_sf10_status_names",
    """SELECT status, CASE status WHEN 0 THEN 'envelope validated' WHEN 1 THEN 'bad phy CRC' WHEN 2 THEN 'invalid frame' WHEN 3 THEN 'no matching key'
  WHEN 4 THEN 'decryption unvalidated' WHEN 5 THEN 'unsupported payload' END AS name, count(*) AS receptions FROM rec GROUP BY ALL""",
)
def sf10(t: Testbed) -> DataFrame:
    d = t.receptions.groupBy("status").agg(F.count("*").alias("receptions"))
    return d.select("status", flags.decode_status_name(F.col("status")).alias("name"), "receptions")


@query(
    "q_sf11_classification",
    """SELECT session_id, reception_id, CASE WHEN reception_id % 4 = 0 THEN 'unknown LoRa' ELSE classification END AS classification FROM rec""",
)
def sf11(t: Testbed) -> DataFrame:
    claimed = F.when(F.col("reception_id") % 4 == 0, F.concat(F.lit("surely "), "classification")).otherwise(F.col("classification"))
    return t.receptions.select("session_id", "reception_id", flags.canonical_classification(claimed).alias("classification"))


@query(
    "q_sf12_source_columns",
    """SELECT session_id, acq_id, CASE session_id % 4 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'RTL-SDR' WHEN 2 THEN 'HackRF' ELSE 'RAK5146 USB/LBT' END AS source_label,
  CASE WHEN session_id % 4 IN (0, 2) THEN 16 END AS lna, CASE WHEN session_id % 4 <> 3 THEN 12800 END AS sample_rate FROM acqs""",
)
def sf12(t: Testbed) -> DataFrame:
    from bandwatch.functions.text import by_source

    k = F.col("session_id") % 4
    kind = F.when(k == 0, "synthetic").when(k == 1, "rtl").when(k == 2, "hackrf").otherwise("rak")
    return by_source(t.acquisitions.withColumn("receiver", kind)).select(
        "session_id", "acq_id", "source_label", "lna", F.col("sample_rate").cast("int").alias("sample_rate")
    )


@query(
    "q_sf14_geometry",
    f"""SELECT session_id, seq, {r6(f'cos(latitude * {math.pi / 180!r}::DOUBLE)')} AS c, {r6(f'sin(longitude * {math.pi / 180!r}::DOUBLE)')} AS s,
  CAST(ceil(longitude * 10) AS BIGINT) AS up, CAST(floor(longitude * 10) AS BIGINT) AS down FROM pos""",
)
def sf14(t: Testbed) -> DataFrame:
    rad = math.pi / 180
    return t.positions.select(
        "session_id", "seq", micro(F.cos(F.col("latitude") * rad)).alias("c"), micro(F.sin(F.col("longitude") * rad)).alias("s"),
        F.ceil(F.col("longitude") * 10).alias("up"), F.floor(F.col("longitude") * 10).alias("down"),
    )


@query(
    "q_sf15_printable_text",
    r"""
SELECT c_custkey, replace(replace(replace(c_name || '\' || chr(9) || 'é' || c_mktsegment, '\', '\\'), chr(9), '\x09'), 'é', '\xc3\xa9') AS text FROM customer""",
)
def sf15(t: Testbed) -> DataFrame:
    d = t.raw("customer").select("c_custkey", F.concat("c_name", F.lit("\\\té"), "c_mktsegment").alias("v"))
    return d.select("c_custkey", sinks.printable(F.col("v")).alias("text"))


@query(
    "q_sf16_tuner_commands",
    """SELECT a.session_id, a.acq_id, center_hz + a.session_id % 5 * 100 AS command_hz, center_hz - a.session_id % 5 * 100 AS scan_hz FROM acqs a""",
)
def sf16(t: Testbed) -> DataFrame:
    return t.acquisitions.select(
        "session_id", "acq_id", (F.col("center_hz") + F.col("offset_hz")).alias("command_hz"), (F.col("center_hz") - F.col("offset_hz")).alias("scan_hz")
    )


@query(
    "q_sf17_clocks",
    """WITH a AS (SELECT session_id, min(utc_start_us - start_us) AS base FROM tile GROUP BY ALL)
SELECT t.session_id, tile_id, base + start_us AS utc_us, greatest(base, base + start_us - 3000 - CAST(end_sample AS DOUBLE) / 12800 * 1e6) / 1e6 AS block_epoch_s FROM tile t JOIN a USING (session_id)""",
)
def sf17(t: Testbed) -> DataFrame:
    from bandwatch.functions.text import block_epoch_us

    base = t.tiles.groupBy("session_id").agg(F.min(F.col("utc_start_us") - F.col("start_us")).alias("base"))
    d = t.tiles.select("session_id", "tile_id", "start_us", "end_sample").join(base, "session_id")
    arrival = F.col("base") + F.col("start_us") - 3_000
    epoch = block_epoch_us(F.col("base"), arrival, F.col("end_sample"), F.lit(12_800.0))
    return d.select("session_id", "tile_id", (F.col("base") + F.col("start_us")).alias("utc_us"), (epoch / 1e6).alias("block_epoch_s"))


# -- data quality -------------------------------------------------------------------------

KEY = "CAST({} AS VARCHAR) AS key"


def rules_sql(table: str, source: str, ident: str, rules: dict[str, str]) -> str:
    parts = [f"SELECT session_id, '{table}' AS table_name, {KEY.format(ident)}, '{name}' AS rule FROM {source} WHERE {bad}" for name, bad in rules.items()]
    return "\nUNION ALL ".join(parts)


@query(
    "q_dq1_tile_rules",
    rules_sql("tiles", "tile", "tile_id", {
        "clipped above samples": "tile_id % 101 = 0", "unknown quality bits": "tile_id % 103 = 0", "mean above peak": "tile_id % 107 = 0",
        "activity beyond bins": "tile_id % 109 = 0", "sample count": "tile_id % 113 = 0", "utc and elapsed lengths differ": "tile_id % 127 = 0",
    }).replace("UNION ALL SELECT session_id, 'tiles' AS table_name, CAST(tile_id AS VARCHAR) AS key, 'sample count'",
               "UNION ALL SELECT session_id, 'tiles', CAST(tile_id AS VARCHAR), 'duration against rate' FROM tile WHERE tile_id % 113 = 0 UNION ALL SELECT session_id, 'tiles' AS table_name, CAST(tile_id AS VARCHAR) AS key, 'sample count'"),
)
def dq1(t: Testbed) -> DataFrame:
    """Rules over tiles of which some were damaged."""
    k = lambda n: F.col("tile_id") % n == 0
    bad = (
        t.tiles.withColumn("clipped", F.when(k(101), 10_000).otherwise(F.col("clipped")))
        .withColumn("quality", F.when(k(103), 2048).otherwise(F.col("quality")))
        .withColumn("mean_dbfs", F.when(k(107), F.transform("mean_dbfs", lambda x: x + 20)).otherwise(F.col("mean_dbfs")))
        .withColumn("activity", F.when(k(109), F.array_repeat(F.array(F.lit(64)), 4)).otherwise(F.col("activity")))
        .withColumn("end_sample", F.when(k(113), F.col("end_sample") + 64).otherwise(F.col("end_sample")))
        .withColumn("utc_end_us", F.when(k(127), F.col("utc_end_us") + 2_500).otherwise(F.col("utc_end_us")))
    )
    wide = t.acquisitions.withColumn("span_hz", F.lit(13_000))  # the lowest bin reaches beyond the rate
    return dq.tile_violations(bad, wide)


@query(
    "q_dq2_power_rules",
    rules_sql("power", "tile", "tile_id", {"power does not cover tile": "tile_id % 89 = 0", "power longer than a second": "tile_id % 97 = 0"}),
)
def dq2(t: Testbed) -> DataFrame:
    bad = t.tiles.withColumn("power_start_us", F.when(F.col("tile_id") % 89 == 0, F.col("start_us") + 1).otherwise(F.col("start_us")))
    bad = bad.withColumn("power_end_us", F.when(F.col("tile_id") % 97 == 0, F.col("power_start_us") + 1_000_001).otherwise(F.col("end_us")))
    return dq.power_block_violations(bad)


@query(
    "q_dq3_interval_rules",
    rules_sql("gaps", "gap", "gap_id", {"end not after start": "gap_id % 11 = 0", "utc and elapsed lengths differ": "gap_id % 11 = 0", "reason": "gap_id % 13 = 0"}),
)
def dq3(t: Testbed) -> DataFrame:
    bad = t.coverage_gaps.withColumn("end_us", F.when(F.col("gap_id") % 11 == 0, F.col("start_us")).otherwise(F.col("end_us")))
    return dq.gap_violations(bad.withColumn("reason", F.when(F.col("gap_id") % 13 == 0, "").otherwise(F.col("reason"))))


@query(
    "q_dq4_event_rules",
    rules_sql("events", "nrg", "event_id", {"active above length": "event_id % 17 = 0", "mean above peak": "event_id % 19 = 0"}),
)
def dq4(t: Testbed) -> DataFrame:
    bad = t.events_energy.withColumn("active_us", F.when(F.col("event_id") % 17 == 0, F.col("end_us") - F.col("start_us") + 1).otherwise(F.col("active_us")))
    return dq.event_violations(bad.withColumn("mean_dbfs", F.when(F.col("event_id") % 19 == 0, F.col("peak_dbfs") + 1).otherwise(F.col("mean_dbfs"))))


@query(
    "q_dq5_fix_rules",
    rules_sql("positions", "pos", "seq", {"coordinates": "seq % 23 = 0", "satellites": "seq % 29 = 0"}),
)
def dq5(t: Testbed) -> DataFrame:
    bad = t.positions.withColumn("latitude", F.when(F.col("seq") % 23 == 0, 90.5).otherwise(F.col("latitude")))
    return dq.position_violations(bad.withColumn("satellites", F.when(F.col("seq") % 29 == 0, 1001).otherwise(F.col("satellites"))))


@query(
    "q_dq6_reception_rules",
    """
WITH r AS (SELECT *, CASE WHEN reception_id % 31 = 0 THEN false ELSE crc_valid END AS crc, CASE WHEN reception_id % 37 = 0 THEN NULL ELSE evidence_port END AS ep FROM rec)
SELECT session_id, 'receptions' AS table_name, CAST(reception_id AS VARCHAR) AS key, 'classified without sound frame' AS rule FROM r WHERE status = 0 AND NOT (crc AND header_valid)
UNION ALL SELECT session_id, 'receptions', CAST(reception_id AS VARCHAR), 'evidence not eligible' FROM r WHERE ep IS NOT NULL AND NOT (crc AND header_valid)
UNION ALL SELECT session_id, 'receptions', CAST(reception_id AS VARCHAR), 'possible without evidence' FROM r WHERE ep IS NULL AND classification = 'possible Meshtastic'""",
)
def dq6(t: Testbed) -> DataFrame:
    bad = t.receptions.withColumn("crc_valid", F.when(F.col("reception_id") % 31 == 0, False).otherwise(F.col("crc_valid")))
    return dq.reception_violations(bad.withColumn("evidence_port", F.when(F.col("reception_id") % 37 != 0, F.col("evidence_port"))))


@query(
    "q_dq7_bin_rules",
    """
WITH b AS (SELECT session_id, CAST(first_center_hz + bin * 200 AS BIGINT) AS c, count(*) AS n FROM (SELECT DISTINCT session_id, acq_id, first_center_hz FROM tile), binof GROUP BY ALL)
SELECT session_id, 'bins' AS table_name, CAST(c AS VARCHAR) AS key, 'active above observed' AS rule FROM b WHERE c % 1400 = 0
UNION ALL SELECT session_id, 'bins', CAST(c AS VARCHAR), 'duplicate' FROM b WHERE c % 1800 = 0""",
)
def dq7(t: Testbed) -> DataFrame:
    from bandwatch.operators.occupancy import grid_exposure
    from bandwatch.plans.query import SurveyQuery

    g = grid_exposure(t.tiles, t.acquisitions, SurveyQuery()).withColumn("c", F.col("center_hz").cast("bigint"))
    bins = g.select(
        "session_id", F.col("c").alias("center_hz"), F.lit(200).alias("width_hz"), "observed_us",
        F.when(F.col("c") % 1400 == 0, F.col("observed_us") + 1).otherwise(F.lit(0)).alias("active_us"),
    )
    twice = bins.unionByName(bins.where("center_hz % 1800 = 0"))
    return dq.bin_violations(bins).unionByName(dq.duplicate_keys(twice, "bins", ["session_id", "center_hz"], F.col("center_hz")))


@query(
    "q_dq8_waveform_rules",
    rules_sql("waveforms", "wave", "waveform_id", {"bandwidth": "waveform_id % 41 = 0", "delimiter before preamble": "waveform_id % 43 = 0"}),
)
def dq8(t: Testbed) -> DataFrame:
    bad = t.waveforms.withColumn("bandwidth_hz", F.when(F.col("waveform_id") % 41 == 0, 31_250).otherwise(F.col("bandwidth_hz")))
    return dq.waveform_violations(bad.withColumn("delimiter_us", F.when(F.col("waveform_id") % 43 == 0, F.col("first_observed_us")).otherwise(F.col("delimiter_us"))))


@query(
    "q_dq9_discovery_rules",
    """
SELECT session_id, 'discovery_bands' AS table_name, CAST(subband AS VARCHAR) AS key, 'negative counter' AS rule FROM dband WHERE processed_samples % 7 = 0
UNION ALL SELECT session_id, 'discovery_gaps', CAST(gap_id AS VARCHAR), 'reason' FROM dgap WHERE gap_id % 9 = 0""",
)
def dq9(t: Testbed) -> DataFrame:
    bands = t.discovery_bands.withColumn("abandoned_samples", F.when(F.col("processed_samples") % 7 == 0, -1).otherwise(F.col("abandoned_samples")))
    gaps = t.discovery_gaps.withColumn("reason", F.when(F.col("gap_id") % 9 == 0, "unknown").otherwise(F.col("reason")))
    return dq.discovery_violations(bands, gaps)


@query(
    "q_dq10_scan_rules",
    """
WITH x AS (SELECT *, CASE WHEN scan_id % 53 = 0 THEN start_us - 110000 ELSE start_us END AS st, CASE WHEN scan_id % 53 = 0 THEN utc_start_us - 110000 ELSE utc_start_us END AS ut FROM scan),
y AS (SELECT *, lag(end_us) OVER w AS pe, lag(scan_id) OVER w AS pid FROM x WINDOW w AS (PARTITION BY session_id, board ORDER BY st, scan_id))
SELECT session_id, 'scans' AS table_name, CAST(scan_id AS VARCHAR) AS key, 'sample count' AS rule FROM scan WHERE samples <> 4
UNION ALL SELECT session_id, 'scans', CAST(scan_id AS VARCHAR), 'overlaps previous scan' FROM y WHERE st < pe
UNION ALL SELECT session_id, 'scans', CAST(scan_id AS VARCHAR), 'id not increasing' FROM y WHERE scan_id <= pid
UNION ALL SELECT session_id, 'scans', CAST(scan_id AS VARCHAR), 'outside span' FROM scan WHERE frequency_hz + 117150 > 922000000
UNION ALL SELECT session_id, 'scans', CAST(scan_id AS VARCHAR), 'negative time' FROM x WHERE st < 0""",
)
def dq10(t: Testbed) -> DataFrame:
    early = F.col("scan_id") % 53 == 0
    bad = t.rssi_scans.withColumn("start_us", F.when(early, F.col("start_us") - 110_000).otherwise(F.col("start_us")))
    bad = bad.withColumn("utc_start_us", F.when(early, F.col("utc_start_us") - 110_000).otherwise(F.col("utc_start_us")))
    return dq.scan_violations(bad, 4, 902_000_000, 922_000_000, CHUNK_US)


@query(
    "q_dq11_packet_profiles",
    """
WITH p(lane_label, b, sf) AS (VALUES ('lane 0', 250000, 11), ('lane 1', 125000, 9), ('lane 2', 500000, 8))
SELECT session_id, 'packets' AS table_name, CAST(reception_id AS VARCHAR) AS key, CASE WHEN b IS NULL THEN 'no profile' ELSE 'disagrees with profile' END AS rule
FROM rec LEFT JOIN p USING (lane_label) WHERE b IS NULL OR bandwidth_hz <> b OR spreading_factor <> sf""",
)
def dq11(t: Testbed) -> DataFrame:
    lane = F.col("lane_label")
    profiles = t.receptions.select("session_id", "lane_label").distinct().where(lane != "lane 3").select(
        "session_id", "lane_label",
        F.when(lane == "lane 0", 250_000).when(lane == "lane 1", 125_000).otherwise(500_000).alias("profile_bandwidth_hz"),
        F.when(lane == "lane 0", 11).when(lane == "lane 1", 9).otherwise(8).alias("profile_spreading_factor"),
    )
    return dq.packet_violations(t.receptions, profiles)


@query(
    "q_dq12_acquisition_rules",
    """
SELECT session_id, 'acquisitions' AS table_name, CAST(acq_id AS VARCHAR) AS key, 'overlaps previous' AS rule FROM acqs WHERE acq_id = 2 AND session_id % 2 = 0
UNION ALL SELECT session_id, 'acquisitions', CAST(acq_id AS VARCHAR), 'open before next' FROM acqs WHERE acq_id = 1 AND session_id % 3 = 0""",
)
def dq12(t: Testbed) -> DataFrame:
    bad = t.acquisitions.withColumn("start_us", F.when((F.col("acq_id") == 2) & (F.col("session_id") % 2 == 0), F.col("start_us") - 1).otherwise(F.col("start_us")))
    return dq.acquisition_violations(bad.withColumn("finalized", F.col("session_id") % 3 != 0))


@query(
    "q_dq13_order_and_grid",
    """
WITH x AS (SELECT session_id, acq_id, tile_id, end_sample, end_us, CASE WHEN tile_id % 97 = 0 THEN start_us - 30000 ELSE start_us END AS st,
  CASE WHEN tile_id % 97 = 0 THEN first_sample - 384 ELSE first_sample END AS fs, CASE WHEN tile_id % 83 = 0 THEN 63 ELSE 64 END AS n FROM tile),
y AS (SELECT *, lag(end_sample) OVER w AS pe, lag(end_us) OVER w AS pt, lag(acq_id) OVER w AS pa, lag(n) OVER w AS pn FROM x WINDOW w AS (PARTITION BY session_id ORDER BY st, tile_id))
SELECT session_id, 'tile_order' AS table_name, CAST(tile_id AS VARCHAR) AS key, 'overlap or disorder' AS rule FROM y WHERE fs < pe OR st < pt
UNION ALL SELECT session_id, 'tile_order', CAST(tile_id AS VARCHAR), 'grid changes in acquisition' FROM y WHERE pa = acq_id AND pn <> n""",
)
def dq13(t: Testbed) -> DataFrame:
    from bandwatch.catalog.sequences import shifted

    bad = shifted(t).withColumn("bin_count", F.when(F.col("tile_id") % 83 == 0, 63).otherwise(F.col("bin_count")))
    return dq.order_and_grid_violations(bad, CHUNK_US)


@query(
    "q_dq14_decoder_counters",
    """
WITH c AS (SELECT session_id, lane_label, count(*) FILTER (WHERE crc_valid) AS crc_valid, count(*) FILTER (WHERE status <= 1) AS completed, count(*) FILTER (WHERE status = 0) AS classified FROM rec GROUP BY ALL)
SELECT session_id, 'decoder' AS table_name, lane_label AS key, 'crc valid above completed' AS rule FROM c WHERE crc_valid > completed
UNION ALL SELECT session_id, 'decoder', lane_label, 'started above candidates' FROM c WHERE lane_label = 'lane 1'""",
)
def dq14(t: Testbed) -> DataFrame:
    c = t.receptions.groupBy("session_id", "lane_label").agg(
        F.count("*").alias("candidates"),
        (F.count("*") + F.when(F.col("lane_label") == "lane 1", 1).otherwise(0)).alias("started"),
        F.count_if("crc_valid").alias("crc_valid"),
        F.count_if(F.col("status") <= 1).alias("completed"),
        F.count_if(F.col("status") == 0).alias("classified"),
    )
    return dq.decoder_violations(c)


@query(
    "q_dq15_reconciliation",
    "SELECT DISTINCT session_id, 'sessions' AS table_name, CAST(session_id AS VARCHAR) AS key, 'tiles against session' AS rule FROM ev WHERE session_id % 2 = 1",
)
def dq15(t: Testbed) -> DataFrame:
    saved = t.sessions.withColumn("measurement_us", F.col("measurement_us") + F.col("session_id") % 2)
    return dq.reconciliation(t.tiles, t.acquisitions, saved)


@query(
    "q_dq16_histogram_sessions",
    """
WITH o AS (SELECT DISTINCT session_id FROM ev WHERE session_id % 2 = 0)
SELECT session_id, 'sessions' AS table_name, CAST(session_id AS VARCHAR) AS key, 'spectrum rows in histogram session' AS rule FROM o WHERE session_id IN (SELECT session_id FROM tile)
UNION ALL SELECT session_id, 'sessions', CAST(session_id AS VARCHAR), 'packets against receptions' FROM o WHERE session_id IN (SELECT session_id FROM rec)""",
)
def dq16(t: Testbed) -> DataFrame:
    only = t.sessions.withColumn("source", F.when(F.col("session_id") % 2 == 0, "histogram").otherwise(F.col("source")))
    return dq.histogram_session_violations(only, t.tiles, t.receptions.where("crc_valid"), t.receptions)


@query(
    "q_fp12_validated_selection",
    "SELECT session_id, count(*) AS tiles FROM sel GROUP BY ALL",
)
def fp12(t: Testbed) -> DataFrame:
    """A selection is checked when it is built; bad ones never reach Spark."""
    from dataclasses import replace

    from bandwatch.operators.select import clip_time

    for bad in ({"time_bucket_s": 0.0}, {"max_events": 2001}, {"upper_hz": 1.0}, {"elapsed_end": 0.05}):
        try:
            replace(SEL, **bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    return clip_time(t.tiles, SEL).groupBy("session_id").agg(F.count("*").alias("tiles"))
