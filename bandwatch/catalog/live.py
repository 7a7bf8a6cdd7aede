"""Streaming queries (each drains the given files as a stream) and report products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.catalog.occupancy import SEL, TIME_SQL, m, s
from bandwatch.catalog.places import CELL_M, GEO_SQL, SCAN_HI, SCAN_LO, SCAN_Q, SCAN_SQL
from bandwatch.catalog.prelude import SEL_HI_US, SEL_LO_US, pct, r6
from bandwatch.catalog.registry import query
from bandwatch.functions.power import micro
from bandwatch.operators.occupancy import seconds_columns
from bandwatch.plans import reports
from bandwatch.session import shared_folder
from bandwatch.sources.testbed import Testbed
from bandwatch.streaming import jobs


#: The column that cuts a table into files in time order.
CLOCKS = {"events": "event_id", "embeddings": "vec_id", "orders": "o_orderkey"}
FILES = 3


def live(t: Testbed, table: str) -> Testbed:
    """The test tables with one of them as a stream of three slices in time order, a micro-batch each.

    A slice has as many files as a third of the table has partitions. Where a slice is too small
    to fill them all, each slice is one file, so that no micro-batch takes rows of two slices.
    """
    rows, clock = t.raw(table), CLOCKS[table]
    low, high = rows.agg(F.min(clock), F.max(clock)).first()
    edges = [low + (high - low + 1) * k // FILES for k in range(FILES + 1)]
    for files in (max(1, rows.rdd.getNumPartitions() // FILES), 1):
        folder = shared_folder(t.spark, "stream-input")
        for k in range(FILES):
            part = rows.where((F.col(clock) >= edges[k]) & (F.col(clock) < edges[k + 1]))
            (part.repartition(files) if files > 1 else part.coalesce(1)).write.parquet(f"{folder}/{table}-{k}")
        if all(len(t.spark.read.parquet(f"{folder}/{table}-{k}").inputFiles()) == files for k in range(FILES)):
            break
    return Testbed(t.spark, t.sf_dir, streams={table: f"{folder}/*"}, batch_files=files)


def session_ends(l: Testbed, t: Testbed) -> DataFrame:
    """The stream's last record of each session, as the mark that the session ended."""
    last = t.acquisitions.groupBy("session_id").agg(F.max("end_us").alias("last_us"))
    return l._events.join(last, "session_id").where("end_us = last_us").select("session_id")


@query(
    "q_st1_live_bin_totals",
    f"""
WITH c AS (SELECT session_id, acq_id, bin, count(*) AS n FROM cell GROUP BY ALL),
l AS (SELECT session_id, acq_id, bin, count(*) AS tiles, avg(power(10.0::DOUBLE, (-80.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) / 10)) AS p, max(-70.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) AS pk
  FROM tile, binof GROUP BY ALL)
SELECT l.session_id, l.acq_id, CAST(l.bin AS INTEGER) AS bin, coalesce(n, 0) * 5000 / 1e6 AS active_s, coalesce(n, 0) AS cells, tiles * 20000 / 1e6 AS observed_s,
  {r6("10.0::DOUBLE * log10(p)")} AS mean_dbfs, {r6("pk")} AS peak_dbfs
FROM l LEFT JOIN c ON c.session_id = l.session_id AND c.acq_id = l.acq_id AND c.bin = l.bin""",
)
def st1(t: Testbed) -> DataFrame:
    d = jobs.drained(jobs.bin_totals(live(t, "events").tiles, t.acquisitions), ["session_id", "acq_id", "bin"])
    mean = 10 * F.log10(F.col("energy") / F.col("observed_us"))
    return d.select("session_id", "acq_id", "bin", s("active"), "cells", s("observed"), micro(mean).alias("mean_dbfs"), micro(F.col("peak_dbfs")).alias("peak_dbfs"))


@query(
    "q_st2_survey_windows",
    """
WITH RECURSIVE b AS (SELECT session_id, start_us // 20000 + 1 AS tile_id, count(DISTINCT f) * 5000 AS busy FROM cell GROUP BY ALL),
s AS (SELECT session_id, min(start_us) AS a, max(end_us) AS z FROM tile GROUP BY ALL),
w AS (SELECT session_id, a, z, (SELECT min(end_us) FROM tile t WHERE t.session_id = s.session_id AND t.end_us >= a + 5000000) AS e FROM s
  UNION ALL SELECT session_id, e, z, (SELECT min(end_us) FROM tile t WHERE t.session_id = w.session_id AND t.end_us >= w.e + 5000000) FROM w WHERE e < z)
SELECT session_id, a / 1e6 AS window_start_s, coalesce(e, z) / 1e6 AS window_end_s, count(*) * 20000 / 1e6 AS observed_s,
  CAST(coalesce(sum(busy), 0) AS BIGINT) / 1e6 AS busy_s, count(*) AS tiles
FROM w JOIN tile USING (session_id) LEFT JOIN b USING (session_id, tile_id) WHERE start_us >= a AND end_us <= coalesce(e, z) GROUP BY session_id, a, e, z""",
)
def st2(t: Testbed) -> DataFrame:
    """Windows depend on the data; the session's end closes the last one."""
    l = live(t, "events")
    return seconds_columns(jobs.drained(jobs.survey_windows(l.tiles, t.acquisitions, session_ends(l, t))))


@query(
    "q_st2_aligned_windows",
    """
WITH b AS (SELECT session_id, start_us // 20000 + 1 AS tile_id, count(DISTINCT f) * 5000 AS busy FROM cell GROUP BY ALL)
SELECT session_id, utc_start_us // 5000000 * 5000000 AS window_start_us, count(*) * 20000 / 1e6 AS observed_s, CAST(coalesce(sum(busy), 0) AS BIGINT) / 1e6 AS busy_s, count(*) AS tiles
FROM tile LEFT JOIN b USING (session_id, tile_id) GROUP BY ALL""",
)
def st2_aligned(t: Testbed) -> DataFrame:
    d = jobs.aligned_windows(live(t, "events").tiles, t.acquisitions)
    return jobs.drained(d, ["session_id", "window_start_us"]).select("session_id", "window_start_us", s("observed"), s("busy"), "tiles")


@query(
    "q_st3_live_buckets",
    """
WITH f AS (SELECT session_id, start_us + 5000 * f AS a, start_us + 5000 * f + 5000 AS b, EXISTS (SELECT 1 FROM cell c WHERE c.session_id = t.session_id AND c.start_us = t.start_us AND c.f = q.f) AS busy FROM tile t, range(4) q(f)),
p AS (SELECT session_id, a, b, busy, unnest(range(a // 33000, (b - 1) // 33000 + 1)) AS bucket FROM f)
SELECT session_id, bucket, sum(least(b, (bucket + 1) * 33000) - greatest(a, bucket * 33000)) / 1e6 AS observed_s,
  sum(CASE WHEN busy THEN least(b, (bucket + 1) * 33000) - greatest(a, bucket * 33000) ELSE 0 END) / 1e6 AS busy_s FROM p GROUP BY ALL""",
)
def st3(t: Testbed) -> DataFrame:
    d = jobs.time_buckets(live(t, "events").tiles, t.acquisitions, 33_000)
    return jobs.drained(d, ["session_id", "bucket"]).select("session_id", "bucket", s("observed"), s("busy"))


@query(
    "q_st4_live_sample_gaps",
    """
WITH blk AS (SELECT vec_id // 250 AS session_id, vec_id % 250 * 32 AS fs FROM embeddings WHERE vec_id % 50 <> 49),
br AS (SELECT *, lag(fs + 32) OVER (PARTITION BY session_id ORDER BY fs) AS pe FROM blk)
SELECT session_id, pe AS gap_first_sample, fs - pe AS missing_samples, 'application_drop' AS reason FROM br WHERE fs > pe""",
)
def st4(t: Testbed) -> DataFrame:
    blocks = live(t, "embeddings").iq_blocks.withColumn("n", (F.size("iq") / 2).cast("bigint"))
    return jobs.drained(jobs.sample_gaps(blocks))


@query(
    "q_st5_source_stalls",
    """
WITH e AS (SELECT user_id % 16 AS session_id, event_id AS seq, epoch_us(ts) AS t0 FROM events),
x AS (SELECT *, lag(t0) OVER (PARTITION BY session_id ORDER BY t0, seq) AS p FROM e)
SELECT session_id, seq, p AS stalled_from_us, t0 AS resumed_us, 'source_stall' AS reason FROM x WHERE t0 - p > 4000000000""",
)
def st5(t: Testbed) -> DataFrame:
    """Stalls in recorded arrival times; the live watchdog is `jobs.sample_gaps(stall_ms=...)`."""
    from bandwatch.operators.sequences import stalls

    arrivals = t.raw("events").select(
        (F.col("user_id") % 16).alias("session_id"), F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival_us"),
    )
    return stalls(arrivals, 4_000_000_000, 86_400_000_000)


@query("q_st6_live_bursts")
def st6(t: Testbed) -> DataFrame:
    """Equals the batch bursts of the same tiles (tested)."""
    l = live(t, "events")
    return seconds_columns(jobs.drained(jobs.live_bursts(l.tiles, t.acquisitions, session_ends(l, t))))


@query("q_st7_live_events")
def st7(t: Testbed) -> DataFrame:
    from bandwatch.catalog.detection import frames_of

    l = live(t, "events")
    return jobs.drained(jobs.live_events(frames_of(l), session_ends(l, t)))


@query(
    "q_st8_live_positions",
    """
WITH m AS (SELECT t.session_id, t.tile_id, t.end_us, max(struct_pack(seq := seq, valid := valid, manual := manual, mono := monotonic_us, lat := latitude, lon := longitude)) AS f
  FROM (SELECT session_id, tile_id, end_us FROM tile) t LEFT JOIN pos p ON p.session_id = t.session_id AND p.monotonic_us <= t.end_us AND p.monotonic_us > t.end_us - 4000000 GROUP BY ALL)
SELECT session_id, tile_id AS fact_id, CASE WHEN f.valid AND (f.manual OR end_us - f.mono <= 40000) THEN f.lat END AS latitude,
  CASE WHEN f.valid AND (f.manual OR end_us - f.mono <= 40000) THEN f.lon END AS longitude FROM m""",
)
def st8(t: Testbed) -> DataFrame:
    l = live(t, "events")
    facts = l.tiles.select("session_id", F.col("end_us").alias("t_us"), F.col("tile_id").alias("fact_id"))
    return jobs.drained(jobs.live_positions(facts, l.positions, 40_000))


@query(
    "q_st9_late_tiles",
    """
SELECT session_id, tile_id, start_us, tile_id % 10 = 0 AND start_us < max(CASE WHEN tile_id % 10 <> 0 THEN end_us END) OVER (PARTITION BY session_id) AS late FROM tile""",
)
def st9(t: Testbed) -> DataFrame:
    """Every tenth tile comes in a second file, behind the others."""
    folder = shared_folder(t.spark, "stream-input")
    for k, rule in enumerate(("tile_id % 10 <> 0", "tile_id % 10 = 0")):
        t.tiles.select("session_id", "tile_id", "start_us", "end_us").where(rule).coalesce(1).write.parquet(f"{folder}/{k}")
    files = t.spark.readStream.schema("session_id bigint, tile_id bigint, start_us bigint, end_us bigint")
    return jobs.drained(jobs.ordered_or_late(files.option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")))


@query(
    "q_st10_live_deduplication",
    "SELECT DISTINCT session_id, monotonic_us // 100000 AS slot FROM pos",
)
def st10(t: Testbed) -> DataFrame:
    p = live(t, "events").positions.withColumn("slot", F.expr("monotonic_us div 100000"))
    d = jobs.without_duplicates(p.select("session_id", "slot", "utc_us"), ["session_id", "slot"], "utc_us", "1 day")
    return jobs.drained(d).select("session_id", "slot")


@query(
    "q_st11_latest_readings",
    f"""SELECT session_id, board, frequency_hz, scan_id, {r6('CAST(above AS DOUBLE) / samples')} AS exceedance FROM scan
QUALIFY row_number() OVER (PARTITION BY session_id, board, frequency_hz ORDER BY scan_id DESC) = 1""",
)
def st11(t: Testbed) -> DataFrame:
    """Scans are written as files first, then read as a stream."""
    path = shared_folder(t.spark, "scans")
    t.rssi_scans.write.parquet(path)
    stream = t.spark.readStream.schema(t.rssi_scans.schema).parquet(path)
    d = jobs.drained(jobs.latest_readings(stream), ["session_id", "board", "frequency_hz"])
    return d.select("session_id", "board", "frequency_hz", "scan_id", m("exceedance"))


@query(
    "q_st12_checkpoint_counters",
    """
SELECT session_id, utc_start_us // 1000000 * 1000000 AS second_us, count(*) * 20000 / 1e6 AS input_s, count(*) FILTER (WHERE event_type <> 'error') * 20000 / 1e6 AS measured_s,
  count(*) FILTER (WHERE event_type = 'error') * 256 AS dropped_samples, count(*) FILTER (WHERE event_type = 'purchase') * 3 AS clipped, count(*) FILTER (WHERE event_type <> 'error') AS tiles
FROM ev GROUP BY ALL""",
)
def st12(t: Testbed) -> DataFrame:
    l = live(t, "events")
    d = jobs.drained(jobs.checkpoint_counters(l.tiles, l.coverage_gaps), ["session_id", "second_us"])
    return d.select("session_id", "second_us", s("input"), s("measured"), "dropped_samples", "clipped", "tiles")


@query(
    "q_st13_waveform_upserts",
    """
SELECT w.session_id, w.waveform_id, max(version) AS version FROM wave w JOIN (SELECT session_id, waveform_id, arg_min(bandwidth_hz, version) AS b, arg_min(spreading_factor, version) AS sf FROM wave GROUP BY ALL) f
ON f.session_id = w.session_id AND f.waveform_id = w.waveform_id AND f.b = w.bandwidth_hz AND f.sf = w.spreading_factor GROUP BY ALL""",
)
def st13(t: Testbed) -> DataFrame:
    table, checkpoint = shared_folder(t.spark, "waveforms"), shared_folder(t.spark, "checkpoint")
    rows = live(t, "orders").waveforms
    jobs.upsert_waveforms(rows, table, checkpoint, None).awaitTermination()
    return jobs.read_waveforms(t.spark, table, rows.schema).select("session_id", "waveform_id", "version")


@query("q_sk8_append_sink", "SELECT session_id, tile_id, start_us / 1e6 AS start_s FROM tile")
def sk8(t: Testbed) -> DataFrame:
    return jobs.drained(live(t, "events").tiles.select("session_id", "tile_id", "start_us")).select("session_id", "tile_id", s("start"))


# -- report products -----------------------------------------------------------------------


@query("q_rp1_analysis_bundle")
def rp1(t: Testbed) -> DataFrame:
    """Row counts of every table of the analysis bundle, per session."""
    parts = [
        d.groupBy("session_id").agg(F.count("*").alias("rows")).withColumn("part", F.lit(name))
        for name, d in reports.analyze(t, SEL).items()
    ]
    return reduce(DataFrame.unionByName, parts).select("part", "session_id", "rows")


@query(
    "q_rp2_frequency_report",
    f"""
WITH g AS (SELECT session_id, acq_id, sum(least(end_us, {SEL_HI_US}) - greatest(start_us, {SEL_LO_US})) AS gap_us, min(greatest(start_us, {SEL_LO_US})) AS g0, max(least(end_us, {SEL_HI_US})) AS g1
  FROM gap WHERE end_us > {SEL_LO_US} AND start_us < {SEL_HI_US} GROUP BY ALL),
x AS (SELECT session_id, acq_id, min(a) AS t0, max(b) AS t1, sum(b - a) AS o FROM sel GROUP BY ALL),
z AS (SELECT session_id, acq_id, bin, sum(f1 - f0) AS busy FROM selcell GROUP BY ALL)
SELECT x.session_id, x.acq_id, CAST(bin AS INTEGER) AS bin, o / 1e6 AS observed_s, coalesce(busy, 0) / 1e6 AS busy_s, least(t0, g0) / 1e6 AS earliest_s,
  greatest(t1, g1) / 1e6 AS latest_s, coalesce(gap_us, 0) / 1e6 AS gap_s, 0.0::DOUBLE AS excluded_missing_gps_s, {pct("coalesce(busy, 0)", "o")} AS occupancy_pct
FROM x JOIN selbin USING (acq_id) LEFT JOIN g ON g.session_id = x.session_id AND g.acq_id = x.acq_id LEFT JOIN z ON z.session_id = x.session_id AND z.acq_id = x.acq_id AND z.bin = selbin.bin""".replace(
        "CAST(bin AS INTEGER)", "CAST(selbin.bin AS INTEGER)"
    ),
)
def rp2(t: Testbed) -> DataFrame:
    d = seconds_columns(reports.report("frequency", t, SEL))
    return d.select(
        "session_id", "acq_id", "bin", "observed_s", "busy_s", "earliest_s", "latest_s", "gap_s", "excluded_missing_gps_s",
        m("occupancy_pct"),
    )


@query(
    "q_rp2_time_report",
    TIME_SQL.replace("SELECT e.session_id, e.acq_id, e.bucket, s0 / 1e6", "SELECT session_id, acq_id, bucket, elapsed_start_s, observed_s, busy_s, occupancy_pct FROM (SELECT e.session_id, e.acq_id, e.bucket, s0 / 1e6") + ")",
)
def rp2_time(t: Testbed) -> DataFrame:
    d = seconds_columns(reports.report("time", t, SEL))
    return d.select("session_id", "acq_id", "bucket", "elapsed_start_s", "observed_s", "busy_s", m("occupancy_pct"))


@query(
    "q_rp2_geographic_report",
    GEO_SQL + f" SELECT session_id, acq_id, cell_row, cell_column, CAST(bin AS INTEGER) AS bin, o / 1e6 AS observed_s, {pct('busy', 'o')} AS occupancy_pct FROM geo",
)
def rp2_geo(t: Testbed) -> DataFrame:
    d = seconds_columns(reports.report("geographic", t, SEL, cell_m=CELL_M, include_positions=True))
    return d.select("session_id", "acq_id", "cell_row", "cell_column", "bin", "observed_s", m("occupancy_pct"))


@query(
    "q_rp3_waveform_report",
    f"""SELECT session_id, waveform_id, version, floor(latitude * 1e4 + 0.5) / 1e4 AS latitude, -floor(-longitude * 1e4 + 0.5) / 1e4 AS longitude FROM wave
WHERE center_hz + bandwidth_hz / 2.0::DOUBLE > {SEL.lower_hz} AND center_hz - bandwidth_hz / 2.0::DOUBLE < {SEL.upper_hz}
  AND delimiter_us >= {SEL_LO_US} AND delimiter_us < {SEL_HI_US} AND session_id IN (SELECT session_id FROM acqs)""",
)
def rp3(t: Testbed) -> DataFrame:
    d = reports.report("waveforms", t, SEL, include_positions=True)
    return d.select("session_id", "waveform_id", "version", "latitude", "longitude")


@query(
    "q_rp3_track_report",
    f"""
WITH a AS (SELECT session_id, arg_min(utc_start_us - start_us, tile_id) AS anchor FROM tile GROUP BY ALL)
SELECT session_id, seq, (utc_us - anchor) / 1e6 AS elapsed_s, floor(latitude * 1e3 + 0.5) / 1e3 AS latitude FROM pos JOIN a USING (session_id)
WHERE valid AND utc_us - anchor >= {SEL_LO_US} AND utc_us - anchor < {SEL_HI_US}""",
)
def rp3_track(t: Testbed) -> DataFrame:
    d = reports.report("track", t, SEL, include_positions=True, decimals=3)
    return d.select("session_id", "seq", s("elapsed"), "latitude")


@query("q_rp4_findings")
def rp4(t: Testbed) -> DataFrame:
    """Row counts of every findings table, per session."""
    tables = reports.findings(t, SEL, CELL_M, include_positions=True)
    parts = [
        d.groupBy("session_id").agg(F.count("*").alias("rows")).withColumn("part", F.lit(name)) for name, d in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).select("part", "session_id", "rows")


@query(
    "q_rp5_rssi_report",
    f"""
WITH {SCAN_SQL} SELECT 'boards' AS part, session_id, count(DISTINCT board) AS rows FROM ss GROUP BY ALL
UNION ALL SELECT 'scans', session_id, count(*) FROM ss GROUP BY ALL
UNION ALL SELECT 'frequency', session_id, count(DISTINCT struct_pack(b := board, f := frequency_hz)) FROM ss GROUP BY ALL""",
)
def rp5(t: Testbed) -> DataFrame:
    tables = reports.rssi_report(t.rssi_scans, SCAN_LO, SCAN_HI, SCAN_Q)
    parts = [
        d.groupBy("session_id").agg(F.count("*").alias("rows")).withColumn("part", F.lit(name)) for name, d in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).select("part", "session_id", "rows")


@query(
    "q_rp7_acquisition_scope",
    f"""
SELECT session_id, acq_id, greatest({SEL_LO_US}, acq_start_us) / 1e6 AS scope_start_s, least({SEL_HI_US}, acq_end_us) / 1e6 AS scope_end_s, center_hz
FROM acqs WHERE acq_end_us > {SEL_LO_US} AND acq_start_us < {SEL_HI_US} AND center_hz + 6400 > {SEL.lower_hz} AND center_hz - 6400 < {SEL.upper_hz}
  AND (session_id, acq_id) IN (SELECT (session_id, acq_id) FROM sel)""",
)
def rp7(t: Testbed) -> DataFrame:
    d = reports.acquisition_scope(t.tiles, t.acquisitions, SEL)
    return d.select("session_id", "acq_id", s("scope_start"), s("scope_end"), "center_hz")


ARCHIVED = {
    "session": "(SELECT DISTINCT session_id FROM acqs)", "acquisition_segment": "acqs", "spectrum_tile": "tile", "spectrum_event": "nrg",
    "coverage_gap": "gap", "reception": "rec", "waveform": "wave", "receiver_position": "pos", "rssi_scan": "scan",
}


@query(
    "q_rp6_archive_pages",
    " UNION ALL ".join(f"SELECT '{kind}' AS record_type, session_id, count(*) AS records FROM {rows} GROUP BY ALL" for kind, rows in ARCHIVED.items()),
)
def rp6(t: Testbed) -> DataFrame:
    """The detailed archive, written and read back: records of every type and session."""
    from bandwatch.sources.sinks import write_archive

    path = shared_folder(t.spark, "archive")
    write_archive(reports.archive_records(t), path)
    return t.spark.read.parquet(path).groupBy("record_type", "session_id").agg(F.count("*").alias("records"))
