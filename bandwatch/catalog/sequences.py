"""Sequence, join and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwatch.catalog.occupancy import FREQ_SQL, OBS, SEL, m, s
from bandwatch.catalog.prelude import SEL_HI_US, SEL_LO_US, r6
from bandwatch.catalog.registry import query
from bandwatch.functions.power import micro, seconds
from bandwatch.operators import asof, charts, topk
from bandwatch.operators import occupancy as occ
from bandwatch.operators import select as sel_ops
from bandwatch.operators import sequences as seq
from bandwatch.operators.ordered import running_sum
from bandwatch.session import written_once
from bandwatch.sources.survey import receptions_metadata
from bandwatch.sources.testbed import Testbed

# Short chunks, so that the registered queries exercise the carry between chunks.
CHUNK_US = 7_000_000


def shifted(t: Testbed) -> DataFrame:
    """Tiles with some start times and samples pulled into their predecessor."""
    early = F.col("tile_id") % 97 == 0
    return t.tiles.withColumn("start_us", F.when(early, F.col("start_us") - 30_000).otherwise(F.col("start_us"))).withColumn(
        "first_sample", F.when(early, F.col("first_sample") - 384).otherwise(F.col("first_sample"))
    )


@query(
    "q_wn2_order_violations",
    """
WITH x AS (SELECT session_id, tile_id, end_sample, end_us, CASE WHEN tile_id % 97 = 0 THEN start_us - 30000 ELSE start_us END AS st,
  CASE WHEN tile_id % 97 = 0 THEN first_sample - 384 ELSE first_sample END AS fs FROM tile),
y AS (SELECT *, lag(end_sample) OVER w AS pe, lag(end_us) OVER w AS pt FROM x WINDOW w AS (PARTITION BY session_id ORDER BY st, tile_id))
SELECT session_id, tile_id, fs AS first_sample, pe AS previous_end_sample FROM y WHERE fs < pe OR st < pt""",
)
def wn2(t: Testbed) -> DataFrame:
    return seq.order_violations(shifted(t), CHUNK_US)


RUN_SQL = """
x AS (SELECT *, CASE WHEN lag(end_us) OVER w = start_us AND lag(acq_id) OVER w = acq_id THEN 0 ELSE 1 END AS st
  FROM tile WINDOW w AS (PARTITION BY session_id ORDER BY start_us)),
y AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY start_us) AS rid FROM x),
runs AS (SELECT *, min(start_us) OVER (PARTITION BY session_id, rid) AS run_us FROM y)"""


@query(
    "q_wn3_contiguous_runs",
    f"""
WITH {RUN_SQL} SELECT session_id, run_us / 1e6 AS run_s, acq_id, max(end_us) / 1e6 AS end_s, count(*) AS tiles, CAST(sum(4) AS BIGINT) AS frames
FROM runs GROUP BY session_id, run_us, acq_id""",
)
def wn3(t: Testbed) -> DataFrame:
    return occ.seconds_columns(seq.runs(t.tiles, CHUNK_US))


@query(
    "q_wn4_discontinuities",
    """
WITH x AS (SELECT session_id, first_sample, start_us, lag(end_sample) OVER w AS pe, lag(end_us) OVER w AS pt FROM tile
  WINDOW w AS (PARTITION BY session_id ORDER BY start_us))
SELECT session_id, count(*) FILTER (WHERE pe IS NOT NULL AND (pe <> first_sample OR pt <> start_us)) AS discontinuities, count(*) AS tiles
FROM x GROUP BY ALL""",
)
def wn4(t: Testbed) -> DataFrame:
    return seq.discontinuities(t.tiles, CHUNK_US)


@query(
    "q_wn5_merged_gaps",
    """
WITH g AS (SELECT session_id, start_us, end_us + gap_id % 4 * 25000 AS end_us FROM gap),
x AS (SELECT *, max(end_us) OVER (PARTITION BY session_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
y AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_us, end_us) AS i FROM x)
SELECT session_id, min(start_us) / 1e6 AS start_s, max(end_us) / 1e6 AS end_s, count(*) AS gaps FROM y GROUP BY session_id, i""",
)
def wn5(t: Testbed) -> DataFrame:
    longer = t.coverage_gaps.withColumn("end_us", F.col("end_us") + F.col("gap_id") % 4 * 25_000)
    return occ.seconds_columns(seq.merged_gaps(longer, CHUNK_US))


@query(
    "q_wn6_track_segments",
    """
WITH x AS (SELECT *, CASE WHEN valid AND coalesce(lag(valid) OVER w, false) AND monotonic_us - lag(monotonic_us) OVER w <= 100000
    AND manual = lag(manual) OVER w THEN 0 ELSE 1 END AS st FROM pos WINDOW w AS (PARTITION BY session_id ORDER BY monotonic_us, seq)),
y AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY monotonic_us, seq) AS i FROM x)
SELECT session_id, min(seq) AS first_seq, manual, count(*) AS fixes, min(monotonic_us) / 1e6 AS start_s, max(monotonic_us) / 1e6 AS end_s
FROM y WHERE valid GROUP BY session_id, i, manual""",
)
def wn6(t: Testbed) -> DataFrame:
    return occ.seconds_columns(seq.track_segments(t.positions, 100_000, CHUNK_US))


@query(
    "q_wn8_last_fixes",
    "SELECT session_id, seq, latitude, longitude FROM pos QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 1200",
)
def wn8(t: Testbed) -> DataFrame:
    return topk.recent_ascending(t.positions, 1200, "seq").select("session_id", "seq", "latitude", "longitude")


@query(
    "q_wn9_smoothed_peaks",
    f"""
WITH b AS (SELECT session_id, acq_id, start_us // 500000 AS bucket, bin // 16 AS col, max(-70.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) AS value
  FROM tile, binof GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, acq_id, col ORDER BY bucket) AS i FROM b),
y AS (SELECT a.session_id, a.acq_id, a.col, a.bucket, a.i,
    sum(0.4::DOUBLE * p.value * power(0.6::DOUBLE, a.i - p.i)) + -180.0::DOUBLE * power(0.6::DOUBLE, max(a.i)) AS y
  FROM n a JOIN n p ON a.session_id = p.session_id AND a.acq_id = p.acq_id AND a.col = p.col AND p.i <= a.i GROUP BY ALL)
SELECT session_id, acq_id, col AS "column", bucket, {r6("y")} AS smoothed FROM y""",
)
def wn9(t: Testbed) -> DataFrame:
    peaks = (
        t.tiles.select(
            "session_id", "acq_id", F.expr("start_us div 500000").alias("bucket"),
            F.posexplode("peak_dbfs").alias("bin", "p"),
        )
        .groupBy("session_id", "acq_id", "bucket", F.expr("cast(bin div 16 as bigint)").alias("column"))
        .agg(F.max("p").alias("value"))
    )
    d = charts.smoothed(peaks, ["session_id", "acq_id", "column"], "bucket")
    return d.select("session_id", "acq_id", "column", "bucket", m("smoothed"))


@query(
    "q_wn10_pooled_columns",
    f"""
WITH {FREQ_SQL}, p AS (SELECT session_id, acq_id, bin, CAST(busy_us AS BIGINT) AS busy_us FROM freq),
lo AS (SELECT session_id, acq_id, min(bin) AS b0, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT lo.session_id, lo.acq_id, b0, c.range AS col, c.range * n // 20 AS x0, greatest(c.range * n // 20 + 1, (c.range + 1) * n // 20) AS x1 FROM lo, range(20) c)
SELECT c.session_id, c.acq_id, col AS "column", max(busy_us) / 1e6 AS busy_s FROM c JOIN p ON p.session_id = c.session_id AND p.acq_id = c.acq_id AND bin - b0 >= x0 AND bin - b0 < x1 GROUP BY ALL
UNION ALL
SELECT c.session_id, c.acq_id, 1000 + col AS "column", max(busy_us) / 1e6 AS busy_s
FROM (SELECT lo.session_id, lo.acq_id, b0, c.range AS col, c.range * n // 100 AS x0, greatest(c.range * n // 100 + 1, (c.range + 1) * n // 100) AS x1 FROM lo, range(100) c) c
JOIN p ON p.session_id = c.session_id AND p.acq_id = c.acq_id AND bin - b0 >= x0 AND bin - b0 < x1 GROUP BY ALL""",
)
def wn10(t: Testbed) -> DataFrame:
    """Fewer columns than bins (20), then more columns than bins (100, offset by 1000)."""
    f = occ.frequency_summary(t.tiles, t.acquisitions, SEL)
    rows = f.select(
        "session_id", "acq_id", (F.col("bin") - F.col("bin_lo")).alias("bin"), "busy_us",
        (F.col("bin_hi") - F.col("bin_lo")).alias("n"),
    )
    few = charts.pool_columns(rows, ["session_id", "acq_id"], F.col("busy_us"), F.col("n"), 20)
    many = charts.pool_columns(rows, ["session_id", "acq_id"], F.col("busy_us"), F.col("n"), 100)
    both = few.unionByName(many.withColumn("column", F.col("column") + 1000))
    return both.select("session_id", "acq_id", "column", seconds(F.col("value")).alias("busy_s"))


@query(
    "q_wn11_occupancy_columns",
    f"""
WITH {FREQ_SQL},
p AS (SELECT session_id, CAST(floor((lower_hz - 906868500) * 32 / 25600.0::DOUBLE + 1e-9) AS BIGINT) AS c0,
    CAST(ceil((upper_hz - 906868500) * 32 / 25600.0::DOUBLE - 1e-9) AS BIGINT) - 1 AS c1, lower_hz + 100 AS center, busy_us, observed_us FROM freq),
x AS (SELECT session_id, unnest(range(greatest(c0, 0), least(c1, 31) + 1)) AS col, center, CAST(busy_us AS DOUBLE) / observed_us AS r FROM p WHERE c1 >= 0 AND c0 < 32)
SELECT session_id, col AS "column", {r6("max(r)")} AS max_ratio, arg_max(center, struct_pack(r := r, c := -center)) AS bin_center_hz,
  true AS any_observed, false AS any_unobserved FROM x GROUP BY ALL""",
)
def wn11(t: Testbed) -> DataFrame:
    f = occ.frequency_summary(t.tiles, t.acquisitions, SEL)
    d = charts.occupancy_columns(f, F.lit(906_868_500.0), F.lit(906_868_500.0 + 25_600), 32)
    return d.select("session_id", "column", m("max_ratio"), "bin_center_hz", "any_observed", "any_unobserved")


@query(
    "q_jn10_ranges_to_columns",
    """
WITH e AS (SELECT session_id, event_id, greatest(0, CAST(floor((lower_hz - 906868500) / 25600.0::DOUBLE * 40) AS BIGINT)) AS c0,
  least(39, CAST(ceil((upper_hz - 906868500) / 25600.0::DOUBLE * 40) AS BIGINT) - 1) AS c1 FROM nrg)
SELECT session_id, col AS "column", count(*) AS events FROM (SELECT session_id, unnest(range(c0, c1 + 1)) AS col FROM e WHERE c0 <= c1) GROUP BY ALL""",
)
def jn10(t: Testbed) -> DataFrame:
    d = charts.ranges_to_columns(t.events_energy, F.lit(906_868_500.0), F.lit(906_868_500.0 + 25_600), 40)
    return d.groupBy("session_id", "column").agg(F.count("*").alias("events"))


@query(
    "q_wn13_pause_gaps",
    """
WITH a AS (SELECT session_id, acq_id, acq_start_us + acq_id * 150000 AS st, acq_end_us AS en FROM acqs)
SELECT session_id, acq_id, p / 1e6 AS start_s, st / 1e6 AS end_s, 'reception_paused' AS reason
FROM (SELECT *, lag(en) OVER (PARTITION BY session_id ORDER BY acq_id) AS p FROM a) WHERE st > p""",
)
def wn13(t: Testbed) -> DataFrame:
    later = t.acquisitions.withColumn("start_us", F.col("start_us") + F.col("acq_id") * 150_000)
    return occ.seconds_columns(seq.pause_gaps(later))


BLOCK_SQL = """
blk AS (SELECT vec_id // 250 AS session_id, vec_id % 250 * 32 AS fs FROM embeddings WHERE vec_id % 50 <> 49),
br AS (SELECT *, lag(fs + 32) OVER (PARTITION BY session_id ORDER BY fs) AS pe FROM blk)"""


@query(
    "q_wn14_sample_gaps",
    f"""
WITH {BLOCK_SQL},
rn AS (SELECT *, sum(CASE WHEN pe = fs THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY fs) AS i FROM br),
tails AS (SELECT session_id, min(fs) AS f0, count(*) * 32 AS n FROM rn GROUP BY session_id, i)
SELECT session_id, pe AS gap_first_sample, fs - pe AS missing_samples, 'application_drop' AS reason FROM br WHERE fs > pe
UNION ALL SELECT session_id, f0 + n - n % 80 AS gap_first_sample, n % 80 AS missing_samples, 'partial_fft' AS reason FROM tails WHERE n % 80 > 0""",
)
def wn14(t: Testbed) -> DataFrame:
    blocks = t.iq_blocks.select("session_id", "first_sample", (F.size("iq") / 2).cast("bigint").alias("n"))
    drops = seq.sample_gaps(blocks, 1000).select("session_id", "gap_first_sample", "missing_samples", "reason")
    return drops.unionByName(seq.partial_frames(blocks, 80, 1000))


@query(
    "q_wn15_rebased_ids",
    """
WITH l AS (SELECT session_id, acq_id, j % 1250 + 1 AS lt, j % 1250 * 256 AS ls FROM ev),
o AS (SELECT session_id, acq_id, coalesce(sum(n) OVER w, 0) AS tb FROM (SELECT session_id, acq_id, count(*) AS n FROM ev GROUP BY ALL)
  WINDOW w AS (PARTITION BY session_id ORDER BY acq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, acq_id, CAST(lt + tb AS BIGINT) AS tile_id, CAST(ls + tb * 256 AS BIGINT) AS first_sample FROM l JOIN o USING (session_id, acq_id)""",
)
def wn15(t: Testbed) -> DataFrame:
    local = t._events.select(
        "session_id", "acq_id", (F.col("j") % 1250 + 1).alias("local_tile"), (F.col("j") % 1250 * 256).alias("local_sample")
    )
    sizes = local.groupBy("session_id", "acq_id").agg(
        F.count("*").alias("tiles"), (F.count("*") * 256).alias("samples")
    )
    return seq.rebased(local, sizes)


@query(
    "q_ag22_power_blocks",
    f"""
WITH {RUN_SQL},
k AS (SELECT *, (start_us - run_us) // 20000 // 5 AS block FROM runs),
e AS (SELECT session_id, acq_id, run_us, block, min(start_us) AS p0, max(end_us) AS p1, CAST(sum(4) AS BIGINT) AS frames, count(*) AS tiles FROM k GROUP BY ALL),
b AS (SELECT session_id, run_us, block, bin, sum(power(10.0::DOUBLE, (-80.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) / 10) * 4) AS p,
  max(-70.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) AS pk FROM k, binof GROUP BY ALL)
SELECT session_id, acq_id, p0 / 1e6 AS power_start_s, p1 / 1e6 AS power_end_s, frames, tiles, CAST(bin AS INTEGER) AS bin,
  {r6("10.0::DOUBLE * log10(p / frames)")} AS mean_dbfs, {r6("pk")} AS peak_dbfs FROM e JOIN b USING (session_id, run_us, block)""",
)
def ag22(t: Testbed) -> DataFrame:
    d = seq.power_blocks(t.tiles_by_chunk(CHUNK_US), 100_000, CHUNK_US)
    return d.select(
        "session_id", "acq_id", s("power_start"), s("power_end"), "frames", "tiles", "bin", m("mean_dbfs"), m("peak_dbfs")
    )


@query(
    "q_ag23_background",
    f"SELECT session_id, tile_id, {r6('background_dbfs')} AS background_dbfs FROM tile",
)
def ag23(t: Testbed) -> DataFrame:
    return seq.background(t.tiles).select("session_id", "tile_id", m("background_dbfs"))


# -- joins ------------------------------------------------------------------------


@query(
    "q_jn1_left_outer_chain",
    f"""
WITH {RUN_SQL},
k AS (SELECT session_id, tile_id, acq_id, run_us, (start_us - run_us) // 20000 // 5 AS block, start_us, end_us FROM runs),
blk AS (SELECT session_id, run_us, block, min(start_us) AS p0, max(end_us) AS p1 FROM k GROUP BY ALL)
SELECT k.session_id, tile_id, CASE WHEN run_us % 3 <> 0 THEN p0 / 1e6 END AS power_start_s, CASE WHEN run_us % 3 <> 0 THEN p1 / 1e6 END AS power_end_s,
  p.latitude, p.longitude FROM k JOIN blk USING (session_id, run_us, block)
LEFT JOIN pos p ON p.session_id = k.session_id AND p.monotonic_us = k.start_us""",
)
def jn1(t: Testbed) -> DataFrame:
    """Tile to shared power block and fix; every third block is missing and stays visible as NULL."""
    rows = t.tiles.select(
        "session_id", "acq_id", "tile_id", "first_center_hz", "bin_width_hz", "bin_count", "frame_count",
        F.col("start_us").alias("from_us"), F.col("end_us").alias("to_us"),
    )
    keyed = seq.block_keys(rows, 100_000, CHUNK_US)
    blocks = (
        keyed.groupBy("session_id", "run_us", "block")
        .agg(F.min("from_us").alias("power_start_us"), F.max("to_us").alias("power_end_us"))
        .where("run_us % 3 <> 0")
    )
    fixes = t.positions.select("session_id", F.col("monotonic_us").alias("from_us"), "latitude", "longitude")
    d = keyed.join(blocks, ["session_id", "run_us", "block"], "left").join(fixes, ["session_id", "from_us"], "left")
    return d.select("session_id", "tile_id", s("power_start"), s("power_end"), "latitude", "longitude")


@query(
    "q_jn2_window_bins",
    f"""
WITH w AS (SELECT session_id, acq_id, start_us // 5000000 AS window_id, min(start_us) AS w0, max(end_us) AS w1, sum(end_us - start_us) AS o FROM tile GROUP BY ALL),
b AS (SELECT session_id, acq_id, start_us // 5000000 AS window_id, bin, count(*) * 5000 AS active FROM cell GROUP BY ALL)
SELECT session_id, acq_id, window_id, CAST(bin AS INTEGER) AS bin, w0 / 1e6 AS window_start_s, w1 / 1e6 AS window_end_s, o / 1e6 AS observed_s,
  active / 1e6 AS active_s, {r6("CAST(active AS DOUBLE) / o")} AS occupancy FROM w JOIN b USING (session_id, acq_id, window_id)""",
)
def jn2(t: Testbed) -> DataFrame:
    from bandwatch.operators.frames import active_cells
    from bandwatch.plans.query import SurveyQuery

    key = F.expr("start_us div 5000000").alias("window_id")
    windows = t.tiles.groupBy("session_id", "acq_id", key).agg(
        F.min("start_us").alias("window_start_us"),
        F.max("end_us").alias("window_end_us"),
        F.sum(F.col("end_us") - F.col("start_us")).alias("observed_us"),
    )
    every = sel_ops.selected_tiles(t.tiles, t.acquisitions, SurveyQuery()).withColumn("window_id", key)
    bins = (
        active_cells(every, "window_id")
        .groupBy("session_id", "acq_id", "window_id", "bin")
        .agg(F.sum(F.col("f1_us") - F.col("f0_us")).alias("active_us"))
    )
    d = windows.join(bins, ["session_id", "acq_id", "window_id"])
    return d.select(
        "session_id", "acq_id", "window_id", "bin", s("window_start"), s("window_end"), s("observed"), s("active"),
        micro(F.col("active_us") / F.col("observed_us")).alias("occupancy"),
    )


@query(
    "q_jn3_position_at_tile_end",
    """
WITH m AS (SELECT t.session_id, t.tile_id, t.end_us, max(struct_pack(seq := seq, valid := valid, manual := manual, mono := monotonic_us, lat := latitude, lon := longitude)) AS f
  FROM (SELECT session_id, tile_id, end_us FROM tile) t LEFT JOIN pos p ON p.session_id = t.session_id AND p.monotonic_us <= t.end_us
    AND p.monotonic_us > t.end_us - 4000000 GROUP BY ALL)
SELECT session_id, tile_id, CASE WHEN f.valid AND (f.manual OR end_us - f.mono <= 40000) THEN f.lat END AS latitude,
  CASE WHEN f.valid AND (f.manual OR end_us - f.mono <= 40000) THEN f.lon END AS longitude FROM m""",
)
def jn3(t: Testbed) -> DataFrame:
    facts = t.tiles.select("session_id", "tile_id", "end_us")
    d = asof.position_at(facts, t.positions, "end_us", 40_000, CHUNK_US)
    return d.select("session_id", "tile_id", F.col("fix.latitude").alias("latitude"), F.col("fix.longitude").alias("longitude"))


@query(
    "q_jn4_segment_at",
    """
SELECT r.session_id, reception_id, acq_id AS segment_id FROM rec r LEFT JOIN
  (SELECT session_id, acq_id, acq_start_us, lead(acq_start_us, 1, 9223372036854775807) OVER (PARTITION BY session_id ORDER BY acq_start_us) AS nx, acq_end_us FROM acqs) a
ON a.session_id = r.session_id AND r.elapsed_us >= acq_start_us AND r.elapsed_us < nx AND r.elapsed_us <= acq_end_us""",
)
def jn4(t: Testbed) -> DataFrame:
    facts = t.receptions.select("session_id", "reception_id", "elapsed_us")
    return asof.segment_at(facts, t.acquisitions, "elapsed_us", CHUNK_US).select("session_id", "reception_id", "segment_id")


@query(
    "q_jn5_acquisitions_with_data",
    "SELECT session_id, acq_id, center_hz FROM acqs WHERE (session_id, acq_id) IN (SELECT (session_id, acq_id) FROM tile WHERE end_lat > 40.0145)",
)
def jn5(t: Testbed) -> DataFrame:
    owners = t.tiles.where("fix_end.latitude > 40.0145").select("session_id", "acq_id")
    return t.acquisitions.join(owners, ["session_id", "acq_id"], "left_semi").select("session_id", "acq_id", "center_hz")


@query(
    "q_jn6_orphans",
    """
SELECT session_id, reception_id, 'reception outside recorded tiles' AS rule FROM rec r
WHERE NOT EXISTS (SELECT 1 FROM tile t WHERE t.session_id = r.session_id AND t.tile_id = r.elapsed_us // 20000 + 1)""",
)
def jn6(t: Testbed) -> DataFrame:
    rec = t.receptions.withColumn("tile_id", F.expr("elapsed_us div 20000") + 1)
    known = t.tiles.select("session_id", "tile_id")
    return rec.join(known, ["session_id", "tile_id"], "left_anti").select(
        "session_id", "reception_id", F.lit("reception outside recorded tiles").alias("rule")
    )


# -- top-k and set operations ---------------------------------------------------------


@query(
    "q_tk1_busiest_bin",
    f"""
WITH {FREQ_SQL} SELECT session_id, acq_id, CAST(bin AS INTEGER) AS bin, lower_hz + 100 AS center_hz, {r6("100.0::DOUBLE * (CAST(busy_us AS DOUBLE) / observed_us)")} AS occupancy_pct
FROM freq WHERE NOT guarded QUALIFY row_number() OVER (PARTITION BY session_id, acq_id ORDER BY CAST(busy_us AS DOUBLE) / observed_us DESC, bin) = 1""",
)
def tk1(t: Testbed) -> DataFrame:
    d = topk.busiest_bin(occ.frequency_summary(t.tiles, t.acquisitions, SEL))
    return d.select("session_id", "acq_id", "bin", "center_hz", m("occupancy_pct"))


@query(
    "q_tk2_busiest_times",
    f"""
WITH p AS (SELECT session_id, acq_id, (f0 - greatest({SEL_LO_US}, (acq_id - 1) * 25000000)) // 750000 AS bucket, f0, f1, outside FROM selunion),
q AS (SELECT session_id, acq_id, (f1 - 1 - greatest({SEL_LO_US}, (acq_id - 1) * 25000000)) // 750000 AS b1, bucket, f0, f1, outside,
  greatest({SEL_LO_US}, (acq_id - 1) * 25000000) AS anchor FROM p),
c AS (SELECT session_id, acq_id, unnest(range(bucket, b1 + 1)) AS bucket, f0, f1, outside, anchor FROM q),
g AS (SELECT session_id, acq_id, bucket, sum(least(f1, anchor + (bucket + 1) * 750000) - greatest(f0, anchor + bucket * 750000)) AS o,
  sum(CASE WHEN outside THEN least(f1, anchor + (bucket + 1) * 750000) - greatest(f0, anchor + bucket * 750000) ELSE 0 END) AS u FROM c GROUP BY ALL)
SELECT session_id, acq_id, rank, bucket, o / 1e6 AS observed_s, {r6("100.0::DOUBLE * (CAST(u AS DOUBLE) / o)")} AS outside_pct
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, acq_id ORDER BY CAST(u AS DOUBLE) / o DESC, bucket) AS INTEGER) AS rank FROM g) WHERE rank <= 10""",
)
def tk2(t: Testbed) -> DataFrame:
    times = occ.time_summary(t.tiles, t.acquisitions, t.coverage_gaps, SEL)
    d = topk.busiest_times(times, 10)
    return d.select("session_id", "acq_id", "rank", "bucket", s("observed"), micro(100.0 * F.col("share")).alias("outside_pct"))


RECENT_SQL = """
SELECT session_id, 'event' AS kind, event_id AS id FROM nrg QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) <= 200
UNION ALL SELECT session_id, 'waveform', waveform_id * 2 + version FROM wave QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY waveform_id * 2 + version DESC) <= 256
UNION ALL SELECT session_id, 'reception', reception_id FROM rec QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY reception_id DESC) <= 512"""


@query("q_tk4_recent_lists", RECENT_SQL)
def tk4(t: Testbed) -> DataFrame:
    lists = [
        ("event", t.events_energy.select("session_id", F.col("event_id").alias("id")), 200),
        ("waveform", t.waveforms.select("session_id", (F.col("waveform_id") * 2 + F.col("version")).alias("id")), 256),
        ("reception", t.receptions.select("session_id", F.col("reception_id").alias("id")), 512),
    ]
    parts = [topk.recent_per_session(d, n, "id").withColumn("kind", F.lit(kind)) for kind, d, n in lists]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("session_id", "kind", "id")


@query(
    "q_tk5_latest_first",
    "SELECT session_id, event_id, start_us / 1e6 AS start_s FROM nrg ORDER BY start_us DESC, event_id DESC",
)
def tk5(t: Testbed) -> DataFrame:
    return topk.latest_first(t.events_energy, "start_us", "event_id").select("session_id", "event_id", s("start"))


@query(
    "q_tk6_ordered_bins",
    "SELECT DISTINCT session_id, first_center_hz + bin * 200 AS center_hz, 200.0::DOUBLE AS width_hz FROM tile, binof",
)
def tk6(t: Testbed) -> DataFrame:
    return bin_union(t).orderBy("center_hz", "width_hz")


@query(
    "q_so2_bin_union",
    "SELECT DISTINCT session_id, first_center_hz + bin * 200 AS center_hz, 200.0::DOUBLE AS width_hz FROM tile, binof",
)
def so2(t: Testbed) -> DataFrame:
    return bin_union(t)


def bin_union(t: Testbed) -> DataFrame:
    """Exact (center, width) bins over all acquisitions; grids are made distinct before they are spread."""
    grids = t.tiles.select("session_id", "first_center_hz", "bin_width_hz", "bin_count").distinct()
    bins = grids.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bin_count") - 1)))
    return bins.select(
        "session_id", (F.col("first_center_hz") + F.col("bin") * F.col("bin_width_hz")).alias("center_hz"),
        F.col("bin_width_hz").alias("width_hz"),
    ).distinct()


@query(
    "q_so1_record_union",
    """
SELECT session_id, record_type, count(*) AS records, sum(CASE WHEN lower_hz IS NULL THEN 1 ELSE 0 END)::BIGINT AS without_band FROM (
  SELECT session_id, 'spectrum_event' AS record_type, lower_hz FROM nrg UNION ALL SELECT session_id, 'coverage_gap', NULL FROM gap
  UNION ALL SELECT session_id, 'reception', NULL FROM rec) GROUP BY ALL""",
)
def so1(t: Testbed) -> DataFrame:
    events = t.events_energy.select("session_id", F.lit("spectrum_event").alias("record_type"), "lower_hz")
    gaps = t.coverage_gaps.select("session_id", F.lit("coverage_gap").alias("record_type"))
    receptions = t.receptions.select("session_id", F.lit("reception").alias("record_type"))
    every = events.unionByName(gaps, allowMissingColumns=True).unionByName(receptions, allowMissingColumns=True)
    return every.groupBy("session_id", "record_type").agg(
        F.count("*").alias("records"), F.count_if(F.col("lower_hz").isNull()).alias("without_band")
    )


@query(
    "q_so3_segments_without_data",
    "SELECT session_id, acq_id FROM acqs WHERE (session_id, acq_id) NOT IN (SELECT (session_id, acq_id) FROM tile WHERE end_lat > 40.01485 AND end_lon < -74.997)",
)
def so3(t: Testbed) -> DataFrame:
    owners = t.tiles.where("fix_end.latitude > 40.01485 and fix_end.longitude < -74.997").select("session_id", "acq_id")
    return t.acquisitions.join(owners, ["session_id", "acq_id"], "left_anti").select("session_id", "acq_id")


@query(
    "q_so4_duplicates",
    "SELECT session_id, waveform_id, count(*) AS copies FROM wave GROUP BY ALL HAVING count(*) > 1",
)
def so4(t: Testbed) -> DataFrame:
    return t.waveforms.groupBy("session_id", "waveform_id").agg(F.count("*").alias("copies")).where("copies > 1")


# -- counters -------------------------------------------------------------------------


@query(
    "q_ag8_capped_events",
    "SELECT session_id, event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS INTEGER) AS position, "
    "count(*) OVER (PARTITION BY session_id) AS total, count(*) OVER (PARTITION BY session_id) > 150 AS truncated FROM nrg "
    "QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id) <= 150",
)
def ag8(t: Testbed) -> DataFrame:
    d = topk.capped_with_total(t.events_energy, ["session_id"], F.col("event_id"), 150)
    return d.select("session_id", "event_id", "position", "total", "truncated")


@query(
    "q_ag10_waveform_groups",
    """
SELECT session_id, bandwidth_hz, spreading_factor, count(*) AS observations, count(*) FILTER (WHERE NOT complete_in_range) AS partial_range,
  count(*) FILTER (WHERE ambiguous) AS ambiguous, min(center_hz) AS lower_hz, max(center_hz) AS upper_hz FROM wave GROUP BY ALL""",
)
def ag10(t: Testbed) -> DataFrame:
    from bandwatch.operators.sessions import waveform_groups

    return waveform_groups(t.waveforms)


@query(
    "q_ag11_reception_counts",
    """
SELECT session_id, count(*) AS receptions, count(*) FILTER (WHERE crc_valid AND status = 0) AS classified,
  count(*) FILTER (WHERE status = 1) AS crc_failed, count(*) FILTER (WHERE status = 5) AS unsupported FROM rec GROUP BY ALL""",
)
def ag11(t: Testbed) -> DataFrame:
    from bandwatch.operators.sessions import reception_counts

    return reception_counts(t.receptions)


SUMMARY_SQL = """
SELECT s.session_id, source, tiles, clipped, events, gaps, gap_s, receptions, classified FROM
 (SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 'synthetic' ELSE 'receiver' END AS source FROM ev GROUP BY ALL) s
 JOIN (SELECT session_id, count(*) AS tiles, CAST(sum(clipped) AS BIGINT) AS clipped FROM tile GROUP BY ALL) USING (session_id)
 LEFT JOIN (SELECT session_id, count(*) AS events FROM nrg GROUP BY ALL) USING (session_id)
 LEFT JOIN (SELECT session_id, count(*) AS gaps, sum(end_us - start_us) / 1e6 AS gap_s FROM gap GROUP BY ALL) USING (session_id)
 LEFT JOIN (SELECT session_id, count(*) AS receptions, count(*) FILTER (WHERE crc_valid AND status = 0) AS classified FROM rec GROUP BY ALL) USING (session_id)"""


@query("q_sc7_session_summary", SUMMARY_SQL)
def sc7(t: Testbed) -> DataFrame:
    from bandwatch.operators.sessions import session_summary

    d = session_summary(t.sessions, t.tiles, t.events_energy, t.coverage_gaps, t.receptions)
    return d.select("session_id", "source", "tiles", "clipped", "events", "gaps", s("gap"), "receptions", "classified")


@query(
    "q_ag12_session_counters",
    """
SELECT session_id, coalesce(tiles, 0) AS tiles, coalesce(clipped, 0) AS clipped, coalesce(scans, 0) AS scans, coalesce(samples, 0) AS samples FROM
 (SELECT DISTINCT session_id FROM acqs)
 LEFT JOIN (SELECT session_id, count(*) AS tiles, CAST(sum(clipped) AS BIGINT) AS clipped FROM tile GROUP BY ALL) USING (session_id)
 LEFT JOIN (SELECT session_id, count(*) AS scans, CAST(sum(samples) AS BIGINT) AS samples FROM scan GROUP BY ALL) USING (session_id)""",
)
def ag12(t: Testbed) -> DataFrame:
    from bandwatch.operators.sessions import session_counters

    return session_counters(t.sessions, t.tiles, t.rssi_scans)


@query("q_ag20_event_quality", "SELECT CAST(quality AS INTEGER) AS quality, count(*) AS events FROM nrg GROUP BY ALL")
def ag20(t: Testbed) -> DataFrame:
    return t.events_energy.groupBy(F.col("quality").cast("int").alias("quality")).agg(F.count("*").alias("events"))


@query(
    "q_ag21_gap_totals",
    f"""
SELECT session_id, count(*) AS gaps, sum(end_us - start_us) / 1e6 AS gap_s,
  sum(greatest(0, least(end_us, {SEL_HI_US}) - greatest(start_us, {SEL_LO_US}))) / 1e6 AS selected_gap_s FROM gap GROUP BY ALL""",
)
def ag21(t: Testbed) -> DataFrame:
    from bandwatch.operators.sessions import gap_totals

    return occ.seconds_columns(gap_totals(t.coverage_gaps, SEL))


@query(
    "q_ag26_discovery_bands",
    f"""
SELECT session_id, subband, center_hz, processed_samples, abandoned_samples, gap_samples, candidate_limit_hits, track_limit_hits,
  {r6("CAST(processed_samples AS DOUBLE) / (processed_samples + abandoned_samples)")} AS processed_share FROM dband""",
)
def ag26(t: Testbed) -> DataFrame:
    from bandwatch.operators.sessions import band_coverage

    d = band_coverage(t.discovery_bands)
    return d.select(
        "session_id", "subband", "center_hz", "processed_samples", "abandoned_samples", "gap_samples",
        "candidate_limit_hits", "track_limit_hits", m("processed_share"),
    )


@query(
    "q_ag28_lane_health",
    """
SELECT session_id, lane_label, count(*) AS frames, count(*) FILTER (WHERE crc_valid AND status = 0) AS classified,
  count(*) FILTER (WHERE NOT crc_valid) AS crc_failures, sum(duration_us) / 1e6 AS processed_s FROM rec GROUP BY ALL""",
)
def ag28(t: Testbed) -> DataFrame:
    from bandwatch.operators.sessions import lane_health

    return occ.seconds_columns(lane_health(t.receptions))


# -- scans ------------------------------------------------------------------------------


@query(
    "q_sc1_tile_scan",
    "SELECT session_id, acq_id, tile_id, first_sample, start_us / 1e6 AS start_s, first_center_hz, CAST(clipped AS BIGINT) AS clipped, CAST(quality AS INTEGER) AS quality FROM tile",
)
def sc1(t: Testbed) -> DataFrame:
    return t.tiles.select("session_id", "acq_id", "tile_id", "first_sample", s("start"), "first_center_hz", "clipped", "quality")


@query("q_sc2_position_scan", "SELECT session_id, seq, latitude, longitude, altitude_m, manual, valid, hdop, satellites FROM pos")
def sc2(t: Testbed) -> DataFrame:
    return t.positions.select("session_id", "seq", "latitude", "longitude", "altitude_m", "manual", "valid", "hdop", "satellites")


@query("q_sc3_waveform_scan", "SELECT session_id, waveform_id, version, center_hz, bandwidth_hz, spreading_factor FROM wave")
def sc3(t: Testbed) -> DataFrame:
    return t.waveforms.select("session_id", "waveform_id", "version", "center_hz", "bandwidth_hz", "spreading_factor")


@query(
    "q_sc4_reception_scan",
    "SELECT session_id, reception_id, utc_us, elapsed_us, frequency_hz, bandwidth_hz, spreading_factor, coding_rate, duration_us, "
    "snr_db, frequency_error_hz, header_valid, crc_valid, lane_label, status, classification, evidence_port, evidence_signature, latitude, longitude FROM rec",
)
def sc4(t: Testbed) -> DataFrame:
    d = receptions_metadata(t.receptions)
    return d.select(*[c for c in d.columns if c != "fix"], "fix.latitude", "fix.longitude")


@query("q_sc5_gap_scan", "SELECT session_id, gap_id, CAST(missing_samples AS BIGINT) AS missing_samples, start_us / 1e6 AS start_s, end_us / 1e6 AS end_s, reason FROM gap")
def sc5(t: Testbed) -> DataFrame:
    return t.coverage_gaps.select("session_id", "gap_id", "missing_samples", s("start"), s("end"), "reason")


@query(
    "q_sc6_rssi_scan",
    "SELECT session_id, scan_id, board, frequency_hz, samples, start_us / 1e6 AS start_s, latitude, longitude FROM scan",
)
def sc6(t: Testbed) -> DataFrame:
    from bandwatch.operators.rssi import samples
    from bandwatch.sources.survey import scans_with_fix

    scans = t.rssi_scans.withColumn("fix_seq", F.when(F.col("fix").isNotNull(), F.col("scan_id")))
    fixes = scans.where("fix is not null").select("session_id", F.col("scan_id").alias("seq"), "fix.latitude", "fix.longitude")
    d = scans_with_fix(scans.drop("fix"), fixes)
    return d.select("session_id", "scan_id", "board", "frequency_hz", samples().alias("samples"), s("start"), "latitude", "longitude")


@query(
    "q_sc11_event_scan",
    f"SELECT session_id, event_id, start_us / 1e6 AS start_s, end_us / 1e6 AS end_s, lower_hz, upper_hz, {r6('mean_dbfs')} AS mean_dbfs, CAST(quality AS INTEGER) AS quality FROM nrg",
)
def sc11(t: Testbed) -> DataFrame:
    return t.events_energy.select(
        "session_id", "event_id", s("start"), s("end"), "lower_hz", "upper_hz", m("mean_dbfs"), F.col("quality").cast("int").alias("quality")
    )


@query("q_sc12_discovery_gap_scan", "SELECT session_id, gap_id, first_input_sample, end_input_sample, subband, reason FROM dgap")
def sc12(t: Testbed) -> DataFrame:
    return t.discovery_gaps


@query(
    "q_sc13_checkpoint_scan",
    """
WITH c AS (SELECT session_id, end_us // 1000000 AS sec, count(*) * 20000 AS input_us, count(*) FILTER (WHERE event_type <> 'error') * 20000 AS m_us,
  count(*) FILTER (WHERE event_type = 'error') * 256 AS dropped FROM ev GROUP BY ALL)
SELECT session_id, sec AS second, CAST(sum(input_us) OVER w AS BIGINT) / 1e6 AS input_s, CAST(sum(m_us) OVER w AS BIGINT) / 1e6 AS measured_s,
  CAST(sum(dropped) OVER w AS BIGINT) AS dropped FROM c WINDOW w AS (PARTITION BY session_id ORDER BY sec)""",
)
def sc13(t: Testbed) -> DataFrame:
    """Running coverage counters, one row per second."""
    per_second = t._events.groupBy("session_id", F.expr("end_us div 1000000").alias("second")).agg(
        (F.count("*") * 20_000).alias("i"),
        (F.count_if(F.col("event_type") != "error") * 20_000).alias("m"),
        (F.count_if(F.col("event_type") == "error") * 256).alias("d"),
    )
    rows = per_second.withColumn("_chunk", F.expr("second div 10"))
    for value, out in (("i", "input_us"), ("m", "measured_us"), ("d", "dropped")):
        rows = running_sum(rows, ["session_id"], ["second"], F.col(value), out)
    return rows.select("session_id", "second", s("input"), s("measured"), "dropped")


@query(
    "q_wn6_observation_tracks",
    None,
)
def wn6_observations(t: Testbed) -> DataFrame:
    obs = occ.observations(t.tiles, t.acquisitions, t.coverage_gaps, OBS)
    d = seq.observation_tracks(obs, 750_000)
    return d.select("session_id", "bucket", "segment", F.col("fix.latitude").alias("latitude"), F.col("fix.longitude").alias("longitude"))


# -- compact layout -------------------------------------------------------------------

COMPACT_SQL = f"""
{RUN_SQL},
k AS (SELECT *, (start_us - run_us) // 20000 // 50 AS block FROM runs),
kb AS (SELECT *, min(tile_id) OVER p AS power_id, min(start_us) OVER p AS p0, max(end_us) OVER p AS p1 FROM k WINDOW p AS (PARTITION BY session_id, run_us, block)),
lv AS (SELECT session_id, power_id, bin, 10.0::DOUBLE * log10(sum(power(10.0::DOUBLE, (-80.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) / 10)) / count(*)) AS m,
  max(-70.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) AS pk FROM kb, binof GROUP BY ALL)"""


def compact_of(t: Testbed):
    """The testbed's tiles in the compact layout, written as an archive would hold them."""
    from bandwatch.operators.compact import compact

    if "_compact" not in vars(t):
        tiles, blocks, fixes = compact(t.tiles_by_chunk(CHUNK_US), 1_000_000, CHUNK_US)  # fixes are written there
        vars(t)["_compact"] = (written_once(tiles, "compact"), written_once(blocks, "blocks"), fixes)
    return vars(t)["_compact"]


@query(
    "q_sc1_compact_tiles",
    f"""
WITH {COMPACT_SQL}
SELECT kb.session_id, tile_id, power_id, p0 / 1e6 AS power_start_s, p1 / 1e6 AS power_end_s, {r6("m")} AS first_mean_dbfs, {r6("pk")} AS first_peak_dbfs,
  CAST(quality | 512 AS INTEGER) AS quality, start_lat, end_lat FROM kb JOIN lv USING (session_id, power_id) WHERE bin = 0""",
)
def sc1_compact(t: Testbed) -> DataFrame:
    """A compact archive read back: block, levels and fixes of each tile."""
    from bandwatch.operators.compact import expand

    d = expand(*compact_of(t))
    return d.select(
        "session_id", "tile_id", "power_id", s("power_start"), s("power_end"),
        micro(F.get("mean_dbfs", F.lit(0))).alias("first_mean_dbfs"), micro(F.get("peak_dbfs", F.lit(0))).alias("first_peak_dbfs"),
        F.col("quality").cast("int").alias("quality"), F.col("fix_start.latitude").alias("start_lat"), F.col("fix_end.latitude").alias("end_lat"),
    )


@query(
    "q_jn1_three_references",
    f"""
WITH {COMPACT_SQL}
SELECT session_id, tile_id, power_id % 3 <> 0 AS has_power, start_lat IS NOT NULL AS has_start_fix, end_lat IS NOT NULL AS has_end_fix FROM kb""",
)
def jn1_three(t: Testbed) -> DataFrame:
    """Tiles keep their place where every third block is missing."""
    from bandwatch.operators.compact import expand

    tiles, blocks, fixes = compact_of(t)
    d = expand(tiles, blocks.where("power_id % 3 <> 0"), fixes)
    return d.select(
        "session_id", "tile_id", F.col("mean_dbfs").isNotNull().alias("has_power"), F.col("fix_start").isNotNull().alias("has_start_fix"),
        F.col("fix_end").isNotNull().alias("has_end_fix"),
    )


@query(
    "q_dq2_dangling_references",
    f"""
WITH {COMPACT_SQL}
SELECT session_id, 'power_id' AS reference, CAST(power_id AS VARCHAR) AS "key", count(*) AS uses FROM kb WHERE power_id % 3 = 0 GROUP BY ALL""",
)
def dq2_dangling(t: Testbed) -> DataFrame:
    """References of compact tiles to blocks and fixes that are not there; every third block was taken away."""
    from bandwatch.operators.compact import dangling

    tiles, blocks, fixes = compact_of(t)
    return dangling(tiles, blocks.where("power_id % 3 <> 0"), fixes)


@query(
    "q_jn6_reference_audit",
    """
SELECT session_id, 'reception lane' AS reference, lane_label AS "key", count(*) AS uses FROM rec WHERE lane_label = 'lane 3' GROUP BY ALL
UNION ALL SELECT session_id, 'waveform acquisition', CAST(delimiter_us // 5000000 + 1 AS VARCHAR), count(*) FROM wave w
  WHERE NOT EXISTS (SELECT 1 FROM acqs a WHERE a.session_id = w.session_id AND a.acq_id = delimiter_us // 5000000 + 1) GROUP BY ALL
UNION ALL SELECT session_id, 'gap band', CAST(subband AS VARCHAR), count(*) FROM dgap g
  WHERE NOT EXISTS (SELECT 1 FROM dband b WHERE b.session_id = g.session_id AND b.subband = g.subband) GROUP BY ALL
UNION ALL SELECT session_id, 'reception tile', CAST(elapsed_us // 20000 + 1 AS VARCHAR), count(*) FROM rec r
  WHERE NOT EXISTS (SELECT 1 FROM tile t WHERE t.session_id = r.session_id AND t.tile_id = r.elapsed_us // 20000 + 1) GROUP BY ALL""",
)
def jn6_audit(t: Testbed) -> DataFrame:
    """All references of a survey in one shuffle: lanes (one is not configured), acquisitions, bands, tiles."""
    from bandwatch.operators.compact import orphans

    lanes = t.receptions.select("session_id", "lane_label").distinct().where("lane_label <> 'lane 3'")
    segment, tile = F.expr("delimiter_us div 5000000") + 1, F.expr("elapsed_us div 20000") + 1
    return orphans({
        "reception lane": (t.receptions, F.col("lane_label"), lanes, F.col("lane_label")),
        "waveform acquisition": (t.waveforms, segment, t.acquisitions, F.col("acq_id")),
        "gap band": (t.discovery_gaps, F.col("subband"), t.discovery_bands, F.col("subband")),
        "reception tile": (t.receptions, tile, t.tiles, F.col("tile_id")),
    })


# -- status tables --------------------------------------------------------------------

LANE_SQL = """
ls AS (SELECT session_id, lane_label, CAST(right(lane_label, 1) AS INTEGER) % 2 AS board, elapsed_us AS at_us,
    row_number() OVER w AS n, crc_valid, status, duration_us FROM rec WINDOW w AS (PARTITION BY session_id, lane_label ORDER BY elapsed_us))"""


def lane_status(t: Testbed) -> DataFrame:
    """A status row per reception: the lane's counters since its last start; it starts anew every 40 receptions."""
    order = Window.partitionBy("session_id", "lane_label").orderBy("at_us")
    rows = t.receptions.withColumn("at_us", F.col("elapsed_us")).withColumn("n", F.row_number().over(order) - 1).withColumn("boot", F.expr("n div 40"))
    since = Window.partitionBy("session_id", "lane_label", "boot").orderBy("at_us")
    return rows.select(
        "session_id", "lane_label", (F.substring("lane_label", -1, 1).cast("int") % 2).alias("board"), "at_us",
        F.count("*").over(since).alias("frames"), F.count_if(F.col("crc_valid") & (F.col("status") == 0)).over(since).alias("classified"),
        F.count_if(~F.col("crc_valid")).over(since).alias("crc_failures"), F.sum("duration_us").over(since).alias("processed_us"),
    )


LANE_COUNTERS = ["frames", "classified", "crc_failures", "processed_us"]
LANE_SUMS = """count(*) AS frames, count(*) FILTER (WHERE crc_valid AND status = 0) AS classified, count(*) FILTER (WHERE NOT crc_valid) AS crc_failures,
  CAST(sum(duration_us) AS BIGINT) AS processed_us, count(*) FILTER (WHERE n > 1 AND n % 40 = 1) AS restarts"""


@query("q_ag28_lane_counters", f"WITH {LANE_SQL} SELECT session_id, lane_label, {LANE_SUMS} FROM ls GROUP BY ALL")
def ag28_lanes(t: Testbed) -> DataFrame:
    """Lane counters summed over their resets: as if every reception had been counted."""
    from bandwatch.operators.counters import totals

    return totals(lane_status(t), ["session_id", "lane_label"], "at_us", LANE_COUNTERS, chunk_us=CHUNK_US)


@query("q_ag28_board_counters", f"WITH {LANE_SQL} SELECT session_id, board, {LANE_SUMS} FROM ls GROUP BY ALL")
def ag28_boards(t: Testbed) -> DataFrame:
    """The lanes' increments summed by board."""
    from bandwatch.operators.counters import totals

    return totals(lane_status(t), ["session_id", "lane_label"], "at_us", LANE_COUNTERS, ["session_id", "board"], CHUNK_US)


@query(
    "q_ag28_board_health",
    """
SELECT session_id, board, CAST(sum(scans) AS BIGINT) AS scans, CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(receptions) AS BIGINT) AS receptions, CAST(sum(crc_failures) AS BIGINT) AS crc_failures FROM (
  SELECT session_id, board, 1 AS scans, samples, 0 AS receptions, 0 AS crc_failures FROM scan
  UNION ALL SELECT session_id, CAST(right(lane_label, 1) AS INTEGER) % 2, 0, 0, 1, CASE WHEN crc_valid THEN 0 ELSE 1 END FROM rec) GROUP BY ALL""",
)
def ag28_health(t: Testbed) -> DataFrame:
    from bandwatch.operators.counters import board_health

    return board_health(t.rssi_scans, t.receptions.withColumn("board", F.substring("lane_label", -1, 1).cast("int") % 2))


@query(
    "q_sc13_checkpoint_counters",
    """
SELECT session_id, count(*) * 20000 AS input_us, count(*) FILTER (WHERE event_type <> 'error') * 20000 AS measured_us,
  count(*) FILTER (WHERE event_type = 'error') * 256 AS dropped_samples, CAST(max(j) // 700 AS BIGINT) AS restarts FROM ev GROUP BY ALL""",
)
def sc13_counters(t: Testbed) -> DataFrame:
    """Checkpoint rows (a state each 20 ms, started anew after 700 of them) summed over the restarts."""
    from bandwatch.operators.counters import totals

    boot = Window.partitionBy("session_id", F.expr("j div 700")).orderBy("j")
    error = F.col("event_type") == "error"
    rows = t._events.select(
        "session_id", F.col("end_us").alias("at_us"), F.lit("measuring").alias("state"), (F.count("*").over(boot) * 20_000).alias("input_us"),
        (F.count_if(~error).over(boot) * 20_000).alias("measured_us"), (F.count_if(error).over(boot) * 256).alias("dropped_samples"),
    )
    return totals(rows, ["session_id"], "at_us", ["input_us", "measured_us", "dropped_samples"], chunk_us=CHUNK_US)


def discovery_status(t: Testbed) -> DataFrame:
    """A status per session from its bands; some name no known method, some have no fault text, some no acquisition."""
    bands = t.discovery_bands.groupBy("session_id").agg(
        F.sum("processed_samples").alias("accepted_input_samples"), F.sum("abandoned_samples").alias("abandoned_input_samples"),
        F.sum("gap_samples").alias("rejected_input_samples"), F.count("*").alias("observations"),
    )
    nothing = F.lit(0).cast("bigint")
    return bands.select(
        "session_id", F.lit(1).cast("bigint").alias("acq_id"), F.lit(True).alias("enabled"), F.lit(True).alias("finished"), (F.col("session_id") % 5 == 0).alias("failed"),
        F.when(F.col("session_id") % 7 == 0, "other").otherwise("lora-preamble-v2").alias("method"),
        F.when(F.col("session_id") % 10 == 0, "").when(F.col("session_id") % 11 == 0, F.repeat(F.lit("x"), 161)).otherwise("queue").alias("fault"),
        "accepted_input_samples", "rejected_input_samples", F.col("accepted_input_samples").alias("channelized_input_samples"), "abandoned_input_samples",
        F.when(F.col("session_id") % 13 == 0, -1).otherwise(0).cast("bigint").alias("source_queue_drops"), nothing.alias("stream_resets"),
        nothing.alias("result_overflows"), nothing.alias("gap_overflows"), "observations",
    )


@query(
    "q_sc12_discovery_status",
    """
SELECT session_id, CAST(sum(processed_samples) AS BIGINT) AS accepted_input_samples, CAST(sum(abandoned_samples) AS BIGINT) AS abandoned_input_samples,
  session_id % 5 = 0 AS failed, CASE WHEN session_id % 7 = 0 THEN 'other' ELSE 'lora-preamble-v2' END AS method FROM dband GROUP BY ALL""",
)
def sc12_status(t: Testbed) -> DataFrame:
    return written_once(discovery_status(t), "discovery-status").select("session_id", "accepted_input_samples", "abandoned_input_samples", "failed", "method")


@query(
    "q_dq9_status_rules",
    """
WITH d AS (SELECT DISTINCT session_id FROM dband)
SELECT session_id, 'discovery_status' AS table_name, '1' AS "key", 'method' AS rule FROM d WHERE session_id % 7 = 0
UNION ALL SELECT session_id, 'discovery_status', '1', 'failed without fault' FROM d WHERE session_id % 10 = 0
UNION ALL SELECT session_id, 'discovery_status', '1', 'fault text' FROM d WHERE session_id % 11 = 0 AND session_id % 10 <> 0
UNION ALL SELECT session_id, 'discovery_status', '1', 'negative counter' FROM d WHERE session_id % 13 = 0
UNION ALL SELECT session_id, 'discovery_status', '1', 'too many bands' FROM d WHERE session_id = 3
UNION ALL SELECT session_id, 'discovery_status', '1', 'no acquisition' FROM d WHERE NOT EXISTS (SELECT 1 FROM acqs a WHERE a.session_id = d.session_id AND acq_id = 1)""",
)
def dq9_status(t: Testbed) -> DataFrame:
    """Planted faults: methods, texts, counters, one session of 129 bands, statuses without an acquisition."""
    from bandwatch.operators.quality import discovery_status_violations

    bands = t.discovery_bands.withColumn("acq_id", F.lit(1).cast("bigint"))
    wide = bands.where("session_id = 3").limit(1).withColumn("subband", F.explode(F.sequence(F.lit(0), F.lit(128))))
    return discovery_status_violations(discovery_status(t), bands.where("session_id <> 3").unionByName(wide), t.acquisitions)
