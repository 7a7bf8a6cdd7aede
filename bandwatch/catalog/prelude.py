"""SQL text of the test tables, shared by all checking queries.

Each entry is one CTE; ``with_prelude`` puts in front of a query those it
mentions, directly or through others. The formulas are those of
``bandwatch.sources.testbed``, written a second time in SQL.
"""

from __future__ import annotations

import re

# Fixed selection used by most registered queries: part of both grids, clipped times.
SEL_LO_US, SEL_HI_US = 105_000, 45_003_500
SEL_LOWER_HZ, SEL_UPPER_HZ = 906_871_700, 906_887_800

CTES: dict[str, str] = {}

CTES["ev"] = """
SELECT event_id, event_id // 2500 AS session_id, event_id % 2500 AS j, event_id % 2500 // 1250 + 1 AS acq_id,
  user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
  event_id % 2500 * 20000 AS start_us, event_id % 2500 * 20000 + 20000 AS end_us,
  1704067200000000 + event_id // 2500 * 100000000 + event_id % 2500 * 20000 AS utc_start_us
FROM events"""

CTES["vec"] = """
SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
  -80 + 60 * list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))[13] AS background_dbfs
FROM embeddings"""

CTES["acqs"] = """
SELECT session_id, acq_id, min(start_us) AS acq_start_us, max(end_us) AS acq_end_us,
  906875000 + (acq_id - 1) * 12800 AS center_hz
FROM ev GROUP BY ALL"""

CTES["tile"] = """
SELECT ev.*, utc_start_us + 20000 AS utc_end_us, j + 1 AS tile_id, j * 256 AS first_sample, j * 256 + 256 AS end_sample,
  v, background_dbfs, 906875000 + (ev.acq_id - 1) * 12800 - 6400.0::DOUBLE AS first_center_hz,
  CASE WHEN event_type = 'purchase' THEN 3 ELSE 0 END AS clipped,
  CASE WHEN event_type = 'purchase' THEN 133 ELSE 129 END AS quality,
  CASE WHEN event_type = 'view' OR (event_type = 'click' AND value >= 10) THEN 40.0::DOUBLE + user_id / 1e4 END AS end_lat,
  CASE WHEN event_type = 'view' OR (event_type = 'click' AND value >= 10) THEN -75.0::DOUBLE + k / 1e4 END AS end_lon,
  CASE WHEN event_type = 'purchase' OR ((event_type = 'view' OR (event_type = 'click' AND value >= 10)) AND user_id % 5 <> 0)
    THEN 40.0::DOUBLE + user_id / 1e4 END AS start_lat,
  CASE WHEN event_type = 'purchase' OR ((event_type = 'view' OR (event_type = 'click' AND value >= 10)) AND user_id % 5 <> 0)
    THEN -75.0::DOUBLE + k / 1e4 - (k % 3) / 1e4 END AS start_lon,
  a.center_hz, a.acq_start_us, a.acq_end_us
FROM ev JOIN vec ON event_id % (SELECT count(*) FROM embeddings) = vec_id
JOIN acqs a ON a.session_id = ev.session_id AND a.acq_id = ev.acq_id
WHERE event_type <> 'error'"""

CTES["gap"] = """
SELECT session_id, acq_id, j + 1 AS gap_id, 256 AS missing_samples, start_us, end_us, utc_start_us,
  utc_start_us + 20000 AS utc_end_us, 'application_drop' AS reason
FROM ev WHERE event_type = 'error'"""

CTES["binof"] = """
SELECT unnest(range(64)) AS bin"""

# The selection's tiles (time overlap) and its bins per grid.
CTES["sel"] = f"""
SELECT *, greatest(start_us, {SEL_LO_US}) AS a, least(end_us, {SEL_HI_US}) AS b
FROM tile WHERE end_us > {SEL_LO_US} AND start_us < {SEL_HI_US}"""

CTES["selbin"] = f"""
SELECT g.acq_id, bin, g.fc + bin * 200 AS bin_center_hz, g.fc + (bin - 0.5) * 200 AS lower_hz, g.fc + (bin + 0.5) * 200 AS upper_hz,
  abs(g.fc + bin * 200 - g.center_hz) <= 400 + 1e-5 AS guarded
FROM (SELECT DISTINCT acq_id, first_center_hz AS fc, center_hz FROM tile) g, binof
WHERE g.fc + (bin + 0.5) * 200 > {SEL_LOWER_HZ} AND g.fc + (bin - 0.5) * 200 < {SEL_UPPER_HZ}"""

# Clipped frames of the selection, then their active selected cells.
CTES["selframe"] = """
SELECT session_id, acq_id, tile_id, v, f, greatest(a, start_us + 5000 * f) AS f0, least(b, start_us + 5000 * (f + 1)) AS f1
FROM sel, range(4) t(f)
WHERE least(b, start_us + 5000 * (f + 1)) > greatest(a, start_us + 5000 * f)"""

CTES["selcell"] = """
SELECT session_id, acq_id, tile_id, f, f0, f1, bin, guarded, lower_hz, upper_hz
FROM selframe JOIN selbin USING (acq_id)
WHERE v[(bin + 16 * (f // 2)) % 64 + 1] >= 0.3"""

CTES["selunion"] = """
SELECT s.session_id, s.acq_id, s.tile_id, s.f, s.f0, s.f1, c.f IS NOT NULL AS busy,
  coalesce(center, false) AS center, coalesce(outside, false) AS outside
FROM selframe s LEFT JOIN (
  SELECT session_id, tile_id, f, bool_or(guarded) AS center, bool_or(NOT guarded) AS outside
  FROM selcell GROUP BY ALL) c USING (session_id, tile_id, f)"""

# Every cell of every tile, active ones only.
CTES["cell"] = """
SELECT session_id, acq_id, tile_id, start_us, first_center_hz, center_hz, f, bin,
  first_center_hz + bin * 200 AS bin_center_hz, abs(first_center_hz + bin * 200 - center_hz) <= 400 + 1e-5 AS guarded
FROM tile, range(4) t(f), binof
WHERE v[(bin + 16 * (f // 2)) % 64 + 1] >= 0.3"""

CTES["pos"] = """
SELECT session_id, event_id AS seq, 40.0::DOUBLE + user_id / 1e4 AS latitude, -75.0::DOUBLE + k / 1e4 AS longitude,
  CASE WHEN k % 5 <> 0 THEN 100.0::DOUBLE + k END AS altitude_m, user_id % 50 = 0 AS manual,
  NOT (event_type = 'click' AND value < 10) AS valid, utc_start_us AS utc_us, start_us AS monotonic_us,
  'NMEA RMC; GNSS UTC' AS source, CASE WHEN k % 7 <> 0 THEN 1.0::DOUBLE + k % 10 / 10.0::DOUBLE END AS hdop,
  CAST(4 + k % 9 AS INTEGER) AS satellites
FROM ev WHERE event_type IN ('view', 'click')"""

CTES["nrg"] = """
SELECT o_orderkey // 5000 AS session_id, o_orderkey % 5000 + 1 AS event_id, o_orderkey % 5000 * 10000 AS start_us,
  o_orderkey % 5000 * 10000 + 2000 + o_custkey % 40 * 1000 AS end_us,
  906875000 - 6500.0::DOUBLE + o_custkey % 100 * 200 AS lower_hz,
  906875000 - 6500.0::DOUBLE + o_custkey % 100 * 200 + (1 + o_orderkey % 12) * 200 AS upper_hz,
  2000 + o_custkey % 40 * 1000 - o_orderkey % 3 * 500 AS active_us,
  -90.0::DOUBLE + o_totalprice / 10000 AS mean_dbfs, -85.0::DOUBLE + o_totalprice / 10000 AS peak_dbfs,
  129 + CASE WHEN o_orderstatus = 'P' THEN 64 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 16 ELSE 0 END AS quality,
  CASE WHEN o_orderkey % 4 <> 0 THEN 40.0::DOUBLE + o_custkey % 150 / 1e4 END AS end_lat,
  CASE WHEN o_orderkey % 4 <> 0 THEN -75.0::DOUBLE + o_custkey % 100 / 1e4 END AS end_lon
FROM orders"""

CTES["ord"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderkey // 5000 AS session_id, o_orderkey % 5000 * 10000 AS t_us,
  906000000 + o_custkey % 20 * 100000 AS center_hz,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 125000 WHEN '3' THEN 500000 WHEN '5' THEN 62500 ELSE 250000 END AS bandwidth_hz,
  CAST(7 + o_orderkey % 6 AS INTEGER) AS spreading_factor,
  CASE WHEN o_orderkey % 3 <> 0 THEN 40.0::DOUBLE + o_custkey % 150 / 1e4 END AS latitude,
  CASE WHEN o_orderkey % 3 <> 0 THEN -75.0::DOUBLE + o_custkey % 100 / 1e4 END AS longitude
FROM orders"""

CTES["wave"] = """
SELECT session_id, o_orderkey % 5000 // 2 + 1 AS waveform_id, o_orderkey % 2 AS version, center_hz::DOUBLE AS center_hz,
  bandwidth_hz, spreading_factor, greatest(0, t_us - 8000) AS first_observed_us, t_us + 1000 AS delimiter_us,
  1704067200000000 + session_id * 100000000 + t_us + 1000 AS delimiter_utc_us,
  o_totalprice / 500000.0::DOUBLE AS up_match, greatest(0.01::DOUBLE, o_totalprice / 500000.0::DOUBLE - 0.05::DOUBLE) AS down_match,
  CAST(1 + o_custkey % 4 AS INTEGER) AS contributing_subbands, o_custkey % 3 <> 0 AS complete_in_range,
  o_custkey % 11 = 0 AS ambiguous, latitude, longitude
FROM ord"""

CTES["rec"] = """
SELECT session_id, o_orderkey % 5000 + 1 AS reception_id, 1704067200000000 + session_id * 100000000 + t_us AS utc_us,
  t_us AS elapsed_us, center_hz AS frequency_hz, bandwidth_hz, spreading_factor,
  CAST(5 + o_orderkey % 4 AS INTEGER) AS coding_rate, 20000 + o_custkey % 50 * 1000 AS duration_us,
  o_totalprice / 25000.0::DOUBLE - 10.0::DOUBLE AS snr_db, o_custkey % 200 - 100.0::DOUBLE AS frequency_error_hz,
  o_orderstatus <> 'O' AS header_valid, o_orderstatus <> 'O' AS crc_valid, 'lane ' || (o_custkey % 4) AS lane_label,
  CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 + o_orderkey % 4 END AS INTEGER) AS status,
  CASE WHEN o_orderstatus = 'F' THEN 'likely Meshtastic'
    WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 3 THEN 'possible Meshtastic' ELSE 'unknown LoRa' END AS classification,
  CAST(CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 4 = 3) THEN 1 + o_custkey % 70 END AS INTEGER) AS evidence_port,
  CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 4 = 3) THEN o_custkey % 2 = 0 END AS evidence_signature,
  latitude, longitude
FROM ord"""

CTES["hist"] = """
SELECT l_orderkey, least(32, CAST(floor(l_quantity * 33 / 51) AS INTEGER)) AS hbin, count(*) AS n FROM lineitem GROUP BY ALL"""

CTES["scan"] = """
SELECT l_orderkey // 5000 AS session_id, l_orderkey % 5000 + 1 AS scan_id, CAST(l_orderkey % 2 AS INTEGER) AS board,
  902400000 + l_orderkey % 100 * 200000 AS frequency_hz, l_orderkey % 5000 * 50000 AS start_us,
  l_orderkey % 5000 * 50000 + 40000 AS end_us,
  1704067200000000 + l_orderkey // 5000 * 100000000 + l_orderkey % 5000 * 50000 AS utc_start_us,
  CAST(sum(n) AS BIGINT) AS samples, CAST(coalesce(sum(n) FILTER (WHERE hbin <= 19), 0) AS BIGINT) AS above,
  CASE WHEN l_orderkey % 5 <> 0 THEN 40.0::DOUBLE + l_orderkey % 100 / 1e3 END AS latitude,
  CASE WHEN l_orderkey % 5 <> 0 THEN -75.0::DOUBLE + l_orderkey % 37 / 1e3 END AS longitude, l_orderkey
FROM hist GROUP BY l_orderkey"""

CTES["dband"] = """
SELECT p_partkey // 16 AS session_id, CAST(p_partkey % 16 AS INTEGER) AS subband, 906000000.0::DOUBLE + p_partkey % 16 * 125000 AS center_hz,
  CAST(p_size * 1000 AS BIGINT) AS processed_samples, p_partkey % 7 * 100 AS abandoned_samples, p_partkey % 3 * 50 AS gap_samples,
  p_partkey % 5 AS candidate_limit_hits, p_partkey % 4 AS track_limit_hits
FROM part"""

CTES["dgap"] = """
SELECT c_custkey // 100 AS session_id, c_custkey % 100 + 1 AS gap_id, c_custkey % 100 * 1000 AS first_input_sample,
  c_custkey % 100 * 1000 + 200 + c_nationkey AS end_input_sample, CAST(c_nationkey % 17 - 1 AS INTEGER) AS subband,
  CASE WHEN c_custkey % 2 = 0 THEN 'source_queue_full' ELSE 'input_discontinuity' END AS reason
FROM customer"""

# Per bin power of the selection, per acquisition.
CTES["selpower"] = """
SELECT session_id, acq_id, tile_id, a, b, bin, power(10.0::DOUBLE, (-80.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) / 10.0::DOUBLE) AS mean_p,
  power(10.0::DOUBLE, (-70.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) / 10.0::DOUBLE) AS peak_p
FROM sel JOIN selbin USING (acq_id)"""


def _mentions(sql: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", sql)]


def with_prelude(sql: str) -> str:
    """Put the needed CTEs, in dependency order, in front of a query."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in _mentions(CTES[name]):
            if other != name and other not in ordered:
                visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in _mentions(sql):
        visit(name)
    if not ordered:
        return sql.strip()
    own = ""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        own, body = ", " + body[5:], ""
    # Any of the expressions may refer to itself; where none does the word changes nothing.
    recursive = "RECURSIVE " if own.startswith(", RECURSIVE ") else ""
    own = own.replace(", RECURSIVE ", ", ", 1)
    return f"WITH {recursive}" + ", ".join(f"{n} AS ({CTES[n]})" for n in ordered) + own + "\n" + body


def db6(expr: str) -> str:
    """Level in dB of a power expression, rounded to six decimals; NULL without power."""
    return f"CASE WHEN ({expr}) > 0 THEN floor(10.0::DOUBLE * log10({expr}) * 1e6 + 0.5) / 1e6 END"


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {r6(f'100.0::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST({part} AS DOUBLE) / {whole}))')} END"
