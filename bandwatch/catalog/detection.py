"""Burst, event, waveform and spectrum queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.catalog.occupancy import SEL, m, s
from bandwatch.catalog.prelude import r6
from bandwatch.catalog.registry import query
from bandwatch.functions import flags
from bandwatch.functions.power import micro
from bandwatch.operators import bursts, events, spectrum, waveforms
from bandwatch.operators import select as sel_ops
from bandwatch.operators.occupancy import seconds_columns
from bandwatch.sources.testbed import CENTER_HZ, RATE, Testbed

CHUNK_US = 7_000_000


@query(
    "q_bu1_tile_components",
    f"""
WITH seed AS (SELECT session_id, acq_id, tile_id, bin, bool_and(guarded) AS guarded FROM selcell GROUP BY ALL HAVING count(*) >= 2),
mk AS (SELECT *, CASE WHEN lag(bin) OVER w IS NULL OR bin - lag(bin) OVER w > 3 OR guarded <> lag(guarded) OVER w THEN 1 ELSE 0 END AS st
  FROM seed WINDOW w AS (PARTITION BY session_id, tile_id ORDER BY bin)),
isl AS (SELECT *, sum(st) OVER (PARTITION BY session_id, tile_id ORDER BY bin) AS cid FROM mk),
comp AS (SELECT session_id, acq_id, tile_id, cid, min(bin) AS lo, max(bin) AS hi, count(*) AS n, bool_and(guarded) AS center FROM isl GROUP BY ALL),
fr AS (SELECT DISTINCT c.session_id, c.tile_id, i.cid, c.f, c.f0, c.f1 FROM selcell c JOIN isl i USING (session_id, tile_id, bin)),
tm AS (SELECT session_id, tile_id, cid, min(f0) AS t0, max(f1) AS t1, sum(f1 - f0) AS act FROM fr GROUP BY ALL),
pk AS (SELECT c.session_id, c.tile_id, cid, max(-70.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) AS pk FROM comp c JOIN tile t USING (session_id, tile_id) JOIN binof ON bin BETWEEN lo AND hi GROUP BY ALL),
lim AS (SELECT acq_id, min(bin) AS b0, max(bin) AS b1 FROM selbin GROUP BY ALL)
SELECT c.session_id, c.acq_id, c.tile_id, CAST(lo AS INTEGER) AS low_bin, CAST(hi AS INTEGER) AS high_bin, center AS center_region, n < hi - lo + 1 AS ambiguous,
  t0 / 1e6 AS first_s, t1 / 1e6 AS last_s, act / 1e6 AS active_s, {r6('pk')} AS peak_dbfs,
  CAST(s.quality | CASE WHEN center THEN 256 ELSE 0 END | CASE WHEN a > s.start_us OR b < s.end_us OR lo = b0 OR hi = b1 THEN 16 ELSE 0 END AS INTEGER) AS quality
FROM comp c JOIN tm USING (session_id, tile_id, cid) JOIN pk USING (session_id, tile_id, cid)
JOIN sel s ON s.session_id = c.session_id AND s.tile_id = c.tile_id JOIN lim ON lim.acq_id = c.acq_id""",
)
def bu1(t: Testbed) -> DataFrame:
    d = bursts.component_rows(sel_ops.selected_tiles(t.tiles, t.acquisitions, SEL))
    return d.select(
        "session_id", "acq_id", "tile_id", "low_bin", "high_bin", "center_region", "ambiguous", s("first"), s("last"),
        s("active"), m("peak_dbfs"), "quality",
    )


# The association step by step: one step per tile of a run and guard class, the state is the list of open tracks and what has closed.
TRACK = "STRUCT(first BIGINT, last BIGINT, lo BIGINT, hi BIGINT, act BIGINT, pk DOUBLE, q BIGINT, amb BOOLEAN, lim BOOLEAN, n BIGINT, blo BIGINT, bhi BIGINT)"
BURST_SQL = f"""
WITH RECURSIVE seed AS (SELECT session_id, acq_id, tile_id, bin, bool_and(guarded) AS guarded FROM selcell GROUP BY ALL HAVING count(*) >= 2),
mk AS (SELECT *, CASE WHEN lag(bin) OVER w IS NULL OR bin - lag(bin) OVER w > 3 OR guarded <> lag(guarded) OVER w THEN 1 ELSE 0 END AS st
  FROM seed WINDOW w AS (PARTITION BY session_id, tile_id ORDER BY bin)),
isl AS (SELECT *, sum(st) OVER (PARTITION BY session_id, tile_id ORDER BY bin) AS cid FROM mk),
comp AS (SELECT session_id, acq_id, tile_id, cid, min(bin) AS lo, max(bin) AS hi, count(*) AS n, bool_and(guarded) AS center FROM isl GROUP BY ALL),
fr AS (SELECT DISTINCT c.session_id, c.tile_id, i.cid, c.f, c.f0, c.f1 FROM selcell c JOIN isl i USING (session_id, tile_id, bin)),
tm AS (SELECT session_id, tile_id, cid, list(struct_pack(f := f, f0 := f0, f1 := f1)) AS fr FROM fr GROUP BY ALL),
pk AS (SELECT c.session_id, c.tile_id, cid, max(-70.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) AS pk FROM comp c JOIN tile t USING (session_id, tile_id) JOIN binof ON bin BETWEEN lo AND hi GROUP BY ALL),
lim AS (SELECT acq_id, min(bin) AS b0, max(bin) AS b1 FROM selbin GROUP BY ALL),
rn AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(acq_id) OVER w = acq_id THEN 0 ELSE 1 END AS st FROM sel WINDOW w AS (PARTITION BY session_id ORDER BY a)),
rr AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY a) AS rid FROM rn),
re AS (SELECT *, max(a) OVER (PARTITION BY session_id, rid) AS run_last FROM rr),
step AS (SELECT r.session_id, r.acq_id, rid, center, a AS now, run_last, row_number() OVER (PARTITION BY r.session_id, rid, center ORDER BY a) AS k, p FROM (
  SELECT c.session_id, c.tile_id, c.center, list(struct_pack(
    first := list_min(list_transform(fr, lambda x: x.f0)), last := list_max(list_transform(fr, lambda x: x.f1)), lo := lo, hi := hi,
    act := CAST(list_sum(list_transform(fr, lambda x: x.f1 - x.f0)) AS BIGINT), pk := pk.pk,
    q := CAST(s.quality | CASE WHEN center THEN 256 ELSE 0 END | CASE WHEN a > s.start_us OR b < s.end_us OR lo = b0 OR hi = b1 THEN 16 ELSE 0 END AS BIGINT),
    amb := n < hi - lo + 1, fr := fr) ORDER BY lo) AS p
  FROM comp c JOIN tm USING (session_id, tile_id, cid) JOIN pk USING (session_id, tile_id, cid)
  JOIN sel s ON s.session_id = c.session_id AND s.tile_id = c.tile_id JOIN lim ON lim.acq_id = c.acq_id GROUP BY ALL) x
  JOIN re r ON r.session_id = x.session_id AND r.tile_id = x.tile_id),
asc_ AS (
  SELECT session_id, acq_id, rid, center, run_last, CAST(0 AS BIGINT) AS k, CAST([] AS {TRACK}[]) AS tr, CAST([] AS {TRACK}[]) AS done
  FROM (SELECT DISTINCT session_id, acq_id, rid, center, run_last FROM step)
  UNION ALL
  SELECT session_id, acq_id, rid, center, run_last, k,
    list_filter(nt, lambda t: t.last - t.first < 10000000),
    list_concat(done, list_concat(gone, list_transform(list_filter(nt, lambda t: t.last - t.first >= 10000000), lambda t: struct_pack(
      first := t.first, last := t.last, lo := t.lo, hi := t.hi, act := t.act, pk := t.pk, q := t.q, amb := t.amb, lim := true, n := t.n, blo := t.blo, bhi := t.bhi))))
  FROM (
    SELECT *, list_concat(
        list_transform(list_filter(range(1, len(live) + 1), lambda j: NOT list_contains(retired, j)), lambda j: CASE WHEN len(list_filter(ext, lambda e: e.j = j)) = 0 THEN live[j] ELSE
          list_transform(list_filter(ext, lambda e: e.j = j), lambda e: struct_pack(first := live[j].first, last := e.c.last, lo := least(live[j].lo, e.c.lo), hi := greatest(live[j].hi, e.c.hi),
            act := live[j].act + e.c.act, pk := greatest(live[j].pk, e.c.pk), q := live[j].q | e.c.q, amb := live[j].amb OR e.c.amb, lim := false, n := live[j].n + 1, blo := e.c.lo, bhi := e.c.hi))[1] END),
        list_transform(fresh, lambda e: struct_pack(first := e.c.first, last := e.c.last, lo := e.c.lo, hi := e.c.hi, act := e.c.act, pk := e.c.pk, q := e.c.q,
          amb := e.c.amb OR len(e.o) > 0, lim := false, n := CAST(1 AS BIGINT), blo := e.c.lo, bhi := e.c.hi))) AS nt,
      list_concat(old, list_transform(retired, lambda j: struct_pack(first := live[j].first, last := live[j].last, lo := live[j].lo, hi := live[j].hi, act := live[j].act, pk := live[j].pk,
        q := live[j].q, amb := true, lim := live[j].lim, n := live[j].n, blo := live[j].blo, bhi := live[j].bhi))) AS gone
    FROM (
      SELECT *, list_distinct(flatten(list_transform(fresh, lambda e: e.o))) AS retired FROM (
        SELECT *, list_transform(list_filter(todo, lambda e: len(e.o) = 1 AND (len(used[e.o[1]]) = 1 OR swept[e.o[1]])), lambda e: struct_pack(j := e.o[1], c := e.c)) AS ext,
          list_filter(todo, lambda e: NOT (len(e.o) = 1 AND (len(used[e.o[1]]) = 1 OR swept[e.o[1]]))) AS fresh
        FROM (
          SELECT *, list_transform(list_filter(range(1, len(p) + 1), lambda i: NOT (len(own[i]) = 1 AND swept[own[i][1]] AND used[own[i][1]][1] <> i)), lambda i: struct_pack(o := own[i], c :=
            CASE WHEN len(own[i]) = 1 AND swept[own[i][1]] THEN struct_pack(
              first := list_min(list_transform(used[own[i][1]], lambda m: p[m].first)), last := list_max(list_transform(used[own[i][1]], lambda m: p[m].last)),
              lo := list_min(list_transform(used[own[i][1]], lambda m: p[m].lo)), hi := list_max(list_transform(used[own[i][1]], lambda m: p[m].hi)),
              act := CAST(list_sum(list_transform(list_distinct(flatten(list_transform(used[own[i][1]], lambda m: p[m].fr))), lambda x: x.f1 - x.f0)) AS BIGINT),
              pk := list_max(list_transform(used[own[i][1]], lambda m: p[m].pk)), q := list_reduce(list_transform(used[own[i][1]], lambda m: p[m].q), lambda x, y: x | y), amb := true,
              fr := list_distinct(flatten(list_transform(used[own[i][1]], lambda m: p[m].fr)))) ELSE p[i] END)) AS todo
          FROM (
            SELECT *, list_transform(range(1, len(live) + 1), lambda j: len(used[j]) > 1
                AND len(list_filter(used[j], lambda i: len(own[i]) <> 1 OR p[i].lo < live[j].lo - 2 OR p[i].hi > live[j].hi + 2)) = 0
                AND 4 * len(list_filter(list_distinct(flatten(list_transform(used[j], lambda i: p[i].fr))), lambda x: len(list_filter(used[j], lambda i: list_contains(p[i].fr, x))) > 1))
                  <= len(list_distinct(flatten(list_transform(used[j], lambda i: p[i].fr))))) AS swept
            FROM (
              SELECT *, list_transform(range(1, len(live) + 1), lambda j: list_filter(range(1, len(p) + 1), lambda i: list_contains(own[i], j))) AS used FROM (
                SELECT *, list_transform(p, lambda c: list_filter(range(1, len(live) + 1), lambda j: c.first - live[j].last <= 40000 AND c.lo <= live[j].bhi + 3 AND c.hi >= live[j].blo - 3)) AS own
                FROM (SELECT s.*, z.done, list_filter(z.tr, lambda t: s.now - t.last <= 40000) AS live, list_filter(z.tr, lambda t: s.now - t.last > 40000) AS old
                  FROM asc_ z JOIN step s ON s.session_id = z.session_id AND s.rid = z.rid AND s.center = z.center AND s.k = z.k + 1))))))))),
last_ AS (SELECT * FROM asc_ QUALIFY k = max(k) OVER (PARTITION BY session_id, rid, center)),
brst AS (
  SELECT session_id, acq_id, center, t, t.lim AS lim FROM (SELECT session_id, acq_id, center, unnest(done) AS t FROM last_)
  UNION ALL SELECT session_id, acq_id, center, t, t.lim OR run_last - t.last <= 40000 FROM (SELECT session_id, acq_id, center, run_last, unnest(tr) AS t FROM last_))"""


@query(
    "q_bu2_bursts",
    f"""{BURST_SQL}
SELECT b.session_id, b.acq_id, b.center AS center_region, t.first / 1e6 AS start_s, t.last / 1e6 AS end_s, g.fc + (t.lo - 0.5::DOUBLE) * 200 AS lower_hz, g.fc + (t.hi + 0.5::DOUBLE) * 200 AS upper_hz,
  t.act / 1e6 AS active_s, {r6("t.pk")} AS peak_dbfs, CAST(t.q AS INTEGER) AS quality, CAST(t.n AS INTEGER) AS components, t.amb AS ambiguous, b.lim AS limited
FROM brst b JOIN (SELECT DISTINCT acq_id, first_center_hz AS fc FROM tile) g ON g.acq_id = b.acq_id""",
)
def bu2(t: Testbed) -> DataFrame:
    """Bursts of the selection; the association in chains and walks equals the recursion step by step."""
    return seconds_columns(bursts.find_bursts(t.tiles, t.acquisitions, SEL, CHUNK_US)).withColumn("peak_dbfs", m("peak_dbfs"))


@query(
    "q_bu3_burst_pieces",
    """
WITH seed AS (SELECT session_id, acq_id, tile_id, bin, bool_and(guarded) AS guarded FROM selcell GROUP BY ALL HAVING count(*) >= 2),
hit AS (SELECT c.session_id, c.acq_id, c.tile_id, c.guarded, max(f1) AS last_us FROM selcell c JOIN seed USING (session_id, tile_id, bin) GROUP BY ALL),
rn AS (SELECT session_id, acq_id, tile_id, a, b, CASE WHEN lag(b) OVER w = a AND lag(acq_id) OVER w = acq_id THEN 0 ELSE 1 END AS st
  FROM sel WINDOW w AS (PARTITION BY session_id ORDER BY a)),
rr AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY a) AS rid FROM rn),
x AS (SELECT r.session_id, r.acq_id, rid, guarded, a, last_us, max(last_us) OVER (PARTITION BY r.session_id, rid, guarded ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM hit h JOIN rr r ON r.session_id = h.session_id AND r.tile_id = h.tile_id),
y AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 40000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, rid, guarded ORDER BY a) AS p FROM x)
SELECT session_id, acq_id, guarded AS center_region, min(a) / 1e6 AS piece_s, max(last_us) / 1e6 AS last_s, count(*) AS tiles FROM y GROUP BY session_id, acq_id, rid, guarded, p""",
)
def bu3(t: Testbed) -> DataFrame:
    """Independent pieces of the burst association: where all tracks have expired."""
    rows = bursts.pieces(sel_ops.selected_tiles(t.tiles, t.acquisitions, SEL), CHUNK_US)
    return seconds_columns(
        rows.groupBy("session_id", "acq_id", "run_us", "center_region", "piece_us")
        .agg(F.max("last_us").alias("last_us"), F.count_distinct("tile_id").alias("tiles"))
        .drop("run_us")
    )


@query(
    "q_jn9_overlap_matches",
    f"""{BURST_SQL}
SELECT session_id, acq_id, center AS center_region, t.amb AS ambiguous, lim AS limited, count(*) AS bursts, CAST(sum(t.n) AS BIGINT) AS components FROM brst GROUP BY ALL""",
)
def jn9(t: Testbed) -> DataFrame:
    """Bursts that took in more than one component, by outcome of the overlap match."""
    d = bursts.find_bursts(t.tiles, t.acquisitions, SEL, CHUNK_US)
    return d.groupBy("session_id", "acq_id", "center_region", "ambiguous", "limited").agg(
        F.count("*").alias("bursts"), F.sum("components").alias("components")
    )


# -- events -----------------------------------------------------------------------


def frames_of(t: Testbed) -> DataFrame:
    """Every frame of every tile: active bins, with the tile's mean as their power."""
    powers = F.transform("bins", lambda b: F.pow(F.lit(10.0), F.get(F.col("mean_dbfs"), b) / 10.0))
    return (
        t.tiles.select(
            "session_id", "first_sample", "bin_count", "clipped", "fft_size", "mean_dbfs",
            F.posexplode("activity").alias("frame", "bins"),
        )
        .select(
            "session_id",
            (F.col("first_sample") + F.col("frame") * F.col("fft_size")).alias("first_sample"),
            F.col("fft_size").cast("bigint").alias("frame_samples"),
            F.lit(-(-2 * RATE // 64) * 64).cast("bigint").alias("segment_samples"),
            "bin_count", "clipped", "bins", powers.alias("powers"),
        )
    )


EV1_SQL = f"""
c AS (SELECT cell.session_id, cell.acq_id, tile.first_sample + f * 64 AS fs, bin, tile.clipped, power(10.0::DOUBLE, (-80.0::DOUBLE + 60.0::DOUBLE * v[bin + 1]) / 10.0::DOUBLE) AS p
  FROM cell JOIN tile ON tile.session_id = cell.session_id AND tile.start_us = cell.start_us),
mk AS (SELECT *, CASE WHEN bin - lag(bin) OVER w = 1 THEN 0 ELSE 1 END AS st FROM c WINDOW w AS (PARTITION BY session_id, fs ORDER BY bin)),
isl AS (SELECT *, sum(st) OVER (PARTITION BY session_id, fs ORDER BY bin) AS rid FROM mk),
runs AS (SELECT session_id, fs, rid, min(bin) AS lo, max(bin) AS hi, sum(p) AS s, max(p) AS pk, count(*) AS n,
  CASE WHEN min(bin) = 0 OR max(bin) = 63 THEN 16 ELSE 0 END | CASE WHEN max(clipped) > 0 THEN 4 ELSE 0 END AS q FROM isl GROUP BY ALL)"""


@query(
    "q_ev1_frame_runs",
    f"""WITH {EV1_SQL} SELECT session_id, fs AS first_sample, CAST(lo AS INTEGER) AS low, CAST(hi AS INTEGER) AS high, {r6('10.0::DOUBLE * log10(s / n)')} AS mean_dbfs,
  {r6('10.0::DOUBLE * log10(pk)')} AS peak_dbfs, n AS "count", CAST(q AS INTEGER) AS quality FROM runs""",
)
def ev1(t: Testbed) -> DataFrame:
    d = events.frame_runs(frames_of(t)).select("session_id", "first_sample", F.explode("runs").alias("r"))
    return d.select(
        "session_id", "first_sample", "r.low", "r.high", micro(10.0 * F.log10(F.col("r.sum") / F.col("r.count"))).alias("mean_dbfs"),
        micro(10.0 * F.log10(F.col("r.peak"))).alias("peak_dbfs"), "r.count", "r.quality",
    )


@query(
    "q_ev2_overflow_merge",
    f"""
WITH c AS (SELECT session_id, tile_id, bin, clipped, power(10.0::DOUBLE, (-80.0::DOUBLE + 60.0::DOUBLE * v[(bin // 4) + 1]) / 10.0::DOUBLE) AS p FROM tile, range(256) b(bin) WHERE bin % 2 = 0 OR (bin % 10 = 1)),
mk AS (SELECT *, CASE WHEN bin - lag(bin) OVER w = 1 THEN 0 ELSE 1 END AS st FROM c WINDOW w AS (PARTITION BY session_id, tile_id ORDER BY bin)),
isl AS (SELECT *, sum(st) OVER (PARTITION BY session_id, tile_id ORDER BY bin) - 1 AS rid FROM mk),
g AS (SELECT *, max(rid) OVER (PARTITION BY session_id, tile_id) + 1 AS nr FROM isl),
m AS (SELECT *, CASE WHEN nr > 64 THEN rid // CAST(ceil(nr / 64.0::DOUBLE) AS BIGINT) ELSE rid END AS gid FROM g)
SELECT session_id, tile_id, CAST(min(bin) AS INTEGER) AS low, CAST(max(bin) AS INTEGER) AS high, count(*) AS "count", {r6('10.0::DOUBLE * log10(sum(p) / count(*))')} AS mean_dbfs,
  CAST(96 | bit_or(CASE WHEN bin = 0 OR bin = 255 THEN 16 ELSE 0 END | CASE WHEN clipped > 0 THEN 4 ELSE 0 END) AS INTEGER) AS quality
FROM m GROUP BY session_id, tile_id, gid""",
)
def ev2(t: Testbed) -> DataFrame:
    """Frames with more than 64 runs: every tile as one wide frame of many short runs."""
    bins = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda b: (b % 2 == 0) | (b % 10 == 1))
    powers = F.transform("bins", lambda b: F.pow(F.lit(10.0), F.get(F.col("mean_dbfs"), F.floor(b / 4).cast("int")) / 10.0))
    frames = t.tiles.withColumn("bins", bins).withColumn("powers", powers).withColumn("bin_count", F.lit(256))
    d = events.frame_runs(frames).select("session_id", "tile_id", F.explode("runs").alias("r"))
    return d.select(
        "session_id", "tile_id", "r.low", "r.high", "r.count", micro(10.0 * F.log10(F.col("r.sum") / F.col("r.count"))).alias("mean_dbfs"), "r.quality"
    )


@query("q_ev3_connected_events")
def ev3(t: Testbed) -> DataFrame:
    """Events over all frames (sequential connection; checked on fixtures)."""
    d = events.event_levels(events.find_events(frames_of(t), 1 << 16))
    return d.select(
        "session_id", "first_sample", "end_sample", "low_bin", "high_bin", "cells", m("mean_dbfs"), m("peak_dbfs"), "quality"
    )


@query(
    "q_ev4_event_conservation",
    "SELECT session_id, count(*) AS cells FROM cell GROUP BY ALL",
)
def ev4(t: Testbed) -> DataFrame:
    """Splits and merges neither lose nor double a cell: cells over all events equal active cells."""
    return events.find_events(frames_of(t), 1 << 16).groupBy("session_id").agg(F.sum("cells").alias("cells"))


@query(
    "q_ev5_center_flag",
    """
SELECT n.session_id, event_id, acq_id, CAST(quality | CASE WHEN lower_hz <= center_hz + 400 AND upper_hz >= center_hz - 400 THEN 256 ELSE 0 END AS INTEGER) AS quality
FROM nrg n JOIN acqs a ON a.session_id = n.session_id AND n.start_us >= acq_start_us AND n.start_us < acq_end_us""",
)
def ev5(t: Testbed) -> DataFrame:
    config = t.acquisitions.withColumn("bin_width_hz", F.lit(200.0))
    d = events.mark_center(t.events_energy, config)
    return d.select("session_id", "event_id", "acq_id", F.col("quality").cast("int").alias("quality"))


# -- waveforms -----------------------------------------------------------------------


# One step of the association per finding of a moment (moments lie far beyond the tolerance): the state is the list of observations.
FITS = """list_filter(range(1, len(obs) + 1), lambda i: NOT list_contains(obs[i].bands, band)
    AND greatest(obs[i].c1, c) - least(obs[i].c0, c) <= 2.0::DOUBLE * bw / power(2, sf) AND greatest(obs[i].t1, t) - least(obs[i].t0, t) <= 2.0::DOUBLE * 2000000 / bw)"""
WF1_SQL = f"""
WITH RECURSIVE fnd AS (
  SELECT o_orderkey // 5000 AS session_id, o_orderkey // 4 AS g, CASE o_orderkey // 4 % 3 WHEN 0 THEN 125000 WHEN 1 THEN 250000 ELSE 62500 END AS bw,
    CAST(7 + o_orderkey // 4 % 6 AS INTEGER) AS sf, 906000000.0::DOUBLE + o_orderkey // 4 % 50 * 100000 + o_custkey % 8 * 100.0::DOUBLE AS c,
    o_orderkey // 4 * 20000 + o_custkey % 5 * 8.0::DOUBLE AS t, CAST(o_custkey % 4 AS INTEGER) AS band, o_totalprice / 500000.0::DOUBLE AS up, o_totalprice / 520000.0::DOUBLE AS down,
    row_number() OVER (PARTITION BY o_orderkey // 4 ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderkey // 4) AS n FROM orders),
st AS (
  SELECT session_id, g, bw, sf, n, 1 AS k, [struct_pack(bands := [band], c0 := c, c1 := c, t0 := t, t1 := t, bc := c, bt := t, bu := up, bd := down, found := 1, amb := false)] AS obs FROM fnd WHERE k = 1
  UNION ALL
  SELECT session_id, g, bw, sf, n, CAST(k AS INTEGER),
    CASE WHEN len(fits) = 1 THEN list_transform(obs, lambda o, i: CASE WHEN i <> fits[1] THEN o ELSE struct_pack(
        bands := list_append(o.bands, band), c0 := least(o.c0, c), c1 := greatest(o.c1, c), t0 := least(o.t0, t), t1 := greatest(o.t1, t),
        bc := CASE WHEN least(up, down) > least(o.bu, o.bd) THEN c ELSE o.bc END, bt := CASE WHEN least(up, down) > least(o.bu, o.bd) THEN t ELSE o.bt END,
        bu := CASE WHEN least(up, down) > least(o.bu, o.bd) THEN up ELSE o.bu END, bd := CASE WHEN least(up, down) > least(o.bu, o.bd) THEN down ELSE o.bd END,
        found := o.found + 1, amb := o.amb) END)
      ELSE list_append(obs, struct_pack(bands := [band], c0 := c, c1 := c, t0 := t, t1 := t, bc := c, bt := t, bu := up, bd := down, found := 1, amb := len(fits) > 1)) END
  FROM (SELECT f.*, obs, {FITS} AS fits FROM (SELECT f.*, st.obs FROM st JOIN fnd f ON f.g = st.g AND f.k = st.k + 1) f))
SELECT session_id, CAST(bw AS INTEGER) AS bandwidth_hz, sf AS spreading_factor, o.bc AS center_hz, o.bt AS delimiter_sample, o.bu AS up_match, o.bd AS down_match,
  CAST(len(o.bands) AS INTEGER) AS subbands, CAST(o.found AS INTEGER) AS found, o.amb AS ambiguous
FROM (SELECT session_id, bw, sf, unnest(obs) AS o FROM st WHERE k = n)"""


@query("q_wf1_associated_findings", WF1_SQL)
def wf1(t: Testbed) -> DataFrame:
    """Findings of neighbouring subbands, four per moment, associated into observations."""
    o = t.raw("orders")
    g = F.expr("o_orderkey div 4")
    findings = o.select(
        F.expr("o_orderkey div 5000").alias("session_id"),
        F.col("o_orderkey").alias("seq"),
        F.when(g % 3 == 0, 125_000).when(g % 3 == 1, 250_000).otherwise(62_500).alias("bandwidth_hz"),
        (7 + g % 6).cast("int").alias("spreading_factor"),
        (906e6 + g % 50 * 1e5 + F.col("o_custkey") % 8 * 100.0).alias("center_hz"),
        (g * 20_000 + F.col("o_custkey") % 5 * 8.0).alias("delimiter_sample"),
        (F.col("o_custkey") % 4).cast("int").alias("subband"),
        F.lit(2_000_000).alias("sample_rate"),
        (F.col("o_totalprice") / 500_000.0).alias("up_match"),
        (F.col("o_totalprice") / 520_000.0).alias("down_match"),
    )
    return waveforms.associate_findings(findings, 1 << 20)


@query(
    "q_wf2_complete_in_range",
    """
SELECT w.session_id, waveform_id, version, w.center_hz - bandwidth_hz / 2.0::DOUBLE >= lo AND w.center_hz + bandwidth_hz / 2.0::DOUBLE <= hi AS complete_in_range
FROM wave w JOIN (SELECT session_id, min(center_hz - 6400.0::DOUBLE) - 200000 AS lo, max(center_hz + 6400.0::DOUBLE) + 200000 AS hi FROM acqs GROUP BY ALL) USING (session_id)""",
)
def wf2(t: Testbed) -> DataFrame:
    wide = t.acquisitions.withColumn("span_hz", F.col("span_hz") + 400_000)
    d = waveforms.complete_in_range(t.waveforms, sel_ops.default_range(wide))
    return d.select("session_id", "waveform_id", "version", "complete_in_range")


@query(
    "q_sk9_latest_waveforms",
    "SELECT session_id, waveform_id, version, bandwidth_hz, center_hz FROM wave QUALIFY row_number() OVER (PARTITION BY session_id, waveform_id ORDER BY version DESC) = 1",
)
def sk9(t: Testbed) -> DataFrame:
    return waveforms.latest_versions(t.waveforms).select("session_id", "waveform_id", "version", "bandwidth_hz", "center_hz")


@query(
    "q_sk9_profile_changes",
    "SELECT session_id, waveform_id FROM wave GROUP BY ALL HAVING min(bandwidth_hz) <> max(bandwidth_hz) OR min(spreading_factor) <> max(spreading_factor)",
)
def sk9_changes(t: Testbed) -> DataFrame:
    return waveforms.profile_changes(t.waveforms)


# -- spectrum -----------------------------------------------------------------------

N = 24
LEVEL = -26.0

SAMPLE_SQL = f"""
blk AS (SELECT vec_id // 250 AS session_id, vec_id % 250 * 32 AS fs, embedding FROM embeddings WHERE vec_id % 50 <> 49),
bm AS (SELECT *, CASE WHEN lag(fs) OVER w = fs - 32 THEN 0 ELSE 1 END AS st FROM blk WINDOW w AS (PARTITION BY session_id ORDER BY fs)),
br AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY fs) AS rid FROM bm),
bs AS (SELECT *, min(fs) OVER (PARTITION BY session_id, rid) AS run FROM br),
smp AS (SELECT session_id, run, fs + n.range - run AS pos, CAST(embedding[2 * n.range + 1] AS DOUBLE) AS re, CAST(embedding[2 * n.range + 2] AS DOUBLE) AS im FROM bs, range(32) n),
fr AS (SELECT session_id, run, pos // {N} AS frame, pos % {N} AS n, re, im, count(*) OVER (PARTITION BY session_id, run, pos // {N}) AS have FROM smp),
tw AS (SELECT n.range AS n, k.range AS k, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n.range / {N}) AS w, cos(2 * pi() * n.range * k.range / {N}) AS c, sin(2 * pi() * n.range * k.range / {N}) AS s FROM range({N}) n, range({N}) k),
ft AS (SELECT session_id, run, frame, k, sum(w * (re * c + im * s)) AS x, sum(w * (im * c - re * s)) AS y FROM fr JOIN tw USING (n) WHERE have = {N} GROUP BY ALL),
pw AS (SELECT session_id, run, frame, run + frame * {N} AS first_sample, (CASE WHEN k >= {N // 2} THEN k - {N} ELSE k END) + {N // 2 - 1} AS bin,
  (x * x + y * y) / ({N} * (SELECT sum(w * w) FROM tw WHERE k = 0)) AS p FROM ft WHERE k <> {N // 2})"""


def spectra(t: Testbed) -> DataFrame:
    """Spectra of N samples; blocks hold 32, so most frames straddle two blocks."""
    first, last, _, _ = spectrum.bin_grid(N, N, N)
    return spectrum.frame_power(spectrum.whole_frames(t.iq_blocks, N, 1000), N, first, last)


@query(
    "q_sp1_frame_power",
    f"WITH {SAMPLE_SQL} SELECT session_id, first_sample, CAST(bin AS INTEGER) AS bin, {r6('p')} AS power FROM pw",
)
def sp1(t: Testbed) -> DataFrame:
    d = spectra(t).select("session_id", "first_sample", F.posexplode("power").alias("bin", "power"))
    return d.select("session_id", "first_sample", "bin", m("power"))


@query(
    "q_sp2_threshold_activity",
    f"WITH {SAMPLE_SQL} SELECT session_id, first_sample, CAST(bin AS INTEGER) AS bin FROM pw WHERE p >= power(10.0::DOUBLE, {LEVEL}::DOUBLE / 10)",
)
def sp2(t: Testbed) -> DataFrame:
    return spectrum.active_bins(spectra(t), LEVEL).select("session_id", "first_sample", F.explode("bins").alias("bin"))


@query(
    "q_sp3_tile_formation",
    f"""
WITH {SAMPLE_SQL}, b AS (SELECT session_id, run, frame // 5 AS tile, bin, min(first_sample) AS first_sample, max(first_sample) + {N} AS end_sample, count(*) AS frames, avg(p) AS mp, max(p) AS pk FROM pw GROUP BY ALL)
SELECT session_id, first_sample, end_sample, CAST(frames AS INTEGER) AS frame_count, CAST(bin AS INTEGER) AS bin, {r6('10.0::DOUBLE * log10(mp)')} AS mean_dbfs, {r6('10.0::DOUBLE * log10(pk)')} AS peak_dbfs FROM b""",
)
def sp3(t: Testbed) -> DataFrame:
    d = spectrum.tiles_from_spectra(spectra(t), 5, N, LEVEL)
    d = d.select(
        "session_id", "first_sample", "end_sample", "frame_count", F.posexplode(F.arrays_zip("mean_dbfs", "peak_dbfs")).alias("bin", "p")
    )
    return d.select(
        "session_id", "first_sample", "end_sample", "frame_count", "bin", micro(F.col("p.mean_dbfs")).alias("mean_dbfs"),
        micro(F.col("p.peak_dbfs")).alias("peak_dbfs"),
    )


@query(
    "q_sp4_clipped_samples",
    """SELECT vec_id // 250 AS session_id, vec_id % 250 * 32 AS first_sample,
  CAST(len(list_filter(range(32), lambda i: abs(CAST(embedding[2 * i + 1] AS DOUBLE) * 4) >= 127 / 128.0::DOUBLE OR abs(CAST(embedding[2 * i + 2] AS DOUBLE) * 4) >= 127 / 128.0::DOUBLE)) AS BIGINT) AS clipped
FROM embeddings WHERE vec_id % 50 <> 49""",
)
def sp4(t: Testbed) -> DataFrame:
    loud = F.transform("iq", lambda x: x * 4)
    return t.iq_blocks.select("session_id", "first_sample", spectrum.clipped_samples(loud).alias("clipped"))


@query(
    "q_sp5_bin_grid",
    f"""
SELECT session_id, acq_id, CAST(greatest(-32, ceil(-10000 / 400.0::DOUBLE + 0.5)) AS INTEGER) AS first_bin, CAST(least(31, floor(10000 / 400.0::DOUBLE - 0.5)) AS INTEGER) AS last_bin,
  200.0::DOUBLE AS width_hz, 300.0::DOUBLE AS noise_bandwidth_hz, center_hz + 200 * greatest(-32, ceil(-10000 / 400.0::DOUBLE + 0.5)) AS first_center_hz FROM acqs""",
)
def sp5(t: Testbed) -> DataFrame:
    first, last, width, enbw = spectrum.bin_grid(RATE, 10_000, 64)
    return t.acquisitions.select(
        "session_id", "acq_id", F.lit(first).alias("first_bin"), F.lit(last).alias("last_bin"), F.lit(width).alias("width_hz"),
        micro(F.lit(enbw)).alias("noise_bandwidth_hz"), (F.col("center_hz") + first * width).alias("first_center_hz"),
    )


@query(
    "q_sc9_normalized_samples",
    f"""
WITH x AS (SELECT vec_id, i.range AS i, CAST(floor(CAST(embedding[i.range + 1] AS DOUBLE) * 256) AS INTEGER) AS code FROM embeddings, range(64) i)
SELECT vec_id, {r6('sum(code / 128.0::DOUBLE * i)')} AS signed_sum, {r6('sum((greatest(0, least(255, code + 128)) - 127.5::DOUBLE) / 128.0::DOUBLE * i)')} AS offset_sum FROM x GROUP BY ALL""",
)
def sc9(t: Testbed) -> DataFrame:
    code = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("int"))
    raw = t.raw("embeddings").select("vec_id", code.alias("code"))
    offset = F.transform("code", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x + 128)))

    def weighted(samples):
        return F.aggregate(F.transform(samples, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)

    return raw.select(
        "vec_id",
        micro(weighted(spectrum.normalized_samples(F.col("code"), "signed"))).alias("signed_sum"),
        micro(weighted(spectrum.normalized_samples(offset, "offset"))).alias("offset_sum"),
    )


@query("q_ev3_events_from_samples")
def ev_from_samples(t: Testbed) -> DataFrame:
    """Events straight from sample blocks: spectrum, threshold, connection."""
    frames = spectrum.event_frames(spectra(t), LEVEL, 1000.0, N)
    d = events.event_levels(events.find_events(frames, 1000))
    low, high = CENTER_HZ + F.col("low_bin") - 0.5, CENTER_HZ + F.col("high_bin") + 0.5
    return d.select(
        "session_id", "first_sample", "end_sample", low.alias("lower_hz"), high.alias("upper_hz"), "cells", m("mean_dbfs"),
        m("peak_dbfs"), "quality", flags.quality_names(F.col("quality")).alias("quality_names"),
    )
