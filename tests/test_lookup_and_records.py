"""As-of lookups, ordered scans, sentences, encodings, text, histograms, spectra, streams."""

import math
import random

import numpy as np
import pytest
from conftest import Fixture, tile
from pyspark.sql import Window
from pyspark.sql import functions as F

from bandwatch.functions import codecs
from bandwatch.operators import asof, ordered, rssi, spectrum, waveforms
from bandwatch.sources import nmea, sinks
from bandwatch.sources.schemas import TABLES
from bandwatch.streaming import jobs


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_chunked_scans_equal_plain_windows(spark, chunk):
    rng = random.Random(5)
    rows = [(k, t, rng.randrange(50)) for k in (1, 2) for t in sorted(rng.sample(range(200), 40))]
    df = spark.createDataFrame(rows, "k bigint, t bigint, v bigint")
    w = Window.partitionBy("k").orderBy("t")
    want = df.select(
        "k", "t", F.lag("v").over(w).alias("p"), F.max("v").over(w).alias("m"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
    )
    c = ordered.chunked(df, "t", chunk)
    got = ordered.with_previous(c, ["k"], ["t"], F.struct("v"), "p")
    got = ordered.running_max(got, ["k"], ["t"], {"m": F.col("v")})
    got = ordered.running_sum(got, ["k"], ["t"], F.col("v"), "s")
    got = got.select("k", "t", F.col("p.v").alias("p"), "m", "s")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def positions(spark, rows):
    full = [(1, i, 10.0, 20.0, None, manual, valid, t, t, "x", None, 5) for i, (t, valid, manual) in enumerate(rows)]
    return spark.createDataFrame(full, TABLES["positions"])


def found(spark, rows, t):
    facts = spark.createDataFrame([(1, t)], "session_id bigint, t bigint")
    return asof.position_at(facts, positions(spark, rows), "t", chunk_us=500_000).first().fix is not None


def test_latest_fix_decides_even_when_invalid(spark):
    s = 1_000_000
    two = [(10 * s, True, False), (11 * s, False, False)]
    assert found(spark, two, int(10.5 * s)) and not found(spark, two, int(11.5 * s)) and not found(spark, two, 9 * s)
    one = [(10 * s, True, False)]
    assert found(spark, one, 12 * s) and not found(spark, one, 12 * s + 10_000)
    assert found(spark, [(10 * s, True, True)], 40 * s)


def sentence(body):
    x = 0
    for c in body:
        x ^= ord(c)
    return f"${body}*{x:02X}"


def test_nmea(spark):
    utc = 764_426_119  # 1994-03-23 12:35:19
    rmc = "GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W"
    gga = "GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,"
    lines = {
        sentence(rmc): "fix", sentence(gga) + "\r\n": "fix", sentence(rmc)[:-2] + "00": "rejected", "$" + rmc: "rejected",
        sentence(rmc) + "x": "rejected", "$" + "A" * 300 + "*00": "rejected", sentence(rmc.replace(",A,", ",V,")): "invalid",
        sentence(gga.replace(",E,1,", ",E,0,")): "invalid", sentence(gga.replace(",E,1,", ",E,6,")): "invalid",
        sentence(gga.replace("4807", "4867")): "rejected", sentence(gga.replace("123519", "123540")): "invalid",
        sentence("GPGSV,1,1,00"): "rejected",
    }
    rows = [(1, i, 0, utc * 1_000_000, s) for i, s in enumerate(lines)]
    out = nmea.parse(spark.createDataFrame(rows, TABLES["nmea_sentences"])).orderBy("seq").collect()
    assert [r.outcome for r in out] == list(lines.values())
    assert out[0].latitude == pytest.approx(48.1173) and out[1].longitude == pytest.approx(11.51666667)
    assert out[0].utc_s == utc and out[1].satellites == 8
    midnight = spark.createDataFrame(
        [(1, 0, 0, (86_400 * 100 + 1) * 1_000_000, sentence(gga.replace("123519", "235959")))], TABLES["nmea_sentences"]
    )
    r = nmea.parse(midnight).first()
    assert r.outcome == "fix" and r.utc_s == 86_400 * 100 - 1


def test_mask_codecs(spark):
    def decode(packed, frames, bins):
        df = spark.createDataFrame([(1, bytearray(packed), frames, bins)], "id int, packed binary, frame_count int, bin_count int")
        r = codecs.decode_activity(df, ["id"]).first()
        return r.activity, r.reason

    assert decode([0, 0b101, 0b10], 2, 3) == ([[0, 2], [1]], None)
    assert decode([1, 2, 0, 0b101], 2, 3) == ([[0, 2], [0, 2]], None)
    assert decode([0, 0b1000], 1, 3)[1] == "nonzero bitmap padding"
    for bad in ([], [2, 0], [1, 0, 0, 1], [1, 5, 0, 1], [0, 1, 1], [1, 1, 0]):
        assert decode(bad, 1, 8)[0] is None
    rng = random.Random(1)
    rows = [(i, bytearray(rng.choice([0, 0, 255]) for _ in range(n))) for i, n in enumerate((1, 3, 40, 3000))]
    df = spark.createDataFrame(rows, "id int, mask binary").withColumn("packed", codecs.runs_encode(F.col("mask")))
    for r in df.collect():
        assert codecs._expand(bytes(r.packed), len(r.mask)).tolist() == list(r.mask)
        assert len(r.packed) <= len(r.mask) + 1


def test_level_and_histogram_codecs(spark):
    levels, counts = [-123.456, 0.0, 12.345, -300.0], [i * 70_001 for i in range(33)]
    df = spark.createDataFrame([(levels, counts)], "l array<double>, c array<bigint>")
    r = df.select(
        codecs.centi_db_decode(codecs.centi_db_encode(F.col("l"))).alias("l"),
        codecs.histogram_decode(codecs.histogram_encode(F.col("c"))).alias("c"),
    ).first()
    assert r.l == [-123.46, 0.0, 12.35, -300.0] and r.c == counts


def test_codecs_work_on_batches(spark):
    """No text is made for each value; nulls, empty and odd rows keep their results; misfits fail."""
    rows = [([1.0, None, -0.005], None, b"\x01\x00\xff"), (None, [0, 2**32 - 1], None), ([], [], b"")]
    df = spark.createDataFrame(rows, "l array<double>, c array<bigint>, b binary")
    made = df.select(codecs.centi_db_encode("l").alias("l"), codecs.histogram_encode("c").alias("c"), codecs.centi_db_decode("b").alias("b"), codecs.histogram_decode("b").alias("h"))
    assert "conv(" not in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and "ArrowEvalPython" in plan
    got = [tuple(None if x is None else x if isinstance(x, list) else bytes(x) for x in r) for r in made.collect()]
    assert got == [(b"\x64\x00\xff\xff", None, [0.01], None), (None, b"\x00\x00\x00\x00\xff\xff\xff\xff", None, None), (b"", b"", [], None)]
    for bad in ("array(2L)", "array(-1L)", "array(4294967296L)"):
        blob = spark.range(1).select(codecs.histogram_encode(F.expr(bad)).alias("b"))
        if bad == "array(2L)":
            assert blob.first().b == b"\x02\x00\x00\x00"
        else:
            with pytest.raises(Exception, match="32 bits"):
                blob.collect()


def test_formula_safe_text(spark):
    texts = {"=1": True, "  +x": True, "-": True, "@a": True, "\tx": True, "\nx": True, "a=1": False, "": False, "   ": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s.startswith("'") for r in df.select("t", sinks.csv_safe(F.col("t")).alias("s")).collect()}
    assert got == texts
    d = spark.createDataFrame([("a\\b\té",)], "t string").select(sinks.printable(F.col("t")).alias("s")).first()
    assert d.s == "a\\\\b\\x09\\xc3\\xa9"


def test_long_reports_fail_instead_of_being_cut(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_csv(spark.range(11), str(tmp_path / "r"), max_rows=10)
    sinks.write_csv(spark.range(10), str(tmp_path / "s"), max_rows=10)
    with pytest.raises(PermissionError):
        sinks.require_positions(False)


def test_histogram_exceedance_never_splits_a_bin(spark):
    counts = [0] * 33
    counts[19], counts[20], counts[21] = 1000, 500, 500
    df = spark.createDataFrame([(counts, -11.0)], "counts array<bigint>, rssi_offset_db double")
    r = df.select(*[rssi.fraction_above(t).alias(f"t{-int(t)}") for t in (-87.0, -90.0, -91.0)]).first()
    assert (r.t87, r.t90, r.t91) == (0.5, 0.5, 0.75)


def blocks(spark, samples, sizes, first=0):
    rows, at = [], first
    for n in sizes:
        part = samples[at - first : at - first + n]
        rows.append((1, at, "complex", np.column_stack([part.real, part.imag]).ravel().tolist()))
        at += n
    return spark.createDataFrame(rows, TABLES["iq_blocks"])


def test_tone_and_chunk_invariance(spark):
    n = 64
    first, last, width, enbw = spectrum.bin_grid(n, n, n)
    assert (first, last, width) == (-31, 30, 1.0) or (first, last) == (-31, 31)
    assert enbw == pytest.approx(1.5)
    z = np.exp(2j * np.pi * 5 * np.arange(10 * n + 17) / n)

    def power(sizes):
        d = spectrum.frame_power(spectrum.whole_frames(blocks(spark, z, sizes), n, 200), n, first, last)
        return {r.first_sample: r.power for r in d.collect()}

    whole, parts = power([10 * n + 17]), power([100, 3, 60, 200, 1, 293])
    assert whole.keys() == parts.keys() and len(whole) == 10
    for k, p in whole.items():
        assert p == pytest.approx(parts[k])
        assert 10 * math.log10(sum(p)) == pytest.approx(0, abs=1e-9)
        assert max(range(len(p)), key=p.__getitem__) + first == 5


def test_waveform_association_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for seq in range(120):
        moment = seq // 4
        rows.append((1, seq, 125_000, 9, 906e6 + moment % 5 * 1e5 + rng.choice([0, 100, 400, 900]),
                     moment * 5_000.0 + rng.choice([0, 8, 16, 40]), rng.randrange(3), 2_000_000, rng.random(), rng.random()))
    df = spark.createDataFrame(
        rows, "session_id bigint, seq bigint, bandwidth_hz int, spreading_factor int, center_hz double, "
        "delimiter_sample double, subband int, sample_rate int, up_match double, down_match double")  # fmt: skip
    got = sorted((r.subbands, r.found, r.ambiguous, r.center_hz, r.delimiter_sample) for r in waveforms.associate_findings(df, 20_000).collect())
    known = []
    for _, _, bw, sf, c, t, band, rate, up, down in rows:
        fit = [o for o in known if band not in o["b"] and max(*o["c"], c) - min(*o["c"], c) <= 2 * bw / 2**sf
               and max(*o["t"], t) - min(*o["t"], t) <= 2 * rate / bw]
        if len(fit) == 1:
            o = fit[0]
            o["b"].add(band)
            o["c"].append(c)
            o["t"].append(t)
            if min(up, down) > o["s"]:
                o["s"], o["best"] = min(up, down), (c, t)
        else:
            known.append({"b": {band}, "c": [c, c], "t": [t, t], "s": min(up, down), "best": (c, t), "a": len(fit) > 1})
    want = sorted((len(o["b"]), len(o["c"]) - 1, o["a"], *o["best"]) for o in known)
    assert got == want


def test_stream_bursts_and_windows_equal_batch(spark, tmp_path):
    from bandwatch.operators import bursts
    from bandwatch.plans.query import SurveyQuery

    def active(i):
        return [[b for b in (10, 30, 64, 100) if (i * (b + 3)) % 7 < 4]] * 80

    rows = [tile(i, active(i), 128, frame_us=250) for i in range(600) if i % 113]
    t = Fixture(spark, rows, center=905_256_000)
    third = len(rows) // 3
    for k in range(3):  # three files in time order: three micro-batches
        part = rows[k * third :] if k == 2 else rows[k * third : (k + 1) * third]
        spark.createDataFrame(part, TABLES["tiles"]).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(TABLES["tiles"]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    columns = ["center_region", "start_us", "end_us", "lower_hz", "upper_hz", "active_us", "components", "ambiguous", "limited"]
    live = {tuple(r) for r in jobs.drained(jobs.live_bursts(stream, t.acquisitions)).select(*columns).collect()}
    batch = {tuple(r) for r in bursts.find_bursts(t.tiles, t.acquisitions, SurveyQuery(), 10**6).select(*columns).collect()}
    still_open = batch - live
    assert live <= batch and all(r[2] > rows[-1]["start_us"] - 60_000 for r in still_open)
    windows = jobs.drained(jobs.survey_windows(stream, t.acquisitions)).orderBy("window_start_us").collect()
    want, start, seen = [], None, 0
    for r in rows:
        start = r["start_us"] if start is None else start
        seen += 20_000
        if r["end_us"] - start >= 5_000_000:
            want.append((start, r["end_us"], seen))
            start, seen = r["end_us"], 0
    assert [(w.window_start_us, w.window_end_us, w.observed_us) for w in windows] == want


def test_late_tiles_are_marked(spark, tmp_path):
    # 1 is behind the state, a second 4 overlaps what was taken
    for k, ids in enumerate(([0, 2, 3], [1, 4, 4])):
        part = [tile(i, [[0]], 4) for i in ids]
        spark.createDataFrame(part, TABLES["tiles"]).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(TABLES["tiles"]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    rows = jobs.drained(jobs.ordered_or_late(stream)).collect()
    assert sorted((r.tile_id - 1, r.late) for r in rows) == [(0, False), (1, True), (2, False), (3, False), (4, False), (4, True)]


def streamed(spark, path, rows, schema):
    """A stream with a micro-batch for each list of rows."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path / f"part={k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "part=*"))


def test_late_facts_are_quarantined(spark, tmp_path):
    fixes = "session_id bigint, monotonic_us bigint, seq bigint, valid boolean, manual boolean, latitude double, longitude double"
    facts = "session_id bigint, t_us bigint, fact_id bigint"
    f = streamed(spark, tmp_path / "facts", [[(1, 600_000, 1)], [(1, 2_000_000, 2)]], facts)
    p = streamed(spark, tmp_path / "fixes", [[(1, 500_000, 1, True, False, 1.0, 2.0), (1, 3_000_000, 2, True, False, 3.0, 4.0)], []], fixes)
    rows, late = jobs.drained_parts(jobs.live_positions(f, p))
    assert [tuple(r) for r in rows.collect()] == [(1, 1, 1.0, 2.0)]
    import json

    assert [json.loads(r.late_row)["fact_id"] for r in late.collect()] == [2]


def test_overlapping_blocks_are_no_gaps(spark, tmp_path):
    blocks = streamed(spark, tmp_path, [[(1, 0, 100), (1, 50, 20)], [(1, 100, 10), (1, 130, 10)]], "session_id bigint, first_sample bigint, n bigint")
    got = sorted(tuple(r) for r in jobs.drained(jobs.sample_gaps(blocks)).collect())
    assert got == [(1, 50, 0, "overlap"), (1, 110, 20, "application_drop")]


def test_the_last_window_comes_with_the_end_of_the_session(spark, tmp_path):
    rows = [tile(i, [[0]] * 80, 4, frame_us=250) for i in range(300)]
    t = Fixture(spark, rows)
    stream = streamed(spark, tmp_path / "tiles", [rows[:150], rows[150:]], TABLES["tiles"])
    ends = streamed(spark, tmp_path / "ends", [[], [(1,)]], "session_id bigint")
    got = jobs.drained(jobs.survey_windows(stream, t.acquisitions, ends)).orderBy("window_start_us").collect()
    assert [(w.window_start_us, w.window_end_us, w.tiles) for w in got] == [(0, 5_000_000, 250), (5_000_000, 6_000_000, 50)]


def test_a_stored_profile_stays(spark, tmp_path):
    schema = "session_id bigint, waveform_id bigint, version bigint, bandwidth_hz bigint, spreading_factor int"
    batches = [[(1, 7, 5, 125_000, 9)], [(1, 7, 3, 250_000, 9), (1, 8, 1, 125_000, 7)], [(1, 7, 6, 125_000, 9), (1, 8, 2, 500_000, 7)]]
    stream = streamed(spark, tmp_path / "in", batches, schema)
    table = str(tmp_path / "table")
    jobs.upsert_waveforms(stream, table, str(tmp_path / "checkpoint"), None).awaitTermination()
    rows = jobs.read_waveforms(spark, table, stream.schema).collect()
    assert {(r.waveform_id, r.version, r.bandwidth_hz) for r in rows} == {(7, 6, 125_000), (8, 1, 125_000)}
    refused = spark.read.schema(stream.schema).parquet(f"{table}/quarantine/*").collect()
    assert {(r.waveform_id, r.version) for r in refused} == {(7, 3), (8, 2)}
