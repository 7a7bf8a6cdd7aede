"""Ordered scans in chunks against plain loops."""

import random

import pytest
from conftest import tile
from pyspark.sql import functions as F

from bandwatch.operators import charts, sequences
from bandwatch.operators.ordered import greedy_starts


def greedy_by_hand(rows, limit):
    """rows: (key, begin, test) in order."""
    out, open_ = {}, {}
    for key, begin, test in rows:
        if key not in open_ or test > open_[key] + limit:
            open_[key] = begin
        out[key, begin] = open_[key]
    return out


@pytest.mark.parametrize(("chunk", "limit"), [(40, 100), (100, 100), (1000, 100), (7, 1), (300, 0), (10**9, 250)])
def test_greedy_segments_equal_a_loop(spark, chunk, limit):
    """Uneven lengths, gaps, segments longer than a chunk, one row longer than the limit."""
    rng, rows = random.Random(chunk), []
    for key in (1, 2, 3):
        at = rng.randrange(50)
        for _ in range(200):
            length = rng.choice([1, 5, 17, 40, 180 if key == 2 else 20])
            rows.append((key, at, at + length))
            at += length + rng.choice([0, 0, 0, 30, 500 if key == 3 else 3])
    df = spark.createDataFrame(rows, "k int, a bigint, b bigint").withColumn("test", F.lit("kept")).repartition(5)
    got = greedy_starts(df, ["k"], "a", "a", "b", F.lit(limit), "s", chunk)
    assert got.columns == ["k", "a", "b", "test", "s"]
    assert {(r["k"], r["a"]): r["s"] for r in got.collect()} == greedy_by_hand(rows, limit)
    # Short keys of a chunk come as one group, with the same cuts; a null is a key of its own.
    two = df.withColumn("k2", F.when(F.col("k") > 1, F.col("k"))).withColumn("k", F.lit(0))
    got = greedy_starts(two, ["k", "k2"], "a", "a", "b", F.lit(limit), "s", chunk).where("k2 IS NOT NULL")
    assert {(r["k2"], r["a"]): r["s"] for r in got.collect()} == greedy_by_hand([r for r in rows if r[0] > 1], limit)
    assert greedy_starts(df.limit(0), ["k"], "a", "a", "b", F.lit(limit), "s", chunk).count() == 0


def test_power_blocks_of_uneven_tiles(spark):
    """Blocks of at most 10 ms by the greedy rule, over tiles of mixed lengths; a break and a grid change end a block."""
    rng, tiles, at = random.Random(4), [], 0
    for i in range(60):
        n = rng.choice([1, 2, 3, 7, 15, 60])
        at += 5_000 if i == 20 else 0
        tiles.append(tile(i, [[0]] * n, 2, start=at, means=[-60.0 - i, -70.0], width=4_000.0 if i < 40 else 2_000.0))
        at += n * 256
    df = spark.createDataFrame(tiles, "session_id bigint, acq_id bigint, tile_id bigint, start_us bigint, end_us bigint, first_center_hz double, "
                               "bin_width_hz double, bin_count int, frame_count int, mean_dbfs array<double>, peak_dbfs array<double>")  # fmt: skip
    want, open_ = [], None
    for t in tiles:
        fresh = open_ is None or open_["end_us"] != t["start_us"] or open_["bin_width_hz"] != t["bin_width_hz"] or t["end_us"] - open_["begin"] > 10_000
        if fresh:
            open_ = {"begin": t["start_us"], "bin_width_hz": t["bin_width_hz"], "frames": 0, "tiles": 0, "power": [0.0, 0.0], "peak": [-300.0] * 2}
            want.append(open_)
        open_["end_us"] = t["end_us"]
        open_["frames"] += t["frame_count"]
        open_["tiles"] += 1
        for b in (0, 1):
            open_["power"][b] += 10 ** (t["mean_dbfs"][b] / 10) * t["frame_count"]
            open_["peak"][b] = max(open_["peak"][b], t["peak_dbfs"][b])
    for chunk in (3_000, 20_000, 10**9):
        got = sequences.power_blocks(df, 10_000, chunk).orderBy("power_start_us", "bin").collect()
        assert [(r["power_start_us"], r["power_end_us"], r["frames"], r["tiles"]) for r in got[::2]] == [(w["begin"], w["end_us"], w["frames"], w["tiles"]) for w in want]
        for r, (w, b) in zip(got, ((w, b) for w in want for b in (0, 1))):
            assert r["power"] == pytest.approx(w["power"][b]) and r["peak_dbfs"] == w["peak"][b] and r["bin"] == b
    assert len({w["tiles"] for w in want}) > 3


def test_smoothing_equals_the_recurrence(spark):
    """10,000 values of one column, from the start level on, beside a short column."""
    rng = random.Random(6)
    rows = [(1, i * 3, rng.uniform(-120, 0)) for i in range(10_000)] + [(2, i, -50.0) for i in range(3)]
    got = charts.smoothed(spark.createDataFrame(rows, "k int, at bigint, value double"), ["k"], "at").orderBy("k", "at").collect()
    y, key = None, None
    for (k, _, x), r in zip(rows, got):
        y, key = (charts.FLOOR_DBFS if k != key else y), k
        y = 0.4 * x + 0.6 * y
        assert r["smoothed"] == pytest.approx(y, abs=1e-9)


def test_arrays_that_lie_by_chunk_are_not_shuffled(spark):
    """Power arrays moved in a shuffle by chunk, and their bins in two more; only the narrow side moves now."""
    tiles = [tile(i, [[0]] * 3, 2, start=i * 768, means=[-60.0 - i, -70.0]) for i in range(40)]
    df = spark.createDataFrame(tiles, "session_id bigint, acq_id bigint, tile_id bigint, start_us bigint, end_us bigint, first_center_hz double, "
                               "bin_width_hz double, bin_count int, frame_count int, mean_dbfs array<double>, peak_dbfs array<double>")  # fmt: skip
    blocks = sequences.power_blocks(df.repartition(3, "session_id", F.expr("start_us div 3000L")), 2_000, 3_000)
    assert blocks._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 1
    got = sorted((r["power_start_us"], r["bin"], r["tiles"], r["peak_dbfs"], round(r["power"], 15)) for r in blocks.collect())
    whole = sequences.power_blocks(df, 2_000, 10**9).collect()
    assert got == sorted((r["power_start_us"], r["bin"], r["tiles"], r["peak_dbfs"], round(r["power"], 15)) for r in whole)
    assert len(got) == 40 and any(a < c * 3_000 < a + n * 768 for a, _, n, *_ in got for c in range(12))  # blocks over an edge


def test_tiles_of_a_chunk_are_dealt_before_they_get_arrays(spark):
    from bandwatch.sources.testbed import Testbed

    t = Testbed(spark, "/root/testdata/sf0.001")
    near = t.tiles_by_chunk(7_000_000)
    assert near.columns == t.tiles.columns and near.count() == t.tiles.count() and near.exceptAll(t.tiles).isEmpty()
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    dealt = [i for i, line in enumerate(plan.splitlines()) if "RepartitionByExpression" in line and "div 7000000" in line]
    assert dealt and dealt[0] > next(i for i, line in enumerate(plan.splitlines()) if "Join Inner" in line)
