"""Burst grouping and energy events against closed-form expectations."""

import pytest
from conftest import Fixture, tile
from pyspark.sql import functions as F

from bandwatch.functions import flags
from bandwatch.operators import bursts, events
from bandwatch.plans.query import SurveyQuery

CENTER = 905_256_000


def always(*bins):
    return [list(bins)] * 80


def grouped(spark, tiles, q=SurveyQuery(), chunk_us=50_000):
    t = Fixture(spark, tiles, center=CENTER)
    d = bursts.find_bursts(t.tiles, t.acquisitions, q, chunk_us)
    return d.orderBy("start_us", "lower_hz").collect()


def at(i, frames):
    return tile(i, frames, 128, frame_us=250)


def test_association_spans_quiet_tiles(spark):
    active = always(10, 11, 64, 90, 91)
    out = grouped(spark, [at(0, active), at(1, always()), at(2, active)])
    assert len(out) == 3 and sum(b.center_region for b in out) == 1
    assert all(b.active_us == 40_000 and b.end_us - b.start_us == 60_000 for b in out)


def test_no_grouping_across_a_missing_tile(spark):
    out = grouped(spark, [at(0, always(10)), at(2, always(10))])
    assert len(out) == 2 and out[0].limited


def test_separated_bursts_expire(spark):
    out = grouped(spark, [at(i, always(10) if i in (0, 7) else always()) for i in range(8)])
    assert len(out) == 2 and not out[0].limited and out[1].limited


def test_query_clips_frames_and_bins(spark):
    q = SurveyQuery(lower_hz=904_998_000, upper_hz=905_158_000, elapsed_start=0.005, elapsed_end=0.015)
    out = grouped(spark, [at(0, always(10, 90))], q)
    assert len(out) == 1 and out[0].active_us == 10_000 and out[0].quality & flags.BOUNDARY


def test_ambiguous_bridge_keeps_tracks_apart(spark):
    out = grouped(spark, [at(0, always(10, 20)), at(1, always(*range(10, 21)))])
    assert len(out) == 3 and all(b.ambiguous for b in out)


def test_single_frame_is_no_burst_and_long_activity_is_cut(spark):
    assert grouped(spark, [at(0, [[10], *always()[1:]])]) == []
    out = grouped(spark, [at(i, always(10)) for i in range(510)], chunk_us=1_000_000)
    assert len(out) == 2 and out[0].limited
    assert sum(b.active_us for b in out) == 10_200_000


@pytest.mark.parametrize("simultaneous", [False, True])
def test_sweep_pieces(spark, simultaneous):
    pieces = [[10, 20] if simultaneous else [10] if f < 40 else [20] for f in range(80)]
    out = grouped(spark, [at(0, always(*range(10, 21))), at(1, pieces)])
    if simultaneous:
        assert len(out) == 3
    else:
        assert len(out) == 1 and out[0].active_us == 40_000 and out[0].ambiguous


def test_chunks_do_not_change_bursts(spark):
    tiles = [at(i, always(*(b for b in (10, 30, 64, 100) if (i * (b + 3)) % 7 < 4))) for i in range(60) if i % 13]
    one, many = grouped(spark, tiles, chunk_us=10**9), grouped(spark, tiles, chunk_us=45_000)
    assert one == many and len(one) > 5


def frames(spark, rows):
    """rows: (frame index, active bins)."""
    data = [(1, i * 8, 8, 80, 32, 0, b, [1.0] * len(b)) for i, b in rows]
    return spark.createDataFrame(
        data,
        "session_id bigint, first_sample bigint, frame_samples bigint, segment_samples bigint, bin_count int, "
        "clipped bigint, bins array<int>, powers array<double>",
    )


def test_events_merge_split_and_close(spark):
    rows = [(0, [5, 9]), (1, [5, 6, 7, 8, 9]), (2, [5, 9]), (3, []), (4, [20]), (6, [20])]
    out = events.find_events(frames(spark, rows), 24).orderBy("first_sample").collect()
    assert [(e.first_sample, e.end_sample, e.low_bin, e.high_bin) for e in out] == [(0, 24, 5, 9), (32, 40, 20, 20), (48, 56, 20, 20)]
    assert out[0].quality & flags.MERGED and not out[0].quality & flags.TRUNCATED
    assert out[1].quality & flags.TRUNCATED and out[2].quality & flags.TRUNCATED
    assert out[0].cells == 9


def test_long_events_are_cut_and_marked(spark):
    out = events.find_events(frames(spark, [(i, [3]) for i in range(25)]), 64).orderBy("first_sample").collect()
    assert [e.end_sample - e.first_sample for e in out] == [80, 80, 40]
    assert all(e.quality & flags.TRUNCATED for e in out)


def test_run_overflow_keeps_power(spark):
    d = events.frame_runs(frames(spark, [(0, list(range(0, 32, 2)))]).withColumn("bin_count", F.lit(32)))
    assert len(d.first().runs) == 16
    wide = spark.createDataFrame(
        [(1, 0, 8, 80, 512, 0, list(range(0, 400, 2)), [2.0] * 200)], frames(spark, [(0, [1])]).schema
    )
    runs = events.frame_runs(wide).first().runs
    assert len(runs) == 50 and sum(r["sum"] for r in runs) == 400.0
    assert all(r.quality & flags.MERGED and r.quality & flags.TRUNCATED for r in runs)


def walked(spark, tiles, q=SurveyQuery()):
    """The sequential association alone: each piece walked whole, not cut into bands or chains."""
    t = Fixture(spark, tiles, center=CENTER)
    rows = bursts.pieces(bursts.selected_tiles(t.tiles, t.acquisitions, q)).orderBy("from_us", "low_bin").toPandas()
    out = []
    for _, piece in rows.groupby(bursts.GROUP[:-2]):
        walker = bursts._Walker((1, 1, 0, False))
        out += [r for row in piece.itertuples(index=False) for r in walker.row(row)] + walker.close()
    return sorted(r[3:] for r in out)


def same(got, want):
    assert sorted(tuple(r)[3:] for r in got) == want


def test_bands_and_chains_equal_the_sequential_walk(spark):
    """A carrier that never stops, for more than ten seconds, beside bursts that sweep, split, merge and stop."""
    tiles = []
    for i in range(530):
        frames = [[20, 21] if i != 300 else [19, 20, 21] for _ in range(80)]
        for f in range(80):
            if i % 9 < 5:
                frames[f] = [*frames[f], 40 + i % 9]
            if i % 23 in (3, 4, 5):
                frames[f] = [*frames[f], *([90, 91, 100, 101] if i % 23 == 4 else range(90, 102))]
            if i % 31 in (1, 2):
                frames[f] = [*frames[f], 120 if f < 40 else 126]
        tiles.append(at(i, [sorted(x) for x in frames]))
    t = Fixture(spark, tiles, center=CENTER)
    rows = bursts.parts(bursts.pieces(bursts.selected_tiles(t.tiles, t.acquisitions, SurveyQuery()))).cache()
    assert rows.select(*bursts.GROUP[:-2]).distinct().count() < 5 < 100 < rows.select(*bursts.GROUP).distinct().count()
    assert rows.where("chain").select(*bursts.GROUP).distinct().count() > 50 and not rows.where("not chain").isEmpty()
    carrier = rows.where("low_bin in (19, 20)").select("chain", *bursts.GROUP).distinct().collect()
    assert len(carrier) == 1 and carrier[0]["chain"]
    want = walked(spark, tiles)
    for chunk_us in (3_000_000,):
        same(grouped(spark, tiles, chunk_us=chunk_us), want)
    assert sum(w[-1] and w[0] < 11_000_000 for w in want) >= 1 and any(w[-2] for w in want)


@pytest.mark.parametrize("seed", range(2))
def test_random_bursts_equal_the_sequential_walk(spark, seed):
    import random

    rng, tiles, on = random.Random(seed), [], {}
    for i in range(120):
        for b in (5, 8, 12, 30, 34, 70, 100, 104, 108):
            on[b] = on.get(b, False) ^ (rng.random() < 0.25)
        frames = [sorted({b + (rng.random() < 0.2) for b in on if on[b] and rng.random() < 0.7}) for _ in range(8)]
        if rng.random() > 0.05:
            tiles.append(tile(i, frames, 128, frame_us=2500))
    same(grouped(spark, tiles, chunk_us=70_000), walked(spark, tiles))


def connected(spark, rows, segment=80, bins=512):
    """Events by the cut operator, and by walking every frame's runs in order."""
    data = spark.createDataFrame(
        [(1, i * 8, 8, segment, bins, 0, b, [float(x % 7 + 1) for x in b]) for i, b in rows], frames(spark, [(0, [1])]).schema
    )
    got = sorted(tuple(r)[1:] for r in events.find_events(data, 200).collect())
    tracks, want, end = events.EventTracks(8, segment), [], None
    table = events.frame_runs_or_quiet(data).orderBy("first_sample").collect()
    for r in table:
        if end is not None and end != r["first_sample"]:
            want += tracks.finish(True)
        if r["active"]:
            want += tracks.step(r["first_sample"], events.runs_of(r["runs"]))
        else:
            want += tracks.finish(False)
        end = r["first_sample"] + 8
    return got, sorted(events.event_tuple(e) for e in want + tracks.finish(True)), data


def test_event_bands_and_chains_equal_the_sequential_walk(spark):
    """An activity that never stops beside events that merge, split and stop; breaks in the samples."""
    import random

    rng, rows = random.Random(8), []
    for i in range(400):
        active = {200, 200 + i % 2} | {b for b in range(5, 60) if rng.random() < 0.25} | ({400} if i % 40 < 25 else set())
        if i % 97 and i not in (150, 151):
            rows.append((i, sorted(active) if i % 131 else []))
    got, want, data = connected(spark, rows)
    assert got == want and len(got) > 100
    parts = events.event_parts(events.event_pieces(data)).cache()
    assert parts.select(*events.GROUP[:3]).distinct().count() < 15 < 50 < parts.select(*events.GROUP).distinct().count()
    assert parts.where("band = 200").select("chain").distinct().collect() == [(True,)] and not parts.where("not chain").isEmpty()


def test_many_runs_are_not_merged_by_default(spark):
    got, want, _ = connected(spark, [(i, list(range(0, 400, 2))) for i in range(12)])
    assert got == want and len(got) == 400 and {r[2] - r[3] for r in got} == {0}


def test_runs_are_found_by_batches_of_frames(spark):
    """List functions took 2 ms for a frame of many runs; the values are theirs, powers added bin by bin."""
    from pyspark.sql import Row

    data = [(1, 0, 8, 80, 8, 3, [0, 1, 4, 7], [1.0, 2.0, None, 0.5]), (1, 8, 8, 80, 8, None, [], []), (1, 16, 8, 80, 8, 0, [2, 4, 6], [0.1, 0.2, 0.3])]
    made = events.frame_runs(spark.createDataFrame(data, frames(spark, [(0, [1])]).schema), 2)
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    run = lambda *v: Row(**dict(zip(("low", "high", "sum", "peak", "count", "quality"), v)))
    merged = flags.MERGED | flags.TRUNCATED
    first, last = (r.runs for r in made.orderBy("first_sample").collect())
    assert first == [run(0, 4, None, 2.0, 3, merged | flags.BOUNDARY | flags.CLIPPED), run(7, 7, 0.5, 0.5, 1, merged | flags.BOUNDARY | flags.CLIPPED)]
    assert last == [run(2, 4, 0.1 + 0.2, 0.2, 2, merged), run(6, 6, 0.3, 0.3, 1, merged)]


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    from bandwatch.sources import testbed

    monkeypatch.setattr(testbed, "ROWS_PER_TASK", 50)
    t = testbed.Testbed(spark, "/root/testdata/sf0.001")
    rows = t.raw("events").count()
    assert rows > 50 * spark.sparkContext.defaultParallelism
    assert t.spread("events").rdd.getNumPartitions() == -(-rows // 50)
