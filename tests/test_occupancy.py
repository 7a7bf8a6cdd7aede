"""Occupancy against closed-form expectations."""

import math

import pytest
from conftest import Fixture, fix, gap, tile
from pyspark.sql import functions as F

from bandwatch.operators import charts, geo
from bandwatch.operators import occupancy as occ
from bandwatch.plans.query import SurveyQuery

MEANS = [-60.0, -40.0, -80.0]


def three_tiles(spark, simultaneous=False, gaps=()):
    masks = [[0, 1], [], [0, 1], []] if simultaneous else [[0], [1], [0], [1]]
    fixes = [(fix(10.1234567, 0.1234567),) * 2, (None, None), (fix(10.1234567, 0.35),) * 2]
    rows = [tile(i, masks, 2, means=[MEANS[i]] * 2, fixes=fixes[i], first=900_000_000.0) for i in range(3)]
    return Fixture(spark, rows, gaps=gaps)


@pytest.mark.parametrize("simultaneous", [False, True])
def test_union_is_never_the_sum_of_bins(spark, simultaneous):
    t = three_tiles(spark, simultaneous)
    bins = occ.frequency_summary(t.tiles, t.acquisitions, SurveyQuery()).collect()
    assert len(bins) == 2
    for b in bins:
        assert b.observed_us == 12 * 256 and b.busy_us == 6 * 256 and b.occupancy_pct == 50
        assert b.mean_dbfs == pytest.approx(10 * math.log10((1e-6 + 1e-4 + 1e-8) / 3))
        assert b.peak_dbfs == pytest.approx(-30)
        assert b.missing_position_us == 4 * 256
    total = occ.totals(t.tiles, t.acquisitions, t.coverage_gaps, SurveyQuery()).first()
    assert total.busy_us / total.observed_us == (0.5 if simultaneous else 1.0)


def test_partial_frames_are_clipped(spark):
    t = three_tiles(spark)
    q = SurveyQuery(lower_hz=899_998_000, upper_hz=900_002_000, elapsed_start=128e-6, elapsed_end=384e-6)
    rows = occ.frequency_summary(t.tiles, t.acquisitions, q).collect()
    assert [(r.bin, r.observed_us, r.busy_us) for r in rows] == [(0, 256, 128)]


def test_gap_buckets_are_unobserved_not_quiet(spark):
    t = Fixture(spark, [tile(0, [[0], [1], [0], [1]], 2, first=900_000_000.0)], gaps=[gap(1024, 20_000)])
    rows = occ.time_summary(t.tiles, t.acquisitions, t.coverage_gaps, SurveyQuery(time_bucket_s=0.005)).orderBy("bucket").collect()
    assert len(rows) == 4
    assert rows[0].occupancy_pct == 100
    assert rows[1].observed_us == 0 and rows[1].occupancy_pct is None and rows[1].mean_dbfs is None


def test_low_activity(spark):
    frames = [[10] for _ in range(128)]
    first = [[*([0] if f < 7 else []), 10, *([20] if f < 3 else [])] for f in range(128)]
    t = Fixture(spark, [tile(i, first if i == 0 else frames, 21, first=900_000_000.0) for i in range(16)])
    got = {r.bin: round(r.occupancy_pct, 3) for r in occ.frequency_summary(t.tiles, t.acquisitions, SurveyQuery()).collect()}
    assert (got[0], got[20], got[10], got[5]) == (0.342, 0.146, 100, 0)


def test_center_guard_is_a_comparison(spark):
    masks = [[0, 4, 8], [4], [1, 4, 7], [4]]
    t = Fixture(spark, [tile(0, masks, 9, first=900_000_000.0)], center=900_016_000)
    total = occ.totals(t.tiles, t.acquisitions, t.coverage_gaps, SurveyQuery()).first()
    assert (total.busy_us, total.center_busy_us, total.outside_busy_us) == (1024, 1024, 512)
    guarded = occ.grid_exposure(t.tiles, t.acquisitions, SurveyQuery()).where("guarded").count()
    assert guarded == 5


def test_buckets_conserve_totals_and_stay_bounded(spark):
    tiles = [tile(i, [[0]] * 4 if i == 200 else [[]] * 4, 9, start=i * 1_000_000, first=900_000_000.0) for i in range(201)]
    t = Fixture(spark, tiles)
    q = SurveyQuery(time_bucket_s=0.001, max_observations=50)
    rows = occ.observations(t.tiles, t.acquisitions, t.coverage_gaps, q)
    total = occ.totals(t.tiles, t.acquisitions, t.coverage_gaps, q).first()
    assert rows.count() <= 50
    summed = rows.agg(F.sum("observed_us").alias("o"), F.sum("busy_us").alias("b")).first()
    assert (summed.o, summed.b) == (total.observed_us, total.busy_us)
    assert total.busy_us == 1024


def test_geographic_cells(spark):
    t = three_tiles(spark)
    d = geo.geographic_summary(t.tiles, t.acquisitions, SurveyQuery(), 100.0)
    assert d.count() == 6 and d.select("cell_row", "cell_column").distinct().count() == 3
    q = SurveyQuery().with_rectangle(10, 11, 0.1, 0.2)
    assert geo.geographic_summary(t.tiles, t.acquisitions, q, 100.0).count() == 2
    extent = occ.acquisition_extent(t.tiles, t.acquisitions, t.coverage_gaps, q).first()
    assert extent.excluded_missing_gps_us == 1024


def test_date_line_and_poles(spark):
    ends = [(fix(0.0, 179.9999), fix(0.0, -179.9999)), (fix(90.0, 0.0),) * 2, (fix(-90.0, 180.0),) * 2]
    t = Fixture(spark, [tile(i, [[0]] * 4, 2, fixes=ends[i], first=900_000_000.0) for i in range(3)])
    rows = geo.geographic_summary(t.tiles, t.acquisitions, SurveyQuery(), 100.0).collect()
    assert len(rows) == 6
    for r in rows:
        assert -90 <= r.cell_south < r.cell_north <= 90 and -180 <= r.cell_west < r.cell_east <= 180
    assert sum(r.crossing_us > 0 for r in rows) == 2
    with pytest.raises(ValueError):
        SurveyQuery().with_rectangle(0, 1, 179, -179)


def test_plot_extent_crosses_the_date_line(spark):
    rows = [(1, i, 40.0, lon, True) for i, lon in enumerate((179.999, -179.999, -179.998))]
    p = spark.createDataFrame(rows, "session_id bigint, seq bigint, latitude double, longitude double, valid boolean")
    e = geo.extent(p)
    assert 200 < e.first().east_west_m < 300
    assert geo.mean_position(p, e).first().mean_longitude == pytest.approx(-179.99933333, abs=1e-6)


@pytest.mark.parametrize(("bins", "columns"), [(7, 3), (3, 7), (5, 5), (64, 20), (10, 33)])
def test_pooling_matches_its_definition(spark, bins, columns):
    df = spark.range(bins).select(F.col("id").alias("bin"), (F.col("id") * 37 % 11).alias("v"))
    got = {r.column: r.value for r in charts.pool_columns(df, [], F.col("v"), F.lit(bins), columns).collect()}
    want = {}
    for c in range(columns):
        lo = c * bins // columns
        want[c] = max(x * 37 % 11 for x in range(lo, max(lo + 1, (c + 1) * bins // columns)))
    assert got == want
