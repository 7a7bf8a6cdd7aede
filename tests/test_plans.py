"""Plans stay what they should be, and registered queries agree with their SQL."""

import io
import random
from contextlib import redirect_stdout

import duckdb
import pytest
from conftest import Fixture, tile

from __spark_entry__ import entry, oracle_sql, queries
from bandwatch.operators import geo
from bandwatch.operators import occupancy as occ
from bandwatch.plans.query import SurveyQuery
from bandwatch.sources.survey import Survey

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_busy_time_reads_no_power_and_pushes_time(spark, tmp_path):
    t = Fixture(spark, [tile(i, [[0], [1]], 4) for i in range(8)])
    for name in ("tiles", "acquisitions", "coverage_gaps"):
        getattr(t, name).write.parquet(str(tmp_path / name))
    s = Survey(spark, str(tmp_path))
    q = SurveyQuery(elapsed_start=0.001, elapsed_end=0.003)
    text = plan(occ.frame_union(s.tiles, s.acquisitions, q))
    scans = [line for line in text.splitlines() if line.startswith("ReadSchema") and "activity" in line]
    assert len(scans) == 1 and "mean_dbfs" not in scans[0] and "peak_dbfs" not in scans[0]
    assert "GreaterThan(end_us,1000)" in text and "LessThan(start_us,3000)" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # the only shuffles are the partial sums and what the small configuration join needs
    assert occ.frame_union(s.tiles, s.acquisitions, q).first().busy_us == 2000


@pytest.mark.parametrize("seed", range(3))
def test_extent_of_a_full_circle_against_brute_force(spark, seed):
    rng = random.Random(seed)
    lons = [x / 20 - 180 + rng.random() / 100 for x in range(7200)]
    del lons[100 * seed + 50]
    rows = [(1, i, 0.0, lon, True) for i, lon in enumerate(lons)]
    p = spark.createDataFrame(rows, "session_id bigint, seq bigint, latitude double, longitude double, valid boolean")
    ring = sorted(x % 360 for x in lons)
    largest = max(b - a for a, b in zip(ring, [*ring[1:], ring[0] + 360]))
    assert geo.extent(p).first().arc_degrees == pytest.approx(360 - largest)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize(
    "name", ["q_ag1_frequency_summary", "q_jn3_position_at_tile_end", "q_bu1_tile_components", "q_ag13_rssi_frequency_summary"]
)
def test_query_agrees_with_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("events", "embeddings", "orders", "lineitem"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries()[name](spark, SF).toArrow()
    want = duck.execute(oracle_sql()[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    a, b = (sorted(map(repr, t.select(names).to_pylist())) for t in (got, want))
    assert a == b and a


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_live_slices_have_many_files(spark):
    """A slice of a table of many partitions is written by several tasks and still comes as one micro-batch."""
    from bandwatch.catalog.live import FILES, live
    from bandwatch.sources.testbed import Testbed

    sf, name = "/root/testdata/sf0.01", "q_st2_survey_windows"
    want = sorted(map(tuple, queries()[name](spark, sf).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        l = live(Testbed(spark, sf), "events")
        folder = l.streams["events"][:-2]
        files = [len(spark.read.parquet(f"{folder}/events-{k}").inputFiles()) for k in range(FILES)]
        assert files == [l.batch_files] * FILES and l.batch_files > 1
        assert sorted(map(tuple, queries()[name](spark, sf).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
