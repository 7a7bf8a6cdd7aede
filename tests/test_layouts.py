"""Compact layout, counters over resets, and the export policy."""

import pytest
from conftest import Fixture, fix, tile
from pyspark.sql import functions as F

from bandwatch.operators import compact, counters
from bandwatch.operators.occupancy import frequency_summary, totals
from bandwatch.plans.archive import REGISTRY, ExportPolicy, feature_rows, records
from bandwatch.plans.query import SurveyQuery

PLACES = [(None, None), (fix(10.1, 0.1), None), (fix(10.1, 0.1), fix(10.2, 0.3)), (None, fix(10.1, 0.1))]


@pytest.fixture(scope="module")
def survey(spark):
    tiles = [tile(i, [[b for b in range(3) if (i + f) % (b + 2) == 0] for f in range(4)], 3, means=[-60.0 - i % 5, -70.0, -90.0], fixes=PLACES[i % 4], start=i * 1024 + (90 if i > 9 else 0)) for i in range(24)]
    return Fixture(spark, tiles)


def test_both_layouts_give_equal_answers(survey):
    parts = [d.cache() for d in compact.compact(survey.tiles, 5_000, 3_000)]
    tiles, blocks, fixes = parts
    assert blocks.count() == 7 and fixes.count() == 2 and blocks.agg(F.max(F.col("end_us") - F.col("start_us"))).first()[0] <= 5_000
    back = compact.expand(*parts)
    both = ["session_id", "tile_id", "activity", "fix_start", "fix_end", "frame_count", "start_us"]
    assert back.select(both).exceptAll(survey.tiles.select(both)).isEmpty() and back.count() == survey.tiles.count()
    a, q = survey.acquisitions, SurveyQuery()
    fine, coarse = ({r["bin"]: r for r in frequency_summary(t, a, q).collect()} for t in (survey.tiles, back))
    for b in range(3):
        assert (fine[b]["busy_us"], fine[b]["observed_us"]) == (coarse[b]["busy_us"], coarse[b]["observed_us"])
        assert fine[b]["mean_dbfs"] == pytest.approx(coarse[b]["mean_dbfs"], abs=0.011) and fine[b]["peak_dbfs"] == coarse[b]["peak_dbfs"]
    busy = [c for c in totals(survey.tiles, a, survey.coverage_gaps, q).columns if c.endswith("_us")]
    assert totals(survey.tiles, a, survey.coverage_gaps, q).select(busy).collect() == totals(back, a, survey.coverage_gaps, q).select(busy).collect()
    assert compact.dangling(*parts).isEmpty()
    lost = compact.dangling(tiles, blocks.where("power_id <> 1"), fixes.where("false")).collect()
    assert {(r["reference"], r["uses"]) for r in lost if r["reference"] == "power_id"} == {("power_id", 4)}
    assert sum(r["uses"] for r in lost if r["reference"] != "power_id") == 24
    assert compact.expand(tiles, blocks.where("power_id <> 1"), fixes).where("mean_dbfs IS NULL").count() == 4


def test_wide_columns_meet_one_join(survey):
    """Tiles move once, to their references; power arrays once, to be summed; fixes and runs are narrow."""
    tiles, blocks, fixes = compact.compact(survey.tiles, 5_000, 3_000)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(tiles).count("Join ") == 1 and plan(blocks).count("Join ") == 2 and plan(blocks).count("FlatMapCoGroupsInArrow") == 1
    joins = [line for line in plan(compact.expand(tiles, blocks, fixes)).splitlines() if "Join LeftOuter" in line]
    assert "power_id" in joins[0] and len(joins) == 3


def test_counters_hold_over_resets(spark):
    rows = [("a", 1, 5, 1), ("a", 2, 9, 1), ("a", 3, 2, 0), ("a", 4, 2, 0), ("a", 5, None, 0), ("b", 1, 7, 3), ("a", 9, 4, 1)]
    df = spark.createDataFrame(rows, "lane string, at bigint, frames bigint, failed bigint").withColumn("board", F.lit(0))
    for chunk in (2, 100):
        got = {r["lane"]: (r["frames"], r["failed"], r["restarts"]) for r in counters.totals(df, ["lane"], "at", ["frames", "failed"], chunk_us=chunk).collect()}
        assert got == {"a": (9 + 2 + 0 + 4, 1 + 0 + 1, 2), "b": (7, 3, 0)}
    both = counters.totals(df, ["lane"], "at", ["frames", "failed"], ["board"]).first()
    assert (both["frames"], both["restarts"]) == (22, 2)


def test_nothing_leaves_unasked(survey):
    closed = records(survey, ExportPolicy(), ["spectrum_tile", "spectrum_tile_start_position", "acquisition_segment"])
    assert "spectrum_tile_start_position" not in closed
    assert closed["spectrum_tile"].where("latitude IS NOT NULL OR longitude IS NOT NULL OR altitude_m IS NOT NULL").isEmpty()
    opened = records(survey, ExportPolicy(positions=True, decimals=1), ["spectrum_tile", "spectrum_tile_start_position"])
    assert {r["latitude"] for r in opened["spectrum_tile"].select("latitude").distinct().collect()} == {None, 10.2, 10.1}
    assert opened["spectrum_tile_start_position"].count() == 12
    for kind, rows in (closed | opened).items():
        assert not any(f.dataType.typeName() == "struct" for f in rows.schema.fields), kind
    with pytest.raises(PermissionError):
        feature_rows(survey, ExportPolicy(), ["spectrum_tile"])
    with pytest.raises(ValueError):
        ExportPolicy(decimals=8)
    assert len(REGISTRY) == 20


def test_archive_rows_are_not_sorted_by_type(spark, tmp_path):
    """One write sorted all rows by their type, in a task's memory or on disk; types are now written by themselves."""
    from bandwatch.sources import sinks

    a = spark.range(3).select("id", F.lit(1).alias("n"))
    b = spark.range(2).select(F.col("id").cast("string").alias("name"), (F.col("id") * 2).alias("id"))
    path = str(tmp_path / "archive")
    sinks.write_archive({"first": a, "second": b, "none": a.limit(0)}, path)
    rows = spark.read.parquet(path).select("record_type", "id", "n", "name").collect()
    assert sorted(map(str, rows)) == sorted(map(str, sinks.archive({"first": a, "second": b}).select("record_type", "id", "n", "name").collect()))
    kinds = [spark.read.parquet(f"{path}/record_type={kind}").schema for kind in ("first", "second")]
    assert kinds[0] == kinds[1] and [f.name for f in kinds[0]] == ["id", "n", "name"]


def test_histogram_tasks_do_not_grow(spark, monkeypatch):
    from bandwatch.sources import testbed

    monkeypatch.setattr(testbed, "ROWS_PER_TASK", 100)
    t = testbed.Testbed(spark, "/root/testdata/sf0.001")
    assert t.rssi_scans.rdd.getNumPartitions() == -(-t.raw("lineitem").count() // 100)


def test_findings_know_the_size_of_acquisitions(spark):
    """Derived anew in each table, acquisitions had no known size and whole tiles were shuffled to meet them."""
    from bandwatch.plans.reports import findings
    from bandwatch.sources.testbed import Testbed

    bins = findings(Testbed(spark, "/root/testdata/sf0.001"), SurveyQuery())["bins"]
    assert any("/acquisitions-" in name for name in bins.inputFiles())


def test_analysis_and_cells_know_the_size_of_acquisitions(spark):
    """So do the analysis bundle and the geographic summary."""
    from bandwatch.operators.geo import geographic_summary
    from bandwatch.plans import reports
    from bandwatch.sources.testbed import Testbed

    survey = Testbed(spark, "/root/testdata/sf0.001")
    tables = reports.analyze(survey, SurveyQuery())
    cells = geographic_summary(survey.tiles, survey.acquisitions, SurveyQuery(), 100.0)
    for df in (tables["totals"], tables["bins"], tables["observations"], cells):
        assert any("/acquisitions-" in name for name in df.inputFiles())


def test_blocks_leave_their_chunk_whole(survey):
    """Bins left a chunk as rows, and were shuffled and collected again into arrays."""
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    blocks = compact.compact(survey.tiles, 5_000, 3_000)[1]
    assert "Aggregate" not in plan(blocks) and "explode" not in plan(blocks)
    rows = lambda d: {r["power_id"]: r.asDict() | {"mean_dbfs": [round(x, 12) for x in r["mean_dbfs"]]} for r in d.collect()}
    assert rows(blocks) == rows(compact.compact(survey.tiles, 5_000, 10**9)[1])


def test_compact_archive_is_made_of_tiles_by_chunk(spark):
    from bandwatch.catalog.sequences import compact_of
    from bandwatch.sources.testbed import Testbed

    t = Testbed(spark, "/root/testdata/sf0.001")
    count = t.tiles.count()
    vars(t)["tiles"] = None  # dealt at random: power arrays would have to move
    assert compact_of(t)[0].count() == count


def test_references_that_are_not_read_are_not_joined(survey):
    """All three references of a tile were joined, whatever was read."""
    parts = [d.cache() for d in compact.compact(survey.tiles, 5_000, 3_000)]
    joins = lambda *c: compact.expand(*parts).select("session_id", "tile_id", *c)._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
    assert [joins("activity"), joins("mean_dbfs"), joins("fix_end.latitude"), joins("mean_dbfs", "fix_start", "fix_end")] == [0, 1, 1, 3]
    tiles, blocks, fixes = parts
    twice = compact.expand(tiles, blocks.unionAll(blocks), fixes.unionAll(fixes))  # an id names one block or fix
    assert twice.count() == tiles.count() and twice.where("mean_dbfs IS NULL").isEmpty() and twice.where("fix_end IS NOT NULL").count() == 12


def test_both_layouts_know_the_size_of_acquisitions(spark):
    """Tiles, whole, were shuffled to meet acquisitions, and compact tiles to meet fixes that the summary does not read."""
    from bandwatch.catalog.records import c5
    from bandwatch.sources.testbed import Testbed

    same = c5(Testbed(spark, "/root/testdata/sf0.001"))
    assert any("/acquisitions-" in name for name in same.inputFiles())
    assert same._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
