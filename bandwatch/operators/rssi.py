"""Sampled-RSSI histograms: exceedance, summaries, sweep assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwatch.functions.power import percent
from bandwatch.operators.select import RSSI_HALF_FILTER_HZ

BINS = 33
STEP_DB = 4.0
THRESHOLD_DBM = -87.0
FILTER_HZ = 234_300


def bin_lower_dbm(i: Column, offset: Column) -> Column:
    """Lower edge of a histogram bin; the last bin is open below (NULL)."""
    return F.when(i < BINS - 1, offset - STEP_DB * i)


def samples() -> Column:
    return F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)


def samples_above(threshold: float) -> Column:
    """Samples in bins that lie wholly at or above the threshold; bins are never split."""
    chosen = F.transform(
        "counts",
        lambda c, i: F.when((i < BINS - 1) & (F.col("rssi_offset_db") - STEP_DB * i >= threshold), c).otherwise(0),
    )
    return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda a, c: a + c)


def fraction_above(threshold: float) -> Column:
    total = samples()
    return F.when(total > 0, samples_above(threshold) / total).otherwise(F.lit(0.0))


def bin_label(i: Column) -> Column:
    lower = (-11 - 4 * i).cast("string")
    upper = (-7 - 4 * i).cast("string")
    return F.when(i == 0, ">= -11").when(i == BINS - 1, "< -135").otherwise(
        F.concat(F.lit("["), lower, F.lit(", "), upper, F.lit(")"))
    )


def frequency_summary(scans: DataFrame) -> DataFrame:
    """Per board and frequency: scans, samples, exceedance, summed histogram, times, last fix.

    The 33 bins are 33 sums of one aggregate, which combine on the map side;
    nothing is collected.
    """
    rows = scans.withColumn("n", samples()).withColumn("above", samples_above(THRESHOLD_DBM))
    sums = [F.sum(F.get("counts", F.lit(i))).alias(f"_c{i}") for i in range(BINS)]
    grouped = rows.groupBy("session_id", "board", "frequency_hz").agg(
        F.count("*").alias("scans"),
        F.sum("n").alias("samples"),
        F.sum("above").alias("above"),
        F.min("start_us").alias("first_us"),
        F.max("end_us").alias("last_us"),
        F.min("utc_start_us").alias("utc_first_us"),
        F.max("utc_end_us").alias("utc_last_us"),
        F.count_if("boundary").alias("boundary_scans"),
        F.count_if(F.col("fix").isNull()).alias("scans_without_fix"),
        F.max_by("fix", F.when(F.col("fix").isNotNull(), F.col("scan_id"))).alias("last_fix"),
        *sums,
    )
    return (
        grouped.withColumn("counts", F.array(*[F.col(f"_c{i}") for i in range(BINS)]))
        .drop(*[f"_c{i}" for i in range(BINS)])
        .withColumn("exceedance_pct", percent(F.col("above"), F.col("samples")))
    )


def board_rollup(frequency: DataFrame) -> DataFrame:
    """Per board: centers, active centers, scans, samples, times and outer filter edges."""
    return frequency.groupBy("session_id", "board").agg(
        F.count("*").alias("centers"),
        F.count_if(F.col("above") > 0).alias("active_centers"),
        F.sum("scans").alias("scans"),
        F.sum("samples").alias("samples"),
        F.sum("above").alias("above"),
        F.sum("scans_without_fix").alias("scans_without_fix"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        (F.min("frequency_hz") - RSSI_HALF_FILTER_HZ).alias("lower_hz"),
        (F.max("frequency_hz") + RSSI_HALF_FILTER_HZ).alias("upper_hz"),
    )


def scan_rows(scans: DataFrame) -> DataFrame:
    """One report row per selected scan."""
    return scans.select(
        "session_id",
        "board",
        "scan_id",
        "frequency_hz",
        samples().alias("samples"),
        (100.0 * fraction_above(THRESHOLD_DBM)).alias("exceedance_pct"),
        "start_us",
        "end_us",
        "boundary",
        F.concat_ws(";", F.transform("counts", lambda c: c.cast("string"))).alias("histogram"),
    )


def latest_cells(scans: DataFrame, step_hz: int) -> DataFrame:
    """Latest scan per board and frequency, with its display cell."""
    half = min(step_hz, FILTER_HZ) / 2.0
    latest = scans.groupBy("session_id", "board", "frequency_hz").agg(
        F.max("scan_id").alias("scan_id"),
        F.max_by(fraction_above(THRESHOLD_DBM), "scan_id").alias("exceedance"),
    )
    return latest.withColumn("lower_hz", F.col("frequency_hz") - half).withColumn(
        "upper_hz", F.col("frequency_hz") + half
    )


def sweep_plan(points: DataFrame, boards: int) -> DataFrame:
    """Assign board i the sweep points ``[n*i/b, n*(i+1)/b)`` of each session's plan."""
    order = Window.partitionBy("session_id").orderBy("frequency_hz")
    n = F.count("*").over(Window.partitionBy("session_id"))
    index = F.row_number().over(order) - 1
    # board of a point: the largest i with floor(n*i/b) <= index
    board = F.floor(((index + 1) * boards - 1) / n)
    return points.withColumn("board", board.cast("int")).withColumn("point", index)


def off_plan(scans: DataFrame, plan: DataFrame) -> DataFrame:
    """Scans off the grid or in another board's slice."""
    owned = plan.select("session_id", "board", "frequency_hz")
    return scans.join(owned, ["session_id", "board", "frequency_hz"], "left_anti")
