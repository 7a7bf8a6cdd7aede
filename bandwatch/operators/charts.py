"""Display reductions: bins and ranges to a fixed number of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwatch.functions.power import ratio
from bandwatch.operators.ordered import affine_scan

SMOOTHING = 0.4
FLOOR_DBFS = -180.0


def pool_columns(df: DataFrame, keys: Sequence[str], value: Column, n: Column, columns: int) -> DataFrame:
    """Max-pool ``bin`` 0..n-1 into columns ``[i*n/c, max(+1, (i+1)*n/c))``.

    With fewer bins than columns a bin repeats over several columns.
    """
    c = F.lit(columns)
    first = F.floor(F.col("bin") * c / n)
    # columns whose start falls in this bin, and columns that contain it
    last = F.ceil((F.col("bin") + 1) * c / n) - 1
    spread = df.withColumn("column", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    lo = F.floor(F.col("column") * n / c)
    hi = F.greatest(lo + 1, F.floor((F.col("column") + 1) * n / c))
    return (
        spread.where((F.col("bin") >= lo) & (F.col("bin") < hi))
        .groupBy(*keys, "column")
        .agg(F.max(value).alias("value"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))
    )


def occupancy_columns(frequency: DataFrame, lower_hz: Column, upper_hz: Column, columns: int) -> DataFrame:
    """Bins drawn on their real frequency edges: per column the highest ratio and its bin.

    Works for grids of different widths; a column also tells whether any of its
    bins was observed and whether any was not.
    """
    n = F.lit(columns)
    scale = n / (upper_hz - lower_hz)
    placed = (
        frequency.withColumn("c0", F.floor((F.col("lower_hz") - lower_hz) * scale + 1e-9))
        .withColumn("c1", F.ceil((F.col("upper_hz") - lower_hz) * scale - 1e-9) - 1)
        .where((F.col("c1") >= 0) & (F.col("c0") < n))
        .withColumn(
            "column", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), "c0"), F.least(n - 1, F.col("c1"))))
        )
    )
    value = ratio(F.col("busy_us"), F.col("observed_us"))
    seen = F.col("observed_us") > 0
    best = F.max(F.when(seen, F.struct(value.alias("ratio"), (-F.col("center_hz")).alias("neg")))).alias("_best")
    return (
        placed.groupBy("session_id", "column")
        .agg(best, F.bool_or(seen).alias("any_observed"), F.bool_or(~seen).alias("any_unobserved"))
        .select(
            "session_id",
            "column",
            F.col("_best.ratio").alias("max_ratio"),
            (-F.col("_best.neg")).alias("bin_center_hz"),
            "any_observed",
            "any_unobserved",
        )
    )


def ranges_to_columns(ranges: DataFrame, lower: Column, upper: Column, columns: int) -> DataFrame:
    """Intervals spread over the display columns they touch, as rows of (interval, column)."""
    n = F.lit(columns)
    lo = F.floor((F.col("lower_hz") - lower) / (upper - lower) * n)
    hi = F.ceil((F.col("upper_hz") - lower) / (upper - lower) * n) - 1
    return (
        ranges.withColumn("_lo", F.greatest(F.lit(0).cast("bigint"), lo))
        .withColumn("_hi", F.least(n - 1, hi).cast("bigint"))
        .where("_lo <= _hi")
        .withColumn("column", F.explode(F.sequence("_lo", "_hi")))
        .drop("_lo", "_hi")
    )


def smoothed(peaks: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Exponential display smoothing ``y = 0.4 x + 0.6 y'`` per column, from the floor level on.

    The whole history counts. Counting the blocks of the scan is a job of its own.
    """
    return affine_scan(peaks, keys, order, F.lit(1 - SMOOTHING), SMOOTHING * F.col("value"), F.lit(FLOOR_DBFS), "smoothed")
