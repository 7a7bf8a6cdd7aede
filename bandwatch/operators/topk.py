"""Top-k, recency and bounded-list operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwatch.functions.power import ratio


def busiest_bin(frequency: DataFrame) -> DataFrame:
    """Per acquisition: the busiest bin outside the guard; ties go to the lower bin."""
    share = ratio(F.col("busy_us"), F.col("observed_us"))
    rows = frequency.where("not guarded and observed_us > 0")
    best = F.max(F.struct(share.alias("share"), (-F.col("bin")).alias("neg"), "center_hz", "bin"))
    return rows.groupBy("session_id", "acq_id").agg(best.alias("b")).select(
        "session_id", "acq_id", "b.bin", "b.center_hz", (100.0 * F.col("b.share")).alias("occupancy_pct")
    )


def busiest_times(times: DataFrame, k: int = 10) -> DataFrame:
    """The k time groups of each acquisition with the highest outside-guard occupancy.

    Each group pre-selects nothing: ranking runs over one row per time group.
    """
    share = ratio(F.coalesce("outside_busy_us", F.lit(0)), F.col("observed_us"))
    order = Window.partitionBy("session_id", "acq_id").orderBy(F.desc("share"), "bucket")
    return (
        times.where("observed_us > 0")
        .withColumn("share", share)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def busiest_cells(cells: DataFrame, k: int = 20) -> DataFrame:
    """The k receiver cells of each acquisition with the busiest single bin."""
    best = F.max(F.struct("busy_us", (-F.col("bin")).alias("neg"), "bin", "center_hz"))
    per_cell = (
        cells.where("located")
        .groupBy("session_id", "acq_id", "cell_row", "cell_column")
        .agg(best.alias("b"), F.max("observed_us").alias("observed_us"), F.max("crossing_us").alias("crossing_us"))
        .where("observed_us > 0")
        .withColumn("occupancy", F.col("b.busy_us") / F.col("observed_us"))
    )
    order = Window.partitionBy("session_id", "acq_id").orderBy(F.desc("occupancy"), "cell_row", "cell_column")
    return (
        per_cell.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            "session_id", "acq_id", "rank", "cell_row", "cell_column", "b.bin", "b.center_hz",
            (100.0 * F.col("occupancy")).alias("occupancy_pct"), "observed_us", "crossing_us",
        )
    )


def most_recent(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n rows with the highest order columns, newest first."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def recent_ascending(df: DataFrame, n: int, order: str) -> DataFrame:
    """The n newest rows of every session, oldest first."""
    return recent_per_session(df, n, order).orderBy("session_id", order)


def latest_first(df: DataFrame, start: str, ident: str) -> DataFrame:
    return df.orderBy(F.desc(start), F.desc(ident))


def recent_per_session(df: DataFrame, n: int, order: str) -> DataFrame:
    """The n newest rows of every session.

    For a rank filter like this Spark limits per key before the shuffle
    (WindowGroupLimit), so a long session sends at most n rows per task.
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def capped_with_total(df: DataFrame, keys: Sequence[str], order: Column, n: int) -> DataFrame:
    """First n rows per key, with the full count and whether the list was cut.

    Counting is a map-side aggregate of all rows; only bucket winners are ranked.
    """
    total = df.groupBy(*keys).agg(F.count("*").alias("total"))
    local = Window.partitionBy(*keys, "_b").orderBy("_o")
    final = Window.partitionBy(*keys).orderBy("_o")
    first = (
        df.withColumn("_o", order)
        .withColumn("_b", F.pmod(F.xxhash64("_o"), F.lit(64)))
        .withColumn("_r", F.row_number().over(local))
        .where(F.col("_r") <= n)
        .withColumn("position", F.row_number().over(final))
        .where(F.col("position") <= n)
        .drop("_o", "_b", "_r")
    )
    return first.join(total, list(keys)).withColumn("truncated", F.col("total") > n)
