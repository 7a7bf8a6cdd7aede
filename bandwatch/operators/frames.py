"""Frame-level activity of selected tiles.

A tile row carries the activity of all its frames, so the any-of union over
bins is decided inside the row. Nothing here shuffles; the sums that follow
combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _edge(index: str) -> Column:
    """Start of a frame: the tile is divided evenly, in whole microseconds."""
    return F.expr(f"start_us + (end_us - start_us) * ({index}) div frame_count")


def frame_activity(selected: DataFrame, *keep: str) -> DataFrame:
    """One row per frame with exposure: clipped times, selected active bins, union flags."""
    chosen = F.filter(F.col("frame_bins"), lambda b: (b >= F.col("bin_lo")) & (b < F.col("bin_hi")))
    frames = selected.select(
        "session_id", "acq_id", "tile_id", "start_us", "end_us", "from_us", "to_us", "frame_count",
        "bin_lo", "bin_hi", "guard_lo", "guard_hi", *keep,
        F.posexplode("activity").alias("frame", "frame_bins"),
    )
    return (
        frames.withColumn("f0_us", F.greatest(F.col("from_us"), _edge("frame")))
        .withColumn("f1_us", F.least(F.col("to_us"), _edge("frame + 1")))
        .where("f1_us > f0_us")
        .withColumn("bins", chosen)
        .withColumn("busy", F.size("bins") > 0)
        .withColumn("center_busy", F.exists("bins", lambda b: b.between(F.col("guard_lo"), F.col("guard_hi"))))
        .withColumn("outside_busy", F.exists("bins", lambda b: ~b.between(F.col("guard_lo"), F.col("guard_hi"))))
        .drop("frame_bins", "start_us", "end_us", "frame_count")
    )


def active_cells(selected: DataFrame, *keep: str) -> DataFrame:
    """One row per active selected (frame, bin) cell; quiet cells never become rows."""
    return (
        frame_activity(selected, *keep)
        .where("busy")
        .select(
            "session_id", "acq_id", "tile_id", "frame", "f0_us", "f1_us", "guard_lo", "guard_hi", *keep,
            F.explode("bins").alias("bin"),
        )
        .withColumn("guarded", F.col("bin").between(F.col("guard_lo"), F.col("guard_hi")))
    )


def band_power(array: str) -> Column:
    """Linear power summed over the selected bins of one tile."""
    chosen = F.slice(F.col(array), F.col("bin_lo") + 1, F.col("bin_hi") - F.col("bin_lo"))
    return F.aggregate(chosen, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x / 10.0))


def with_frame_states(selected: DataFrame) -> DataFrame:
    """Add ``states``: per frame its clipped time and union flags, kept inside the tile row."""
    lo, hi, glo, ghi = (F.col(c) for c in ("bin_lo", "bin_hi", "guard_lo", "guard_hi"))

    def state(bins: Column, i: Column) -> Column:
        chosen = F.filter(bins, lambda b: (b >= lo) & (b < hi))
        length = F.col("end_us") - F.col("start_us")
        n = F.col("frame_count")
        return F.struct(
            F.greatest(F.col("from_us"), F.col("start_us") + F.floor(length * i / n)).alias("f0"),
            F.least(F.col("to_us"), F.col("start_us") + F.floor(length * (i + 1) / n)).alias("f1"),
            (F.size(chosen) > 0).alias("busy"),
            F.exists(chosen, lambda b: b.between(glo, ghi)).alias("center"),
            F.exists(chosen, lambda b: ~b.between(glo, ghi)).alias("outside"),
        )

    return selected.withColumn("states", F.transform("activity", state))


def time_in(state: str, start: Column, end: Column) -> Column:
    """Microseconds of ``[start, end)`` in which a union flag holds, from ``states``."""
    return F.aggregate(
        "states",
        F.lit(0).cast("bigint"),
        lambda acc, s: acc
        + F.when(s[state], F.greatest(F.lit(0), F.least(s["f1"], end) - F.greatest(s["f0"], start))).otherwise(0),
    )
