"""As-of lookups: the latest earlier record decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.operators.ordered import CHUNK_US, chunked, running_max

FIX_TOLERANCE_US = 2_000_000


def latest_before(
    facts: DataFrame,
    records: DataFrame,
    keys: Sequence[str],
    fact_time: str,
    record_time: str,
    rank: Sequence[str],
    out: str,
    chunk_us: int = CHUNK_US,
) -> DataFrame:
    """Add, as struct ``out``, the record with the highest ``rank`` at or before each fact's time.

    Facts and records are merged in one ordered pass instead of a range join.
    The latest record is a running maximum over (rank, record), so long
    sessions split into chunks. Project facts to their key and time first:
    every column of ``facts`` is shuffled once.
    """
    record = F.struct(*rank, *[c for c in records.columns if c not in (*keys, *rank)])
    left = facts.select(
        *keys, F.col(fact_time).alias("_t"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact")
    )
    right = records.select(*keys, F.col(record_time).alias("_t"), F.lit(0).alias("_kind"), record.alias("_record"))
    merged = chunked(left.unionByName(right, allowMissingColumns=True), "_t", chunk_us)
    found = running_max(merged, keys, ["_t", "_kind"], {out: F.col("_record")})
    return found.where("_kind = 1").select("_fact.*", out)


def position_at(
    facts: DataFrame,
    positions: DataFrame,
    time: str,
    tolerance_us: int = FIX_TOLERANCE_US,
    chunk_us: int = CHUNK_US,
) -> DataFrame:
    """Attach the fix known at ``time``.

    The latest fix in insertion order decides even when it is invalid: then
    there is none. Valid fixes age out after ``tolerance_us``; manual ones do not.
    """
    found = latest_before(facts, positions, ["session_id"], time, "monotonic_us", ["seq"], "_fix", chunk_us)
    usable = F.col("_fix.valid") & (
        F.col("_fix.manual") | (F.col(time) - F.col("_fix.monotonic_us") <= tolerance_us)
    )
    return found.withColumn("fix", F.when(usable, F.col("_fix"))).drop("_fix")


def segment_at(facts: DataFrame, acquisitions: DataFrame, time: str, chunk_us: int = CHUNK_US) -> DataFrame:
    """Attach the acquisition whose interval holds ``time``; NULL before, after and between."""
    segments = acquisitions.select(
        "session_id",
        F.col("start_us").alias("segment_start_us"),
        F.col("end_us").alias("segment_end_us"),
        F.col("acq_id").alias("segment_id"),
    )
    found = latest_before(
        facts, segments, ["session_id"], time, "segment_start_us", ["segment_start_us", "segment_end_us"], "_s", chunk_us
    )
    inside = F.col(time) <= F.col("_s.segment_end_us")
    return found.withColumn("segment_id", F.when(inside, F.col("_s.segment_id"))).drop("_s")
