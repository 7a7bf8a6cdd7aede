"""Status tables of counters that only rise, until their source starts anew.

A counter that falls has been reset: its new value is all that was counted since. So a
row adds its difference to the row before, or its own value after a reset, and sums of
these increments hold across restarts, per lane, board, decoder or any other key. They are sums of
row-wise numbers: they combine in the tasks, and a long series is read in time chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwatch.operators.ordered import CHUNK, CHUNK_US, chunked, with_previous


def increments(rows: DataFrame, keys: Sequence[str], time: str, counters: Sequence[str], chunk_us: int = CHUNK_US) -> DataFrame:
    """``rows`` with ``counters`` replaced by what each row adds, and ``restarted`` where any of them fell. A null counter adds nothing."""
    held = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counters]
    plain = rows.select(*[c for c in rows.columns if c not in counters], *held)
    seen = with_previous(chunked(plain, time, chunk_us), keys, [time], F.struct(*counters), "_prev").drop(CHUNK)
    fell: Column = F.lit(False)
    for c in counters:
        fell = fell | F.coalesce(F.col(c) < F.col(f"_prev.{c}"), F.lit(False))
    seen = seen.withColumn("restarted", fell)  # one reset is a reset of all counters of the source
    added = {c: F.when(F.col("_prev").isNull() | F.col("restarted"), F.col(c)).otherwise(F.col(c) - F.col(f"_prev.{c}")) for c in counters}
    return seen.withColumns(added).drop("_prev")


def totals(rows: DataFrame, keys: Sequence[str], time: str, counters: Sequence[str], into: Sequence[str] | None = None, chunk_us: int = CHUNK_US) -> DataFrame:
    """Sums over restarts, per ``into`` (by default the series' own keys), and the number of restarts."""
    each = increments(rows, keys, time, counters, chunk_us)
    return each.groupBy(*(into or keys)).agg(*[F.sum(c).alias(c) for c in counters], F.count_if("restarted").alias("restarts"))


def board_health(scans: DataFrame, receptions: DataFrame) -> DataFrame:
    """Per session and board: scans and their samples, receptions and those that failed their check. ``receptions`` has ``board``."""
    samples = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    nothing = F.lit(0).cast("bigint")
    seen = scans.select("session_id", "board", F.lit(1).cast("bigint").alias("scans"), samples.alias("samples"), nothing.alias("receptions"), nothing.alias("crc_failures"))
    heard = receptions.select(
        "session_id", "board", nothing.alias("scans"), nothing.alias("samples"), F.lit(1).cast("bigint").alias("receptions"),
        F.when(~F.col("crc_valid"), 1).otherwise(0).cast("bigint").alias("crc_failures"),
    )
    sums = [F.sum(c).alias(c) for c in ("scans", "samples", "receptions", "crc_failures")]
    return seen.unionByName(heard).groupBy("session_id", "board").agg(*sums)
