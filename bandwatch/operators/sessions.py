"""Counters and summaries per session, lane and subband."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.functions import flags
from bandwatch.functions.power import ratio
from bandwatch.plans.query import SurveyQuery

CLASSIFIED = "crc_valid and status = 0"


def waveform_groups(waveforms: DataFrame) -> DataFrame:
    return waveforms.groupBy("session_id", "bandwidth_hz", "spreading_factor").agg(
        F.count("*").alias("observations"),
        F.count_if(~F.col("complete_in_range")).alias("partial_range"),
        F.count_if("ambiguous").alias("ambiguous"),
        F.min("center_hz").alias("lower_hz"),
        F.max("center_hz").alias("upper_hz"),
    )


def reception_counts(receptions: DataFrame) -> DataFrame:
    return receptions.groupBy("session_id").agg(
        F.count("*").alias("receptions"),
        F.count_if(F.expr(CLASSIFIED)).alias("classified"),
        F.count_if(F.col("status") == flags.STATUS_BAD_CRC).alias("crc_failed"),
        F.count_if(F.col("status") == flags.STATUS_UNSUPPORTED_PAYLOAD).alias("unsupported"),
    )


def session_counters(sessions: DataFrame, tiles: DataFrame, scans: DataFrame) -> DataFrame:
    """Counters of every session, also of those with scans only or with nothing."""
    from bandwatch.operators.rssi import samples

    t = tiles.groupBy("session_id").agg(
        F.count("*").alias("tiles"), F.coalesce(F.sum("clipped"), F.lit(0)).alias("clipped")
    )
    r = scans.groupBy("session_id").agg(F.count("*").alias("scans"), F.sum(samples()).alias("samples"))
    every = sessions.select("session_id").join(t, "session_id", "left").join(r, "session_id", "left")
    return every.fillna(0, ["tiles", "clipped", "scans", "samples"])


def session_summary(
    sessions: DataFrame, tiles: DataFrame, events: DataFrame, gaps: DataFrame, receptions: DataFrame
) -> DataFrame:
    """One row per session: metadata joined with counters of its tables."""
    parts = [
        tiles.groupBy("session_id").agg(F.count("*").alias("tiles"), F.sum("clipped").alias("clipped")),
        events.groupBy("session_id").agg(F.count("*").alias("events")),
        gaps.groupBy("session_id").agg(
            F.count("*").alias("gaps"), F.sum(F.col("end_us") - F.col("start_us")).alias("gap_us")
        ),
        receptions.groupBy("session_id").agg(
            F.count("*").alias("receptions"), F.count_if(F.expr(CLASSIFIED)).alias("classified")
        ),
    ]
    out = sessions
    for p in parts:
        out = out.join(p, "session_id", "left")
    return out


def gap_totals(gaps: DataFrame, q: SurveyQuery) -> DataFrame:
    inside = F.least("end_us", F.lit(q.end_us)) - F.greatest("start_us", F.lit(q.start_us))
    return gaps.groupBy("session_id").agg(
        F.count("*").alias("gaps"),
        F.sum(F.col("end_us") - F.col("start_us")).alias("gap_us"),
        F.sum(F.greatest(F.lit(0), inside)).alias("selected_gap_us"),
    )


def band_coverage(bands: DataFrame) -> DataFrame:
    """Shares per subband. Units of different subbands do not add up, so there is no total."""
    share = ratio(F.col("processed_samples"), F.col("processed_samples") + F.col("abandoned_samples"))
    return bands.withColumn("processed_share", share)


def lane_health(receptions: DataFrame) -> DataFrame:
    return receptions.groupBy("session_id", "lane_label").agg(
        F.count("*").alias("frames"),
        F.count_if(F.expr(CLASSIFIED)).alias("classified"),
        F.count_if(~F.col("crc_valid")).alias("crc_failures"),
        F.sum("duration_us").alias("processed_us"),
    )
