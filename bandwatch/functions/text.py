"""Labels, clocks and per-source columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Receiver kinds and the labels they are shown with.
SOURCE_LABELS = {"synthetic": "synthetic", "rtl": "RTL-SDR", "hackrf": "HackRF", "rak": "RAK5146 USB/LBT"}
LAST_UTC_US = 253_402_300_800_000_000


def utc_text(utc_us: Column) -> Column:
    """UTC to the second, ``Unavailable`` outside years 1970 to 9999."""
    inside = (utc_us > 0) & (utc_us < LAST_UTC_US)
    return F.when(inside, F.date_format(F.timestamp_micros(utc_us), "yyyy-MM-dd HH:mm:ss 'UTC'")).otherwise("Unavailable")


def source_label(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, label in SOURCE_LABELS.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


def by_source(acquisitions: DataFrame) -> DataFrame:
    """Blank the settings a kind of receiver does not have."""
    kind = F.col("receiver")
    staged = ~kind.isin("rtl", "rak")
    rtl = kind == "rtl"
    return (
        acquisitions.withColumn("source_label", source_label(kind))
        .withColumns({c: F.when(staged, F.col(c)) for c in ("lna", "vga", "amp")})
        .withColumn("sample_rate", F.when(kind != "rak", F.col("sample_rate")))
        .withColumn("threshold_dbfs", F.when(kind != "rak", F.col("threshold_dbfs")))
        .withColumn("rtl_auto", F.when(rtl, F.col("rtl_auto")))
        .withColumn("rtl_gain_db", F.when(rtl & ~F.coalesce("rtl_auto", F.lit(False)), F.col("rtl_gain_db")))
    )


def block_epoch_us(run_start_us: Column, arrival_us: Column, end_sample: Column, rate: Column) -> Column:
    """Wall clock of a run's first sample, from a block's arrival; never before the run began."""
    return F.greatest(run_start_us, arrival_us - end_sample / rate * 1e6)
