"""Power and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: powers below this count as this, so silence reads -180 dBFS.
MINIMUM_POWER = 1e-18


def linear(dbfs: Column) -> Column:
    return F.pow(F.lit(10.0), dbfs / 10.0)


def dbfs(power: Column) -> Column:
    """Linear power to dBFS with the measurement floor."""
    return 10.0 * F.log10(F.greatest(power, F.lit(MINIMUM_POWER)))


def dbfs_or_null(power: Column) -> Column:
    """Linear power to dBFS for reports: no power, no level."""
    return F.when(power > 0, 10.0 * F.log10(power))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL (never 0) where nothing was observed."""
    return F.when(whole > 0, part / whole)


def percent(part: Column, whole: Column) -> Column:
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / whole))
    return F.when(part.isNotNull() & (whole > 0), 100.0 * bounded)


def seconds(us: Column) -> Column:
    return us / F.lit(1_000_000.0)


def micro(x: Column) -> Column:
    """Round to six decimals in a way every engine agrees on."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def round_half_away(x: Column, decimals: int) -> Column:
    scale = float(10**decimals)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def log_scale(occupancy: Column) -> Column:
    """Zero-preserving logarithmic height of an occupancy ratio in 0..1."""
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), occupancy))
    return F.log1p(bounded * 1e6) / F.log1p(F.lit(1e6))


def linear_scale(occupancy: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), occupancy))
