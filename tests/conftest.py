import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402, F401
from bandwatch.session import local_session  # noqa: E402
from bandwatch.sources.schemas import TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


FIX = ("latitude", "longitude", "altitude_m", "manual", "utc_us", "monotonic_us", "source", "hdop", "satellites")


def fix(lat, lon):
    return dict(zip(FIX, (lat, lon, None, False, 0, 0, "test", None, 8)))


class Fixture:
    """Small survey tables built from rows."""

    def __init__(self, spark, tiles, center=906_000_000, rate=16_000_000, gaps=()):
        self.spark = spark
        self.tiles = spark.createDataFrame(tiles, TABLES["tiles"])
        end = max(max(t["end_us"] for t in tiles), max((g["end_us"] for g in gaps), default=0))
        acquisition = dict(
            session_id=1, acq_id=1, start_us=0, end_us=end, finalized=True, center_hz=center, sample_rate=rate,
            span_hz=rate, threshold_dbfs=-60.0, offset_hz=0, lna=16, vga=20, amp=False, rtl_gain_db=None, rtl_auto=None,
        )
        self.acquisitions = spark.createDataFrame([acquisition], TABLES["acquisitions"])
        self.coverage_gaps = spark.createDataFrame(list(gaps), TABLES["coverage_gaps"])


def tile(i, frames, bins, frame_us=256, means=None, fixes=(None, None), first=905_000_000.0, width=4_000.0, start=None):
    """One tile; ``frames`` lists the active bins of each frame."""
    n = len(frames)
    begin = i * n * frame_us if start is None else start
    means = means or [-80.0] * bins
    return dict(
        session_id=1, acq_id=1, tile_id=i + 1, first_sample=i * n * 4096, end_sample=(i + 1) * n * 4096, start_us=begin,
        end_us=begin + n * frame_us, utc_start_us=10**15 + begin, utc_end_us=10**15 + begin + n * frame_us,
        power_start_us=begin, power_end_us=begin + n * frame_us, first_center_hz=first, bin_width_hz=width, fft_size=4096,
        frame_count=n, bin_count=bins, background_dbfs=-100.0, clipped=0, quality=129, mean_dbfs=means,
        peak_dbfs=[m + 10 for m in means], activity=frames, fix_start=fixes[0], fix_end=fixes[1],
    )


def gap(start, end):
    return dict(
        session_id=1, gap_id=1, missing_samples=0, utc_start_us=10**15 + start, utc_end_us=10**15 + end, start_us=start,
        end_us=end, reason="application_drop",
    )
