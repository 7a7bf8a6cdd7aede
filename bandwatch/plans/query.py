"""Selections: frequency range x time range x rectangle x grouping."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SurveyQuery:
    """A selection. Zero bounds mean the whole recorded range.

    Frequencies in Hz and times in elapsed seconds; intervals are half-open.
    ``max_observations`` and ``max_events`` bound what a display takes (at most 2000);
    0, the default, neither widens time groups nor cuts lists.
    """

    lower_hz: float = 0.0
    upper_hz: float = 0.0
    elapsed_start: float = 0.0
    elapsed_end: float = 0.0
    geographic: bool = False
    south: float = -90.0
    north: float = 90.0
    west: float = -180.0
    east: float = 180.0
    time_bucket_s: float = 1.0
    max_observations: int = 0
    max_events: int = 0

    def __post_init__(self) -> None:
        for bound in (self.lower_hz, self.upper_hz, self.elapsed_start, self.elapsed_end):
            if not math.isfinite(bound) or not 0 <= bound <= 1e10:
                raise ValueError("selection bounds must be finite, non-negative and at most 1e10")
        if self.upper_hz > 0 and self.upper_hz <= self.lower_hz:
            raise ValueError("empty or reversed frequency range")
        if self.elapsed_end > 0 and self.elapsed_end <= self.elapsed_start:
            raise ValueError("empty or reversed time range")
        if not math.isfinite(self.time_bucket_s) or not 0.001 <= self.time_bucket_s <= 1e10:
            raise ValueError("time groups must be at least one millisecond")
        if not 0 <= self.max_observations <= 2000 or not 0 <= self.max_events <= 2000:
            raise ValueError("display bounds must be 0 through 2000")
        if self.geographic:
            corners = (self.south, self.north, self.west, self.east)
            if (
                not all(map(math.isfinite, corners))
                or abs(self.south) > 90
                or abs(self.north) > 90
                or abs(self.west) > 180
                or abs(self.east) > 180
                or self.south > self.north
                or self.west > self.east
            ):
                raise ValueError("invalid rectangle; split a selection that crosses the date line")

    @property
    def start_us(self) -> int:
        return round(self.elapsed_start * 1_000_000)

    @property
    def end_us(self) -> int:
        """Exclusive end; far beyond any record where the query leaves it open."""
        return round(self.elapsed_end * 1_000_000) if self.elapsed_end > 0 else 10**16

    @property
    def bucket_us(self) -> int:
        return round(self.time_bucket_s * 1_000_000)

    def with_rectangle(self, south: float, north: float, west: float, east: float) -> SurveyQuery:
        return replace(self, geographic=True, south=south, north=north, west=west, east=east)
