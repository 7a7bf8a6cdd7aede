"""State machines of the live operators."""

from __future__ import annotations

import json
from dataclasses import asdict

from bandwatch.operators import bursts, events
from bandwatch.streaming.stateful import Walker

WINDOW_US = 5_000_000
FIX_TOLERANCE_US = 2_000_000


class SurveyWindows(Walker):
    """Windows that close once their tiles reach five seconds; the next starts there."""

    def __init__(self, key: tuple) -> None:
        self.start, self.end, self.observed, self.busy, self.tiles = None, None, 0, 0, 0

    def flush(self) -> list[tuple]:
        """The last window, shorter than the others."""
        done = [(self.start, self.end, self.observed, self.busy, self.tiles)] if self.tiles else []
        self.start, self.observed, self.busy, self.tiles = self.end, 0, 0, 0
        return done

    def row(self, row) -> list[tuple]:
        if self.start is None:
            self.start = int(row.start_us)
        self.observed += int(row.end_us - row.start_us)
        self.busy += int(row.busy_us)
        self.tiles += 1
        end = self.end = int(row.end_us)
        if end - self.start < WINDOW_US:
            return []
        done = [(self.start, end, self.observed, self.busy, self.tiles)]
        self.start, self.observed, self.busy, self.tiles = end, 0, 0, 0
        return done


class SampleGaps(Walker):
    """A block that does not start where the last one ended; no input for long."""

    def __init__(self, key: tuple) -> None:
        self.expected = None

    def row(self, row) -> list[tuple]:
        first, expected = int(row.first_sample), self.expected
        end = first + int(row.n)
        self.expected = end if expected is None else max(expected, end)
        if expected is None or first == expected:
            return []
        if first < expected:  # samples that were there already: nothing is missing
            return [(first, 0, "overlap")]
        return [(expected, first - expected, "application_drop")]

    def late(self, row) -> list[tuple]:
        return [(int(row.first_sample), 0, "late_block")]

    def stalled(self) -> list[tuple]:
        """The missing count of a stall is unknown: NULL."""
        return [(self.expected, None, "source_stall")]


class LiveBursts(Walker):
    """Bursts of a session's tiles, both guard classes; breaks end all open tracks."""

    def __init__(self, key: tuple) -> None:
        self.tracks = {c: bursts.BurstTracks() for c in (False, True)}
        self.start, self.end, self.grid = None, None, None

    def flush(self) -> list[tuple]:
        if self.start is None:
            return []
        return [x for c, b in self.tracks.items() for x in self._out(c, b.finish(self.start))]

    def state(self):
        return {
            "tracks": {c: [asdict(t) for t in b.open] for c, b in self.tracks.items()},
            "start": self.start,
            "end": self.end,
            "grid": self.grid,
        }

    def restore(self, saved) -> None:
        for c, rows in saved["tracks"].items():
            self.tracks[c].open = [bursts.Track(**r) for r in rows]
        self.start, self.end, self.grid = saved["start"], saved["end"], saved["grid"]

    def row(self, row) -> list[tuple]:
        grid = (int(row.acq_id), float(row.first_center_hz), float(row.bin_width_hz), int(row.bin_count))
        out: list[tuple] = []
        start = int(row.from_us)
        if self.end is not None and (start != self.end or grid != self.grid):
            for c, b in self.tracks.items():
                done, b.open = b.open, []
                for t in done:
                    t.limited = True
                out += self._out(c, done)
        self.start, self.end, self.grid = start, int(row.to_us), grid
        found = json.loads(row.components)
        for c, b in self.tracks.items():
            parts = [self._part(row, p) for p in found if bool(p["center_region"]) == c]
            done = b.step(start, parts, grid[2]) if parts else b.expire(start)
            out += self._out(c, done)
        return out

    @staticmethod
    def _out(center: bool, done) -> list[tuple]:
        return [(center, *bursts.burst_tuple(t)) for t in done]

    @staticmethod
    def _part(row, p) -> bursts.Part:
        first, width = float(row.first_center_hz), float(row.bin_width_hz)
        length, frames = int(row.end_us - row.start_us), {}
        for f in p["frames"]:
            a = max(int(row.from_us), int(row.start_us) + length * int(f) // int(row.frame_count))
            b = min(int(row.to_us), int(row.start_us) + length * (int(f) + 1) // int(row.frame_count))
            frames[int(f)] = (a, b)
        return bursts.Part(
            int(p["first_us"]),
            int(p["last_us"]),
            first + (int(p["low_bin"]) - 0.5) * width,
            first + (int(p["high_bin"]) + 0.5) * width,
            int(p["active_us"]),
            float(p["peak_dbfs"]),
            int(p["quality"]),
            bool(p["ambiguous"]),
            frames,
        )


class LiveEvents(Walker):
    """Energy events of a session's frames; a missing frame truncates, a quiet one closes."""

    def __init__(self, key: tuple) -> None:
        self.expected, self.tracks = None, None

    def flush(self) -> list[tuple]:
        done = [] if self.tracks is None else self.tracks.finish(truncated=True)
        return [events.event_tuple(e) for e in done]

    def state(self):
        t = self.tracks
        return {
            "expected": self.expected,
            "sizes": None if t is None else (t.frame_samples, t.segment_samples),
            "open": [] if t is None else [asdict(e) for e in t.open],
            "split": [] if t is None else t.split,
        }

    def restore(self, saved) -> None:
        self.expected = saved["expected"]
        if saved["sizes"] is not None:
            self.tracks = events.EventTracks(*saved["sizes"])
            self.tracks.open = [events.Event(**e) for e in saved["open"]]
            self.tracks.split = saved["split"]

    def row(self, row) -> list[tuple]:
        if self.tracks is None:
            self.tracks = events.EventTracks(int(row.frame_samples), int(row.segment_samples))
        first = int(row.first_sample)
        broken = self.expected is not None and first != self.expected
        done = self.tracks.finish(truncated=True) if broken else []
        self.expected = first + int(row.frame_samples)
        runs = row.runs if row.runs is not None else []
        done += self.tracks.step(first, events.runs_of(runs)) if len(runs) else self.tracks.finish(truncated=False)
        return [events.event_tuple(e) for e in done]


class LiveFix(Walker):
    """Facts and fixes of one session, in time order: the latest fix decides."""

    def __init__(self, key: tuple) -> None:
        self.fix = None

    def row(self, row) -> list[tuple]:
        if row.kind == 0:
            # insertion order decides among fixes already heard
            if self.fix is None or int(row.seq) >= self.fix[0]:
                self.fix = (int(row.seq), int(row.t_us), bool(row.valid), bool(row.manual), float(row.latitude), float(row.longitude))
            return []
        return [(int(row.fact_id), *self._position(int(row.t_us), int(row.tolerance_us)))]

    def _position(self, t: int, tolerance: int) -> tuple:
        if self.fix is None:
            return (None, None)
        _, at, valid, manual, lat, lon = self.fix
        return (lat, lon) if valid and (manual or t - at <= tolerance) else (None, None)


class OrderGuard(Walker):
    """Passes rows in order and marks those that begin before what was taken has ended."""

    def __init__(self, key: tuple) -> None:
        self.end = None

    def row(self, row) -> list[tuple]:
        if self.end is not None and int(row.start_us) < self.end:
            return self.late(row)
        self.end = int(row.end_us)
        return [(int(row.tile_id), int(row.start_us), False)]

    def late(self, row) -> list[tuple]:
        return [(int(row.tile_id), int(row.start_us), True)]
