"""Waveform observations: association across subbands, latest versions, range flags."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwatch.operators.ordered import CHUNK, bands, chunked, group_start, running_max
from bandwatch.operators.walk import names_of, typed, walk_groups

TOLERANCE_FACTOR = 2.0


@dataclass(eq=False)
class Observation:
    best: tuple
    score: float
    subbands: set[int]
    centers: list[float]
    times: list[float]
    ambiguous: bool = False
    found: int = field(default=1)


OBSERVATION_COLUMNS = (
    "center_hz double, delimiter_sample double, up_match double, down_match double, subbands int, found int, "
    "ambiguous boolean"
)
GROUP = ["session_id", "bandwidth_hz", "spreading_factor", "piece", "band", "part"]


class _Associator:
    """Findings of one piece in order of arrival.

    A finding joins an observation only if exactly one fits: a new subband,
    centers and delimiters of all members within the tolerances. If several
    fit, it becomes an observation of its own, marked ambiguous. Observations are
    filed in cells of time and center, by their least values: those that may fit
    lie within a tolerance of the finding, so only few cells are looked at.
    """

    def __init__(self, key: tuple) -> None:
        self.key, self.known = key[:3], []
        self.cells: dict[tuple[int, int], list[Observation]] = {}
        self.frequency_tolerance = TOLERANCE_FACTOR * float(key[1]) / 2 ** int(key[2])
        self.time_cell = None

    def _cell(self, o: Observation) -> tuple[int, int]:
        return math.floor(o.times[0] / self.time_cell), math.floor(o.centers[0] / self.frequency_tolerance)

    def _near(self, c: float, t: float, time_tolerance: float):
        def around(value: float, tolerance: float, size: float) -> range:
            tolerance *= 1 + 1e-9  # rounding leaves none out
            return range(math.floor((value - tolerance) / size), math.floor((value + tolerance) / size) + 1)

        for i in around(t, time_tolerance, self.time_cell):
            for j in around(c, self.frequency_tolerance, self.frequency_tolerance):
                yield from self.cells.get((i, j), ())

    def _fits(self, o: Observation, c: float, t: float, band: int, time_tolerance: float) -> bool:
        return (
            band not in o.subbands
            and max(*o.centers, c) - min(*o.centers, c) <= self.frequency_tolerance
            and max(*o.times, t) - min(*o.times, t) <= time_tolerance
        )

    def row(self, row) -> list[tuple]:
        c, t, band = float(row.center_hz), float(row.delimiter_sample), int(row.subband)
        tolerance = TOLERANCE_FACTOR * float(row.sample_rate) / float(row.bandwidth_hz)
        self.time_cell = self.time_cell or tolerance
        fits = [o for o in self._near(c, t, tolerance) if self._fits(o, c, t, band, tolerance)]
        fit = (c, t, float(row.up_match), float(row.down_match))
        score = min(row.up_match, row.down_match)
        if len(fits) != 1:
            o = Observation(fit, score, {band}, [c, c], [t, t], len(fits) > 1)
            self.known.append(o)
            self.cells.setdefault(self._cell(o), []).append(o)
            return []
        o = fits[0]
        was = self._cell(o)
        o.subbands.add(band)
        o.centers = [min(*o.centers, c), max(*o.centers, c)]
        o.times = [min(*o.times, t), max(*o.times, t)]
        o.found += 1
        if (now := self._cell(o)) != was:
            self.cells[was].remove(o)
            self.cells.setdefault(now, []).append(o)
        if score > o.score:
            o.best, o.score = fit, score
        return []

    def close(self) -> list[tuple]:
        return [(*self.key, *o.best, len(o.subbands), o.found, o.ambiguous) for o in self.known]


def associate_findings(findings: DataFrame, chunk_samples: int = 1 << 30) -> DataFrame:
    """Associate per-subband findings into observations.

    Findings with one bandwidth and spreading factor are cut into pieces where
    the time since all earlier ones exceeds the tolerance, pieces into bands of
    centers that lie within the tolerance of each other, and bands again by time: so a
    part holds only nearly simultaneous findings of one place in the spectrum.
    """
    keys = ["session_id", "bandwidth_hz", "spreading_factor"]
    order = ["delimiter_sample", "seq"]
    rows = chunked(findings.withColumn("_s", F.floor("delimiter_sample")), "_s", chunk_samples)
    rows = running_max(rows, keys, order, {"reach": F.col("delimiter_sample")}, inclusive=False)
    tolerance = TOLERANCE_FACTOR * F.col("sample_rate") / F.col("bandwidth_hz")
    fresh = F.col("reach").isNull() | (F.col("delimiter_sample") - F.col("reach") > tolerance)
    rows = group_start(rows, keys, order, fresh, F.col("delimiter_sample"), "piece").drop(CHUNK, "reach")
    spread = TOLERANCE_FACTOR * F.col("bandwidth_hz") / F.pow(F.lit(2.0), F.col("spreading_factor"))
    rows = bands(rows.withColumn("_c", F.floor(F.col("center_hz") / spread)), GROUP[:4], "_c", "_c", 1, "band")
    rows = running_max(chunked(rows, "_s", chunk_samples), GROUP[:5], order, {"reach": F.col("delimiter_sample")}, inclusive=False)
    rows = group_start(rows, GROUP[:5], order, fresh, F.col("delimiter_sample"), "part").drop(CHUNK, "reach", "_s", "_c")
    schema = f"{typed(rows, GROUP[:3])}, {OBSERVATION_COLUMNS}"
    return walk_groups(rows, GROUP, ["seq"], _Associator, schema, [*GROUP[:3], *names_of(OBSERVATION_COLUMNS)])


def complete_in_range(waveforms: DataFrame, usable: DataFrame) -> DataFrame:
    """Whether the whole footprint lies in the session's usable range."""
    half = F.col("bandwidth_hz") / 2.0
    inside = (F.col("center_hz") - half >= F.col("usable_lower_hz")) & (
        F.col("center_hz") + half <= F.col("usable_upper_hz")
    )
    return waveforms.join(usable, "session_id").withColumn("complete_in_range", inside)


def latest_versions(waveforms: DataFrame) -> DataFrame:
    """Last version per id. An aggregate, not a sort: versions combine on the map side."""
    rest = [c for c in waveforms.columns if c not in ("session_id", "waveform_id")]
    newest = F.max_by(F.struct(*rest), "version").alias("w")
    return waveforms.groupBy("session_id", "waveform_id").agg(newest).select("session_id", "waveform_id", "w.*")


def profile_changes(waveforms: DataFrame) -> DataFrame:
    """Ids whose bandwidth or spreading factor changes between versions, for quarantine."""
    return (
        waveforms.groupBy("session_id", "waveform_id")
        .agg(
            F.min("bandwidth_hz").alias("b0"),
            F.max("bandwidth_hz").alias("b1"),
            F.min("spreading_factor").alias("s0"),
            F.max("spreading_factor").alias("s1"),
        )
        .where("b0 <> b1 or s0 <> s1")
        .select("session_id", "waveform_id")
    )


def ranked_versions(waveforms: DataFrame) -> DataFrame:
    """All versions with their rank, newest first."""
    order = Window.partitionBy("session_id", "waveform_id").orderBy(F.desc("version"))
    return waveforms.withColumn("rank", F.row_number().over(order))
