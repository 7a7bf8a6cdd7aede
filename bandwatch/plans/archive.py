"""The detailed archive and its map form: every record type under one privacy policy.

A registry lists the record types: where their rows come from, what identifies them, their
clock, and the fix that places them. The policy is applied in one place on the way out: it
blanks coordinates and the operator's own words unless they are asked for, leaves
out records that are nothing but a position, and rounds what it lets through. So no record
type can carry a position past it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwatch.functions.power import round_half_away
from bandwatch.operators.occupancy import frequency_summary
from bandwatch.plans.query import SurveyQuery
from bandwatch.sources.sinks import activity_runs, require_positions

#: Columns in the operator's own words.
PROVENANCE = ["title", "antenna", "receiver", "notes"]


@dataclass(frozen=True)
class ExportPolicy:
    """What may leave: positions (rounded to ``decimals``) and provenance only if asked for."""

    positions: bool = False
    provenance: bool = False
    decimals: int = 4

    def __post_init__(self) -> None:
        if not 0 <= self.decimals <= 7:
            raise ValueError("coordinate decimals must be 0 through 7")

    def coordinate(self, value: Column) -> Column:
        return round_half_away(value, self.decimals) if self.positions else F.lit(None).cast("double")

    def apply(self, rows: DataFrame) -> DataFrame:
        """Coordinates and provenance blanked or rounded, wherever they stand in a record."""
        out = []
        for f in rows.schema.fields:
            c = F.col(f"`{f.name}`")
            if f.name == "fix":
                out += [self.coordinate(c["latitude"]).alias("latitude"), self.coordinate(c["longitude"]).alias("longitude")]
                out.append((c["altitude_m"] if self.positions else F.lit(None).cast("double")).alias("altitude_m"))
            elif isinstance(f.dataType, T.StructType):
                continue  # no other structure leaves
            elif f.name in ("latitude", "longitude"):
                out.append(self.coordinate(c).alias(f.name))
            elif f.name in PROVENANCE and not self.provenance or f.name == "altitude_m" and not self.positions:
                out.append(F.lit(None).cast(f.dataType).alias(f.name))
            else:
                out.append(c)
        return rows.select(*out)


@dataclass(frozen=True)
class Record:
    """A record type: its rows, the columns that make its id, its clock, its fix."""

    rows: Callable[[object], DataFrame]
    ident: list[str]
    clock: str | None = None
    fix: str | None = None
    #: Nothing but a position: left out unless positions are asked for.
    position_only: bool = False


def whole_summary(survey) -> DataFrame:
    return frequency_summary(survey.tiles, survey.acquisitions, SurveyQuery())


def side(table: str, ident: str) -> Callable[[object], DataFrame]:
    """Where something started: a record of its own, since a record has one place."""
    return lambda s: getattr(s, table).where("fix_start IS NOT NULL").select("session_id", ident, "start_us", "fix_start")


REGISTRY: dict[str, Record] = {
    "session": Record(lambda s: s.sessions, []),
    "acquisition_segment": Record(lambda s: s.acquisitions, ["acq_id"], "start_us"),
    "spectrum_bin": Record(whole_summary, ["acq_id", "bin"]),
    "spectrum_tile": Record(lambda s: s.tiles.drop("activity").withColumnsRenamed({"mean_dbfs": "bin_mean_dbfs", "peak_dbfs": "bin_peak_dbfs"}), ["tile_id"], "start_us", "fix_end"),
    "spectrum_tile_start_position": Record(side("tiles", "tile_id"), ["tile_id"], "start_us", "fix_start", True),
    "spectrum_activity_run": Record(lambda s: activity_runs(s.tiles), ["tile_id", "frame_start"]),
    "spectrum_event": Record(lambda s: s.events_energy, ["event_id"], "start_us", "fix_end"),
    "spectrum_event_start_position": Record(side("events_energy", "event_id"), ["event_id"], "start_us", "fix_start", True),
    "coverage_gap": Record(lambda s: s.coverage_gaps, ["gap_id"], "start_us"),
    "coverage_checkpoint": Record(lambda s: s.checkpoints, ["at_us"], "at_us"),
    "reception": Record(lambda s: s.receptions, ["reception_id"], "elapsed_us", "fix"),
    "waveform_observation": Record(lambda s: s.waveforms, ["waveform_id", "version"], "delimiter_us", "fix"),
    "discovery_status": Record(lambda s: s.discovery_status, ["acq_id"]),
    "discovery_band": Record(lambda s: s.discovery_bands, ["acq_id", "subband"]),
    "discovery_gap": Record(lambda s: s.discovery_gaps, ["gap_id"]),
    "lane_status": Record(lambda s: s.lane_status, ["lane_label", "at_us"], "at_us"),
    "automatic_decoder": Record(lambda s: s.decoder_status, ["acq_id"]),
    "rssi_scan": Record(lambda s: s.rssi_scans.drop("counts"), ["scan_id"], "start_us", "fix"),
    "rssi_histogram": Record(
        lambda s: s.rssi_scans.select("session_id", "scan_id", "start_us", F.posexplode("counts").alias("histogram_bin", "samples")), ["scan_id", "histogram_bin"], "start_us"
    ),
    "receiver_position": Record(lambda s: s.positions, ["seq"], "monotonic_us", None, True),
}


def records(survey, policy: ExportPolicy, types: list[str] | None = None) -> dict[str, DataFrame]:
    """The rows of each record type under the policy, with ``record_id`` and ``elapsed_us``. Tables that a survey lacks give none."""
    out = {}
    for kind in types or REGISTRY:
        r = REGISTRY[kind]
        if r.position_only and not policy.positions:
            continue
        try:
            rows = r.rows(survey)
        except AttributeError:
            continue
        ident = F.concat_ws("/", *[F.col(c).cast("string") for c in r.ident]) if r.ident else F.lit("")
        clock = F.col(r.clock).cast("bigint") if r.clock else F.lit(None).cast("bigint")
        rows = rows.withColumn("record_id", ident).withColumn("elapsed_us", clock)
        if r.fix and r.fix != "fix":
            rows = rows.withColumn("fix", F.col(r.fix))
        out[kind] = policy.apply(rows)
    return out


def feature_rows(survey, policy: ExportPolicy, types: list[str]) -> DataFrame:
    """GeoJSON features of records; those without a place (discovery, histograms) keep a null geometry. Refuses without the opt-in."""
    require_positions(policy.positions)
    out = None
    for kind, rows in records(survey, policy, types).items():
        placed = "latitude" in rows.columns
        point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")) if placed else None
        geometry = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), point) if placed else F.lit(None).cast("struct<type:string,coordinates:array<double>>")
        rest = [c for c in rows.columns if c not in ("latitude", "longitude")]
        feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.lit(kind).alias("record_type"), *rest).alias("properties"))
        features = rows.select(F.lit(kind).alias("record_type"), "session_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))
        out = features if out is None else out.unionByName(features)
    return out
