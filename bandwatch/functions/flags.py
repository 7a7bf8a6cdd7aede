"""Quality flags and other small enumerations (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quality bit-set, in bit order, with the names used in reports.
UNCALIBRATED = 1
UPSTREAM_LOSS_UNKNOWN = 2
CLIPPED = 4
POSITION_MISSING = 8
BOUNDARY = 16
TRUNCATED = 32
MERGED = 64
BACKGROUND_UNCERTAIN = 128
DC_SUSPECT = 256
POWER_AGGREGATED = 512

QUALITY_NAMES = [
    (UNCALIBRATED, "uncalibrated"),
    (UPSTREAM_LOSS_UNKNOWN, "upstream_loss_unknown"),
    (CLIPPED, "clipped"),
    (POSITION_MISSING, "position_missing"),
    (BOUNDARY, "measurement_boundary"),
    (TRUNCATED, "truncated"),
    (MERGED, "merged"),
    (BACKGROUND_UNCERTAIN, "background_uncertain"),
    (DC_SUSPECT, "possible_receiver_center_artifact"),
    (POWER_AGGREGATED, "power_time_aggregated"),
]

# Reception decode states, by code.
DECODE_STATUS = [
    "envelope validated",
    "bad phy CRC",
    "invalid frame",
    "no matching key",
    "decryption unvalidated",
    "unsupported payload",
    "ambiguous keys",
    "unsupported PKI",
    "invalid profile",
    "crypto error",
]
STATUS_CLASSIFIED = 0
STATUS_BAD_CRC = 1
STATUS_UNSUPPORTED_PAYLOAD = 5

# The labels a classification may keep; all else is unknown.
KNOWN_CLASSIFICATIONS = ["likely Meshtastic", "possible Meshtastic", "likely LoRaWAN"]
UNKNOWN_CLASSIFICATION = "unknown LoRa"


def quality_names(quality: Column) -> Column:
    """Set bits to ``;``-joined names, in bit order."""
    return F.concat_ws(
        ";", *[F.when(quality.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in QUALITY_NAMES]
    )


def flag(condition: Column, bit: int) -> Column:
    return F.when(condition, F.lit(bit)).otherwise(F.lit(0))


def decode_status_name(code: Column) -> Column:
    names = F.array(*[F.lit(n) for n in DECODE_STATUS])
    return F.when(code.between(0, len(DECODE_STATUS) - 1), F.get(names, code)).otherwise("invalid frame")


def canonical_classification(label: Column) -> Column:
    return F.when(label.isin(KNOWN_CLASSIFICATIONS), label).otherwise(UNKNOWN_CLASSIFICATION)
