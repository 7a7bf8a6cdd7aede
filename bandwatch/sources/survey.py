"""Survey tables as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwatch.sources.schemas import TABLES

RECEPTION_ALLOWED = [
    "session_id", "reception_id", "utc_us", "elapsed_us", "frequency_hz", "bandwidth_hz",
    "spreading_factor", "coding_rate", "duration_us", "snr_db", "frequency_error_hz", "header_valid",
    "crc_valid", "lane_label", "status", "classification", "evidence_port", "evidence_signature", "fix",
]


class Survey:
    """Tables of many sessions, one attribute per table in ``schemas.TABLES``.

    Reading is lazy and schema-checked; nothing is inferred. Lay ``tiles`` out
    partitioned by ``session_id`` and sorted by ``start_us``: file statistics
    then prune time selections, and the session filter prunes partitions.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")

    def compact_tiles_expanded(self) -> DataFrame:
        """The tiles of a compact archive in the columns of the detailed layout."""
        from bandwatch.operators.compact import expand

        return expand(self.compact_tiles, self.power_blocks, self.fixes)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def receptions_metadata(receptions: DataFrame) -> DataFrame:
    """Only allow-listed metadata columns leave a reception table."""
    return receptions.select(*RECEPTION_ALLOWED)


def scans_with_fix(scans: DataFrame, positions: DataFrame) -> DataFrame:
    """Scans left-joined to their referenced fix; a missing fix stays visible."""
    fixes = positions.select(
        "session_id", F.col("seq").alias("fix_seq"), "latitude", "longitude"
    )
    return scans.join(fixes, ["session_id", "fix_seq"], "left")


def file_snapshot(spark: SparkSession, path: str, schema: str, cutoff: str) -> DataFrame:
    """One consistent revision for several passes: files written up to ``cutoff``.

    Parquet files are immutable, so fixing the set of files by modification
    time fixes the rows; files added later are not seen by any pass.
    """
    return spark.read.schema(schema).option("modifiedBefore", cutoff).parquet(path)
