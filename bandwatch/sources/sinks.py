"""Sinks: CSV reports, archives, GeoJSON, metadata-only copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bandwatch.functions.power import round_half_away


def csv_safe(text: Column) -> Column:
    """Text a spreadsheet cannot take for a formula."""
    risky = text.rlike(r"^[\x00-\x20]*[=+\-@]") | text.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def csv_ready(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            csv_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, max_rows: int | None = None) -> None:
    """Write a report; with ``max_rows`` a longer one fails, it is never cut."""
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows to write")
    csv_ready(df).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def printable(text: Column) -> Column:
    """Printable ASCII: backslashes doubled, other bytes as \\xhh (UTF-8)."""
    octets = F.hex(F.encode(text, "UTF-8"))

    def render(h: Column) -> Column:
        def one(i: Column) -> Column:
            pair = F.substr(h, i * 2 + 1, F.lit(2))
            code = F.conv(pair, 16, 10).cast("int")
            return (
                F.when(code == 92, F.lit("\\\\"))
                .when((code >= 32) & (code < 127), F.char(code))
                .otherwise(F.concat(F.lit("\\x"), F.lower(pair)))
            )

        return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), one), "")

    from bandwatch.functions.binding import bound

    return F.when(F.length(text) == 0, F.lit("")).otherwise(bound(octets, render))


def private_positions(df: DataFrame, columns: list[str], include: bool, decimals: int) -> DataFrame:
    """Round coordinates where their export is enabled; drop them where it is not."""
    if not 0 <= decimals <= 7:
        raise ValueError("coordinate decimals must be 0 through 7")
    if not include:
        return df.drop(*columns)
    return df.withColumns({c: round_half_away(F.col(c), decimals) for c in columns})


def require_positions(include: bool) -> None:
    """Geographic and track reports refuse without the opt-in."""
    if not include:
        raise PermissionError("this report needs receiver positions to be enabled")


def archive(records: dict[str, DataFrame]) -> DataFrame:
    """One wide table of all record types; absent columns are NULL."""
    out = None
    for kind, df in records.items():
        typed = df.select(F.lit(kind).alias("record_type"), *df.columns)
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    return out


def write_archive(records: dict[str, DataFrame], path: str) -> None:
    """Archive partitioned by record type, so that one type is read without the others.

    Types are written one after the other: a row's folder is known, so rows are not sorted by it in
    memory or on disk. All have the columns of the whole archive.
    """
    whole = archive({kind: df.limit(0) for kind, df in records.items()}).drop("record_type").schema
    for kind, df in records.items():
        own = {f.name: f.dataType for f in df.schema.fields}
        wide = df.select(*[(F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole.fields])
        wide.write.option("compression", "zstd").parquet(f"{path}/record_type={kind}")


def geojson_features(df: DataFrame, latitude: str, longitude: str, properties: list[str], decimals: int) -> DataFrame:
    """One GeoJSON feature per row; rows without a position keep a null geometry."""
    lat, lon = (round_half_away(F.col(c), decimals) for c in (latitude, longitude))
    point = F.when(
        F.col(latitude).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    )
    feature = F.struct(
        F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")
    )
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features, written in parallel."""
    features.write.text(path)


def metadata_copy(tables: dict[str, DataFrame], allowed: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Each table rebuilt from its allow-list; every other column becomes NULL."""
    return {
        name: df.select(
            *[F.col(f.name) if f.name in allowed[name] else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        )
        for name, df in tables.items()
    }


def activity_runs(tiles: DataFrame) -> DataFrame:
    """Consecutive equal frames of a tile as (start, count, mask hex).

    Frames lie in the tile's row, so runs are found there without a shuffle.
    """
    from bandwatch.functions.binding import bound
    from bandwatch.functions.codecs import bitmap

    def runs(frames: Column) -> Column:
        numbered = F.transform(frames, lambda a, i: F.struct(i.alias("i"), a.alias("a")))
        starts = F.filter(numbered, lambda x: (x["i"] == 0) | (F.get(frames, x["i"] - 1) != x["a"]))

        def rows(begins: Column) -> Column:
            return F.transform(
                begins,
                lambda x, k: F.struct(
                    x["i"].alias("frame_start"),
                    (F.coalesce(F.get(begins, k + 1)["i"], F.size(frames)) - x["i"]).alias("frame_count"),
                    F.lower(F.hex(bitmap(F.array(x["a"]), F.col("bin_count")))).alias("mask_hex"),
                ),
            )

        return bound(starts, rows)

    return tiles.select("session_id", "tile_id", F.explode(bound(F.col("activity"), runs)).alias("r")).select(
        "session_id", "tile_id", "r.*"
    )


FIX_FIELDS = [
    "latitude", "longitude", "altitude_m", "manual", "utc_us", "monotonic_us", "source", "hdop", "satellites",
]


def deduplicated_fixes(fixes: DataFrame) -> DataFrame:
    """Identical fixes (all nine fields, NULL equal to NULL) once, under one id.

    The id is a hash of the fields, so writers agree on it without coordination.
    """
    return fixes.withColumn("fix_id", F.xxhash64(*FIX_FIELDS)).groupBy("session_id", *FIX_FIELDS, "fix_id").agg(
        F.count("*").alias("uses")
    )
