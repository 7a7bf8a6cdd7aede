"""Receiver places: metric cells, extents, projections, tracks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwatch.functions import flags
from bandwatch.functions.power import round_half_away
from bandwatch.operators.occupancy import ACQ, bin_edges, exposure, grid_columns, measures, per_bin
from bandwatch.operators.select import in_region, selected_tiles
from bandwatch.plans.query import SurveyQuery
from bandwatch.session import written_once

EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180
SLOT_DEGREES = 0.1


def metric_cell(latitude: Column, longitude: Column, metres: float) -> Column:
    """Cell of about ``metres`` x ``metres``: latitude bands, columns per band.

    NULL without a position. Longitude 180 folds to -180; rows and columns are
    clamped at the poles and at the date line.
    """
    step = metres / METRES_PER_DEGREE
    bands = math.ceil(180 / step)
    row = F.least(F.lit(bands - 1), F.greatest(F.lit(0), F.floor((latitude + 90) / step))).cast("bigint")
    south = -90 + row * F.lit(step)
    north = F.least(F.lit(90.0), south + step)
    around = 2 * math.pi * EARTH_RADIUS_M * F.cos((south + north) / 2 * (math.pi / 180))
    columns = F.greatest(F.lit(1), F.ceil(around / metres)).cast("bigint")
    folded = F.when(longitude == 180, F.lit(-180.0)).otherwise(longitude)
    column = F.least(columns - 1, F.greatest(F.lit(0), F.floor((folded + 180) / 360 * columns))).cast("bigint")
    cell = F.struct(
        row.alias("row"),
        column.alias("column"),
        south.alias("south"),
        north.alias("north"),
        (-180 + column * 360.0 / columns).alias("west"),
        (-180 + (column + 1) * 360.0 / columns).alias("east"),
    )
    return F.when(latitude.isNotNull(), cell)


def with_cells(tiles: DataFrame, metres: float) -> DataFrame:
    """Add the tile-end cell and whether the tile started in another cell."""
    end = metric_cell(F.col("fix_end.latitude"), F.col("fix_end.longitude"), metres)
    start = metric_cell(F.col("fix_start.latitude"), F.col("fix_start.longitude"), metres)
    apart = ~(
        F.col("_end.row").eqNullSafe(F.col("_start.row")) & F.col("_end.column").eqNullSafe(F.col("_start.column"))
    )
    return (
        tiles.withColumn("_end", end)
        .withColumn("_start", start)
        .withColumn("crossing", apart)
        .withColumn("cell_row", F.col("_end.row"))
        .withColumn("cell_column", F.col("_end.column"))
        .drop("_start", "_end")
    )


def cell_edges(df: DataFrame, metres: float, decimals: int | None = None) -> DataFrame:
    """Edges of the cell of a row; recomputed from the cell number, not carried along."""
    step = metres / METRES_PER_DEGREE
    south = -90 + F.col("cell_row") * F.lit(step)
    north = F.least(F.lit(90.0), south + step)
    around = 2 * math.pi * EARTH_RADIUS_M * F.cos((south + north) / 2 * (math.pi / 180))
    columns = F.greatest(F.lit(1), F.ceil(around / metres))
    west = -180 + F.col("cell_column") * 360.0 / columns
    east = -180 + (F.col("cell_column") + 1) * 360.0 / columns
    for name, value in (("south", south), ("north", north), ("west", west), ("east", east)):
        df = df.withColumn(f"cell_{name}", value if decimals is None else round_half_away(value, decimals))
    return df


def geographic_summary(
    tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery, metres: float, decimals: int | None = None
) -> DataFrame:
    """One row per acquisition, receiver cell and bin; the unlocated group is kept.

    Exposure is shared by a cell's bins, so it is summed per cell once. Acquisitions are written, so that
    Spark knows their size and moves them where they are small, not the tiles with their power arrays.
    """
    if not 10 <= metres <= 10_000:
        raise ValueError("cell size must be between 10 and 10000 metres")
    sel = with_cells(selected_tiles(tiles, written_once(acquisitions, "acquisitions"), q), metres)
    wide = F.col("quality").bitwiseAND(flags.POWER_AGGREGATED) != 0
    crossing_us = F.sum(F.when(F.col("crossing"), F.col("to_us") - F.col("from_us")).otherwise(0))
    keys = [*ACQ, "cell_row", "cell_column"]
    common = (
        exposure(
            sel,
            keys,
            q,
            [crossing_us.alias("crossing_us"), F.bool_or(wide).alias("_wide"), F.bool_or("crossing").alias("_cross"),
             *grid_columns()],
        )
        .withColumn(
            "quality",
            F.col("quality").bitwiseOR(flags.flag(F.col("_wide") | F.col("_cross"), flags.BOUNDARY)),
        )
        .drop("_wide", "_cross")
    )
    bins = per_bin(sel, keys)
    same = (
        (F.col("b.session_id") == F.col("c.session_id"))
        & (F.col("b.acq_id") == F.col("c.acq_id"))
        & F.col("b.cell_row").eqNullSafe(F.col("c.cell_row"))
        & F.col("b.cell_column").eqNullSafe(F.col("c.cell_column"))
    )
    joined = bins.alias("b").join(common.alias("c"), same)
    rows = joined.select(
        *[F.col(f"b.{k}") for k in [*keys, "bin", "power_us", "peak", "busy_us", "outside_busy_us"]],
        *[F.col(f"c.{c}") for c in common.columns if c not in keys],
    )
    rows = measures(bin_edges(rows), F.col("guarded")).withColumn("located", F.col("cell_row").isNotNull())
    return cell_edges(rows, metres, decimals)


def crossings(tiles: DataFrame, acquisitions: DataFrame, q: SurveyQuery, metres: float) -> DataFrame:
    """Per cell: exposure, and how much of it comes from tiles that crossed a cell edge."""
    sel = with_cells(selected_tiles(tiles, acquisitions, q), metres)
    d = F.col("to_us") - F.col("from_us")
    return sel.groupBy(*ACQ, "cell_row", "cell_column").agg(
        F.sum(d).alias("observed_us"), F.sum(F.when(F.col("crossing"), d).otherwise(0)).alias("crossing_us")
    )


# -- plot geometry --------------------------------------------------------------


def wrap_positive(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def wrap_signed(degrees: Column) -> Column:
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def extent(positions: DataFrame) -> DataFrame:
    """Per session: reference point and spread, date-line aware.

    The circle of longitudes is cut at its largest gap. Longitudes fall into
    3600 slots; the first and last of each slot give the gaps between slots.
    A gap inside a slot can only be the largest where no gap between slots
    exceeds a slot's width, so single longitudes are ordered only in sessions
    that fill the whole circle, slot by slot.
    """
    valid = positions.where("valid and latitude between -90 and 90 and longitude between -180 and 180")
    spans = valid.groupBy("session_id").agg(
        F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.count("*").alias("fixes")
    )
    lon = valid.select("session_id", wrap_positive(F.col("longitude")).alias("lon"))
    lon = lon.withColumn("slot", F.floor(F.col("lon") / SLOT_DEGREES))
    slots = lon.groupBy("session_id", "slot").agg(F.min("lon").alias("first"), F.max("lon").alias("last"))
    order, whole = Window.partitionBy("session_id").orderBy("slot"), Window.partitionBy("session_id")
    following = F.coalesce(F.lead("first").over(order), F.min("first").over(whole) + 360.0)
    gap = F.struct((following - F.col("last")).alias("gap"), (-following).alias("neg"))
    between = slots.select("session_id", gap.alias("g")).groupBy("session_id").agg(F.max("g").alias("g"))
    full = between.where(F.col("g.gap") <= SLOT_DEGREES).select("session_id")
    inner = Window.partitionBy("session_id", "slot").orderBy("lon")
    inside = (
        lon.join(full, "session_id", "left_semi")
        .distinct()
        .withColumn("next", F.lead("lon").over(inner))
        .where("next is not null")
        .select("session_id", F.struct((F.col("next") - F.col("lon")).alias("gap"), (-F.col("next")).alias("neg")).alias("g"))
    )
    cut = between.unionByName(inside).groupBy("session_id").agg(F.max("g").alias("g"))
    arc = F.greatest(F.lit(0.0), 360.0 - F.col("g.gap"))
    ref_lat = (F.col("south") + F.col("north")) / 2
    return (
        spans.join(cut, "session_id")
        .withColumn("arc_degrees", arc)
        .withColumn("reference_latitude", ref_lat)
        .withColumn(
            "reference_longitude", wrap_signed(wrap_positive(-F.col("g.neg")) + F.col("arc_degrees") / 2)
        )
        .withColumn(
            "east_west_m",
            F.col("arc_degrees") * F.cos(F.col("reference_latitude") * (math.pi / 180)) * METRES_PER_DEGREE,
        )
        .withColumn("north_south_m", (F.col("north") - F.col("south")) * METRES_PER_DEGREE)
        .drop("g")
    )


def mean_position(positions: DataFrame, extents: DataFrame) -> DataFrame:
    """Per session: mean reported position; longitudes averaged about the reference."""
    reference = extents.select("session_id", "reference_longitude")
    offset = wrap_signed(F.col("longitude") - F.col("reference_longitude"))
    return (
        positions.where("valid")
        .join(reference, "session_id")
        .groupBy("session_id", "reference_longitude")
        .agg(F.avg("latitude").alias("mean_latitude"), F.avg(offset).alias("_offset"))
        .select(
            "session_id",
            "mean_latitude",
            wrap_signed(F.col("reference_longitude") + F.col("_offset")).alias("mean_longitude"),
        )
    )


def projected(positions: DataFrame, extents: DataFrame) -> DataFrame:
    """Metres east and north of the session's reference point."""
    reference = extents.select("session_id", "reference_latitude", "reference_longitude")
    east = (
        wrap_signed(F.col("longitude") - F.col("reference_longitude"))
        * F.cos(F.col("reference_latitude") * (math.pi / 180))
        * METRES_PER_DEGREE
    )
    north = (F.col("latitude") - F.col("reference_latitude")) * METRES_PER_DEGREE
    return (
        positions.where("valid")
        .join(reference, "session_id")
        .select("session_id", "seq", east.alias("east_m"), north.alias("north_m"))
    )


def scale_length(width_m: Column) -> Column:
    """Largest 1, 2 or 5 x 10^n not above a quarter of the width."""
    quarter = width_m / 4
    decade = F.pow(F.lit(10.0), F.floor(F.log10(quarter)))
    lead = quarter / decade
    return F.when(lead >= 5, 5.0).when(lead >= 2, 2.0).otherwise(1.0) * decade


def receiver_track(positions: DataFrame, tiles: DataFrame, q: SurveyQuery) -> DataFrame:
    """Valid fixes on the session clock: fix UTC minus the first tile's UTC anchor."""
    anchor = tiles.groupBy("session_id").agg(
        F.min_by(F.col("utc_start_us") - F.col("start_us"), "tile_id").alias("anchor_us")
    )
    located = positions.where("valid").withColumn("fix", F.struct("latitude", "longitude"))
    return (
        located.join(anchor, "session_id")
        .withColumn("elapsed_us", F.col("utc_us") - F.col("anchor_us"))
        .where((F.col("elapsed_us") >= q.start_us) & (F.col("elapsed_us") < q.end_us) & in_region("fix", q))
        .drop("fix", "anchor_us")
    )
