"""The compact layout: tiles that refer to shared power blocks and to fixes by id.

Dictionary coding of the detailed layout: up to a second of contiguous tiles of one grid
share one power block, and equal fixes of a session are stored once. ``expand`` puts both
back with three left outer joins, so that every operator reads either layout; a tile
whose block or fix is missing stays, with nulls in its place and its reference kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwatch.functions import flags
from bandwatch.operators.ordered import CHUNK_US
from bandwatch.operators.sequences import block_keys, block_levels
from bandwatch.session import written_once

#: What a compact tile does not hold itself.
SHARED = ["mean_dbfs", "peak_dbfs", "power_start_us", "power_end_us", "fix_start", "fix_end"]
TIMES = ["first_sample", "end_sample", "start_us", "end_us", "utc_start_us", "utc_end_us"]
FIX_FIELDS = ["latitude", "longitude", "altitude_m", "manual", "utc_us", "monotonic_us", "source", "hdop", "satellites"]


def compact(tiles: DataFrame, max_us: int = 1_000_000, chunk_us: int = CHUNK_US) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(compact tiles, power blocks, fixes) of detailed tiles. A block has the id of its first tile."""
    grid = ["session_id", "acq_id", "tile_id", "first_center_hz", "bin_width_hz", "bin_count"]
    keyed = block_keys(tiles.select(*grid, F.col("start_us").alias("from_us"), F.col("end_us").alias("to_us")), max_us, chunk_us)
    members = keyed.select("session_id", "tile_id", "from_us", "block", F.min("tile_id").over(Window.partitionBy("session_id", "run_us", "block")).alias("power_id"))

    # A fix has the number of its first use: twice the tile, odd at its end.
    side = lambda c, i: F.struct(F.col(c).alias("fix"), (F.col("tile_id") * 2 + i).alias("use"))
    uses = tiles.select("session_id", "tile_id", F.explode(F.array(side("fix_start", 0), side("fix_end", 1))).alias("u")).select("session_id", "tile_id", "u.*").where("fix IS NOT NULL")
    fixes = written_once(uses.groupBy("session_id", "fix").agg(F.min("use").alias("fix_id")), "fixes")
    number = lambda odd: F.max(F.when(F.col("use") % 2 == odd, F.col("fix_id")))
    placed = uses.join(fixes, ["session_id", "fix"]).groupBy("session_id", "tile_id").agg(number(0).alias("start_fix"), number(1).alias("end_fix"))
    # All references of a tile in one narrow row: what is wide moves once, to meet them.
    refs = written_once(members.join(placed, ["session_id", "tile_id"], "left"), "references")
    lead = ["first_center_hz", "bin_width_hz", "fft_size", "bin_count"]
    extent = {c: (c, "min") for c in lead} | {c: (c, "max" if c.startswith("end") or "_end_" in c else "min") for c in TIMES} | {"frame_count": ("frame_count", "sum")}
    rows = tiles.select("session_id", "tile_id", *extent).join(refs.select("session_id", "tile_id", "block", "power_id"), ["session_id", "tile_id"])
    means = F.zip_with("power", "n", lambda power, n: 10 * F.log10(power / n)).alias("mean_dbfs")
    blocks = block_levels(tiles, refs, rows, extent, chunk_us).select("session_id", "power_id", *extent, means, F.col("peak").alias("peak_dbfs"))
    kept = [c for c in tiles.columns if c not in SHARED]
    rows = tiles.select(*kept).join(refs.drop("from_us", "block"), ["session_id", "tile_id"])
    return rows.select(*kept, "power_id", "start_fix", "end_fix"), blocks, fixes.select("session_id", "fix_id", "fix.*")


def expand(tiles: DataFrame, blocks: DataFrame, fixes: DataFrame) -> DataFrame:
    """Compact tiles in the columns of the detailed layout, flagged as aggregated power, with their references.

    An id names one block or fix. Since each is taken once by id, Spark leaves out the join whose columns are not read.
    """

    def once(rows: DataFrame, key: str, fields: list[str], name: str, out: str) -> DataFrame:
        taken = rows.groupBy("session_id", F.col(key).alias(name)).agg(*[F.first(c).alias(c) for c in fields])
        return taken.select("session_id", name, F.struct(*fields).alias(out))

    power = once(blocks, "power_id", ["start_us", "end_us", "mean_dbfs", "peak_dbfs"], "power_id", "_power")
    out = tiles
    for name in ("start_fix", "end_fix"):
        out = out.join(once(fixes, "fix_id", FIX_FIELDS, name, f"_{name}"), ["session_id", name], "left")
    out = out.join(power, ["session_id", "power_id"], "left")  # last: the arrays take part in no other join
    return out.select(
        *[c for c in tiles.columns if c not in ("power_id", "start_fix", "end_fix", "quality")],
        F.col("quality").bitwiseOR(F.lit(flags.POWER_AGGREGATED)).alias("quality"),
        F.col("_power.start_us").alias("power_start_us"), F.col("_power.end_us").alias("power_end_us"),
        F.col("_power.mean_dbfs").alias("mean_dbfs"), F.col("_power.peak_dbfs").alias("peak_dbfs"),
        F.col("_start_fix").alias("fix_start"), F.col("_end_fix").alias("fix_end"), "power_id", "start_fix", "end_fix",
    )


def orphans(references: dict[str, tuple[DataFrame, Column, DataFrame, Column]]) -> DataFrame:
    """(session_id, reference, key, uses): keys that rows refer to and that their target table lacks.

    ``references``: name -> (rows, key, target, its key). All references are checked in one
    shuffle: keys of both sides are tagged, counted in the tasks, and meet in one aggregation, so a
    key that a third of all rows hold costs one row per task.
    """
    tagged = None
    for name, (rows, key, target, own) in references.items():
        uses = rows.select("session_id", F.lit(name).alias("reference"), key.cast("string").alias("key"), F.lit(1).alias("use"), F.lit(0).alias("there"))
        keys = target.select("session_id", F.lit(name).alias("reference"), own.cast("string").alias("key"), F.lit(0).alias("use"), F.lit(1).alias("there"))
        both = uses.where("key IS NOT NULL").unionByName(keys)
        tagged = both if tagged is None else tagged.unionByName(both)
    counted = tagged.groupBy("session_id", "reference", "key").agg(F.sum("use").alias("uses"), F.max("there").alias("there"))
    return counted.where("there = 0 AND uses > 0").drop("there")


def dangling(tiles: DataFrame, blocks: DataFrame, fixes: DataFrame) -> DataFrame:
    """References of compact tiles to blocks and fixes that are not stored."""
    return orphans({
        "power_id": (tiles, F.col("power_id"), blocks, F.col("power_id")),
        "start_fix": (tiles, F.col("start_fix"), fixes, F.col("fix_id")),
        "end_fix": (tiles, F.col("end_fix"), fixes, F.col("fix_id")),
    })
