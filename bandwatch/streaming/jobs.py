"""Live operators: streams in, streaming DataFrames out.

The same row-local operators as in batch run on the stream; what needs order
or memory is a streaming aggregate or a keyed state machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from bandwatch.operators import bursts, events
from bandwatch.operators.frames import active_cells, time_in, with_frame_states
from bandwatch.operators.occupancy import split_buckets
from bandwatch.operators.select import selected_tiles
from bandwatch.plans.query import SurveyQuery
from bandwatch.session import shared_folder
from bandwatch.streaming import walkers
from bandwatch.streaming.stateful import walk_stream

#: Behind every time and sample: where a session's closing row stands.
LAST = 1 << 62


def append_sink(df: DataFrame, path: str, checkpoint: str, seconds: int | None = 1) -> StreamingQuery:
    """Append to parquet, about once a second, exactly once across restarts.

    With ``seconds=None`` all input that is there is taken, then the query ends.
    """
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    when = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} second"}
    return writer.outputMode("append").trigger(**when).start()


def update_sink(df: DataFrame, path: str, checkpoint: str, seconds: int | None = 1) -> StreamingQuery:
    """Keep every micro-batch's updated rows; the latest batch of a key holds its value."""

    def save(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch_id", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/part={batch}")

    when = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} second"}
    writer = df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.outputMode("update").trigger(**when).start()


def drained(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all input that is there, and read its result.

    ``keys`` marks an updating result: the latest row per key is kept. Late rows
    that a walker quarantined are left out; ``drained_parts`` has them.
    """
    return drained_parts(df, keys)[0]


def drained_parts(df: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The result of a drained stream and, for walkers, its quarantined rows (keys, ``late_row``)."""
    spark = df.sparkSession
    path, checkpoint = shared_folder(spark, "stream"), shared_folder(spark, "checkpoint")
    if keys is None:
        append_sink(df, path, checkpoint, None).awaitTermination()
        rows = spark.read.schema(df.schema).parquet(path)
        if "late_row" not in df.columns:
            return rows, None
        return rows.where("late_row is null").drop("late_row"), rows.where("late_row is not null").select(df.columns[0], "late_row")
    update_sink(df, path, checkpoint, None).awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("v")).select(*keys, "v.*"), None


def bin_totals(tiles: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Running totals per bin: busy time, active cells, observed time, energy and peak.

    Active cells and the levels of each tile meet as rows of one aggregation, so there is one
    state row for each bin of an acquisition: its number is bounded by the grids, not by time.
    """
    selected = selected_tiles(tiles, acquisitions, SurveyQuery())
    keys, no, zero = ["session_id", "acq_id", "bin"], F.lit(None).cast("double"), F.lit(0).cast("bigint")
    cells = active_cells(selected).select(
        *[F.col(k) if k != "bin" else F.col(k).cast("int").alias(k) for k in keys], (F.col("f1_us") - F.col("f0_us")).cast("bigint").alias("active_us"),
        F.lit(1).cast("bigint").alias("cells"), zero.alias("observed_us"), F.lit(0.0).alias("energy"), no.alias("peak_dbfs"),
    )
    length = F.col("to_us") - F.col("from_us")
    levels = selected.select("session_id", "acq_id", length.cast("bigint").alias("d"), F.posexplode(F.arrays_zip("mean_dbfs", "peak_dbfs")).alias("bin", "p"))
    levels = levels.select(
        *keys, zero.alias("active_us"), zero.alias("cells"), F.col("d").alias("observed_us"),
        (F.pow(F.lit(10.0), F.col("p.mean_dbfs") / 10) * F.col("d")).alias("energy"), F.col("p.peak_dbfs").alias("peak_dbfs"),
    )
    sums = [F.sum(c).alias(c) for c in ("active_us", "cells", "observed_us", "energy")]
    return cells.unionByName(levels).groupBy(*keys).agg(*sums, F.max("peak_dbfs").alias("peak_dbfs"))


def busy_tiles(tiles: DataFrame, acquisitions: DataFrame) -> DataFrame:
    whole = with_frame_states(selected_tiles(tiles, acquisitions, SurveyQuery()))
    return whole.select(
        "session_id", "acq_id", "tile_id", "start_us", "end_us", "utc_start_us", "from_us", "to_us",
        time_in("busy", F.col("from_us"), F.col("to_us")).alias("busy_us"),
    )


def with_ends(rows: DataFrame, ends: DataFrame | None, **order: Column) -> DataFrame:
    """``rows`` and a closing row for each of ``ends`` (a stream with session_id), behind all others."""
    if ends is None:
        return rows
    closing = ends.select("session_id", *[c.alias(n) for n, c in order.items()], F.lit(True).alias("closes"))
    return rows.withColumn("closes", F.lit(False)).unionByName(closing, allowMissingColumns=True)


def survey_windows(tiles: DataFrame, acquisitions: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Data-driven windows of at least five seconds of a session; its end gives out the last, shorter one."""
    return walk_stream(
        with_ends(busy_tiles(tiles, acquisitions), ends, start_us=F.lit(LAST)),
        {"session_id": "bigint"},
        "start_us",
        walkers.SurveyWindows,
        "window_start_us bigint, window_end_us bigint, observed_us bigint, busy_us bigint, tiles bigint",
    )


def aligned_windows(tiles: DataFrame, acquisitions: DataFrame, width: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """The clock-aligned variant: tumbling UTC windows with a watermark."""
    timed = busy_tiles(tiles, acquisitions).withColumn("ts", F.timestamp_micros("utc_start_us"))
    return (
        timed.withWatermark("ts", late)
        .groupBy("session_id", F.window("ts", width).alias("w"))
        .agg(
            F.sum(F.col("end_us") - F.col("start_us")).alias("observed_us"),
            F.sum("busy_us").alias("busy_us"),
            F.count("*").alias("tiles"),
        )
        .select("session_id", F.unix_micros("w.start").alias("window_start_us"), "observed_us", "busy_us", "tiles")
    )


def time_buckets(tiles: DataFrame, acquisitions: DataFrame, bucket_us: int) -> DataFrame:
    """Fixed elapsed-time buckets, live: tiles are split at the edges, then summed."""
    pieces = split_buckets(
        with_frame_states(selected_tiles(tiles, acquisitions, SurveyQuery())), F.lit(0), F.lit(bucket_us)
    )
    a, b = F.col("piece_start_us"), F.col("piece_end_us")
    return pieces.groupBy("session_id", "bucket").agg(
        F.sum(b - a).alias("observed_us"), F.sum(time_in("busy", a, b)).alias("busy_us")
    )


def sample_gaps(blocks: DataFrame, stall_ms: int | None = None) -> DataFrame:
    """Gaps in sample coordinates; with ``stall_ms`` also a gap when input stops."""
    return walk_stream(
        blocks.select("session_id", "first_sample", "n"),
        {"session_id": "bigint"},
        "first_sample",
        walkers.SampleGaps,
        "gap_first_sample bigint, missing_samples bigint, reason string",
        stall_ms,
    )


def live_bursts(tiles: DataFrame, acquisitions: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    rows = bursts.with_components(selected_tiles(tiles, acquisitions, SurveyQuery())).select(
        "session_id", "acq_id", "start_us", "end_us", "from_us", "to_us", "first_center_hz", "bin_width_hz", "bin_count",
        "frame_count", F.to_json("components").alias("components"),
    )
    return walk_stream(
        with_ends(rows, ends, from_us=F.lit(LAST)), {"session_id": "bigint"}, "from_us", walkers.LiveBursts, "center_region boolean, " + bursts.BURST_COLUMNS
    )


def live_events(frames: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    rows = events.frame_runs_or_quiet(frames)
    rows = with_ends(rows, ends, first_sample=F.lit(LAST))
    return walk_stream(rows, {"session_id": "bigint"}, "first_sample", walkers.LiveEvents, events.EVENT_COLUMNS)


def live_positions(facts: DataFrame, positions: DataFrame, tolerance_us: int = walkers.FIX_TOLERANCE_US) -> DataFrame:
    """Facts (``fact_id``, ``t_us``) with the fix known at their time.

    Both streams meet in one keyed state. Ties go to the fix: facts are ordered
    half a microsecond after fixes of the same time.
    """
    f = facts.select(
        "session_id", (F.col("t_us") * 2 + 1).alias("at"), F.lit(1).alias("kind"), "t_us", "fact_id",
        F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("boolean").alias("valid"),
        F.lit(None).cast("boolean").alias("manual"), F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"), F.lit(tolerance_us).cast("bigint").alias("tolerance_us"),
    )
    p = positions.select(
        "session_id", (F.col("monotonic_us") * 2).alias("at"), F.lit(0).alias("kind"), F.col("monotonic_us").alias("t_us"),
        F.lit(None).cast("bigint").alias("fact_id"), "seq", "valid", "manual", "latitude", "longitude",
        F.lit(tolerance_us).cast("bigint").alias("tolerance_us"),
    )
    return walk_stream(
        f.unionByName(p), {"session_id": "bigint"}, "at", walkers.LiveFix, "fact_id bigint, latitude double, longitude double"
    )


def ordered_or_late(tiles: DataFrame) -> DataFrame:
    """Tiles with a mark on those that arrive behind their session's state."""
    return walk_stream(
        tiles.select("session_id", "tile_id", "start_us", "end_us"),
        {"session_id": "bigint"},
        "start_us",
        walkers.OrderGuard,
        "tile_id bigint, start_us bigint, late boolean",
    )


def without_duplicates(rows: DataFrame, keys: list[str], utc_us: str, late: str = "10 seconds") -> DataFrame:
    """Suppress repeats of a key within the watermark; state does not grow without end."""
    timed = rows.withColumn("ts", F.timestamp_micros(utc_us)).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(keys).drop("ts")


def latest_readings(scans: DataFrame) -> DataFrame:
    """Latest scan per board and frequency."""
    from bandwatch.operators.rssi import THRESHOLD_DBM, fraction_above

    return scans.groupBy("session_id", "board", "frequency_hz").agg(
        F.max("scan_id").alias("scan_id"), F.max_by(fraction_above(THRESHOLD_DBM), "scan_id").alias("exceedance")
    )


def checkpoint_counters(tiles: DataFrame, gaps: DataFrame, every: str = "1 second", late: str = "5 seconds") -> DataFrame:
    """Input, measured and dropped per second of UTC: tiles are measured, gaps are input that was dropped."""
    length, zero = (F.col("end_us") - F.col("start_us")).cast("bigint"), F.lit(0).cast("bigint")
    lead = ["session_id", "utc_start_us"]
    measured = tiles.select(
        *lead, length.alias("input_us"), length.alias("measured_us"), zero.alias("dropped_samples"), F.col("clipped").cast("bigint").alias("clipped"),
        F.lit(1).cast("bigint").alias("tiles"),
    )
    dropped = gaps.select(
        *lead, length.alias("input_us"), zero.alias("measured_us"), F.col("missing_samples").cast("bigint").alias("dropped_samples"), zero.alias("clipped"), zero.alias("tiles")
    )
    timed = measured.unionByName(dropped).withColumn("ts", F.timestamp_micros("utc_start_us")).withWatermark("ts", late)
    counters = ["input_us", "measured_us", "dropped_samples", "clipped", "tiles"]
    counted = timed.groupBy("session_id", F.window("ts", every).alias("w")).agg(*[F.sum(c).alias(c) for c in counters])
    return counted.select("session_id", F.unix_micros("w.start").alias("second_us"), *counters)


PARTS = 16


def waveform_parts(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """The revision that holds each part of an upserted table, by the newest commit (before a batch)."""
    commits = f"{table}/commits"
    path = spark._jvm.org.apache.hadoop.fs.Path(commits)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    done = spark.read.schema("part int, revision bigint, batch bigint").parquet(commits)
    done = done if before is None else done.where(F.col("batch") < before)
    newest = done.where(F.col("batch") == done.agg(F.max("batch").alias("b")).scalar())
    return {r["part"]: r["revision"] for r in newest.collect()}  # at most PARTS rows


def read_waveforms(spark: SparkSession, table: str, schema: StructType, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """The committed rows of an upserted table, or of some of its parts."""
    held = waveform_parts(spark, table, before)
    paths = [f"{table}/data/revision={r}/part={p}" for p, r in held.items() if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_waveforms(waveforms: DataFrame, table: str, checkpoint: str, seconds: int | None = 1) -> StreamingQuery:
    """Keep the last version per waveform id in a parquet table.

    Rows are spread over parts by a hash of their id. A micro-batch rewrites the
    parts that it touches beside the old ones and then commits the list of
    current parts, so readers see whole batches only and a repeated batch does
    no harm. An id keeps the profile that is stored; of a new id the profile of
    its lowest version in the batch. Versions with another profile go to
    ``table/quarantine``.
    """
    from bandwatch.operators.waveforms import latest_versions

    ids = ["session_id", "waveform_id"]

    def merge(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.withColumn("part", F.pmod(F.xxhash64(*ids), F.lit(PARTS)).cast("int")).persist()
        touched = [r["part"] for r in rows.select("part").distinct().collect()]  # at most PARTS
        schema = waveforms.schema
        stored = read_waveforms(spark, table, schema, batch, touched)
        profile = F.struct("bandwidth_hz", "spreading_factor")
        kept = stored.select(*ids, profile.alias("_kept"))
        first = rows.groupBy(*ids).agg(F.min_by(profile, "version").alias("_first"))
        judged = rows.join(kept, ids, "left").join(first, ids).withColumn("_ok", profile == F.coalesce("_kept", "_first"))
        accepted, refused = judged.where("_ok").select(*schema.names), judged.where("not _ok").select(*schema.names)
        merged = latest_versions(stored.unionByName(accepted)).select(*schema.names)
        merged = merged.withColumn("part", F.pmod(F.xxhash64(*ids), F.lit(PARTS)).cast("int"))
        merged.write.mode("overwrite").partitionBy("part").parquet(f"{table}/data/revision={batch}")
        refused.write.mode("overwrite").parquet(f"{table}/quarantine/batch={batch}")
        current = waveform_parts(spark, table, batch) | {p: batch for p in touched}
        parts = spark.createDataFrame(list(current.items()), "part int, revision bigint")
        parts.coalesce(1).write.mode("overwrite").parquet(f"{table}/commits/batch={batch}")
        rows.unpersist()

    when = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} second"}
    return waveforms.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**when).start()
