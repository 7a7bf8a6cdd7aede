"""Data-quality rules: violations as rows of (rule, key), never exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwatch.functions import flags
from bandwatch.operators.ordered import CHUNK, CHUNK_US, chunked, with_previous
from bandwatch.operators.rssi import FILTER_HZ, samples
from bandwatch.operators.select import RSSI_HALF_FILTER_HZ

# Limits of valid records.
LEVEL_MIN, LEVEL_MAX = -300.0, 100.0
MEAN_OVER_PEAK = 0.011
UTC_SLACK_US = 2_000
MAX_HZ = 6_000_000_000
BANDWIDTHS = [15_625, 62_500, 125_000, 250_000, 500_000]
# Reasons that gap records carry.
GAP_REASONS = [
    "source_queue_full", "input_discontinuity", "input_too_large", "invalid_input_order",
    "invalid_sample_coordinate", "processing_failure",
]


def violations(df: DataFrame, table: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule. All rules are tested in one pass over the table.

    A rule that cannot be decided (NULL) counts as kept.
    """
    broken = F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]),
        lambda r: r.isNotNull(),
    )
    return df.select(
        "session_id", F.lit(table).alias("table_name"), key.cast("string").alias("key"), F.explode(broken).alias("rule")
    )


def interval_rules(ident: str) -> dict[str, Column]:
    length, utc = F.col("end_us") - F.col("start_us"), F.col("utc_end_us") - F.col("utc_start_us")
    return {
        "id not positive": F.col(ident) <= 0,
        "end not after start": (length <= 0) | (utc <= 0),
        "utc and elapsed lengths differ": F.abs(utc - length) > UTC_SLACK_US,
        "negative time": (F.col("start_us") < 0) | (F.col("utc_start_us") < 0),
    }


def _level(x: Column) -> Column:
    return (x < LEVEL_MIN) | (x > LEVEL_MAX) | F.isnan(x)


def fix_rules(fix: str) -> dict[str, Column]:
    c = F.col(fix)
    return {
        f"{fix} out of range": (F.abs(c["latitude"]) > 90) | (F.abs(c["longitude"]) > 180),
        f"{fix} satellites": c["satellites"] > 1000,
        f"{fix} times": (c["utc_us"] < 0) | (c["monotonic_us"] < 0),
        f"{fix} hdop": c["hdop"] < 0,
    }


def tile_violations(tiles: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Dimensions, timing against the rate, grid against the span, levels, activity range."""
    config = acquisitions.select("session_id", "acq_id", "center_hz", "sample_rate", "span_hz")
    t = tiles.join(config, ["session_id", "acq_id"])
    n = F.col("end_sample") - F.col("first_sample")
    width = F.col("sample_rate") / F.col("fft_size")
    low, high = F.col("first_center_hz") - width / 2, F.col("first_center_hz") + (F.col("bin_count") - 0.5) * width
    half = F.col("span_hz") / 2.0
    over = F.exists(F.zip_with("mean_dbfs", "peak_dbfs", lambda m, p: m > p + MEAN_OVER_PEAK), lambda bad: bad)
    beyond = F.exists("activity", lambda a: F.exists(a, lambda b: (b < 0) | (b >= F.col("bin_count"))))
    rules = {
        **interval_rules("tile_id"),
        "frame or bin count": ~F.col("frame_count").between(1, 128) | ~F.col("bin_count").between(1, 4096),
        "array sizes": (F.size("mean_dbfs") != F.col("bin_count"))
        | (F.size("peak_dbfs") != F.col("bin_count"))
        | (F.size("activity") != F.col("frame_count")),
        "sample count": n != F.col("frame_count") * F.col("fft_size"),
        "bin width": F.abs(F.col("bin_width_hz") - width) > 1e-7,
        "duration against rate": F.abs((F.col("end_us") - F.col("start_us")) - n * 1e6 / F.col("sample_rate")) > 1,
        "clipped above samples": F.col("clipped") > n,
        "unknown quality bits": F.col("quality") > 1023,
        "grid outside span": (low < F.col("center_hz") - half - 1e-5) | (high > F.col("center_hz") + half + 1e-5),
        "level out of range": _level(F.col("background_dbfs"))
        | F.exists("mean_dbfs", _level)
        | F.exists("peak_dbfs", _level),
        "mean above peak": over,
        "activity beyond bins": beyond,
        **fix_rules("fix_start"),
        **fix_rules("fix_end"),
    }
    return violations(t, "tiles", F.col("tile_id"), rules)


def power_block_violations(tiles: DataFrame) -> DataFrame:
    """Shared power must cover its tile and last at most a second."""
    rules = {
        "power does not cover tile": (F.col("power_start_us") > F.col("start_us"))
        | (F.col("power_end_us") < F.col("end_us")),
        "power longer than a second": F.col("power_end_us") - F.col("power_start_us") > 1_000_000,
    }
    return violations(tiles, "power", F.col("tile_id"), rules)


def gap_violations(gaps: DataFrame) -> DataFrame:
    rules = {
        **interval_rules("gap_id"),
        "reason": (F.length("reason") == 0) | (F.octet_length("reason") > 512),
        "negative samples": F.col("missing_samples") < 0,
    }
    return violations(gaps, "gaps", F.col("gap_id"), rules)


def event_violations(events: DataFrame) -> DataFrame:
    length = F.col("end_us") - F.col("start_us")
    rules = {
        **interval_rules("event_id"),
        "samples": F.col("end_sample") <= F.col("first_sample"),
        "band": F.col("upper_hz") <= F.col("lower_hz"),
        "active above length": (F.col("active_us") > length) | (F.col("active_us") < 0),
        "level out of range": _level(F.col("mean_dbfs")) | _level(F.col("peak_dbfs")),
        "mean above peak": F.col("mean_dbfs") > F.col("peak_dbfs") + MEAN_OVER_PEAK,
        "unknown quality bits": F.col("quality") > 511,
        **fix_rules("fix_end"),
    }
    return violations(events, "events", F.col("event_id"), rules)


def position_violations(positions: DataFrame) -> DataFrame:
    rules = {
        "coordinates": (F.abs("latitude") > 90) | (F.abs("longitude") > 180),
        "times": (F.col("utc_us") < 0) | (F.col("monotonic_us") < 0),
        "hdop": F.col("hdop") < 0,
        "satellites": F.col("satellites") > 1000,
        "source": F.octet_length("source") > 512,
    }
    return violations(positions, "positions", F.col("seq"), rules)


def reception_violations(receptions: DataFrame) -> DataFrame:
    evidence = F.col("evidence_port").isNotNull()
    possible, likely = F.lit(flags.KNOWN_CLASSIFICATIONS[1]), F.lit(flags.KNOWN_CLASSIFICATIONS[0])
    classified = F.col("status") == flags.STATUS_CLASSIFIED
    sound = F.col("crc_valid") & F.col("header_valid")
    eligible = classified | (
        (F.col("status") == flags.STATUS_UNSUPPORTED_PAYLOAD) & (F.col("classification") == possible)
    )
    rules = {
        "frequency": ~F.col("frequency_hz").between(1, MAX_HZ),
        "bandwidth": ~F.col("bandwidth_hz").between(1, 2_000_000),
        "spreading factor": ~F.col("spreading_factor").between(5, 12),
        "coding rate": ~F.col("coding_rate").between(5, 8),
        "lane label": F.octet_length("lane_label") > 160,
        "times": (F.col("utc_us") < 0) | (F.col("elapsed_us") < 0) | (F.col("duration_us") < 0),
        "status": ~F.col("status").between(0, len(flags.DECODE_STATUS) - 1),
        "classified without sound frame": classified & (~sound | (F.col("classification") != likely)),
        "evidence not eligible": evidence & (~sound | ~F.col("evidence_port").between(1, 65_535) | ~eligible),
        "possible without evidence": ~evidence & (F.col("classification") == possible),
    }
    return violations(receptions, "receptions", F.col("reception_id"), rules)


def bin_violations(bins: DataFrame) -> DataFrame:
    rules = {
        "center": ~F.col("center_hz").between(1, MAX_HZ),
        "width": ~F.col("width_hz").between(1, 20_000_000),
        "active above observed": F.col("active_us") > F.col("observed_us"),
        "negative time": (F.col("observed_us") < 0) | (F.col("active_us") < 0),
    }
    return violations(bins, "bins", F.col("center_hz").cast("bigint"), rules)


def duplicate_keys(df: DataFrame, table: str, keys: Sequence[str], key: Column) -> DataFrame:
    """Keys that occur more than once."""
    return (
        df.groupBy(*keys)
        .count()
        .where("count > 1")
        .select("session_id", F.lit(table).alias("table_name"), key.cast("string").alias("key"), F.lit("duplicate").alias("rule"))
    )


def waveform_violations(waveforms: DataFrame) -> DataFrame:
    def match(c: str) -> Column:
        return (F.col(c) <= 0) | (F.col(c) > 1.00001)

    rules = {
        "id": F.col("waveform_id") <= 0,
        "center": ~F.col("center_hz").between(1, MAX_HZ),
        "bandwidth": ~F.col("bandwidth_hz").isin(BANDWIDTHS),
        "spreading factor": ~F.col("spreading_factor").between(7, 12),
        "subbands": ~F.col("contributing_subbands").between(1, 128),
        "delimiter before preamble": F.col("delimiter_us") <= F.col("first_observed_us"),
        "match": match("up_match") | match("down_match"),
        **fix_rules("fix"),
    }
    return violations(waveforms, "waveforms", F.col("waveform_id"), rules)


def discovery_violations(bands: DataFrame, gaps: DataFrame) -> DataFrame:
    counters = ["processed_samples", "abandoned_samples", "gap_samples", "candidate_limit_hits", "track_limit_hits"]
    negative = F.lit(False)
    for c in counters:
        negative = negative | (F.col(c) < 0)
    band_rules = {"center": ~F.col("center_hz").between(1, MAX_HZ), "negative counter": negative}
    gap_rules = {
        "interval": F.col("end_input_sample") <= F.col("first_input_sample"),
        "subband": F.col("subband") < -1,
        "reason": ~F.col("reason").isin(GAP_REASONS),
    }
    return (
        violations(bands, "discovery_bands", F.col("subband"), band_rules)
        .unionByName(duplicate_keys(bands, "discovery_bands", ["session_id", "acq_id", "subband"], F.col("subband")))
        .unionByName(violations(gaps, "discovery_gaps", F.col("gap_id"), gap_rules))
    )


#: The methods a discovery status may name, and the longest fault text.
DISCOVERY_METHODS, FAULT_BYTES, MOST_BANDS = ["lora-preamble-v1", "lora-preamble-v2"], 160, 128


def discovery_status_violations(status: DataFrame, bands: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Rules of the status rows, bands beyond the limit, and statuses of no acquisition.

    Counters tell of different stages and units; they are checked one by one, never against a sum.
    """
    counters = [c for c in status.columns if c.endswith(("_samples", "_drops", "_resets", "_overflows")) or c == "observations"]
    negative = F.lit(False)
    for c in counters:
        negative = negative | F.col(c).isNull() | (F.col(c) < 0)
    rules = {
        "method": F.col("method").isNull() | ~F.col("method").isin(DISCOVERY_METHODS),
        "fault text": F.col("fault").isNull() | (F.octet_length("fault") > FAULT_BYTES) | F.col("fault").contains("\0"),
        "negative counter": negative,
        "failed without fault": F.col("failed") & (F.length("fault") == 0),
    }
    many = bands.groupBy("session_id", "acq_id").agg(F.count_distinct("subband").alias("n")).where(F.col("n") > MOST_BANDS)
    known = acquisitions.select("session_id", "acq_id").distinct()
    lost = status.join(known, ["session_id", "acq_id"], "left_anti")
    key = F.col("acq_id")
    return (
        violations(status, "discovery_status", key, rules)
        .unionByName(duplicate_keys(status, "discovery_status", ["session_id", "acq_id"], key))
        .unionByName(violations(many, "discovery_status", key, {"too many bands": F.lit(True)}))
        .unionByName(violations(lost, "discovery_status", key, {"no acquisition": F.lit(True)}))
    )


def scan_violations(
    scans: DataFrame, expected_samples: int, lower_hz: float, upper_hz: float, chunk_us: int = CHUNK_US
) -> DataFrame:
    """Histogram rules, and overlap of successive scans of one board."""
    edge = RSSI_HALF_FILTER_HZ
    rules = {
        **interval_rules("scan_id"),
        "bins": F.size("counts") != 33,
        "sample count": samples() != expected_samples,
        "longer than 5 s": F.col("end_us") - F.col("start_us") > 5_000_000,
        "filter": F.col("filter_hz") != FILTER_HZ,
        "outside span": (F.col("frequency_hz") - edge < lower_hz) | (F.col("frequency_hz") + edge > upper_hz),
        **fix_rules("fix"),
    }
    rows = chunked(scans.select("session_id", "board", "scan_id", "start_us", "end_us"), "start_us", chunk_us)
    seen = with_previous(rows, ["session_id", "board"], ["start_us", "scan_id"], F.struct("scan_id", "end_us"), "prev")
    order = {
        "overlaps previous scan": F.col("start_us") < F.col("prev.end_us"),
        "id not increasing": F.col("scan_id") <= F.col("prev.scan_id"),
    }
    return violations(scans, "scans", F.col("scan_id"), rules).unionByName(
        violations(seen.drop(CHUNK), "scans", F.col("scan_id"), order)
    )


def packet_violations(receptions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Packets whose frequency, bandwidth or spreading factor differs from their lane's profile.

    A profile without ``profile_frequency_hz`` takes any frequency.
    """
    if "profile_frequency_hz" not in profiles.columns:
        profiles = profiles.withColumn("profile_frequency_hz", F.lit(None).cast("bigint"))
    joined = receptions.join(profiles, ["session_id", "lane_label"], "left")
    rules = {
        "no profile": F.col("profile_bandwidth_hz").isNull(),
        "disagrees with profile": (F.col("bandwidth_hz") != F.col("profile_bandwidth_hz"))
        | (F.col("spreading_factor") != F.col("profile_spreading_factor"))
        | F.coalesce(F.col("frequency_hz") != F.col("profile_frequency_hz"), F.lit(False)),
    }
    return violations(joined, "packets", F.col("reception_id"), rules)


def acquisition_violations(acquisitions: DataFrame) -> DataFrame:
    """Ids dense from 1, finalized before the next begins, no overlap; few rows per session."""
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy("acq_id")
    a = acquisitions.withColumn("_n", F.row_number().over(order)).withColumn("_end", F.lag("end_us").over(order))
    a = a.withColumn("_next", F.lead("acq_id").over(order))
    rules = {
        "id not dense": F.col("acq_id") != F.col("_n"),
        "reversed interval": F.col("end_us") < F.col("start_us"),
        "overlaps previous": F.col("start_us") < F.col("_end"),
        "open before next": ~F.col("finalized") & F.col("_next").isNotNull(),
        "span above rate": F.col("span_hz") > F.col("sample_rate"),
        "threshold": ~F.col("threshold_dbfs").between(-140, 0),
    }
    return violations(a, "acquisitions", F.col("acq_id"), rules)


def order_and_grid_violations(tiles: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Tiles out of order or overlapping, and grid changes inside an acquisition."""
    narrow = tiles.select(
        "session_id", "acq_id", "tile_id", "first_sample", "end_sample", "start_us", "end_us", "first_center_hz",
        "bin_width_hz", "bin_count",
    )
    previous = F.struct("end_sample", "end_us", "acq_id", "first_center_hz", "bin_width_hz", "bin_count")
    seen = with_previous(chunked(narrow, "start_us", chunk_us), ["session_id"], ["start_us", "tile_id"], previous, "p")
    same = F.col("p.acq_id") == F.col("acq_id")
    rules = {
        "overlap or disorder": (F.col("first_sample") < F.col("p.end_sample")) | (F.col("start_us") < F.col("p.end_us")),
        "grid changes in acquisition": same
        & (
            (F.col("p.bin_count") != F.col("bin_count"))
            | (F.abs(F.col("p.first_center_hz") - F.col("first_center_hz")) > 1e-5)
            | (F.abs(F.col("p.bin_width_hz") - F.col("bin_width_hz")) > 1e-8)
        ),
    }
    return violations(seen, "tile_order", F.col("tile_id"), rules)


def decoder_violations(counters: DataFrame) -> DataFrame:
    rules = {
        "started above candidates": F.col("started") > F.col("candidates"),
        "crc valid above completed": F.col("crc_valid") > F.col("completed"),
        "classified above crc valid": F.col("classified") > F.col("crc_valid"),
    }
    return violations(counters, "decoder", F.col("lane_label"), rules)


def reconciliation(tiles: DataFrame, acquisitions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions whose frame time, tile time and saved measurement time disagree."""
    rates = acquisitions.select("session_id", "acq_id", "sample_rate")
    per = (
        tiles.select("session_id", "acq_id", "frame_count", "fft_size", "start_us", "end_us")
        .join(rates, ["session_id", "acq_id"])
        .groupBy("session_id")
        .agg(
            F.sum(F.col("frame_count") * F.col("fft_size") * 1e6 / F.col("sample_rate")).alias("frame_us"),
            F.sum(F.col("end_us") - F.col("start_us")).alias("tile_us"),
        )
        .join(sessions.select("session_id", "measurement_us"), "session_id")
    )
    rules = {
        "frames against tiles": F.abs(F.col("frame_us") - F.col("tile_us")) > 1,
        "tiles against session": F.col("tile_us") != F.col("measurement_us"),
    }
    return violations(per, "sessions", F.col("session_id"), rules)


def histogram_session_violations(sessions: DataFrame, tiles: DataFrame, packets: DataFrame, receptions: DataFrame) -> DataFrame:
    """Histogram-only sessions must have no spectrum rows, and as many packets as receptions."""
    only = sessions.where("source = 'histogram'").select("session_id")
    counts = [
        (tiles, "tiles"), (packets, "packets"), (receptions, "receptions"),
    ]
    joined = only
    for df, name in counts:
        joined = joined.join(df.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "left")
    joined = joined.fillna(0, ["tiles", "packets", "receptions"])
    rules = {
        "spectrum rows in histogram session": F.col("tiles") > 0,
        "packets against receptions": F.col("packets") != F.col("receptions"),
    }
    return violations(joined, "sessions", F.col("session_id"), rules)
