"""Survey tables derived from the driver's star-schema tables.

Each property builds one survey table with plain expressions over the given
parquet files, so its size follows theirs. The same formulas are written in SQL
in ``bandwatch.catalog.prelude``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILES_PER_SESSION = 2500
TILES_PER_ACQ = 1250
TILE_US = 20_000
FRAME_US = 5_000
FRAMES = 4
BINS = 64
WIDTH_HZ = 200.0
RATE = 12_800
FFT = 64
CENTER_HZ = 906_875_000
ACQ_SHIFT_HZ = 12_800
UTC_US = 1_704_067_200_000_000
SESSION_US = 100_000_000
THRESHOLD = 0.3
#: Rows of a driver table that one task makes wide rows of.
ROWS_PER_TASK = 50_000


def _fix(lat: Column, lon: Column, t_us: Column, utc_us: Column, user: Column, k: Column) -> Column:
    return F.struct(
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.when(k % 5 != 0, 100.0 + k).alias("altitude_m"),
        (user % 50 == 0).alias("manual"),
        utc_us.alias("utc_us"),
        t_us.alias("monotonic_us"),
        F.lit("NMEA RMC; GNSS UTC").alias("source"),
        F.when(k % 7 != 0, 1.0 + k % 10 / 10.0).alias("hdop"),
        (4 + k % 9).cast("int").alias("satellites"),
    )


class Testbed:
    __test__ = False  # not a test class

    def __init__(self, spark: SparkSession, sf_dir: str, streams: dict[str, str] | None = None, batch_files: int = 1):
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times carry no zone
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.streams = streams or {}
        self.batch_files = batch_files

    def raw(self, name: str) -> DataFrame:
        """A driver table; those in ``streams`` as a stream of the files of a folder, ``batch_files`` a micro-batch."""
        static = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in self.streams:
            return static
        return self.spark.readStream.schema(static.schema).option("maxFilesPerTrigger", self.batch_files).parquet(self.streams[name])

    def tasks_for(self, name: str) -> int:
        """Tasks that share a table: as many as there are cores, more where a task would have over ``ROWS_PER_TASK`` rows."""
        rows = self.raw(name).count()  # answered from the file footers
        return max(self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))

    def spread(self, name: str) -> DataFrame:
        """A table over ``tasks_for`` tasks, so that a task's rows do not grow with it; one read by as many stays as it is read."""
        df = self.raw(name)
        if df.isStreaming or df.rdd.getNumPartitions() >= (tasks := self.tasks_for(name)):
            return df
        return df.repartition(tasks)

    # -- spectrum -----------------------------------------------------------

    @cached_property
    def _events(self) -> DataFrame:
        return self._described(self.spread("events"))

    def _described(self, events: DataFrame) -> DataFrame:
        j = F.col("event_id") % TILES_PER_SESSION
        utc = UTC_US + F.col("session_id") * SESSION_US
        return (
            events.select(
                "event_id",
                F.expr(f"event_id div {TILES_PER_SESSION}").alias("session_id"),
                j.alias("j"),
                "user_id",
                "event_type",
                "value",
                F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
            )
            .withColumn("acq_id", F.expr(f"j div {TILES_PER_ACQ}") + 1)
            .withColumn("start_us", F.col("j") * TILE_US)
            .withColumn("end_us", F.col("j") * TILE_US + TILE_US)
            .withColumn("utc_start_us", utc + F.col("start_us"))
            .withColumn("utc_end_us", utc + F.col("end_us"))
        )

    @cached_property
    def _vectors(self) -> DataFrame:
        v = F.transform("embedding", lambda x: x.cast("double"))

        def active(shift: int) -> Column:
            bins = F.transform(
                F.col("v"), lambda x, i: F.when(x >= THRESHOLD, F.pmod(i - F.lit(shift), F.lit(BINS)).cast("int"))
            )
            return F.array_sort(F.filter(bins, lambda b: b.isNotNull()))

        return (
            self.raw("embeddings")
            .select("vec_id", v.alias("v"))
            .select(
                "vec_id",
                F.transform("v", lambda x: -80.0 + 60.0 * x).alias("mean_dbfs"),
                F.transform("v", lambda x: -70.0 + 60.0 * x).alias("peak_dbfs"),
                (-80.0 + 60.0 * F.get(F.array_sort("v"), F.lit((BINS - 1) // 5))).alias("background_dbfs"),
                active(0).alias("_even"),
                active(16).alias("_odd"),
            )
            .withColumn("activity", F.array("_even", "_even", "_odd", "_odd"))
            .drop("_even", "_odd")
        )

    @cached_property
    def tiles(self) -> DataFrame:
        return self._tiles(self._events)

    def tiles_by_chunk(self, chunk_us: int) -> DataFrame:
        """The tiles, those of a session's time chunk in one task: events move before they get arrays, so that what groups
        tiles by session and ``ordered.chunked`` need not move the arrays. Twice the tasks of ``spread``, as chunks are dealt by hash."""
        events = self._described(self.raw("events"))
        if events.isStreaming:
            return self.tiles
        return self._tiles(events.repartition(2 * self.tasks_for("events"), "session_id", F.expr(f"start_us div {chunk_us}L")))

    def _tiles(self, events: DataFrame) -> DataFrame:
        e = events.where("event_type <> 'error'")
        count = self.raw("embeddings").count()  # answered from the file footers
        lat, lon = 40.0 + F.col("user_id") / 1e4, -75.0 + F.col("k") / 1e4
        reported = (F.col("event_type") == "view") | ((F.col("event_type") == "click") & (F.col("value") >= 10))
        end_fix = F.when(
            reported, _fix(lat, lon, F.col("end_us"), F.col("utc_end_us"), F.col("user_id"), F.col("k"))
        )
        start_fix = F.when(
            (reported & (F.col("user_id") % 5 != 0)) | (F.col("event_type") == "purchase"),
            _fix(
                lat,
                lon - (F.col("k") % 3) / 1e4,
                F.col("start_us"),
                F.col("utc_start_us"),
                F.col("user_id"),
                F.col("k"),
            ),
        )
        clipped = F.when(F.col("event_type") == "purchase", 3).otherwise(0)
        return (
            e.withColumn("vec_id", F.col("event_id") % count)
            .join(self._vectors, "vec_id")
            .select(
                "session_id",
                "acq_id",
                (F.col("j") + 1).alias("tile_id"),
                (F.col("j") * FRAMES * FFT).alias("first_sample"),
                (F.col("j") * FRAMES * FFT + FRAMES * FFT).alias("end_sample"),
                "start_us",
                "end_us",
                "utc_start_us",
                "utc_end_us",
                F.col("start_us").alias("power_start_us"),
                F.col("end_us").alias("power_end_us"),
                (CENTER_HZ + (F.col("acq_id") - 1) * ACQ_SHIFT_HZ - BINS // 2 * WIDTH_HZ).alias("first_center_hz"),
                F.lit(WIDTH_HZ).alias("bin_width_hz"),
                F.lit(FFT).alias("fft_size"),
                F.lit(FRAMES).alias("frame_count"),
                F.lit(BINS).alias("bin_count"),
                "background_dbfs",
                clipped.cast("bigint").alias("clipped"),
                F.when(F.col("event_type") == "purchase", 133).otherwise(129).alias("quality"),
                "mean_dbfs",
                "peak_dbfs",
                "activity",
                start_fix.alias("fix_start"),
                end_fix.alias("fix_end"),
            )
        )

    @cached_property
    def acquisitions(self) -> DataFrame:
        return (
            self._events.groupBy("session_id", "acq_id")
            .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
            .select(
                "session_id",
                "acq_id",
                "start_us",
                "end_us",
                F.lit(True).alias("finalized"),
                (CENTER_HZ + (F.col("acq_id") - 1) * ACQ_SHIFT_HZ).alias("center_hz"),
                F.lit(RATE).cast("bigint").alias("sample_rate"),
                F.lit(RATE).cast("bigint").alias("span_hz"),
                F.lit(-62.0).alias("threshold_dbfs"),
                (F.col("session_id") % 5 * 100).alias("offset_hz"),
                F.lit(16).alias("lna"),
                F.lit(20).alias("vga"),
                F.lit(False).alias("amp"),
                F.lit(None).cast("double").alias("rtl_gain_db"),
                F.lit(None).cast("boolean").alias("rtl_auto"),
            )
        )

    @cached_property
    def coverage_gaps(self) -> DataFrame:
        return self._events.where("event_type = 'error'").select(
            "session_id",
            (F.col("j") + 1).alias("gap_id"),
            F.lit(FRAMES * FFT).cast("bigint").alias("missing_samples"),
            "utc_start_us",
            "utc_end_us",
            "start_us",
            "end_us",
            F.lit("application_drop").alias("reason"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        e = self._events
        return e.groupBy("session_id").agg(
            F.when(F.col("session_id") % 2 == 0, "synthetic").otherwise("receiver").alias("source"),
            F.concat(F.lit("survey "), F.col("session_id").cast("string")).alias("title"),
            F.lit(True).alias("complete"),
            F.max("end_us").alias("elapsed_us"),
            (F.count("*") * TILE_US).alias("input_us"),
            (F.count_if(F.col("event_type") != "error") * TILE_US).alias("measurement_us"),
            (F.count_if(F.col("event_type") != "error") * FRAMES * FFT).alias("delivered"),
            (F.count_if(F.col("event_type") == "error") * FRAMES * FFT).alias("dropped"),
        )

    @cached_property
    def positions(self) -> DataFrame:
        e = self._events.where("event_type in ('view','click')")
        fix = _fix(
            40.0 + F.col("user_id") / 1e4,
            -75.0 + F.col("k") / 1e4,
            F.col("start_us"),
            F.col("utc_start_us"),
            F.col("user_id"),
            F.col("k"),
        )
        return e.select(
            "session_id",
            F.col("event_id").alias("seq"),
            (~((F.col("event_type") == "click") & (F.col("value") < 10))).alias("valid"),
            fix.alias("fix"),
        ).select("session_id", "seq", "fix.*", "valid")

    @cached_property
    def events_energy(self) -> DataFrame:
        """One energy event per order: an interval and a band."""
        o = self.raw("orders")
        start = F.col("o_orderkey") % 5000 * 10_000
        length = 2_000 + F.col("o_custkey") % 40 * 1_000
        low = CENTER_HZ - 6_500.0 + F.col("o_custkey") % 100 * WIDTH_HZ
        user = F.col("o_custkey")
        t = o.select(
            F.expr("o_orderkey div 5000").alias("session_id"),
            (F.col("o_orderkey") % 5000 + 1).alias("event_id"),
            start.alias("start_us"),
            (start + length).alias("end_us"),
            low.alias("lower_hz"),
            (low + (1 + F.col("o_orderkey") % 12) * WIDTH_HZ).alias("upper_hz"),
            (length - F.col("o_orderkey") % 3 * 500).alias("active_us"),
            (-90.0 + F.col("o_totalprice") / 10_000).alias("mean_dbfs"),
            (-85.0 + F.col("o_totalprice") / 10_000).alias("peak_dbfs"),
            (129 + F.when(F.col("o_orderstatus") == "P", 64).otherwise(0)
             + F.when(F.col("o_orderkey") % 7 == 0, 16).otherwise(0)).alias("quality"),
            F.when(F.col("o_orderkey") % 4 != 0, 40.0 + user % 150 / 1e4).alias("latitude"),
            F.when(F.col("o_orderkey") % 4 != 0, -75.0 + user % 100 / 1e4).alias("longitude"),
        )
        utc = UTC_US + F.col("session_id") * SESSION_US
        fix = F.when(
            F.col("latitude").isNotNull(),
            _fix(F.col("latitude"), F.col("longitude"), F.col("end_us"), utc + F.col("end_us"),
                 F.col("event_id"), F.col("event_id")),
        )
        return t.select(
            "session_id",
            "event_id",
            F.expr(f"start_us * {RATE} div 1000000").alias("first_sample"),
            F.expr(f"end_us * {RATE} div 1000000").alias("end_sample"),
            "start_us",
            "end_us",
            (utc + F.col("start_us")).alias("utc_start_us"),
            (utc + F.col("end_us")).alias("utc_end_us"),
            "lower_hz",
            "upper_hz",
            "active_us",
            "mean_dbfs",
            "peak_dbfs",
            "quality",
            F.lit(None).cast(fix_type()).alias("fix_start"),
            fix.alias("fix_end"),
        )

    # -- waveforms, receptions, histograms -----------------------------------

    @cached_property
    def _orders(self) -> DataFrame:
        o = self.spread("orders")
        priority = F.substring("o_orderpriority", 1, 1)
        t = F.col("o_orderkey") % 5000 * 10_000
        return o.select(
            "o_orderkey",
            F.expr("o_orderkey div 5000").alias("session_id"),
            t.alias("t_us"),
            (906_000_000 + F.col("o_custkey") % 20 * 100_000).alias("center_hz"),
            F.when(priority == "1", 125_000)
            .when(priority == "3", 500_000)
            .when(priority == "5", 62_500)
            .otherwise(250_000)
            .alias("bandwidth_hz"),
            (7 + F.col("o_orderkey") % 6).cast("int").alias("spreading_factor"),
            "o_orderstatus",
            "o_totalprice",
            "o_custkey",
            F.when(
                F.col("o_orderkey") % 3 != 0,
                _fix(
                    40.0 + F.col("o_custkey") % 150 / 1e4,
                    -75.0 + F.col("o_custkey") % 100 / 1e4,
                    t,
                    UTC_US + F.expr("o_orderkey div 5000") * SESSION_US + t,
                    F.col("o_custkey"),
                    F.col("o_custkey"),
                ),
            ).alias("fix"),
        )

    @cached_property
    def waveforms(self) -> DataFrame:
        match = F.col("o_totalprice") / 500_000.0
        return self._orders.select(
            "session_id",
            F.expr("o_orderkey % 5000 div 2 + 1").alias("waveform_id"),
            (F.col("o_orderkey") % 2).alias("version"),
            F.col("center_hz").cast("double").alias("center_hz"),
            "bandwidth_hz",
            "spreading_factor",
            F.greatest(F.lit(0), F.col("t_us") - 8_000).alias("first_observed_us"),
            (F.col("t_us") + 1_000).alias("delimiter_us"),
            (UTC_US + F.col("session_id") * SESSION_US + F.col("t_us") + 1_000).alias("delimiter_utc_us"),
            match.alias("up_match"),
            F.greatest(F.lit(0.01), match - 0.05).alias("down_match"),
            (1 + F.col("o_custkey") % 4).cast("int").alias("contributing_subbands"),
            (F.col("o_custkey") % 3 != 0).alias("complete_in_range"),
            (F.col("o_custkey") % 11 == 0).alias("ambiguous"),
            "fix",
        )

    @cached_property
    def receptions(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", 0)
            .when(F.col("o_orderstatus") == "O", 1)
            .otherwise(2 + F.col("o_orderkey") % 4)
        )
        return self._orders.select(
            "session_id",
            (F.col("o_orderkey") % 5000 + 1).alias("reception_id"),
            (UTC_US + F.col("session_id") * SESSION_US + F.col("t_us")).alias("utc_us"),
            F.col("t_us").alias("elapsed_us"),
            F.col("center_hz").cast("bigint").alias("frequency_hz"),
            "bandwidth_hz",
            "spreading_factor",
            (5 + F.col("o_orderkey") % 4).cast("int").alias("coding_rate"),
            (20_000 + F.col("o_custkey") % 50 * 1_000).alias("duration_us"),
            (F.col("o_totalprice") / 25_000.0 - 10.0).alias("snr_db"),
            (F.col("o_custkey") % 200 - 100.0).alias("frequency_error_hz"),
            (F.col("o_orderstatus") != "O").alias("header_valid"),
            (F.col("o_orderstatus") != "O").alias("crc_valid"),
            F.concat(F.lit("lane "), (F.col("o_custkey") % 4).cast("string")).alias("lane_label"),
            status.cast("int").alias("status"),
            F.when(F.col("o_orderstatus") == "F", "likely Meshtastic")
            .when(status == 5, "possible Meshtastic")
            .otherwise("unknown LoRa")
            .alias("classification"),
            F.when((F.col("o_orderstatus") == "F") | (status == 5), (1 + F.col("o_custkey") % 70).cast("int")).alias(
                "evidence_port"
            ),
            F.when((F.col("o_orderstatus") == "F") | (status == 5), F.col("o_custkey") % 2 == 0).alias(
                "evidence_signature"
            ),
            "fix",
        )

    @cached_property
    def rssi_scans(self) -> DataFrame:
        line = self.raw("lineitem").select(
            "l_orderkey", F.least(F.lit(32), F.floor(F.col("l_quantity") * 33 / 51)).cast("int").alias("b")
        )
        # Two narrow columns move, not 33 counts, into tasks that do not grow: each row becomes 33 in an archive.
        line = line.repartition(self.tasks_for("lineitem"), "l_orderkey")
        counts = [F.count_if(F.col("b") == i).alias(f"c{i}") for i in range(33)]
        key = F.col("l_orderkey")
        start = key % 5000 * 50_000
        utc = UTC_US + F.expr("l_orderkey div 5000") * SESSION_US
        fix = F.when(
            key % 5 != 0,
            _fix(40.0 + key % 100 / 1e3, -75.0 + key % 37 / 1e3, start + 40_000, utc + start + 40_000, key, key),
        )
        return (
            line.groupBy("l_orderkey")
            .agg(*counts)
            .select(
                F.expr("l_orderkey div 5000").alias("session_id"),
                (key % 5000 + 1).alias("scan_id"),
                (key % 2).cast("int").alias("board"),
                (902_400_000 + key % 100 * 200_000).alias("frequency_hz"),
                F.lit(234_300).alias("filter_hz"),
                F.lit(-11.0).alias("rssi_offset_db"),
                (utc + start).alias("utc_start_us"),
                (utc + start + 40_000).alias("utc_end_us"),
                start.alias("start_us"),
                (start + 40_000).alias("end_us"),
                F.array(*[F.col(f"c{i}") for i in range(33)]).alias("counts"),
                fix.alias("fix"),
            )
        )

    # -- sample blocks, sentences, discovery ----------------------------------

    @cached_property
    def iq_blocks(self) -> DataFrame:
        """Each vector is one block of 32 complex samples; every 50th block is missing."""
        return (
            self.raw("embeddings")
            .where("vec_id % 50 <> 49")
            .select(
                F.expr("vec_id div 250").alias("session_id"),
                (F.col("vec_id") % 250 * 32).alias("first_sample"),
                F.lit("complex").alias("encoding"),
                F.transform("embedding", lambda x: x.cast("double")).alias("iq"),
            )
        )

    @cached_property
    def nmea_sentences(self) -> DataFrame:
        from bandwatch.functions.nmea import checksum_hex, degrees_minutes

        p = self.positions
        seconds = F.expr("utc_us div 1000000")
        stamp = F.timestamp_seconds(seconds)
        lat, lon = degrees_minutes(F.col("latitude"), 2), degrees_minutes(F.abs("longitude"), 3)
        ns, ew = F.lit("N"), F.lit("W")
        hms, dmy = F.date_format(stamp, "HHmmss"), F.date_format(stamp, "ddMMyy")
        rmc = F.concat_ws(
            ",", F.lit("GPRMC"), hms, F.when(F.col("valid"), "A").otherwise("V"), lat, ns, lon, ew,
            F.lit("0.0"), F.lit("0.0"), dmy, F.lit(""), F.lit(""), F.lit("A"),
        )
        gga = F.concat_ws(
            ",", F.lit("GPGGA"), hms, lat, ns, lon, ew, F.when(F.col("valid"), "1").otherwise("0"),
            F.lpad(F.col("satellites").cast("string"), 2, "0"), F.lit("1.2"), F.lit("100.5"), F.lit("M"),
            F.lit("0.0"), F.lit("M"), F.lit(""), F.lit(""),
        )
        body = F.when(F.col("seq") % 2 == 0, rmc).otherwise(gga)
        broken = F.when(F.col("seq") % 7 == 0, F.lit("ZZ")).otherwise(checksum_hex(F.col("body")))
        return p.withColumn("body", body).select(
            "session_id",
            "seq",
            F.col("monotonic_us").alias("received_monotonic_us"),
            (seconds * 1_000_000).alias("received_utc_us"),
            F.concat(F.lit("$"), F.col("body"), F.lit("*"), broken).alias("sentence"),
        )

    @cached_property
    def discovery_bands(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.expr("p_partkey div 16").alias("session_id"),
            F.lit(1).cast("bigint").alias("acq_id"),
            (F.col("p_partkey") % 16).cast("int").alias("subband"),
            (906_000_000.0 + F.col("p_partkey") % 16 * 125_000).alias("center_hz"),
            (F.col("p_size") * 1_000).cast("bigint").alias("processed_samples"),
            (F.col("p_partkey") % 7 * 100).alias("abandoned_samples"),
            (F.col("p_partkey") % 3 * 50).alias("gap_samples"),
            (F.col("p_partkey") % 5).alias("candidate_limit_hits"),
            (F.col("p_partkey") % 4).alias("track_limit_hits"),
        )

    @cached_property
    def discovery_gaps(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.expr("c_custkey div 100").alias("session_id"),
            (F.col("c_custkey") % 100 + 1).alias("gap_id"),
            (F.col("c_custkey") % 100 * 1_000).alias("first_input_sample"),
            (F.col("c_custkey") % 100 * 1_000 + 200 + F.col("c_nationkey")).alias("end_input_sample"),
            (F.col("c_nationkey") % 17 - 1).cast("int").alias("subband"),
            F.when(F.col("c_custkey") % 2 == 0, "source_queue_full").otherwise("input_discontinuity").alias("reason"),
        )


def fix_type() -> str:
    from bandwatch.sources.schemas import FIX

    return FIX
