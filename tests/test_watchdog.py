"""The live stall watchdog: a source that pauses gives a stall row by a processing-time timer."""

import time

from bandwatch.session import shared_folder
from bandwatch.streaming import jobs

SCHEMA = "session_id bigint, first_sample bigint, n bigint"


def test_a_paused_source_is_reported_and_resumes(spark):
    source, out, checkpoint = (shared_folder(spark, n) for n in ("source", "out", "checkpoint"))

    def arrive(*blocks):
        spark.createDataFrame(list(blocks), SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def reasons():
        try:
            rows = spark.read.parquet(out).where("late_row IS NULL").collect()
        except Exception:  # noqa: BLE001  nothing written yet
            return []
        return sorted((r["session_id"], r["reason"]) for r in rows)

    def wait(until, seconds=90):
        end = time.time() + seconds
        while time.time() < end and not until():
            time.sleep(0.5)
        return until()

    arrive((1, 0, 100), (1, 100, 100))
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = jobs.append_sink(jobs.sample_gaps(stream, stall_ms=1500), out, checkpoint, 1)
    try:
        assert wait(lambda: (1, "source_stall") in reasons()), query.lastProgress
        before = reasons()
        arrive((1, 200, 100), (1, 400, 100))  # resumed, with samples missing
        assert wait(lambda: (1, "application_drop") in reasons())
        assert len(reasons()) > len(before)
    finally:
        query.stop()
