"""Spectra from sample blocks: framed FFT power, activity, tiles.

Blocks are shuffled only where a frame straddles two of them: whole frames are
measured where their block lies, in Arrow batches with one vectorised FFT each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwatch.functions.power import dbfs
from bandwatch.operators.sequences import sample_runs

# Sample value at which a converter rail counts as clipped; tile length.
CLIP_LEVEL = 127.0 / 128.0
TILE_SECONDS = 0.020
MAX_TILE_FRAMES = 128


def normalized_samples(raw: Column, encoding: str) -> Column:
    """Converter codes to -1..1: signed /128, or offset binary (u - 127.5)/128."""
    if encoding == "signed":
        return F.transform(raw, lambda x: x / F.lit(128.0))
    if encoding == "offset":
        return F.transform(raw, lambda x: (x - F.lit(127.5)) / F.lit(128.0))
    raise ValueError(f"unknown encoding {encoding}")


def clipped_samples(iq: Column) -> Column:
    """Complex samples (interleaved I, Q) with either part at a converter rail."""
    i = F.filter(iq, lambda x, k: k % 2 == 0)
    q = F.filter(iq, lambda x, k: k % 2 == 1)
    pairs = F.zip_with(i, q, lambda a, b: (F.abs(a) >= CLIP_LEVEL) | (F.abs(b) >= CLIP_LEVEL))
    return F.size(F.filter(pairs, lambda hit: hit)).cast("bigint")


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def bin_grid(rate: float, span: float, fft_size: int) -> tuple[int, int, float, float]:
    """First and last signed bin whose edges fit in the span, bin width, noise bandwidth."""
    width = rate / fft_size
    first = max(-fft_size // 2, math.ceil(-span / (2 * width) + 0.5))
    last = min(fft_size // 2 - 1, math.floor(span / (2 * width) - 0.5))
    if last < first:
        raise ValueError("span contains no complete bin")
    w = hann(fft_size)
    return first, last, width, rate * float((w**2).sum()) / float(w.sum()) ** 2


def frames_per_tile(rate: float, fft_size: int) -> int:
    return int(min(MAX_TILE_FRAMES, max(1, math.ceil(TILE_SECONDS * rate / fft_size))))


def whole_frames(blocks: DataFrame, fft_size: int, chunk_samples: int = 1 << 30) -> DataFrame:
    """Cut contiguous runs of blocks into whole frames of interleaved samples.

    A frame never spans a gap; samples after a run's last whole frame are left out.
    """
    sized = blocks.withColumn("n", (F.size("iq") / 2).cast("bigint"))
    labels = sample_runs(sized.select("session_id", "first_sample", "n"), chunk_samples)
    placed = sized.join(labels.drop("n"), ["session_id", "first_sample"])
    n = F.lit(fft_size).cast("bigint")
    offset = F.col("first_sample") - F.col("run_sample")
    parts = (
        placed.withColumn("offset", offset)
        .withColumn(
            "frame",
            F.explode(
                F.sequence(
                    F.floor(F.col("offset") / n), F.floor((F.col("offset") + F.col("n") - 1) / n)
                )
            ),
        )
        .withColumn("_a", F.greatest(F.lit(0), F.col("frame") * n - F.col("offset")))
        .withColumn("_b", F.least(F.col("n"), (F.col("frame") + 1) * n - F.col("offset")))
        .withColumn("iq", F.slice("iq", (2 * F.col("_a") + 1).cast("int"), (2 * (F.col("_b") - F.col("_a"))).cast("int")))
        .select("session_id", "run_sample", "frame", (F.col("offset") + F.col("_a")).alias("at"), "iq")
    )
    whole = parts.where(F.size("iq") == 2 * fft_size).select("session_id", "run_sample", "frame", "iq")
    straddling = (
        parts.where(F.size("iq") < 2 * fft_size)
        .groupBy("session_id", "run_sample", "frame")
        .agg(F.sort_array(F.collect_list(F.struct("at", "iq"))).alias("parts"))
        .select("session_id", "run_sample", "frame", F.flatten(F.transform("parts", lambda p: p["iq"])).alias("iq"))
        .where(F.size("iq") == 2 * fft_size)
    )
    return whole.unionByName(straddling).withColumn("first_sample", F.col("run_sample") + F.col("frame") * n)


def frame_power(frames: DataFrame, fft_size: int, first_bin: int, last_bin: int) -> DataFrame:
    """Integrated power per bin of each frame: ``|FFT|^2 / (N * sum(w^2))``."""
    window = hann(fft_size)
    scale = 1.0 / (fft_size * float((window**2).sum()))
    picks = np.arange(first_bin, last_bin + 1) % fft_size
    keep = ["session_id", "run_sample", "frame", "first_sample"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column("iq").flatten().to_numpy(zero_copy_only=False)
            z = flat.reshape(batch.num_rows, fft_size, 2)
            spectrum = np.fft.fft((z[..., 0] + 1j * z[..., 1]) * window, axis=1)[:, picks]
            power = (spectrum.real**2 + spectrum.imag**2) * scale
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * picks.size
            rail = (np.abs(z) >= CLIP_LEVEL).any(axis=2).sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(rail),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(power.ravel()))],
                names=[*keep, "clipped", "power"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", clipped bigint, power array<double>"
    return frames.select(*keep, "iq").mapInArrow(measure, schema)


def active_bins(spectra: DataFrame, threshold_dbfs: float) -> DataFrame:
    """Per frame the active bins (power at or above the threshold) and their powers."""
    level = 10.0 ** (threshold_dbfs / 10.0)
    indexed = F.transform("power", lambda p, i: F.struct(i.alias("bin"), p.alias("power")))
    hits = F.filter(indexed, lambda h: h["power"] >= level)
    return (
        spectra.withColumn("_hits", hits)
        .withColumn("bins", F.transform("_hits", lambda h: h["bin"]))
        .withColumn("powers", F.transform("_hits", lambda h: h["power"]))
        .withColumn("bin_count", F.size("power"))
        .drop("_hits", "power")
    )


def event_frames(spectra: DataFrame, threshold_dbfs: float, rate: float, fft_size: int) -> DataFrame:
    """Frames in the form the event operators take."""
    segment = math.ceil(2.0 * rate / fft_size) * fft_size
    return active_bins(spectra, threshold_dbfs).select(
        "session_id",
        "first_sample",
        F.lit(fft_size).cast("bigint").alias("frame_samples"),
        F.lit(segment).cast("bigint").alias("segment_samples"),
        "bin_count",
        "clipped",
        "bins",
        "powers",
    )


def tile_bins(spectra: DataFrame, per_tile: int) -> DataFrame:
    """Linear mean and peak per tile and bin; partial sums combine before the shuffle."""
    key = F.floor(F.col("frame") / per_tile).alias("tile")
    return (
        spectra.select("session_id", "run_sample", key, F.posexplode("power").alias("bin", "p"))
        .groupBy("session_id", "run_sample", "tile", "bin")
        .agg(dbfs(F.avg("p")).alias("mean_dbfs"), dbfs(F.max("p")).alias("peak_dbfs"), F.avg("p").alias("mean_power"))
    )


def tiles_from_spectra(spectra: DataFrame, per_tile: int, fft_size: int, threshold_dbfs: float) -> DataFrame:
    """Tiles: arrays per bin, activity per frame, clipped count, background; partial at gaps."""
    key = F.floor(F.col("frame") / per_tile).alias("tile")
    group = ["session_id", "run_sample", "tile"]
    arrays = (
        tile_bins(spectra, per_tile)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("bin", "mean_dbfs", "peak_dbfs"))).alias("b"))
    )
    frames = (
        active_bins(spectra, threshold_dbfs)
        .groupBy("session_id", "run_sample", key)
        .agg(
            F.sort_array(F.collect_list(F.struct("frame", "bins"))).alias("f"),
            F.min("first_sample").alias("first_sample"),
            (F.max("first_sample") + fft_size).alias("end_sample"),
            F.count("*").cast("int").alias("frame_count"),
            F.sum("clipped").alias("clipped"),
        )
    )
    means = F.transform("b", lambda x: x["mean_dbfs"])
    return frames.join(arrays, group).select(
        "session_id",
        "first_sample",
        "end_sample",
        "frame_count",
        "clipped",
        F.size("b").alias("bin_count"),
        means.alias("mean_dbfs"),
        F.transform("b", lambda x: x["peak_dbfs"]).alias("peak_dbfs"),
        F.get(F.array_sort(means), F.floor((F.size("b") - 1) / 5).cast("int")).alias("background_dbfs"),
        F.transform("f", lambda x: x["bins"]).alias("activity"),
    )
