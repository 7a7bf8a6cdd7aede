"""Packed measurement encodings as column expressions and Arrow jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwatch.functions.binding import bound

RAW, RUNS = 0, 1
MAX_RUN = 65_535


def _swapped(text: Column) -> Column:
    """Hex of a little-endian 16-bit value, byte order reversed."""
    return F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2))


def _cells(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a column of lists, without nulls, and how many each list has."""
    column = pa.concat_arrays([column])
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    kept = np.bincount(np.repeat(np.arange(len(column)), sizes)[there], minlength=len(column))
    return pc.drop_null(flat).to_numpy().astype(dtype), kept


def _blobs(like: pa.Array, codes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Fixed-width codes as one binary value for each list; null where ``like`` is."""
    ends = np.concatenate([[0], np.cumsum(sizes * codes.dtype.itemsize)]).astype(np.int32)
    made = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(codes.tobytes())])
    return pc.if_else(like.is_valid(), made, pa.scalar(None, pa.binary()))


def _codes(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The whole codes of a column of binary values, and how many each has; null has none."""
    width, blobs = np.dtype(dtype).itemsize, [b or b"" for b in column.to_pylist()]
    sizes = np.array([len(b) // width for b in blobs], np.int64)
    return np.frombuffer(b"".join(b[: n * width] for b, n in zip(blobs, sizes.tolist())), dtype), sizes


def _lists(valid: pa.Array, values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))
    return pc.if_else(valid, made, pa.scalar(None, made.type))


# Codes of a batch are made at once; null lists and values stay null, null entries are left out.


def centi_db_decode(blob: Column) -> Column:
    """Little-endian int16 hundredths of a dB to levels; an odd byte at the end is left out."""

    def levels(column: pa.Array) -> pa.Array:
        codes, sizes = _codes(column, "<i2")
        return _lists(column.is_valid(), codes / 100.0, sizes)

    return F.arrow_udf(levels, "array<double>")(blob)


def centi_db_encode(levels: Column) -> Column:
    """Levels to little-endian int16 hundredths of a dB, half away from zero; fails on levels that are not finite."""

    def blobs(column: pa.Array) -> pa.Array:
        values, sizes = _cells(column, np.float64)
        if not np.isfinite(values).all():
            raise ValueError("a level is not finite")
        codes = (np.sign(values) * np.floor(np.abs(values) * 100 + 0.5)).astype(np.int64) & 65_535
        return _blobs(column, codes.astype("<u2"), sizes)

    return F.arrow_udf(blobs, "binary")(levels)


def histogram_decode(blob: Column) -> Column:
    """33 little-endian 32-bit counts; NULL unless exactly 132 bytes."""

    def counts(column: pa.Array) -> pa.Array:
        codes, sizes = _codes(column, "<u4")
        whole = pc.fill_null(pc.equal(pc.binary_length(column), 132), False)
        return _lists(whole, codes.astype(np.int64), sizes)

    return F.arrow_udf(counts, "array<bigint>")(blob)


def histogram_encode(counts: Column) -> Column:
    """Counts to little-endian 32-bit values; fails on those that do not fit."""

    def blobs(column: pa.Array) -> pa.Array:
        values, sizes = _cells(column, np.int64)
        if ((values < 0) | (values > 0xFFFFFFFF)).any():
            raise ValueError("a count does not fit 32 bits")
        return _blobs(column, values.astype("<u4"), sizes)

    return F.arrow_udf(blobs, "binary")(counts)


def bitmap(activity: Column, bins: Column) -> Column:
    """Active bins per frame to a frame-major bitmap, least significant bit first."""
    stride = F.ceil(bins / 8).cast("int")

    def frame(active: Column) -> Column:
        def byte(i: Column) -> Column:
            bits = F.filter(active, lambda b: F.floor(b / 8) == i)
            value = F.aggregate(bits, F.lit(0), lambda a, b: a + F.pow(F.lit(2.0), b % 8).cast("int"))
            return F.lpad(F.hex(value.cast("bigint")), 2, "0")

        return F.array_join(F.transform(F.sequence(F.lit(0), stride - 1), byte), "")

    return F.unhex(F.array_join(F.transform(activity, frame), ""))


def runs_encode(mask: Column) -> Column:
    """Bitmap to (count, byte) runs behind tag 1, or the raw bytes behind tag 0 if shorter."""

    def encoded(text: Column) -> Column:
        n = (F.length(text) / 2).cast("int")
        octets = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * 2 + 1, F.lit(2)))

        def of(array: Column) -> Column:
            numbered = F.transform(array, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
            starts = F.filter(numbered, lambda x: (x["i"] == 0) | (F.get(array, x["i"] - 1) != x["b"]))

            def run(begins: Column) -> Column:
                def one(x: Column, k: Column) -> Column:
                    length = F.coalesce(F.get(begins, k + 1)["i"], n) - x["i"]
                    whole = F.floor(length / MAX_RUN).cast("int")
                    rest = F.lpad(F.hex((length % MAX_RUN).cast("bigint")), 4, "0")
                    tail = F.when(length % MAX_RUN > 0, F.concat(_swapped(rest), x["b"])).otherwise("")
                    return F.concat(F.repeat(F.concat(F.lit("FFFF"), x["b"]), whole), tail)

                return F.array_join(F.transform(begins, one), "")

            return bound(starts, run)

        packed = bound(octets, of)
        return bound(packed, lambda p: F.when(F.length(p) < F.length(text), F.concat(F.lit("01"), p)).otherwise(F.concat(F.lit("00"), text)))

    return F.unhex(bound(F.hex(mask), encoded))


def _expand(blob: bytes, size: int) -> np.ndarray:
    data = np.frombuffer(blob, dtype=np.uint8)
    if data.size == 0:
        raise ValueError("empty mask")
    if data[0] == RAW:
        out = data[1:]
    elif data[0] == RUNS and (data.size - 1) % 3 == 0:
        triples = data[1:].reshape(-1, 3).astype(np.int64)
        counts = triples[:, 0] + 256 * triples[:, 1]
        if (counts == 0).any() or counts.sum() > size:
            raise ValueError("invalid mask run")
        out = np.repeat(triples[:, 2].astype(np.uint8), counts)
    else:
        raise ValueError("invalid mask encoding")
    if out.size != size:
        raise ValueError("wrong mask length")
    return out


def decode_activity(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Packed masks to active bins per frame, in Arrow batches.

    Takes ``packed`` (mask), ``frame_count`` and ``bin_count``. A mask that does
    not decode, or has bits beyond the last bin, gives NULL activity and a reason.
    """

    def one(blob: bytes, frames: int, bins: int):
        stride = (bins + 7) // 8
        try:
            bits = np.unpackbits(_expand(blob, stride * frames).reshape(frames, stride), axis=1, bitorder="little")
        except ValueError as e:
            return None, str(e)
        if bits[:, bins:].any():
            return None, "nonzero bitmap padding"
        return [np.flatnonzero(row[:bins]).astype(np.int32).tolist() for row in bits], None

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [
                one(b, f, n)
                for b, f, n in zip(
                    batch.column("packed").to_pylist(),
                    batch.column("frame_count").to_pylist(),
                    batch.column("bin_count").to_pylist(),
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in keys),
                    pa.array([a for a, _ in got], type=pa.list_(pa.list_(pa.int32()))),
                    pa.array([r for _, r in got], type=pa.string()),
                ],
                names=[*keys, "activity", "reason"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", activity array<array<int>>, reason string"
    return packed.select(*keys, "packed", "frame_count", "bin_count").mapInArrow(job, schema)


def explode_cells(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse cells of decoded activity."""
    return decoded.select(*keys, F.posexplode("activity").alias("frame", "bins")).select(
        *keys, "frame", F.explode("bins").alias("bin")
    )
