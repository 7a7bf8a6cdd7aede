"""Vectors of floats as whole numbers: what the operators on embeddings share.

An entry c counts as floor(256 * c), taken in double precision; beyond a long, as the
nearest long. A vector is left out if it is null or holds a null or non-finite entry.
Vectors of different lengths meet as if the shorter ones ended in zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries turned into numbers at a time.
ENTRIES = 1 << 20
#: Largest double that is a long.
TOP = float(2**63 - 1024)


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(256.0 * entries)
    return np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, np.clip(scaled, -(2.0**63), TOP).astype(np.int64))


def matrices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of ``batch`` whose vector (column ``at``) counts, and their numbers, a slice at a time."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy().astype(np.int64)
    step = max(1, ENTRIES // max(1, int(lengths.max(initial=1))))
    for begin in range(0, batch.num_rows, step):
        part, n = batch.slice(begin, step), lengths[begin : begin + step]
        column = part.column(at)
        entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        good = column.is_valid().to_numpy(zero_copy_only=False)
        good[row[~np.isfinite(entries)]] = False
        out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
        inside = good[row]
        out[row[inside], place[inside]] = whole_numbers(entries[inside])
        yield part.filter(pa.array(good)), out[good]


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row as bytes: its width, then its numbers up to the last that is not zero. Equal vectors, equal bytes."""
    if not rows.size:
        return [b""] * len(rows)
    least, most = rows.min(1), rows.max(1)
    width = np.select([(least >= -(2 ** (8 * w - 1))) & (most < 2 ** (8 * w - 1)) for w in (1, 2, 4)], [1, 2, 4], 8)
    used = np.where(rows.any(1), rows.shape[1] - np.argmax(rows[:, ::-1] != 0, 1), 0)
    out = [b""] * len(rows)
    for w in (1, 2, 4, 8):
        own = np.flatnonzero((width == w) & (used > 0))
        numbers, head = rows[own].astype(f"<i{w}"), bytes([w])
        for i, row in zip(own, numbers):
            out[i] = head + row[: used[i]].tobytes()
    return out


def unpacked(vectors: list[bytes], dimensions: int) -> np.ndarray:
    """The rows of ``packed``, with zeros up to ``dimensions``."""
    out = np.zeros((len(vectors), dimensions), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, v in enumerate(vectors):
        if v:
            kinds.setdefault((v[0], len(v)), []).append(i)
    for (w, size), own in kinds.items():
        numbers = np.frombuffer(b"".join(vectors[i][1:] for i in own), f"<i{w}").reshape(len(own), -1)
        out[own, : (size - 1) // w] = numbers
    return out
