"""Whitening by polarisation: covariances from variances of dimensions and of their pair sums.

For each dimension i and each pair (i, j) one number is aggregated: the exact sum of
squares of the centred x_i, or of the centred x_i + x_j. Since

    var(x_i + x_j) = var(x_i) + var(x_j) + 2 cov(x_i, x_j),

the differences of these variances give every covariance; the matrix is assembled on the
driver (dimensions squared, whatever the number of rows) and given to ``eigh``.

Exactness: vectors count as whole numbers (``vectors``). They are centred on the whole
number m next to their mean; what is left, T = sum(x - m), enters as a fraction, so that
n * sum((x-m)^2) - T^2 is n^2 times the variance, exactly. Sums leave a task as limbs of
40 bits, which Spark adds as longs: no size of entries and no number of rows overflows.

The fit list (each distinct vector once) is written to the shared folder. Building the
result runs jobs: the distinct vectors, their sums, their squares, and the covariance of
the whitened vectors, which is measured and not derived.

Nulls and odd rows: a null vector, or one with a null or non-finite entry, gives no row;
a null id is kept; repeated rows give a row each and count once in the fit; shorter
vectors count as ended by zeros. Components whose eigenvalue is zero to double precision
cannot be scaled to variance one and are left out (a deviation beyond 38 digits is null), so an empty table, a single distinct
vector and vectors of length zero give no rows. Other columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.llm.common import sent, written
from bandwatch.llm.vectors import matrices, packed, unpacked

LIMB = 40
#: Numbers squared at a time.
CELLS = 1 << 20
#: Eigenvalues up to this share of the largest are zero to double precision.
NOTHING = 1e-12


def fit_list(rows: DataFrame, vector: str) -> DataFrame:
    """Each distinct vector once, packed; written."""

    def run(batches):
        for batch in batches:
            for _, numbers in matrices(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(packed(numbers), pa.binary())], names=["x"])

    return written(rows.select(vector).mapInArrow(run, "x binary").distinct(), "fit-list")[0]


def exact_sums(fit: DataFrame, dimensions: int, keys: int, add: Callable[[np.ndarray], Iterator[tuple[int, list[int]]]]) -> list[int]:
    """Sums of whole numbers over the fit list. ``add`` gives (first key, numbers) for rows of vectors."""

    def run(batches):
        totals = [0] * keys
        for batch in batches:
            vectors = batch.column(0).to_pylist()
            step = max(1, CELLS // max(1, dimensions))
            for begin in range(0, len(vectors), step):
                for first, numbers in add(unpacked(vectors[begin : begin + step], dimensions)):
                    for k, v in enumerate(numbers, first):
                        totals[k] += v
        key, limb, value = [], [], []
        for k, total in enumerate(totals):
            sign, total, at = (-1 if total < 0 else 1), abs(total), 0
            while total:
                key.append(k), limb.append(at), value.append(sign * (total & ((1 << LIMB) - 1)))
                total, at = total >> LIMB, at + 1
        columns = [pa.array(key, pa.int64()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "limb", "value"])

    parts = fit.mapInArrow(run, "key long, limb int, value long").groupBy("key", "limb").agg(F.sum("value").alias("value"))
    out = [0] * keys
    for r in parts.collect():  # a few limbs for each of `keys` numbers
        out[r["key"]] += r["value"] << (LIMB * r["limb"])
    return out


def plain_sums(x: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    wide = x.size and max(int(x.max()), -int(x.min())) * len(x) >= 2**63
    yield 0, [int(v) for v in (x.astype(object) if wide else x).sum(0)]


def sums_of_squares(z: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, list[int]]]:
    """Of every dimension, then of every pair sum; exact for any longs."""
    most = int(np.abs(z).max(initial=1))
    if 4 * most * most * max(1, len(z)) >= 2**63:
        z = z.astype(object)
    yield 0, [int(v) for v in (z * z).sum(0)]
    first, second = pairs
    for begin in range(0, len(first), step := max(1, CELLS // max(1, len(z)))):
        both = z[:, first[begin : begin + step]] + z[:, second[begin : begin + step]]
        yield z.shape[1] + begin, [int(v) for v in (both * both).sum(0)]


def covariance(squares: list[int], left: list[int], n: int) -> np.ndarray:
    """The matrix from the sums of squares (dimensions, then pairs) and sums of the centred numbers."""
    d = len(left)
    variances = [n * squares[i] - left[i] ** 2 for i in range(d)]  # n^2 times
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = float(Fraction(variances[i], n * n))
    for k, (i, j) in enumerate(zip(*np.triu_indices(d, 1)), d):
        both = n * squares[k] - (left[i] + left[j]) ** 2
        out[i, j] = out[j, i] = float(Fraction(both - variances[i] - variances[j], 2 * n * n))
    return out


class Whitener:
    """The centre and the leading components of a fit list."""

    def __init__(self, n: int, sums: list[int], matrix: np.ndarray, components: int):
        self.n, self.dimensions = n, len(sums)
        self.middle = [(2 * s + n) // (2 * n) for s in sums]
        self.left = [s - n * m for s, m in zip(sums, self.middle)]
        values, vectors = np.linalg.eigh(matrix) if sums else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(values)[::-1][:components]
        order = [k for k in order if values[k] > NOTHING * max(values[-1], 0.0)]
        self.values, self.explained = values[order], values[order] / np.trace(matrix) if order else np.zeros(0)
        self.axes = vectors[:, order] / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - m as longs, or as Python's whole numbers where longs are too short."""
        wide = any(abs(m) >= 2**62 for m in self.middle) or (x.size and (x.max() >= 2**62 or x.min() < -(2**62)))
        return x.astype(object) - np.array(self.middle, object) if wide else x - np.array(self.middle, np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        fraction = np.array([float(Fraction(t, self.n)) for t in self.left])
        return (self.centred(x).astype(np.float64) - fraction) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n x - S)^2) of each row, exact: n^2 sum(z^2) - 2 n sum(z T) + sum(T^2)."""
        z, left = self.centred(x), self.left
        most = max(int(np.abs(z).max(initial=0)), max(map(abs, left), default=0), 1)
        if most * most * max(1, self.dimensions) >= 2**63 or z.dtype == object:
            z, left = z.astype(object), np.array(left, object)
        else:
            left = np.array(left, np.int64)
        n, rest = self.n, sum(t * t for t in self.left)
        return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip((z * z).sum(1), (z * left).sum(1))]


def fit(listed: DataFrame, components: int) -> Whitener | None:
    """The whitener of a fit list; None for an empty one."""
    n, size = listed.agg(F.count("*"), F.max(F.expr("(length(x) - 1) div greatest(conv(hex(substring(x, 1, 1)), 16, 10)::int, 1)"))).first()
    if not n:
        return None
    d = max(size or 0, 0)
    sums = exact_sums(listed, d, d, plain_sums)
    centre = Whitener(n, sums, np.zeros((d, d)), 0)
    pairs = np.triu_indices(d, 1)
    squares = exact_sums(listed, d, d + len(pairs[0]), lambda x: sums_of_squares(centre.centred(x), pairs))
    return Whitener(n, sums, covariance(squares, centre.left, n), components)


def identity_error(listed: DataFrame, whitener: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance, as measured, minus the identity."""
    d, k, n = whitener.dimensions, len(whitener.values), whitener.n
    model = sent(listed.sparkSession, whitener)

    def run(batches):
        own, total, products = model(), np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = own.whitened(unpacked(batch.column(0).to_pylist(), d))
            total, products = total + w.sum(0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array([*total, *products.ravel()])], names=["key", "value"])

    found = np.zeros(k + k * k)
    for r in listed.mapInArrow(run, "key int, value double").groupBy("key").agg(F.sum("value").alias("value")).collect():
        found[r["key"]] = r["value"] / n
    mean = found[:k]
    return float(np.abs(found[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


COLUMNS = "component int, n long, deviation decimal(38,0), whitened double, explained double"


def whiten(embeddings: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and leading component."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    listed = fit_list(rows, "vector")
    whitener = fit(listed, components)
    if whitener is None or not len(whitener.values):
        return rows.sparkSession.createDataFrame([], f"vec_id long, {COLUMNS}, identity_error double")
    model, k, d = sent(rows.sparkSession, whitener), len(whitener.values), whitener.dimensions

    def run(batches):
        own, context = model(), decimal.Context(prec=60)
        for batch in batches:
            for part, x in matrices(batch, 1):
                x = np.pad(x, ((0, 0), (0, d - x.shape[1]))) if x.shape[1] < d else x[:, :d]  # beyond d all are zero
                deviations = own.deviations(x)
                kind = pa.int64() if max(deviations, default=0) < 2**63 else pa.decimal128(38, 0)
                far = pa.array(deviations if kind == pa.int64() else [context.create_decimal(v) if v < 10**38 else None for v in deviations], kind)
                repeated = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [
                    part.column(0).take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, own.n)), far.cast(pa.decimal128(38, 0)).take(repeated),
                    pa.array(own.whitened(x).ravel()), pa.array(np.tile(own.explained, len(x))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(run, f"vec_id long, {COLUMNS}").withColumn("identity_error", F.lit(identity_error(listed, whitener)))
