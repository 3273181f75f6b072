"""Whitening of embeddings from exact integer scatter sums.

Every entry c becomes the integer x = floor(64 c) + 1,000,000. The scatter of x is found without a multiplication: the
integers, less their least one, are cut into bit planes, a plane of 64 rows is one machine word, and the sum of products
of two dimensions is the sum over their pairs of planes of 2^(a+b) * popcount(plane a AND plane b). Tasks add such counts
over their rows and hand on whole numbers in limbs of 16 bits, so sums over any number of rows are exact. The driver gets
dimensions squared numbers, whatever the number of rows; it centres them as integers, n * sum(xy) - sum(x) * sum(y), before
anything is rounded. The eigenvectors that ``eigh`` finds are refined in extended precision, which keeps the small
eigenvalues of a badly scaled covariance right.

Defined results: a row whose vector is null, or holds a null or non-finite entry, is dropped; a vector shorter than the
longest one is taken to go on with zeros (an empty vector is all zeros); entries beyond 2^62 / 64 count as that bound;
rows repeated with equal id and vector are rows of their own, ids may be null; an empty table, or one in which no
dimension varies, gives no rows; components whose eigenvalue is zero, to the precision of the refinement, are left out;
other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
MOST_COMPONENTS = 32
ENTRY_BOUND = 2.0**62
#: Bytes of bit planes that a task holds at a time.
PLANE_BYTES = 8 << 20
LIMB = 16
#: An eigenvalue counts as zero below this share of the largest, which the extended precision cannot tell from zero.
NO_VARIANCE = 1e-15


@dataclass
class Whitening:
    """What the fit list gives: counts and sums are exact integers of y = x - least."""

    n: int
    dims: int
    least: int
    sums: list[int]
    components: np.ndarray  # dims x components, unit columns
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def scaled_rows(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that remain."""
    entry = lambda c: c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf"))
    whole = lambda c: F.floor(F.greatest(F.least(entry(c) * SCALE, F.lit(ENTRY_BOUND)), F.lit(-ENTRY_BOUND))) + SHIFT
    vec = F.col(f"`{vector}`")
    remains = vec.isNotNull() & ~F.coalesce(F.exists(vec, bad), F.lit(True))
    return df.where(remains).select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(vec, whole).alias("x"))


def shifted(column: pa.ListArray, dims: int, least: int) -> np.ndarray:
    """Rows x dims of x - least, as unsigned words; a short vector goes on with the x of zero."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        rows = flat.reshape(len(lengths), dims)
    else:
        rows = np.full((len(lengths), dims), SHIFT, dtype=np.int64)
        rows[np.arange(dims) < lengths[:, None]] = flat
    return rows.astype(np.uint64) - np.uint64(least & (2**64 - 1))


def bit_planes(rows: np.ndarray, bits: int) -> np.ndarray:
    """dims x bits x words: bit b of each dimension, 64 rows a word."""
    n, dims = rows.shape
    padded = np.zeros((-(-n // 64) * 64, dims), dtype=np.uint64)
    padded[:n] = rows
    planes = np.empty((dims, bits, len(padded) // 64), dtype=np.uint64)
    for b in range(bits):
        packed = np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0)
        planes[:, b, :] = np.ascontiguousarray(packed.T).view(np.uint64)
    return planes


class Scatter:
    """Sums of entries and of products over the rows that it has seen, by weight of two."""

    def __init__(self, dims: int, bits: int):
        self.dims, self.bits = dims, bits
        self.weights = np.add.outer(np.arange(bits), np.arange(bits)).ravel()
        self.products = np.zeros((dims, dims, 2 * bits - 1), dtype=np.int64)  # [i, j, w], j >= i
        self.singles = np.zeros((dims, bits), dtype=np.int64)

    def add(self, rows: np.ndarray) -> None:
        words = max(1, PLANE_BYTES // (8 * self.dims * self.bits))
        for at in range(0, len(rows), 64 * words):
            planes = bit_planes(rows[at : at + 64 * words], self.bits)
            self.singles += np.bitwise_count(planes).sum(axis=2, dtype=np.int64)
            for i in range(self.dims):
                for a in range(self.bits):
                    if planes[i, a].any():
                        both = np.bitwise_count(planes[i:] & planes[i, a]).sum(axis=2, dtype=np.int64)  # dims from i, bits
                        self.products[i, i:, a : a + self.bits] += both

    def limbs(self) -> Iterator[tuple[int, int, int, int]]:
        """(i, j, limb, value): value * 2^(16 limb) summed over limbs is a sum of products; i = -1: a plain sum."""
        for counts, place in ((self.singles, lambda at: (-1, int(at))), (self.products.reshape(self.dims * self.dims, -1), lambda at: divmod(int(at), self.dims))):
            for limb in range(-(-counts.shape[1] // LIMB)):
                part = counts[:, limb * LIMB : (limb + 1) * LIMB]
                values = (part << np.arange(part.shape[1])).sum(axis=1)
                for at in np.flatnonzero(values):
                    yield (*place(at), limb, int(values[at]))


def scatter_sums(rows: DataFrame, dims: int, least: int, bits: int) -> DataFrame:
    """(i, j, limb, value), summed over all rows; its size depends on the dimensions only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Scatter(dims, bits)
        for batch in batches:
            seen.add(shifted(batch.column("x"), dims, least))
        columns = [pa.array(c, kind) for c, kind in zip([*zip(*seen.limbs())] or [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "limb", "value"])

    parts = rows.select("x").mapInArrow(count, "i int, j int, limb int, value long")
    return parts.groupBy("i", "j", "limb").agg(F.sum("value").alias("value"))


def refined(v: np.ndarray, x: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric matrix from good first vectors; each round doubles the right digits."""
    x = x.astype(np.longdouble)
    eye = np.eye(len(v), dtype=np.longdouble)
    values = np.zeros(len(v), dtype=np.longdouble)
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ v @ x
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        off = s - np.diag(np.diag(s))
        tiny = 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + float(np.abs(values).max()) * np.linalg.norm(r.astype(float)))
        near = np.abs(gap) <= tiny
        e = np.where(near, r / 2, (off + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
    return values, x / np.sqrt((x * x).sum(axis=0))


def extended(part: int, whole: int) -> np.longdouble:
    """part / whole to the precision of a long double."""
    high = part / whole
    return np.longdouble(high) + np.longdouble(float(Fraction(part, whole) - Fraction(high)))


def fit_whitening(rows: DataFrame, most: int = MOST_COMPONENTS) -> Whitening | None:
    """From ``scaled_rows``; None where there is no row or no variance."""
    about = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims"), F.min(F.size("x")).alias("shortest"),
        F.min(F.array_min("x")).alias("least"), F.max(F.array_max("x")).alias("most"),
    ).first()
    n, dims = about["n"], about["dims"] or 0
    if not n or not dims:
        return None
    ends = [about["least"], about["most"]] + [SHIFT] * (about["shortest"] < dims)
    least, bits = min(ends), (max(ends) - min(ends)).bit_length()
    if not bits:
        return None
    sums, products = [0] * dims, {}
    for r in scatter_sums(rows, dims, least, bits).collect():  # dimensions squared rows for each 16 bits
        value = r["value"] << (LIMB * r["limb"])
        if r["i"] < 0:
            sums[r["j"]] += value
        else:
            products[r["i"], r["j"]] = products.get((r["i"], r["j"]), 0) + value
    v = np.zeros((dims, dims), dtype=np.longdouble)
    for i in range(dims):
        for j in range(i, dims):
            v[i, j] = v[j, i] = extended(n * products.get((i, j), 0) - sums[i] * sums[j], n * n)
    trace = sum(n * products.get((i, i), 0) - sums[i] ** 2 for i in range(dims)) / n**2
    if not trace:
        return None
    values, vectors = refined(v, np.linalg.eigh(v.astype(float))[1])
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > NO_VARIANCE * values.max()][:most]
    return Whitening(n, dims, least, sums, vectors[:, order].astype(float), values[order].astype(float), trace)


def projection(fit: Whitening):
    """A function of shifted rows that gives their whitened components."""
    mean = np.array([s / fit.n for s in fit.sums])
    turn = fit.components / np.sqrt(fit.eigenvalues)
    return lambda rows: (rows.astype(float) - mean) @ turn


def squared_deviations(rows: np.ndarray, fit: Whitening) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact."""
    sums, top = fit.sums, int(rows.max(initial=0))
    if fit.dims * (fit.n * max(top, 1)) ** 2 < 2**62:
        apart = fit.n * rows.astype(np.int64) - np.array(sums)
        return (apart * apart).sum(axis=1).tolist()
    return [sum((fit.n * y - s) ** 2 for y, s in zip(row, sums)) for row in rows.tolist()]


def whiten(rows: DataFrame, fit: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array) of each row; a deviation of over 38 digits is null."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        white = projection(fit)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                y = shifted(part.column("x"), fit.dims, fit.least)
                apart = pa.array([Decimal(d) if d < 10**38 else None for d in squared_deviations(y, fit)], pa.decimal128(38, 0))
                out = white(y)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), apart, lists], names=["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, fit: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured over all rows."""
    k = len(fit.eigenvalues)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white, products, sums = projection(fit), np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            z = white(shifted(batch.column("x"), fit.dims, fit.least))
            products += z.T @ z
            sums += z.sum(axis=0)
        i, j = np.indices((k + 1, k))
        columns = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(np.vstack([products, sums[None, :]]).ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "value"])

    parts = rows.select("x").mapInArrow(cross, "i int, j int, value double")
    total = np.zeros((k + 1, k))
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # at most 33 x 32 numbers
        total[r["i"], r["j"]] = r["value"]
    mean = total[k] / fit.n
    return float(np.abs(total[:k] / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened_table(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining row and component."""
    rows = scaled_rows(df, vec_id, vector)
    fit = fit_whitening(rows, most)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if fit is None:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    explained = F.array(*map(F.lit, fit.explained))
    out = whiten(rows, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(identity_error(rows, fit)).alias("identity_error"),
    )
