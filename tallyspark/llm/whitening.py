"""Embedding whitening: distributed centred covariance, own eigensolver, broadcast projection.

*Rows.* Each entry c of a vector becomes the integer floor(256 c). Statistics are over the fit list, every
distinct integer vector once, so that a vector that a third of all rows repeat counts once; Spark
reduces copies in every task before they move.

*Sums.* Count and sums are exact integers. The covariance is summed from centred rows: every task
returns one symmetric matrix, a row for each dimension, and these are added by dimension in two
steps, so that neither tasks nor the driver hold more than ``FAN_IN`` of a dimension's rows at once.
What reaches the driver is one matrix of dimensions squared.

*Eigenvectors.* On that matrix: Householder reflections make it tridiagonal; Sturm counts bisect the
largest eigenvalues to the last bits; inverse iteration on the shifted tridiagonal matrix gives their
vectors, those of a cluster of close eigenvalues kept orthogonal to each other; the reflections,
applied backwards, turn them into components.

*Projection.* Mean, components and scale, a few times the dimensions, are broadcast with the task;
rows are projected where they are. The whitened covariance is measured in one more pass.

Defined cases: rows whose vector is null, empty, or holds null, infinite or undefined entries, or an
entry whose integer a long cannot hold, are dropped; so are vectors of another length than the
commonest (of two equally common ones the longer). Components whose eigenvalue is zero to working
precision have no scale and are left out, so a table of one distinct vector gives no rows. Rows that
repeat an id are rows each, a null id is kept. A deviation beyond a long is null. An empty table
gives an empty table; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Partial rows of one dimension that one task adds, about.
FAN_IN = 64
#: Rows whose products are held at once.
CHUNK = 4096
EPS = np.finfo(np.float64).eps
LONG = 2.0**63


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x array<long>) of the rows whose vector takes part."""
    entries = F.col(f"`{vector_col}`").cast("array<double>")
    fits = F.forall(entries, lambda c: F.coalesce(F.abs(c * 256.0) < F.lit(LONG), F.lit(False)))  # undefined is larger than all
    whole = vectors.where(F.coalesce(fits, F.lit(False)) & (F.size(entries) > 0))
    return whole.select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(entries, lambda c: F.floor(c * 256.0)).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Fixed-width lists as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def exact_sums(rows: DataFrame, column: str, width: int) -> tuple[int, list[int]]:
    """How many rows, and the sum of each dimension; every task adds its own rows first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 1)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                x = _matrix(batch.column(0).slice(at, CHUNK), width)
                small = np.abs(x.astype(np.float64)).max() * len(x) < LONG / 2
                for i, s in enumerate((x if small else x.astype(object)).sum(axis=0).tolist()):
                    total[i] += s
                total[width] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["i", "s"])

    found = rows.select(column).mapInArrow(part, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # one row per dimension
    return int(found[width].s), [int(r.s) for r in found[:width]]


def added(partials: DataFrame, width: int) -> np.ndarray:
    """The sum of rows (i, salt, values) for each i, as a matrix; ``i`` is bounded by the dimensions."""

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        values = _matrix(rows.column("values"), width).sum(axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "values": pa.array([values.tolist()], pa.list_(pa.float64()))})

    shape = "i int, values array<double>"
    some = partials.groupBy("i", "salt").applyInArrow(total, shape)
    rows = {r.i: r.values_ for r in some.groupBy("i").applyInArrow(total, shape).select("i", F.col("values").alias("values_")).collect()}  # one row per dimension
    return np.array([rows[i] for i in sorted(rows)])


def _salted(rows: DataFrame) -> DataFrame:
    """A salt by partition, so that about ``FAN_IN`` partial rows of a dimension meet."""
    return rows.withColumn("salt", F.floor(F.spark_partition_id() / FAN_IN))


def covariance(rows: DataFrame, column: str, mean: np.ndarray) -> np.ndarray:
    """The sum of (row - mean)(row - mean)^T, centred before multiplying."""
    width = len(mean)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                centred = _matrix(batch.column(0).slice(at, CHUNK), width).astype(np.float64) - mean
                total += centred.T @ centred
                some = True
        if some:
            values = pa.ListArray.from_arrays(pa.array(np.arange(width + 1, dtype=np.int32) * width), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), values], ["i", "values"])

    return added(_salted(rows.select(column).mapInArrow(part, "i int, values array<double>")), width)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix by Householder reflections."""
    a, n, reflectors = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        v = np.zeros(n - k - 1)
        if scale > 0 and np.abs(x[1:]).max() > 0:
            v = x / scale
            v[0] += math.copysign(math.sqrt(v @ v), v[0])
            v /= math.sqrt(v @ v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            q = p - (v @ p) * v
            rest -= 2.0 * (np.outer(v, q) + np.outer(q, v))
            a[k + 1 :, k] = a[k, k + 1 :] = x - 2.0 * (v @ x) * v
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, x: float) -> int:
    """How many eigenvalues of the tridiagonal matrix lie below ``x``: the negative pivots of its Sturm sequence."""
    tiny = max(np.abs(off).max(initial=0.0), np.abs(diagonal).max()) * EPS * EPS + np.finfo(np.float64).tiny
    count, q = 0, 1.0
    for i, d in enumerate(diagonal.tolist()):
        q = d - x - (off[i - 1] * off[i - 1] / q if i else 0.0)
        if abs(q) < tiny:
            q = -tiny
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The k largest eigenvalues, falling, each bisected until its ends are neighbours to working precision."""
    n = len(diagonal)
    around = np.concatenate(([0.0], np.abs(off))) + np.concatenate((np.abs(off), [0.0]))
    low, high = float((diagonal - around).min()), float((diagonal + around).max())
    slack = EPS * max(abs(low), abs(high)) * n + np.finfo(np.float64).tiny
    low, high, found = low - slack, high + slack, []
    for j in range(1, min(k, n) + 1):
        a, b = low, found[-1] + slack if found else high
        while (c := 0.5 * (a + b)) not in (a, b) and b - a > 2 * EPS * max(abs(a), abs(b)):
            a, b = (c, b) if count_below(diagonal, off, c) <= n - j else (a, c)
        found.append(0.5 * (a + b))
    return found


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, y: np.ndarray, least: float) -> np.ndarray:
    """(T - shift)^-1 y by elimination with row exchanges; pivots below ``least`` count as it."""
    n = len(diagonal)
    u, v, w, y = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, y.tolist()
    below = off.tolist()
    for i in range(n - 1):
        if abs(below[i]) > abs(u[i]):
            factor = u[i] / below[i]
            u[i], v[i], w[i], u[i + 1], v[i + 1] = below[i], u[i + 1], v[i + 1], v[i] - factor * u[i + 1], -factor * v[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            u[i] = u[i] if abs(u[i]) > least else math.copysign(least, u[i])
            factor = below[i] / u[i]
            u[i + 1] -= factor * v[i]
            y[i + 1] -= factor * y[i]
    out = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        pivot = u[i] if abs(u[i]) > least else math.copysign(least, u[i])
        out[i] = (y[i] - v[i] * out[i + 1] - w[i] * out[i + 2]) / pivot
    return np.array(out[:n])


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: list[float], steps: int = 8) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one row each; those of a cluster are orthogonal to each other."""
    n, norm = len(diagonal), float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0))
    least, gap = EPS * norm + np.finfo(np.float64).tiny, 1e-3 * norm
    rng, out, shift = np.random.default_rng(11), [], 0.0
    for j, value in enumerate(values):
        shift = min(value, shift - 10 * EPS * norm) if out else value  # equal values get shifts apart
        cluster = [v for v, e in zip(out, values) if e - value < gap]
        x = rng.standard_normal(n)
        for step in range(steps):
            x /= np.abs(x).max()
            x = _solved(diagonal, off, shift, x, least)
            for _ in range(2):
                for v in cluster:
                    x -= (v @ x) * v
            x /= math.sqrt(x @ x)
            moved = diagonal * x - value * x
            moved[1:] += off * x[:-1]
            moved[:-1] += off * x[1:]
            if step >= 2 and np.abs(moved).max() <= 4 * least:
                break
        out.append(x)
    return np.array(out).reshape(len(values), n)


def eigenpairs(a: np.ndarray, k: int) -> tuple[list[float], np.ndarray]:
    """The k leading eigenvalues above rounding, falling, and their unit vectors as rows."""
    scale = 2.0 ** math.frexp(np.abs(a).max(initial=0.0))[1]  # exact, and keeps squares from overflow and underflow
    diagonal, off, reflectors = tridiagonal((a + a.T) / (2 * scale))
    values = leading_values(diagonal, off, k)
    floor = len(a) * EPS * max(abs(values[0]), 0.0) if values else 0.0
    values = [e for e in values if e > floor and e > 0]
    vectors = vectors_of(diagonal, off, values)
    for step in range(len(reflectors) - 1, -1, -1):
        v = reflectors[step]
        vectors[:, step + 1 :] -= 2.0 * np.outer(vectors[:, step + 1 :] @ v, v)
    return [e * scale for e in values], vectors


def _exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null where a long cannot hold it."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if largest * largest * max(1, x.shape[1]) < 2**63:
        moved = n * x - np.array(sums, np.int64)
        return (moved * moved).sum(axis=1).tolist()
    found = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [d if d < 2**63 else None for d in found]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and each of up to k components."""
    rows = durable(integer_vectors(vectors, id_col, vector_col))
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA + ", identity_error double")
    width = lengths.width
    rows = rows.where(F.size("x") == width)
    distinct = durable(rows.select("x").distinct())
    n, sums = exact_sums(distinct, "x", width)
    mean = np.array([s / n for s in sums])
    spread = covariance(distinct, "x", mean) / n
    values, components = eigenpairs(spread, k)
    k, trace = len(values), float(np.trace(spread))
    if not k:
        return vectors.sparkSession.createDataFrame([], SCHEMA + ", identity_error double")
    scaled = components / np.sqrt(values)[:, None]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(np.float64) - mean
            w = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * k), pa.array((x @ scaled.T).ravel()))
            yield pa.RecordBatch.from_arrays([w], ["w"])

    white = distinct.select("x").mapInArrow(project, "w array<double>")
    centre = np.array([r.m for r in white.select(F.posexplode("w").alias("i", "c")).groupBy("i").agg(F.avg("c").alias("m")).orderBy("i").collect()])
    error = float(np.abs(covariance(white, "w", centre) / n - np.eye(k)).max())
    explained = [e / trace for e in values]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), CHUNK):
                batch = whole.slice(at, CHUNK)
                x = _matrix(batch.column(1), width)
                deviation = _exact_deviation(x, n, sums)
                times = np.repeat(np.arange(len(batch)), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array(np.full(len(times), n)),
                    pa.array([deviation[t] for t in times], pa.int64()), pa.array(((x.astype(np.float64) - mean) @ scaled.T).ravel()), pa.array(np.tile(explained, len(batch))),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(place, SCHEMA).withColumn("identity_error", F.lit(error))
