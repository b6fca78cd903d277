"""Whitening of vectors: centred covariance, its leading eigenvectors, and the projection of all rows.

Entries become whole numbers, so sums and products of the rows are added up exactly, in any
order and on any number of tasks: ``n * n * V`` is a matrix of integers, rounded once. Rows are
centred by the whole number nearest to the mean before they are multiplied, and the rest of the
mean (at most one half) is taken off exactly. The d x d matrix meets on the driver; its size is
the square of the dimension, whatever the number of rows. There it is made tridiagonal by
Householder reflections, the leading eigenvalues are found by bisection on Sturm counts, and the
components by inverse iteration, orthogonalised again within clusters of close eigenvalues. They
are broadcast with the plan that projects the rows.

Results. Rows whose vector is null or holds a null or non-finite entry are dropped. Shorter
vectors (empty ones too) count as filled up with zeros. Repeated rows and ties count as often as they occur.
Whole numbers beyond +-2^62 are held there. Components whose eigenvalue is zero to working
precision (fewer rows than dimensions, constant or repeated dimensions) don't exist, so there may
be fewer than asked for, or none: ``whitened`` is then shorter, or empty. ``deviation`` is null where
it exceeds a long. Extra columns stay; of those named like an added one, the added one stays. An
empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from cloakframe.llm.frames import importable

_HOLD = float(1 << 62)
_EXACT = 1 << 53


@dataclass
class Whitening:
    """What ``fit`` has learnt. ``components`` holds unit eigenvectors as columns; ``values`` their eigenvalues, falling."""

    scale: float
    shift: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    centre: list[int] = field(default_factory=list)
    covariance: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def explained(self) -> list[float]:
        trace = float(np.trace(self.covariance))
        return [float(v) / trace for v in self.values]


# -- eigenvectors ----------------------------------------------------------------------------
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections that make symmetric ``a`` tridiagonal."""
    a = np.array(a, float)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        v = v / size if size else v
        reflections.append(v)
        if size:
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] -= 2 * v * (v @ x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection: the Sturm count of x is the number of eigenvalues below x."""
    d = len(diagonal)
    reach = np.abs(np.r_[off, 0.0]) + np.abs(np.r_[0.0, off])
    bound = max(float(np.max(np.abs(diagonal) + reach)), np.finfo(float).tiny)
    tiny = np.finfo(float).tiny / np.finfo(float).eps + np.finfo(float).eps ** 2 * bound
    low, high = np.full(k, -bound * 1.001), np.full(k, bound * 1.001)
    index = d - 1 - np.arange(k)  # of the wanted eigenvalue, ascending from 0
    for _ in range(200):
        x = low + (high - low) / 2
        if np.all((x <= low) | (x >= high)):
            break
        below = np.zeros(k, int)
        q = diagonal[0] - x
        for i in range(d):
            if i:
                q = diagonal[i] - x - off[i - 1] ** 2 / q
            q = np.where(np.abs(q) < tiny, -tiny, q)
            below += q < 0
        right = below <= index
        low, high = np.where(right, x, low), np.where(right, high, x)
    return low + (high - low) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, least: float):
    """Gaussian elimination with row exchanges of the tridiagonal matrix less ``value``; a function that solves for a right side."""
    d = len(diagonal)
    u0, u1, u2 = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * d
    steps = []
    for i in range(d - 1):
        below0, below1, below2 = float(off[i]), u0[i + 1], u1[i + 1]
        swap = abs(below0) > abs(u0[i])
        if swap:
            (u0[i], u1[i], u2[i]), (below0, below1, below2) = (below0, below1, below2), (u0[i], u1[i], u2[i])
        if abs(u0[i]) < least:
            u0[i] = least if u0[i] >= 0 else -least
        factor = below0 / u0[i]
        u0[i + 1], u1[i + 1] = below1 - factor * u1[i], below2 - factor * u2[i]
        steps.append((swap, factor))
    if abs(u0[-1]) < least:
        u0[-1] = least if u0[-1] >= 0 else -least

    def solve(y: np.ndarray) -> np.ndarray:
        y = y.tolist()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor * y[i]
        for i in range(d - 1, -1, -1):
            for j, u in ((i + 1, u1), (i + 2, u2)):
                if j < d:
                    y[i] -= u[i] * y[j]
            y[i] /= u0[i]
        return np.array(y)

    return solve


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric ``a``, falling, and their unit eigenvectors as columns."""
    d = len(a)
    size = float(np.max(np.abs(a))) if d else 0.0
    if not size:
        return np.zeros(k), np.eye(d, k)
    diagonal, off, reflections = tridiagonal(a / size)
    values = eigenvalues(diagonal, off, k)
    norm = float(np.max(np.abs(diagonal) + np.abs(np.r_[off, 0.0]) + np.abs(np.r_[0.0, off])))
    rng = np.random.default_rng(0)
    found: list[np.ndarray] = []
    start, at = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            start = j  # a new cluster
        at = min(float(value), at - 4 * np.finfo(float).eps * norm) if j > start else float(value)
        solve = _solver(diagonal, off, at, np.finfo(float).eps * norm)
        x = rng.normal(size=d)
        for _ in range(5):
            x = solve(x / np.linalg.norm(x))
            for _ in range(2):
                for other in found[start:]:
                    x -= (other @ x) * other
        found.append(x / np.linalg.norm(x))
    vectors = np.column_stack(found)
    for i in range(len(reflections) - 1, -1, -1):
        v, below = reflections[i], vectors[i + 1 :]
        below -= 2 * np.outer(v, v @ below)
    return values * size, vectors


# -- rows --------------------------------------------------------------------------------------
def _usable(vectors: DataFrame) -> DataFrame:
    c = F.col("vector").cast("array<double>")
    odd = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.withColumn("vector", c).filter(c.isNotNull() & ~odd)


def _ragged(column: pa.Array, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all entries: their whole numbers, rows and dimensions."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(scale * flat), -_HOLD, _HOLD).astype(np.int64) + shift
    return x, np.repeat(np.arange(len(lengths)), lengths), np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _matrix(column: pa.Array, m: Whitening) -> np.ndarray:
    """The whole numbers less the centre, row by row; Python's integers where 64 bits might not do."""
    x, row, dim = _ragged(column, m.scale, m.shift)
    full = np.full((len(column), len(m.centre)), m.shift, np.int64)
    full[row, dim] = x
    return full - np.array(m.centre, np.int64) if max(map(abs, m.centre), default=0) < 1 << 61 and np.abs(full.astype(float)).max(initial=0) < 1 << 61 else full.astype(object) - np.array(m.centre, object)


def _sums(vectors: DataFrame, scale: float, shift: int) -> dict[int, tuple[int, int]]:
    def work(batches):
        totals: dict[int, list[int]] = {}
        for batch in batches:
            x, _, dim = _ragged(batch.column(0), scale, shift)
            count = np.bincount(dim)
            if len(x) * np.abs(x.astype(float)).max(initial=0) < 1 << 62:
                part = np.zeros(len(count), np.int64)
            else:
                part = np.zeros(len(count), object)
                x = x.astype(object)
            np.add.at(part, dim, x)
            rows = totals.setdefault(-1, [0, 0])
            rows[0] += batch.num_rows
            for j, (c, s) in enumerate(zip(count.tolist(), part.tolist(), strict=True)):
                t = totals.setdefault(j, [0, 0])
                t[0] += c
                t[1] += int(s)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t[0] for t in totals.values()], pa.int64()), pa.array([Decimal(t[1]) for t in totals.values()], pa.decimal128(38, 0))], ["j", "n", "s"])

    parts = vectors.select("vector").mapInArrow(work, "j int, n long, s decimal(38,0)")
    return {r.j: (r.n, int(r.s)) for r in parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}


def _products(vectors: DataFrame, m: Whitening) -> DataFrame:
    """i, j, exact, rough: what the rows add to the sum of products of dimensions i <= j; rough where doubles hold no exact sum."""
    d = len(m.centre)
    i, j = np.triu_indices(d)

    def work(batches):
        exact, rough = np.zeros((d, d), object), np.zeros((d, d))
        for batch in batches:
            y = _matrix(batch.column(0), m)
            most = int(max(abs(y.max(initial=0)), abs(y.min(initial=0)))) ** 2
            if most * 64 < _EXACT:
                step = max(1, min(len(y), _EXACT // max(most, 1)))
                for a in range(0, len(y), step):
                    part = y[a : a + step].astype(float)
                    exact += (part.T @ part).astype(np.int64).astype(object)
            else:
                part = y.astype(float)
                rough += part.T @ part
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in exact[i, j]], pa.decimal128(38, 0)), pa.array(rough[i, j], pa.float64())],
            ["i", "j", "exact", "rough"],
        )

    return vectors.select("vector").mapInArrow(work, "i int, j int, exact decimal(38,0), rough double")


def fit(vectors: DataFrame, k: int = 32, scale: float = 64.0, shift: int = 1_000_000) -> Whitening:
    """The leading components of all vectors of ``vector``, whose entries c become floor(scale * c) + shift."""
    importable(vectors.sparkSession)
    vectors = _usable(vectors)
    m = Whitening(scale, shift)
    sums = _sums(vectors, scale, shift)
    m.n = sums.pop(-1, (0, 0))[0]
    if not sums:
        return m
    n, d = m.n, len(sums)
    m.sums = [sums[j][1] + shift * (n - sums[j][0]) for j in range(d)]
    m.centre = [(2 * s + n) // (2 * n) for s in m.sums]
    cells = _products(vectors, m).groupBy("i", "j").agg(F.sum("exact").alias("exact"), F.sum("rough").alias("rough")).collect()
    rest = [s - n * c for s, c in zip(m.sums, m.centre, strict=True)]
    v = np.zeros((d, d))
    for r in cells:
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.exact) - rest[r.i] * rest[r.j]) / (n * n) + r.rough / n
    m.covariance = v
    values, vectors_ = leading(v, min(k, d))
    real = values > d * np.finfo(float).eps * max(values[0], 0.0)
    m.values, m.components = values[real], vectors_[:, real]
    return m


def whiten(vectors: DataFrame, m: Whitening) -> DataFrame:
    """``vectors`` (those in use) with ``deviation``, the exact sum over dimensions of (n * x - S)^2, and ``whitened``, an array over components."""
    rows = _usable(vectors.drop("deviation", "whitened"))
    schema = StructType([*rows.schema.fields]).add("deviation", LongType()).add("whitened", ArrayType(DoubleType()))
    project = m.components / np.sqrt(m.values) if len(m.values) else np.zeros((len(m.centre), 0))
    rest = [s - m.n * c for s, c in zip(m.sums, m.centre, strict=True)]

    def work(batches):
        for batch in batches:
            y = _matrix(batch.column(batch.schema.names.index("vector")), m)
            near = np.abs(y.astype(float)) * m.n + m.n  # no less than |n * x - S|
            small = (near * near).sum(axis=1) < 1 << 62
            off = y.astype(object) * m.n - np.array(rest, object) if not small.all() or y.dtype == object else y * m.n - np.array(rest, np.int64)
            if off.dtype == object:
                deviation = [int(t) if t < 1 << 63 else None for t in (off * off).sum(axis=1).tolist()] if off.shape[1] else [0] * len(y)
            else:
                deviation = (off * off).sum(axis=1).tolist()
            w = (off.astype(float) / m.n) @ project
            starts = np.arange(len(y) + 1, dtype=np.int32) * w.shape[1]
            whitened = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.ascontiguousarray(w).ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deviation, pa.int64()), whitened], [*batch.schema.names, "deviation", "whitened"])

    return rows.mapInArrow(work, schema)


def identity_error(vectors: DataFrame, m: Whitening) -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured on all rows (none without components)."""
    k = len(m.values)
    if not k:
        return None
    i, j = np.triu_indices(k + 1)

    def work(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            w = np.column_stack([np.ones(len(w)), w])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    cells = {(r.i, r.j): r.s / m.n for r in whiten(vectors, m).select("whitened").mapInArrow(work, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    return max(abs(c - cells[0, a] * cells[0, b] - (a == b)) for (a, b), c in cells.items() if a)
