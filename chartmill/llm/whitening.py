"""Whitening of embeddings: Welford moments of the distinct vectors, merged across partitions, and an eigen-solve by symmetric QR.

1. Every usable entry c becomes the fixed-point number floor(64 c) + 1000000. The fit list holds each distinct vector once.
2. A partition streams its vectors through Welford's rank-one update of mean and scatter; partitions are merged by the parallel update
   formula, :data:`FAN` at a time until :data:`FAN` are left, so the driver receives a bounded number of d x d matrices. Sums are kept
   exactly beside them, in two halves that do not overflow.
3. The driver solves one d x d matrix: Householder reflections to tridiagonal form, then implicit QR steps with Wilkinson's shift.
4. A second pass over the fit list measures how far the covariance of the whitened vectors is from the identity.

Defined cases: a null vector, one with a null, NaN or infinite entry, and one with an entry of 2^46 and more (which fixed-point numbers do
not hold) give no rows; so does an empty vector. Vectors of different lengths are fitted apart, each length by itself. Repeated rows count once in
the fit and are all returned; a null vec_id is returned like any other. Directions without variance have no component, so a single distinct
vector gives no rows, and neither does an empty table. A deviation beyond 63 bits is null. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

UNIT, OFFSET = 64, 1_000_000
#: Partial results that one task, or the driver, merges at once.
FAN = 32
#: Entries from here on have no fixed-point form.
LARGEST = float(2**46)
#: Sums are kept as their upper part and their lowest 20 bits, so that neither overflows.
HALF = 20


def fixed_point(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The usable rows, with ``x`` (array of long) in the place of the vector, and its length ``dim``."""
    c = F.col(vector)
    usable = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < F.lit(LARGEST)))
    return rows.where(F.coalesce(usable, F.lit(False))).withColumn("x", F.transform(c, lambda e: F.floor(e.cast("double") * UNIT) + OFFSET)).withColumn("dim", F.size("x"))


class Moments:
    """Count, mean and scatter (sum of centred products) of a stream of vectors, and their exact sum."""

    def __init__(self, dim: int):
        self.n, self.mean, self.scatter, self.high, self.low = 0, np.zeros(dim), np.zeros((dim, dim)), np.zeros(dim, np.int64), np.zeros(dim, np.int64)

    def add(self, vectors: np.ndarray) -> None:
        for v in vectors:
            self.n += 1
            before = v - self.mean
            self.mean += before / self.n
            self.scatter += np.multiply.outer(before, v - self.mean)

    def sum_exactly(self, vectors: np.ndarray) -> None:
        self.high += (vectors >> HALF).sum(axis=0)
        self.low += (vectors & ((1 << HALF) - 1)).sum(axis=0)

    def merge(self, other: Moments) -> None:
        """Chan's parallel update."""
        if other.n:
            n, apart = self.n + other.n, other.mean - self.mean
            self.scatter += other.scatter + np.multiply.outer(apart, apart) * (self.n * other.n / n)
            self.mean += apart * (other.n / n)
            self.n, self.high, self.low = n, self.high + other.high, self.low + other.low

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in (self.mean, self.scatter, self.high, self.low)]

    @classmethod
    def unpack(cls, dim: int, n: int, *parts: bytes) -> Moments:
        own = cls(dim)
        own.n = n
        own.mean, own.scatter = np.frombuffer(parts[0]).copy(), np.frombuffer(parts[1]).reshape(dim, dim).copy()
        own.high, own.low = (np.frombuffer(p, np.int64).copy() for p in parts[2:])
        return own

    def total(self) -> list[int]:
        """The exact sum, as Python integers."""
        return [(int(h) << HALF) + int(w) for h, w in zip(self.high, self.low, strict=True)]


PARTIAL = "dim int, part int, n long, mean binary, scatter binary, high binary, low binary"


def matrices(batch: pa.RecordBatch):
    """(dim, row numbers, x - 1000000 as a matrix) for each length in a batch with the columns x and dim."""
    dims, x = np.asarray(batch.column("dim")), batch.column("x")
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, np.asarray(x.take(pa.array(at)).flatten()).reshape(-1, dim) - OFFSET


def moments(fit: DataFrame, project: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> dict[int, Moments]:
    """By length: the moments of the vectors less 1000000, or of their projections ((vector - centre) @ axes)."""

    def stream(batches):
        from pyspark import TaskContext

        found: dict[int, Moments] = {}
        for batch in batches:
            for dim, _, y in matrices(batch):
                if project is None:
                    own = found.setdefault(dim, Moments(dim))
                    own.sum_exactly(y)
                    own.add(y.astype(float))
                elif dim in project:
                    centre, axes = project[dim]
                    found.setdefault(dim, Moments(axes.shape[1])).add((y - centre) @ axes)
        yield partials(found, TaskContext.get().partitionId())

    def merged(key, table: pa.Table):
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        size = len(rows[0]["mean"]) // 8
        own = Moments(size)
        for r in rows:
            own.merge(Moments.unpack(size, r["n"], r["mean"], r["scatter"], r["high"], r["low"]))
        return pa.Table.from_batches([partials({key[0].as_py(): own}, key[1].as_py())])

    parts = written(fit.mapInArrow(stream, PARTIAL))
    lengths = max(1, parts.select("dim").distinct().count())
    while parts.count() > FAN * lengths:
        parts = written(parts.withColumn("to", F.floor(F.col("part") / FAN).cast("int")).groupBy("dim", "to").applyInArrow(merged, PARTIAL))
    found: dict[int, Moments] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["dim"], r["part"])):
        size = len(r["mean"]) // 8
        found.setdefault(r["dim"], Moments(size)).merge(Moments.unpack(size, r["n"], r["mean"], r["scatter"], r["high"], r["low"]))
    return found


def partials(found: dict[int, Moments], part: int) -> pa.RecordBatch:
    packed = [m.pack() for m in found.values()]
    columns = [pa.array(list(found), pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array([m.n for m in found.values()], pa.int64())]
    return pa.RecordBatch.from_arrays(columns + [pa.array([p[k] for p in packed], pa.binary()) for k in range(4)], ["dim", "part", "n", "mean", "scatter", "high", "low"])


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and Q of matrix = Q T Q', by Householder reflections."""
    a = (matrix + matrix.T) / 2
    d = len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0 or length == abs(v[0]):
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k:]
        rest -= 2 * np.multiply.outer(v, v @ rest)
        right = a[k:, k + 1 :]
        right -= 2 * np.multiply.outer(right @ v, v)
        columns = q[:, k + 1 :]
        columns -= 2 * np.multiply.outer(columns @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_eigen(matrix: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns), by implicit QR steps on the tridiagonal form."""
    diagonal, below, q = tridiagonal(matrix)
    axes, d, eps = np.ascontiguousarray(q.T), len(diagonal), np.finfo(float).eps
    high, sweeps = d - 1, 0
    while high > 0:
        small = np.abs(below[:high]) <= eps * (np.abs(diagonal[:high]) + np.abs(diagonal[1 : high + 1]))
        below[:high][small] = 0
        if small[-1]:
            high, sweeps = high - 1, 0
            continue
        if (sweeps := sweeps + 1) > most_sweeps:
            raise ArithmeticError(f"no eigenvalue after {most_sweeps} QR steps")
        low = int(np.flatnonzero(small)[-1]) + 1 if small.any() else 0
        half = (diagonal[high - 1] - diagonal[high]) / 2
        shift = diagonal[high] - below[high - 1] ** 2 / (half + np.copysign(np.hypot(half, below[high - 1]), half if half else 1.0))
        x, z = diagonal[low] - shift, below[low]
        for k in range(low, high):
            length = np.hypot(x, z)
            c, s = (x / length, z / length) if length else (1.0, 0.0)
            if k > low:
                below[k - 1] = length
            p, r, e = diagonal[k], diagonal[k + 1], below[k]
            diagonal[k], diagonal[k + 1] = c * c * p + 2 * c * s * e + s * s * r, s * s * p - 2 * c * s * e + c * c * r
            below[k] = c * s * (r - p) + (c * c - s * s) * e
            if k < high - 1:
                x, z = below[k], s * below[k + 1]
                below[k + 1] *= c
            axes[k], axes[k + 1] = c * axes[k] + s * axes[k + 1], c * axes[k + 1] - s * axes[k]
    order = np.argsort(-diagonal, kind="stable")
    return diagonal[order], axes[order].T


def whiten(rows: DataFrame, most: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    points = fixed_point(rows, vector)
    fit = written(points.select("dim", "x").distinct())
    models = {}
    for dim, m in moments(fit).items():
        values, axes = symmetric_eigen(m.scatter / m.n)
        count = int((values[:most] > max(values[0], 0.0) * dim * np.finfo(float).eps).sum()) if m.n > 1 else 0
        if count:
            centre = np.array([t / m.n for t in m.total()])
            models[dim] = (m.n, m.total(), centre, axes[:, :count] / np.sqrt(values[:count]), values[:count] / values.sum())
    off = {dim: float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max()) for dim, m in moments(fit, {dim: (x[2], x[3]) for dim, x in models.items()}).items()} if models else {}

    def project(batches):
        for batch in batches:
            for dim, at, y in matrices(batch):
                if dim in models:
                    n, total, _, axes, explained = models[dim]
                    apart, width = centred(y, n, total), axes.shape[1]
                    z = (apart.astype(float) / n) @ axes
                    rows_ = pa.array(np.repeat(at, width))
                    columns = [batch.column(key).take(rows_), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(at))), pa.array(np.full(z.size, n, np.int64))]
                    columns += [pa.array(squares(apart), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), width))), pa.array(z.ravel()), pa.array(np.tile(explained, len(at))), pa.array(np.full(z.size, off[dim]))]
                    yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema[key].dataType.simpleString()
    return points.select(key, "x", "dim").mapInArrow(project, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def centred(y: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n y - total, exactly: in 64 bits where they hold it, else in Python integers."""
    if n * (int(np.abs(y).max(initial=0)) + 1) < 2**62 and max(map(abs, total)) < 2**62:
        return y * n - np.array(total, np.int64)
    return y.astype(object) * n - np.array(total, object)


def squares(apart: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; None where 63 bits do not hold it."""
    most = int(np.abs(apart).max(initial=0))
    if most * most * apart.shape[1] < 2**63:
        return (apart.astype(np.int64) ** 2).sum(axis=1).tolist()
    found = (apart.astype(object) ** 2).sum(axis=1)
    return [int(s) if s < 2**63 else None for s in found]
