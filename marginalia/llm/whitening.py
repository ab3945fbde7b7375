"""Whitening of embeddings by a singular value decomposition of the centred rows, without their covariance.

Tasks reduce their centred rows to triangles by blockwise QR, and triangles are stacked and reduced again, `FAN_IN` at a time, until
one is left: its singular values and right vectors are those of all rows. The triangle (dimensions squared, so of a proven size)
is brought to two diagonals by Householder reflections. dqds finds the squares of its singular values, each with high relative
accuracy; twisted factorisations of the tridiagonal B'B give each vector, and vectors of near values are made orthogonal to each other.

Vectors that are null or empty, hold null or non-finite entries or such as need more than 50 bits when scaled, or have another length
than most (of equally frequent lengths the longest counts) are left out. An entry c becomes floor(scale * c) + shift, a whole number, so that counts, sums and deviations
are exact; a deviation that needs more than 64 bits is null. Components without variance (relative to the first below
`LEAST`) aren't returned, so that equal vectors, fewer vectors than dimensions, and an empty table give fewer rows or none. Repeated
ids are rows of their own. Equal eigenvalues have no order of their own: any orthogonal basis of theirs is a right answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.workspace import written

#: Triangles that one task stacks, rows of a block, and the least share of the first eigenvalue that counts as variance.
FAN_IN, BLOCK_ROWS, LEAST = 32, 4096, 1e-13
_EPS = np.finfo(np.float64).eps


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor P of a square matrix: r = Q B P', by Householder reflections from both sides."""
    a, n = r.astype(np.float64).copy(), len(r)
    p = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        v, norm = x.copy(), float(np.linalg.norm(x))
        if norm == 0.0:
            return v, 0.0
        v[0] += math.copysign(norm, v[0])
        return v, 2.0 / float(v @ v)

    for k in range(n):
        v, tau = reflector(a[k:, k])
        a[k:, k:] -= tau * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v, tau = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= tau * np.outer(a[k:, k + 1 :] @ v, v)
            p[:, k + 1 :] -= tau * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential quotient-difference step with a shift; None where the shift was too large."""
    n = len(q)
    d = q[0] - shift
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        if not d >= 0.0:
            return None
        new_q[i] = d + e[i]
        if new_q[i] == 0.0:
            new_e[i], d = 0.0, q[i + 1] - shift
        else:
            ratio = q[i + 1] / new_q[i]
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
    if not d >= 0.0:
        return None
    new_q[-1] = d
    return new_q, new_e


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray, most_steps: int = 200) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling: dqds with shifts from below and deflation at the end."""
    found: list[float] = []
    parts = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper])]
    scale = max((x for x in [*parts[0][0], *parts[0][1]]), default=0.0)
    tiny = scale * np.finfo(np.float64).tiny / _EPS
    while parts:
        q, e = parts.pop()
        total, steps = 0.0, 0
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + total)
                break
            if e[-1] <= _EPS * _EPS * (total + q[-1]) or e[-1] <= tiny:
                found.append(q.pop() + total)
                e.pop()
                steps = 0
                continue
            split = next((i for i in range(n - 2, -1, -1) if e[i] <= _EPS * _EPS * (total + min(q[i], q[i + 1])) or e[i] <= tiny), None)
            if split is not None and total == 0.0:
                parts.append((q[: split + 1], e[:split]))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            # The least value of the last two rows is an upper bound for the least of all; a step that fails tries less, and at last none.
            a, b, c = q[-2], q[-1], e[-1]
            s = a + b + c
            least = 2 * a * b / (s + math.sqrt(max(s * s - 4 * a * b, 0.0))) if s > 0.0 else 0.0
            shift = least * (1.0 - math.sqrt(min(1.0, c / s))) if steps < most_steps and s > 0.0 else 0.0
            step = None
            for _ in range(8):
                step = _dqds(q, e, shift)
                if step is not None or shift == 0.0:
                    break
                shift = shift * 0.25 if shift > tiny else 0.0
            if step is None:
                shift, step = 0.0, _dqds(q, e, 0.0)
            assert step is not None  # without a shift nothing gets negative
            q, e = step
            total += shift
            steps += 1
    return np.sort(np.array(found))[::-1]


def _twisted(diagonal: np.ndarray, off: np.ndarray, value: float) -> np.ndarray:
    """The vector of a tridiagonal matrix at a close eigenvalue: factorised from the top and from the bottom, twisted where they meet best."""
    n = len(diagonal)
    small = _EPS * max(float(np.abs(diagonal).max()), 1e-300) * 1e-3
    top, bottom = np.empty(n), np.empty(n)
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    top[0] = diagonal[0] - value
    for i in range(n - 1):
        pivot = top[i] if abs(top[i]) > small else math.copysign(small, top[i])
        down[i] = off[i] / pivot
        top[i + 1] = diagonal[i + 1] - value - down[i] * off[i]
    bottom[-1] = diagonal[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = bottom[i + 1] if abs(bottom[i + 1]) > small else math.copysign(small, bottom[i + 1])
        up[i] = off[i] / pivot
        bottom[i] = diagonal[i] - value - up[i] * off[i]
    at = int(np.argmin(np.abs(top + bottom - (diagonal - value))))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal matrix as columns, in the order of the squares; zeros for those without variance.

    Vectors whose values lie within a thousandth of each other are made orthogonal and turned within their span (Rayleigh-Ritz), so
    that near values don't mix their vectors.
    """
    n = len(diagonal)
    main = diagonal**2 + np.concatenate([[0.0], upper**2])
    off = diagonal[:-1] * upper
    b = np.diag(diagonal) + np.diag(upper, 1)
    out = np.zeros((n, n))
    if n == 0 or squares[0] <= 0.0:
        return np.eye(n)
    start, last = 0, int(np.count_nonzero(squares > LEAST * squares[0]))
    while start < last:
        stop = start + 1
        while stop < last and squares[stop - 1] - squares[stop] <= 1e-3 * squares[stop - 1]:
            stop += 1
        near = np.empty((n, 0))
        for k in range(start, stop):
            z = _twisted(main, off, squares[k])
            for attempt in range(4):
                before = out[:, :start]
                rest = z - before @ (before.T @ z) if attempt else z
                rest = rest - near @ (near.T @ rest)
                rest = rest - near @ (near.T @ rest)
                size = float(np.linalg.norm(rest))
                if size > 1e-3:
                    break
                z = np.cos((attempt + 1.0) * (np.arange(n) + 1.0) * (k + 1.0))  # the span lacks a direction: any other start will do
                for j in range(3):
                    z = _solved(main, off, squares[k] * (1.0 + 4.0 * _EPS * (j + 1)), z)
            near = np.column_stack([near, rest / size if size > 0.0 else rest])
        if stop - start > 1:
            _, _, turn = np.linalg.svd(b @ near, full_matrices=False)
            near = near @ turn.T
        out[:, start:stop] = near
        start = stop
    return out


def _solved(main: np.ndarray, off: np.ndarray, value: float, z: np.ndarray) -> np.ndarray:
    """A step of inverse iteration."""
    matrix = np.diag(main - value) + np.diag(off, 1) + np.diag(off, -1)
    try:
        z = np.linalg.solve(matrix, z)
    except np.linalg.LinAlgError:
        z = np.linalg.lstsq(matrix, z, rcond=None)[0]
    return z / np.linalg.norm(z)


def principal(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, falling, and the right singular vectors (columns) of a square matrix."""
    size = float(np.abs(triangle).max()) if triangle.size else 0.0
    if size == 0.0:
        return np.zeros(len(triangle)), np.eye(len(triangle))
    diagonal, upper, p = bidiagonal(triangle / size)
    squares = squared_singular_values(diagonal, upper)
    return squares * size * size, p @ right_vectors(diagonal, upper, squares)


def _matrix(column: pa.Array, width: int, scale: int, shift: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(scale * values)).astype(np.int64).reshape(-1, width) + shift


def _blocks(batches: Iterable[pa.RecordBatch], width: int, scale: int, shift: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(a, BLOCK_ROWS)
            yield part.column("vec_id"), _matrix(part.column("vector"), width, scale, shift)


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangle of at least as many rows as columns."""
    width = rows.shape[1]
    if len(rows) < width:
        rows = np.concatenate([rows, np.zeros((width - len(rows), width))])
    return np.linalg.qr(rows, mode="r")


def _reduced(centred: DataFrame, width: int) -> np.ndarray:
    """One triangle of all: stacked FAN_IN at a time by tasks, the last few by the last task."""

    def stacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = np.zeros((0, width))
        for batch in batches:
            for raw in batch.column("r").to_pylist():
                triangle = _triangle(np.concatenate([triangle, np.frombuffer(raw).reshape(width, width)]))
        if len(triangle):
            yield pa.RecordBatch.from_arrays([pa.array([triangle.tobytes()])], names=["r"])

    triangles, left = centred, centred.count()
    while left > 1:
        parts = -(-left // FAN_IN)
        triangles = written(triangles.repartition(parts).mapInArrow(stacked, "r binary"), "triangles")
        left = triangles.count()
    rows = triangles.collect()
    return np.frombuffer(rows[0].r).reshape(width, width) if rows else np.zeros((width, width))


class Whitening:
    """A fitted whitening: n, exact sums, eigenvalues of the covariance, the components as columns, and its trace."""

    def __init__(self, n: int, sums: list[int], triangle: np.ndarray, components: int) -> None:
        squares, vectors = principal(triangle)
        self.n, self.sums, self.width = n, sums, len(sums)
        values = squares / n if n else squares
        self.trace = float(values.sum())
        kept = int(np.count_nonzero(values > LEAST * values[0])) if n and len(values) and values[0] > 0.0 else 0
        self.components = min(kept, components)
        self.values, self.vectors = values[: self.components], vectors[:, : self.components]
        self.weights = self.vectors / np.sqrt(self.values)
        # x - S/n = (x - floor(S/n)) - rest/n: no large numbers are subtracted from each other.
        self.whole = np.array([s // n for s in sums], np.int64) if n else np.zeros(self.width, np.int64)
        self.rest = np.array([(s % n) / n for s in sums]) if n else np.zeros(self.width)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.weights

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums over dimensions of (n * x - S)**2, exact."""
        apart = x - self.whole
        most = int(np.abs(apart).max()) if apart.size else 0
        n, remainders = self.n, [s % self.n for s in self.sums]
        if self.width * (n * (most + 1)) ** 2 < 2**63:
            return pa.array(((n * apart - np.array(remainders, np.int64)) ** 2).sum(axis=1))
        exact = [sum((n * a - r) ** 2 for a, r in zip(row, remainders, strict=True)) for row in apart.tolist()]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def usable(embeddings: DataFrame, id_column: str, vector_column: str, scale: int) -> tuple[DataFrame, int]:
    """vec_id and vector of the rows that count, and the vectors' length."""
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= 2.0**50 / scale)))
    lengths = finite.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = int(lengths[0].width) if lengths else 0
    return finite.where(F.size("vector") == width), width


def fit(rows: DataFrame, width: int, components: int, scale: int, shift: int) -> Whitening:
    """Exact counts and sums first, then the triangle of the centred rows."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for _, x in _blocks(batches, width, scale, shift):
            n += len(x)
            total = [t + s for t, s in zip(total, (x - shift).sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]])], names=["n", "total"])

    each = rows.mapInArrow(sums, "n long, total array<string>").select("n", F.posexplode("total").alias("k", "total"))
    added = each.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("k").collect()
    n = int(added[0].n) if added else 0
    total = [int(a.total) + shift * n for a in added]
    empty = Whitening(n, total, np.zeros((width, width)), 0)
    if not n:
        return empty

    def triangles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = np.zeros((0, width))
        for _, x in _blocks(batches, width, scale, shift):
            triangle = _triangle(np.concatenate([triangle, empty.centred(x)]))
        if len(triangle):
            yield pa.RecordBatch.from_arrays([pa.array([triangle.tobytes()])], names=["r"])

    return Whitening(n, total, _reduced(written(rows.mapInArrow(triangles, "r binary"), "triangles"), width), components)


def identity_error(rows: DataFrame, w: Whitening, scale: int, shift: int) -> float:
    """The largest entry of the whitened rows' covariance less the identity; the products are added up by tasks."""
    k = w.components

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, line, seen = np.zeros((k, k)), np.zeros(k), False
        for _, x in _blocks(batches, w.width, scale, shift):
            y = w.apply(x)
            square, line, seen = square + y.T @ y, line + y.sum(axis=0), True
        if seen:
            flat = np.concatenate([square.ravel(), line])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "value"])

    added = rows.mapInArrow(products, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    flat = np.array([a.value for a in added])
    if not len(flat):
        return 0.0
    mean = flat[k * k :] / w.n
    return float(np.abs(flat[: k * k].reshape(k, k) / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened_components(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, width = usable(embeddings, id_column, vector_column, scale)
    w = fit(rows, width, components, scale, shift)
    error = identity_error(rows, w, scale, shift) if w.components else 0.0
    k = w.components

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, width, scale, shift):
            if k:
                n = len(x) * k
                row = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(n, w.n)), w.deviations(x).take(row), pa.array(w.apply(x).ravel()), pa.array(np.tile(w.values / w.trace, len(x))), pa.array(np.full(n, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
