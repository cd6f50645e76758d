"""Embedding whitening with eigenvectors from FEAST contour integration.

Vectors become whole numbers x = floor(64 c) + 1000000, so counts and sums are exact; every covariance is
taken of n x - S, centred before anything is multiplied. Tasks reduce their rows to a matrix of their own,
matrices are added row by row in a shuffle on the row number, and only the d x d covariance reaches the driver.

There the spectrum is cut into slices at its widest gaps. In a slice, Gauss-Legendre quadrature of
the solves (zI - V) Q = Y on a circle around it projects random vectors on the eigenvectors inside,
Rayleigh-Ritz takes values and vectors from that space, and both are repeated until the residuals are at rounding. The inertia
of V - sI at the ends of the slice (signs of the pivots of the tridiagonal form) says how many there have to be; where
some are missing, the space is widened.

Defined cases: rows whose vector is null or empty, has null or non-finite entries or entries of ``LARGEST`` or
more, or has another length than most vectors (of equally frequent lengths the longer holds) are dropped; a null or
repeated vec_id is a row like any other; components whose eigenvalue is zero (below ``ZERO`` of the largest) do not exist, so a table
of equal vectors, or of one, gives no rows; a deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries from here on are taken as non-finite, so that whole numbers stay far inside a long.
LARGEST = float(1 << 33)
#: Quadrature points on the upper half of a circle, eigenvalues of a slice, most rounds of refinement.
POINTS, SLICE, ROUNDS = 12, 8, 40
EPS = np.finfo(float).eps
#: Eigenvalues below this share of the largest are zero: their relative error would show in the whitened covariance.
ZERO = 1e5 * EPS


def usable(vector: Column) -> Column:
    """True where every entry is a number below ``LARGEST``; a comparison with NaN holds no entry back, so it is asked for."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)), F.lit(False))


def whole(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the usable rows."""
    v = F.col(f"`{vector}`").cast("array<double>")
    # A case, not a filter: the whole numbers are only taken of usable vectors.
    x = F.when(usable(v), F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))
    return rows.select(F.col(f"`{vec_id}`").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull())


def _matrices(column: pa.Array) -> Iterator[np.ndarray]:
    """The vectors of a batch as matrices, one a length."""
    lengths = np.diff(np.asarray(column.offsets))
    values = column.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(lengths)))
    for d in np.unique(lengths).tolist():
        yield values[(first[:-1][lengths == d][:, None] + np.arange(d)).ravel()].reshape(-1, d)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Count and sums of the vectors of the prevailing length; (0, []) without vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for x in _matrices(batch.column(0)):
                n, total = found.get(x.shape[1], (0, 0))
                found[x.shape[1]] = (n + len(x), total + x.sum(0))
        out = [(d, n, total.tolist()) for d, (n, total) in found.items()]
        yield pa.record_batch([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], ["d", "n", "total"])

    parts = rows.select("x").mapInArrow(add, "d int, n long, total array<long>")
    by_place = parts.select("d", "n", F.posexplode("total").alias("place", "total")).groupBy("d", "place")
    added = by_place.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    each = added.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "total"))).alias("totals"))
    best = each.orderBy(F.desc("n"), F.desc("d")).first()
    return (0, []) if best is None else (best.n, [int(t.total) for t in best.totals])


class Centre:
    """n x - S as whole numbers, and x - S/n."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.d = n, len(total)
        self.total = np.array(total, object)

    def exact(self, x: np.ndarray) -> np.ndarray:
        if self.n * max(int(np.abs(x).max(initial=0)), max(map(abs, self.total), default=0) // max(self.n, 1) + 1) < 1 << 61:
            return x * self.n - self.total.astype(np.int64)
        return x.astype(object) * self.n - self.total

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        exact = self.exact(x)
        if exact.dtype != object and self.d * int(np.abs(exact).max(initial=0)) ** 2 >= 1 << 63:
            exact = exact.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (exact * exact).sum(1)]


def moments(rows: DataFrame, centre: Centre, maps: np.ndarray | None = None) -> np.ndarray:
    """Sum over the rows of v v' for v = (1, centred x) or (1, centred x times ``maps``); the first row has the sums."""
    width = 1 + (centre.d if maps is None else maps.shape[1])
    kind = "place int, cells array<double>"

    def part(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.int32()), pa.array([c.tolist() for c in total.values()], pa.list_(pa.float64()))], ["place", "cells"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for x in _matrices(batch.column(0)):
                if x.shape[1] == centre.d:
                    v = centre.centred(x)
                    v = np.column_stack([np.ones(len(v)), v if maps is None else v @ maps])
                    total += v.T @ v
        yield part(dict(enumerate(total)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column(1).flatten().to_numpy().reshape(-1, width)
            for place, row in zip(batch.column(0).to_pylist(), cells):
                total[place] = total[place] + row if place in total else row
        yield part(total)

    added = rows.select("x").mapInArrow(multiply, kind).repartition("place").mapInArrow(add, kind)
    return np.array([r.cells for r in added.orderBy("place").collect()])


# Eigenvectors ------------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a similar tridiagonal matrix, by reflections."""
    a = matrix.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def inertia(form: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: the negative pivots of the shifted form."""
    diagonal, off = form
    tiny = EPS * EPS * max(1.0, np.abs(diagonal).max())
    pivot = diagonal[0] - shifts
    below = (pivot < 0).astype(int)
    for value, square in zip(diagonal[1:], off):
        pivot = value - shifts - square / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def spectrum(form: tuple[np.ndarray, np.ndarray], rounds: int = 30) -> tuple[np.ndarray, float]:
    """All eigenvalues, falling, to about 2**-rounds of the largest, by bisection on the inertia; and a bound of them."""
    diagonal, off = form
    bound = float(np.abs(diagonal).max() + 2 * np.sqrt(off.max(initial=0.0)))
    low, high, place = np.full(len(diagonal), -bound), np.full(len(diagonal), bound), np.arange(len(diagonal))
    for _ in range(rounds + 1):
        middle = (low + high) / 2
        below = inertia(form, middle) <= place
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return ((low + high) / 2)[::-1], bound


def slices(values: np.ndarray, bound: float, want: int) -> list[tuple[float, float]]:
    """(low, high) around about ``SLICE`` eigenvalues each, cut at wide gaps, until ``want`` are inside."""
    gaps = np.append(values[:-1] - values[1:], np.inf)
    margin = max(0.1 * (values[0] - values[-1]), 1e-6 * bound)
    out, high, start = [], values[0] + margin, 0
    while start < want:
        least = min(start + SLICE // 2, want) - 1
        some = np.arange(least, min(start + SLICE, len(values)))
        some = some[some >= want - 1] if want - start <= SLICE and len(some[some >= want - 1]) else some
        end = int(some[np.argmax(gaps[some])])
        while gaps[end] <= 1e-7 * bound:  # inside a cluster: on to its end
            end += 1
        low = values[end] - margin if end + 1 == len(values) else (values[end] + values[end + 1]) / 2
        out.append((low, high))
        high, start = low, end + 1
    return out


def _project(matrix: np.ndarray, low: float, high: float, basis: np.ndarray) -> np.ndarray:
    """The contour integral of the resolvent around [low, high], applied to ``basis``."""
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    middle, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(basis)
    for node, weight in zip(nodes, weights):
        turn = np.exp(0.5j * np.pi * (1 - node))
        solved = np.linalg.solve((middle + radius * turn) * np.eye(len(matrix)) - matrix, basis.astype(complex))
        out += weight / 2 * (radius * turn * solved).real
    return out


def _ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, _ = np.linalg.qr(basis)
    q, _ = np.linalg.qr(q)
    small = q.T @ matrix @ q
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values, q @ turn


def inside(matrix: np.ndarray, form: tuple, bound: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues in (low, high) and their vectors; as many as the inertia says."""
    ends = inertia(form, np.array([low, high]))
    count, d = int(ends[1] - ends[0]), len(matrix)
    width, draw = min(d, max(count + 4, 3 * count // 2)), np.random.default_rng(d)
    while True:
        basis, last = draw.standard_normal((d, width)), np.inf
        for _ in range(ROUNDS):
            values, vectors = _ritz(matrix, basis if width == d else _project(matrix, low, high, basis))
            rest = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
            here = (values > low) & (values < high) & (rest <= 1e-9 * bound)
            worst = rest[here].max(initial=0.0)
            if here.sum() == count and (worst <= 2 * EPS * bound or worst >= last / 2 or width == d):
                return values[here], vectors[:, here]
            last, basis = worst if here.sum() == count else np.inf, vectors
        if width == d:
            raise ArithmeticError(f"{count} eigenvalues expected between {low} and {high}, {int(here.sum())} found")
        width = min(d, 2 * width)


def eigen(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above rounding, falling, and unit vectors as columns; the largest entry of each is positive."""
    d = len(matrix)
    form = tridiagonal(matrix)
    values, bound = spectrum(form)
    want = min(most, d - int(inertia(form, np.array([ZERO * bound]))[0])) if bound > 0 else 0
    if want <= 0:
        return np.zeros(0), np.zeros((d, 0))
    found = [inside(matrix, form, bound, low, high) for low, high in slices(values, bound, want)]
    values, vectors = _ritz(matrix, np.hstack([v for _, v in found]))
    order = np.argsort(-values, kind="stable")[:want]
    values, vectors = values[order], vectors[:, order]
    peak = vectors[np.abs(vectors).argmax(0), np.arange(want)]
    return values, vectors * np.where(peak < 0, -1.0, 1.0)


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component."""
    kept = whole(rows, vec_id, vector)
    n, total = sums(kept)
    centre = Centre(n, total)
    covariance = moments(kept, centre)[1:, 1:] / n if n else np.zeros((0, 0))
    covariance = (covariance + covariance.T) / 2
    values, vectors = eigen(covariance, most) if n else (np.zeros(0), np.zeros((0, 0)))
    maps = vectors / np.sqrt(values)
    explained, error = (values / np.trace(covariance)).tolist() if n else [], 0.0
    if len(values):
        after = moments(kept, centre, maps) / n
        error = float(np.abs(after[1:, 1:] - np.outer(after[0, 1:], after[0, 1:]) - np.eye(len(values))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.diff(np.asarray(batch.column(1).offsets)) == centre.d
            for x in _matrices(batch.column(1)):
                if x.shape[1] == centre.d and len(values):
                    w = centre.centred(x) @ maps
                    cells = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], w.ravel())
                    yield pa.record_batch([batch.column(0).filter(pa.array(fits)), pa.array(centre.deviations(x), pa.int64()), cells], ["vec_id", "deviation", "cells"])

    done = kept.mapInArrow(project, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, deviation long, cells array<double>")
    each = done.select("vec_id", "deviation", F.posexplode("cells").alias("place", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained]) if explained else F.array().cast("array<double>")
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
