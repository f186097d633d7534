"""Whitening of embeddings: leading components of the covariance by contour integration (FEAST)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.common import table

#: Eigenvalues sought in one interval, quadrature nodes on its upper half circle, rounds of subspace iteration at most.
INTERVAL, NODES, ROUNDS = 8, 8, 30
#: Up to here sums of products of whole numbers are exact in double precision.
EXACT = 1 << 53
#: Largest absolute value of a grid entry, so that no long overflows when a vector is put on the grid.
LARGEST = 1 << 61


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) of the rows whose vector holds entries, all of them finite."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return rows.filter((F.size("vector") > 0) & finite)


def on_grid(column: pa.Array | pa.ChunkedArray, dim: int, scale: float, shift: int) -> np.ndarray:
    """Rows of whole numbers: floor(scale * entry) + shift."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    steps = np.floor(scale * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(steps) and np.abs(steps).max() > LARGEST:
        raise OverflowError(f"an entry times {scale} is beyond {LARGEST}")
    return steps.astype(np.int64).reshape(-1, dim) + shift


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers, exactly: in double precision where nothing can be rounded, else in Python's integers."""
    reach = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if reach < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a.astype(object) @ b.astype(object)


# --- moments ---------------------------------------------------------------------------------------------------------


def _totals(scale: float, shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each length of vectors: how many a task has, and their sum by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                rows = on_grid(batch.filter(pa.array(sizes == dim)).column("vector"), dim, scale, shift).astype(object)
                n, sums = found.get(dim, (0, np.zeros(dim, object)))
                found[dim] = n + len(rows), sums + rows.sum(axis=0)
        for dim, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))],
                names=["dim", "i", "n", "s"],
            )

    return run


def _products(dim: int, scale: float, shift: int, centre: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over a task's rows of products of the entries less the whole-number centre, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        middle = np.array(centre, np.int64)
        for batch in batches:
            rows = on_grid(batch.column("vector"), dim, scale, shift) - middle
            widest = int(np.abs(rows).max(initial=1)) ** 2
            step = max(1, EXACT // (2 * widest))  # rows whose products add up exactly in double precision
            for low in range(0, len(rows), step):
                total = total + exact_product(rows[low : low + step].T, rows[low : low + step])
        i, j = np.tril_indices(dim)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], names=["i", "j", "v"]
        )

    return run


class Moments(NamedTuple):
    """Rows, their exact sums by dimension, their covariance (divisor ``n``)."""

    n: int
    sums: list[int]
    covariance: np.ndarray


def moments(vectors: DataFrame, scale: float, shift: int) -> tuple[DataFrame, Moments | None]:
    """The vectors of the commonest length, and their moments on the grid.

    Tasks add up whole numbers, so no order of adding changes anything. Products are taken after centring on the whole
    number next to the mean; what is left of the mean, less than one, is taken off exactly afterwards. The driver gets
    one row a pair of dimensions, whatever the number of vectors.
    """
    totals = vectors.mapInArrow(_totals(scale, shift), "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = totals.orderBy("dim", "i").collect()
    if not found:
        return vectors, None
    n, dim = max((r.n, r.dim) for r in found)
    sums = [int(r.s) for r in found if r.dim == dim]
    rows = vectors.filter(F.size("vector") == dim)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    summed = rows.mapInArrow(_products(dim, scale, shift, centre), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    rest = [s - n * c for s, c in zip(sums, centre)]
    covariance = np.zeros((dim, dim))
    for r in summed:
        covariance[r.i, r.j] = covariance[r.j, r.i] = (n * int(r.v) - rest[r.i] * rest[r.j]) / (n * n)  # one rounding
    return rows, Moments(n, sums, covariance)


# --- components ------------------------------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, squared off-diagonal) of a tridiagonal matrix that is congruent to the symmetric ``matrix`` by reflections,
    so that both have the same inertia under any shift."""
    a = matrix.astype(np.float64).copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        length = np.sqrt((x * x).sum())
        if length == 0.0:
            continue
        x[0] += np.copysign(length, x[0])
        x /= np.sqrt((x * x).sum())
        a[k + 1 :, k:] -= 2.0 * np.outer(x, x @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def above(diagonal: np.ndarray, squares: np.ndarray, shift: float) -> int:
    """Inertia: how many eigenvalues are greater than ``shift``, by the signs of the pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot, count = 1.0, 0
    for k, entry in enumerate(diagonal):
        pivot = entry - shift - (squares[k - 1] / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += int(pivot > 0)
    return count


def _at_rank(diagonal: np.ndarray, squares: np.ndarray, rank: int, low: float, high: float, tolerance: float) -> float:
    """A value within ``tolerance`` of the eigenvalue with ``rank`` - 1 greater ones."""
    while high - low > tolerance:
        middle = (low + high) / 2
        if above(diagonal, squares, middle) >= rank:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def intervals(covariance: np.ndarray, wanted: int, most: int = INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues within by inertia) from the top, for ``wanted`` eigenvalues or a few more.

    Cuts lie in the middle of the widest gap among the eigenvalues where one may lie; a cluster isn't cut.
    """
    diagonal, squares = tridiagonal(covariance)
    radius = np.sqrt(squares)
    reach = np.concatenate([[0.0], radius]) + np.concatenate([radius, [0.0]])
    high, low = float((diagonal + reach).max()), float((diagonal - reach).min())
    size = max(abs(high), abs(low), np.finfo(float).tiny)
    low, high = low - 1e-6 * size, high + 1e-6 * size
    d = len(diagonal)
    values = [_at_rank(diagonal, squares, r, low, high, 1e-9 * size) for r in range(1, min(d, wanted + most) + 1)]

    def gap(k: int) -> float:  # below the first k
        return values[k - 1] - values[k] if k < len(values) else (np.inf if k == d else 0.0)

    cuts, at = [], 0
    while at < min(wanted, d):
        last = min(at + most, len(values))
        ends = [k for k in range(at + max(1, most // 2), last + 1) if k <= d] or [last]
        if at + most >= wanted:
            ends = [k for k in ends if k >= min(wanted, d)] or list(range(min(wanted, d), last + 1))
        best = max(ends, key=gap)
        while best < len(values) and gap(best) < 1e-7 * size:
            best += 1
        if best >= len(values) and best < d:  # a cluster that goes on below: take all that is left
            best = d
        cuts.append(best)
        at = best
    edges = [high] + [low if k == d else (values[k - 1] + values[k]) / 2 for k in cuts]
    counts = [above(diagonal, squares, e) for e in edges]
    return [(b, a, int(n - m)) for a, b, m, n in zip(edges, edges[1:], counts, counts[1:])]


def feast(covariance: np.ndarray, low: float, high: float, count: int, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues within (low, high), falling, and their unit eigenvectors as columns.

    The projector onto their space is the contour integral of (z - V) ** -1 around the interval, by Gauss-Legendre quadrature
    over the upper half circle (the lower one is its conjugate): one complex solve for each node. Rayleigh-Ritz takes the
    components from the projected space, and the result is projected again until its residual is that of rounding. The
    inertia of both ends says how many there must be; while fewer are found, the space is made wider, up to all of it.
    """
    d = len(covariance)
    middle, radius = (low + high) / 2, (high - low) / 2
    width = min(d, max(width, count + max(4, count // 2)))
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(1j * np.pi * (1 + points) / 2)
    shifted = [middle * np.eye(d) + radius * t * np.eye(d) - covariance for t in turns]
    space = np.random.default_rng(d).standard_normal((d, width))
    size, best, stalled = max(np.abs(covariance).max(), np.finfo(float).tiny), None, 0
    for _ in range(ROUNDS):
        projected = sum(w * (radius * t / 2 * np.linalg.solve(m, space.astype(complex))).real for w, t, m in zip(weights, turns, shifted))
        basis, _ = np.linalg.qr(projected)
        basis, _ = np.linalg.qr(basis)
        values, inner = np.linalg.eigh(basis.T @ covariance @ basis)
        space = basis @ inner
        inside = np.flatnonzero((values > low) & (values < high))
        if len(inside) < count and width == d:  # rounded over an end: the nearest ones
            inside = np.argsort(np.maximum(low - values, values - high), kind="stable")[:count]
        if len(inside) < count:
            continue
        residuals = np.sqrt(((covariance @ space - space * values) ** 2).sum(axis=0))
        chosen = inside[np.argsort(residuals[inside])[:count]]  # spurious values, if any, have large residuals
        residual = residuals[chosen].max()
        if best is None or residual < best[0]:
            stalled = 0 if best is None or residual < best[0] / 2 else stalled + 1
            best = residual, values[chosen], space[:, chosen]
        else:
            stalled += 1
        if residual <= 1e-15 * size or (stalled >= 2 and best[0] <= 1e-9 * size):
            break
    if (best is None or best[0] > 1e-9 * size) and width < d:
        return feast(covariance, low, high, count, 2 * width)
    if best is None:
        raise ArithmeticError(f"fewer than the {count} eigenvalues that inertia counts between {low} and {high}")
    order = np.argsort(-best[1], kind="stable")
    vectors = best[2][:, order]
    return best[1][order], vectors / np.sqrt((vectors * vectors).sum(axis=0))


def _solve(covariance: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "count"))):
                values, vectors = feast(covariance, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], names=["value", "direction"])

    return run


def leading_components(spark: SparkSession, covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues above zero and their unit eigenvectors as columns, ``wanted`` at most.

    Each interval of the spectrum is a task of its own. Eigenvalues within rounding of zero aren't returned: whitening
    would divide by them.
    """
    parts = [p for p in intervals(covariance, wanted) if p[2]]
    if not parts or not np.abs(covariance).max() > 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    sought = spark.createDataFrame(parts, "low double, high double, count int").repartition(len(parts))
    found = sorted(sought.mapInArrow(_solve(covariance), "value double, direction array<double>").collect(), key=lambda r: -r.value)
    found = [r for r in found[:wanted] if r.value > 1e-12 * found[0].value]
    return np.array([r.value for r in found]), np.array([r.direction for r in found]).reshape(len(found), -1).T


# --- whitened rows ---------------------------------------------------------------------------------------------------


def _whiten(m: Moments, scale: float, shift: int, values: np.ndarray, vectors: np.ndarray, moments_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Either each row's deviation and whitened entries, or a task's count, sums and centred products of them."""
    projection = vectors / np.sqrt(values)
    k = len(values)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        rows = on_grid(batch.column("vector"), len(m.sums), scale, shift)
        reach = m.n * int(np.abs(rows).max(initial=0)) + max(abs(s) for s in m.sums)
        if reach >= 1 << 62:
            return rows.astype(object) * m.n - np.array(m.sums, object)
        return rows * m.n - np.array(m.sums, np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = centred(batch)
            wide = far.dtype == object or int(np.abs(far).max(initial=0)) ** 2 * far.shape[1] >= 1 << 63
            squares = (far.astype(object) ** 2).sum(axis=1) if wide else (far * far).sum(axis=1)
            squares = pa.array([Decimal(int(s)) for s in squares], pa.decimal128(38, 0))
            white = (far.astype(np.float64) / m.n) @ projection
            ends = np.arange(len(far) + 1, dtype=np.int32) * k
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), squares, pa.ListArray.from_arrays(ends, white.ravel())], names=["vec_id", "deviation", "whitened"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            white = (centred(batch).astype(np.float64) / m.n) @ projection
            here = white.mean(axis=0)
            off = here - mean
            white = white - here
            spread += white.T @ white + np.outer(off, off) * (n * len(white) / (n + len(white)))
            mean += off * (len(white) / (n + len(white)))
            n += len(white)
        if n:
            i, j = np.tril_indices(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n)), pa.array(mean[i]), pa.array(mean[j]), pa.array(spread[i, j])],
                names=["i", "j", "n", "mi", "mj", "v"],
            )

    return products if moments_only else rows


def _identity_error(rows: DataFrame, m: Moments, scale: float, shift: int, values: np.ndarray, vectors: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance, measured over all of them, less the identity."""
    parts = rows.mapInArrow(_whiten(m, scale, shift, values, vectors, True), "i int, j int, n long, mi double, mj double, v double")
    total = parts.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum(F.expr("n * mi * mj")).alias("m"), F.sum(F.expr("n * mi")).alias("si"), F.sum(F.expr("n * mj")).alias("sj")
    )
    entry = (F.col("v") + F.col("m") - F.col("si") * F.col("sj") / F.col("n")) / F.col("n")
    return total.agg(F.max(F.abs(entry - (F.col("i") == F.col("j")).cast("double")))).first()[0]


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error of every row and component.

    Entries go on a grid of whole numbers, floor(scale * entry) + shift; the fit covers all rows. ``deviation`` is the sum over
    the dimensions of (n * x - sum) ** 2, ``whitened`` the centred row on the component's unit eigenvector over the root of
    its eigenvalue, ``explained`` the eigenvalue's share of the trace.

    Null and empty vectors and such as hold a null or non-finite entry are dropped; a null vec_id is kept, and repeated rows
    and ids count and come as often as they are there. Vectors of another length than the commonest (the longer of equally
    common ones) are dropped. Components whose eigenvalue is zero, as in a table of equal rows, aren't returned, so such
    a table, and an empty one, gives no rows; equal eigenvalues are numbered in no particular order. Entries beyond 2 ** 61
    over ``scale`` are an error, never a wrong sum.
    """
    spark = vectors.sparkSession
    rows, m = moments(finite_vectors(vectors), scale, shift)
    values, directions = leading_components(spark, m.covariance, components) if m else (np.zeros(0), None)
    if not len(values):
        nothing = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return spark.createDataFrame([], nothing)
    error = _identity_error(rows, m, scale, shift, values, directions)
    white = rows.mapInArrow(_whiten(m, scale, shift, values, directions, False), "vec_id long, deviation decimal(38,0), whitened array<double>")
    shares = F.array(*[F.lit(float(v)) for v in values / np.trace(m.covariance)])
    long = white.select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return long.select(
        "vec_id", (F.col("_k") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error")
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long; a table on which it doesn't fit one is an error."""
    return whiten(table(spark, sf_dir, "embeddings"), components=32).withColumn("deviation", F.col("deviation").cast("long"))
