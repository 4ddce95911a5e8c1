"""Embedding whitening by spectral divide and conquer with QDWH polar decompositions.

Two passes sum the fit list's quantised vectors and their centred products per task; Spark adds the
sums, and one covariance matrix (dimensions squared, whatever the rows) reaches the driver.  There the
polar factor of the shifted matrix, found by dynamically weighted Halley steps, gives the projector on
the eigenvectors above the shift.  Its range and complement are invariant subspaces, which are split in
the same way until single components are left.  The scaled components are broadcast and applied in blocks.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
_LARGEST = float(1 << 40)  # entries beyond it have no exact long and count as non-finite
_CELLS = 1 << 20  # numbers of a block that a task handles at once
_EPS = np.finfo(float).eps


def polar_factor(matrix: np.ndarray, steps: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by QDWH iterations."""
    n = len(matrix)
    norm = np.linalg.norm(matrix)
    if norm == 0:
        return np.eye(n)
    x = matrix / norm
    r = np.linalg.qr(x, mode="r")
    low = np.abs(np.diag(r)).min()
    if low > _EPS:
        # A lower bound of the least singular value: the inverse of the triangle's inverse norm.
        low = 1.0 / np.linalg.norm(np.linalg.solve(r, np.eye(n)))
    low = min(1.0, max(low, _EPS))
    for _ in range(steps):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        a = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
            new = b / c * x + (a - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        else:
            new = b / c * x + (a - b / c) * np.linalg.solve(np.eye(n) + c * x.T @ x, x.T).T
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (a + b * square) / (1 + c * square))
        if abs(1 - low) < 10 * _EPS and moved < np.cbrt(4 * _EPS):
            break
    return x


def _shifts(matrix: np.ndarray) -> list[float]:
    """Places to split the spectrum; the mean lies strictly inside unless all eigenvalues are equal."""
    mean = np.trace(matrix) / len(matrix)
    spread = np.linalg.norm(matrix - mean * np.eye(len(matrix))) / np.sqrt(len(matrix))
    return [float(np.median(np.diag(matrix))), mean] + [mean + step * spread for step in (0.1, -0.1, 0.25, -0.25, 0.5, -0.5, 0.75, -0.75)]


def eigenvectors(matrix: np.ndarray, scale: float | None = None, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, orthonormal columns) of a symmetric matrix, in no order.

    A block whose off-diagonal part is below rounding of the whole matrix is a cluster of equal
    eigenvalues, in which any basis is one of eigenvectors.
    """
    n = len(matrix)
    scale = np.linalg.norm(matrix) if scale is None else scale
    if n == 1 or np.linalg.norm(matrix - np.diag(np.diag(matrix))) <= _EPS * scale:
        return np.diag(matrix).copy(), np.eye(n)
    random = np.random.default_rng(seed)
    best = None
    for shift in _shifts(matrix):
        projector = (polar_factor(matrix - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        basis = np.hstack([projector @ random.standard_normal((n, rank)), random.standard_normal((n, n - rank))])
        for _ in range(2):
            basis, _ = np.linalg.qr(basis)
            # The range first, then its complement, both cleaned once more.
            basis = np.hstack([projector @ basis[:, :rank], basis[:, rank:] - projector @ basis[:, rank:]])
        basis, _ = np.linalg.qr(basis)
        turned = basis.T @ matrix @ basis
        left = np.linalg.norm(turned[rank:, :rank])
        if best is None or left < best[0]:
            best = (left, rank, basis, turned)
        if left <= 4 * _EPS * n * scale:
            break
    if best is None:  # no shift separates the block: its eigenvalues differ by rounding only
        return np.diag(matrix).copy(), np.eye(n)
    _, rank, basis, turned = best
    turned = (turned + turned.T) / 2
    upper, left = eigenvectors(turned[:rank, :rank], scale, seed + 1)
    lower, right = eigenvectors(turned[rank:, rank:], scale, seed + 2)
    return np.concatenate([upper, lower]), np.hstack([basis[:, :rank] @ left, basis[:, rank:] @ right])


def principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their eigenvectors as columns, polished by one refinement step."""
    values, vectors = eigenvectors(covariance)
    inner = np.eye(len(values)) - vectors.T @ vectors
    turned = vectors.T @ covariance @ vectors
    values = np.diag(turned) / (1 - np.diag(inner))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > 1e-10 * np.abs(values).max(initial=0.0)
    step = np.where(apart, (turned + values[None, :] * inner) / np.where(apart, gaps, 1.0), inner / 2)
    vectors = vectors + vectors @ step
    values = np.einsum("ij,ik,kj->j", vectors, covariance, vectors) / np.einsum("ij,ij->j", vectors, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _blocks(batches, dim: int):
    """(ids, quantised vectors as longs) of bounded blocks of rows."""
    step = max(1, _CELLS // max(dim, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            yield part.column(0), np.floor(SCALE * flat.reshape(-1, dim)).astype(np.int64) + OFFSET


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their number of dimensions (0 if there are none)."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) > _LARGEST))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.size("v") > 0).where(~bad)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    dim = sizes["d"] if sizes else 0
    return rows.where(F.size("v") == dim), dim


def _products(rows: DataFrame, dim: int, of) -> np.ndarray:
    """The sum over all rows of the outer products of `of(block)` (rows x m) with itself."""

    def run(batches):
        total = None
        for _, x in _blocks(batches, dim):
            block = of(x)
            total = block.T @ block + (0 if total is None else total)
        if total is not None:
            cells = np.arange(total.size, dtype=np.int64)
            keep = cells // len(total) <= cells % len(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells[keep]), pa.array(total.ravel()[keep])], ["cell", "part"])

    # At most dimensions squared sums come to the driver.
    sums = rows.mapInArrow(run, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).toPandas()
    m = of(np.zeros((1, dim), dtype=np.int64)).shape[1]
    out = np.zeros(m * m)
    out[sums["cell"].to_numpy()] = sums["part"].to_numpy()
    out = out.reshape(m, m)
    return np.triu(out) + np.triu(out, 1).T


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums over dimensions of (n x - S)^2; sums are Python integers."""
    exact = n * x.astype(object) - sums if n * int(np.abs(x).max()) + max(map(abs, sums)) >= 1 << 62 else n * x - sums.astype(np.int64)
    if exact.dtype != object and int(np.abs(exact).max()) ** 2 * x.shape[1] < 1 << 62:
        return pa.array((exact * exact).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = exact.astype(object)
    return pa.array([Decimal(int(v)) for v in (exact * exact).sum(axis=1)], pa.decimal128(38, 0))


def whiten(rows: DataFrame, components: int = 32) -> DataFrame:
    """Per usable row and component: vec_id, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error.

    Rows take no part whose vector is null, empty, of another length than the commonest one (the
    longer on a tie) or holds null, NaN, infinite or over 2^40 large entries.  An entry c counts as
    x = floor(64 c) + 1000000.  Components whose variance is zero up to rounding have no whitened value
    and no row, so a table of equal vectors, of one vector or of none gives no rows.  Repeated rows
    count and return as often as they occur; a null vec_id stays null; other columns are ignored.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows, dim = usable(rows)

    def sums(batches):
        for _, x in _blocks(batches, dim):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, len(x), dtype=np.int64)), pa.array(x.sum(axis=0))], ["dim", "n", "s"]
            )

    # One row per dimension.
    found = rows.mapInArrow(sums, "dim int, n long, s long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = found.orderBy("dim").collect() if dim else []
    if not found:
        return spark.createDataFrame([], schema)
    n, total = found[0]["n"], np.array([int(r["s"]) for r in found], dtype=object)
    # Whole and fractional parts of S/n apart, so that centring is exact to the last digit.
    whole, part = np.array([s // n for s in total], dtype=np.int64), np.array([(s % n) / n for s in total], dtype=float)
    covariance = _products(rows, dim, lambda x: (x - whole) - part) / n
    trace = float(np.trace(covariance))
    values, vectors = principal(covariance)
    kept = int((values[:components] > 16 * dim * _EPS * values[0]).sum()) if values[0] > 0 else 0
    if kept == 0:
        return spark.createDataFrame([], schema)
    spread = vectors[:, :kept] / np.sqrt(values[:kept])
    explained = values[:kept] / trace
    # A column of ones beside the whitened values sums them too.
    second = _products(rows, dim, lambda x: np.hstack([((x - whole) - part) @ spread, np.ones((len(x), 1))])) / n
    mean = second[:kept, kept]
    error = float(np.abs(second[:kept, :kept] - np.outer(mean, mean) - np.eye(kept)).max())
    shared = spark.sparkContext.broadcast((whole, part, spread, explained, total))  # dimensions x components numbers

    def run(batches):
        whole, part, spread, explained, total = shared.value
        step = max(1, _CELLS // max(dim, 4 * kept))
        for batch in batches:
            for ids, x in _blocks([batch.slice(i, step) for i in range(0, batch.num_rows, step)], dim):
                white = ((x - whole) - part) @ spread
                row = pa.array(np.repeat(np.arange(len(x)), kept))
                size = len(x) * kept
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(row), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n, dtype=np.int64)),
                        _deviation(x, n, total).take(row), pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(size, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
