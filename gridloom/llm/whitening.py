"""Embedding whitening: the leading eigenpairs of a covariance by a block Jacobi-Davidson method whose products run as Spark jobs.

The covariance V of n vectors is never formed. A product V B is one pass over
the vectors: each task centres its rows, multiplies them by B and its transpose
and adds up; the sums of all tasks meet by row of the product. What the driver
holds are blocks of at most ``BASIS`` vectors of the embeddings' dimension, not
rows of the table.

Outer iterations take Ritz pairs of a search space (Rayleigh-Ritz), lock the
leading ones whose residual has reached double precision, and extend the space
by corrections: for each open pair (theta, u) with residual r, an approximate
solution of (I - QQ') (V - theta I) (I - QQ') s = -r by MINRES, with Q the
locked and the current Ritz vectors. All corrections of a block advance
together, so an inner step is one pass over the data whatever the block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import materialize

#: Scale and offset of the integer entries. A component of 2**40 or more can't be placed on that grid.
SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 40)
#: Vectors of the search space before it is cut back, inner steps, outer rounds at most, rows of a product.
BASIS, INNER, ROUNDS, TILE_ROWS = 96, 8, 60, 4096
#: Residuals are locked at this multiple of the largest Ritz value; below NOISE of it a component has no variance.
PRECISION, NOISE = 64 * np.finfo(float).eps, 1e-12

Product = Callable[[np.ndarray], np.ndarray]


def on_grid(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite and below 2**40."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def _entries(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(SCALE * values).astype(np.int64) + OFFSET


def _cells(rows: DataFrame, dim: int, per_tile: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tiles of rows of a matrix of the given shape, added up per task and then by cell."""

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                total += per_tile(_entries(batch.column(0).slice(at, TILE_ROWS), dim))
        for i in range(0, shape[0], 256):
            part = total[i : i + 256]
            row = np.repeat(np.arange(i, i + len(part), dtype=np.int32), shape[1])
            col = np.tile(np.arange(shape[1], dtype=np.int32), len(part))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(part.ravel())], names=["i", "j", "v"])

    sums = rows.select("vector").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(shape)
    out[sums.i.to_numpy(), sums.j.to_numpy()] = sums.v.to_numpy()
    return out


def covariance_product(rows: DataFrame, total: list[int], n: int) -> Product:
    """B -> V B for the covariance V (divisor n) of the grid entries of ``rows.vector``; ``total`` are their exact sums."""
    mean, rest = _mean(total, n)

    def product(b: np.ndarray) -> np.ndarray:
        def tile(x: np.ndarray) -> np.ndarray:
            z = (x - mean) - rest
            return z.T @ (z @ b)

        return _cells(rows, len(total), tile, b.shape) / n

    return product


def _mean(total: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean as an integer part and a rest, so that subtracting it from an entry loses nothing."""
    whole = [s // n for s in total]
    return np.array(whole, dtype=np.int64), np.array([(s - w * n) / n for s, w in zip(total, whole, strict=True)])


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the block's part orthogonal to the others; what is left of dependent columns is dropped."""
    out = np.zeros((len(block), 0))
    for k in range(block.shape[1]):
        v = block[:, k]
        v = v / max(np.linalg.norm(v), 1e-300)
        for _ in range(3):
            for q in (*against, out):
                v = v - q @ (q.T @ v)
            length = np.linalg.norm(v)
            if length < 1e-8:
                break
            v = v / length
        else:
            out = np.column_stack((out, v))
    return out


def minres_block(product: Product, shift: np.ndarray, space: np.ndarray, right: np.ndarray, steps: int, tolerance: float = 1e-2) -> np.ndarray:
    """Approximate solutions of P (V - shift_k) P s_k = P right_k with P = I - space space', one MINRES recurrence per column.

    The columns take their steps together, one product a step; a column whose
    recurrence has ended keeps its solution.
    """
    project = lambda x: x - space @ (space.T @ x)
    v = project(right)
    beta = np.linalg.norm(v, axis=0)
    eta, start = beta.copy(), beta.copy()
    live = beta > 1e-300
    v = v / np.where(live, beta, 1.0)
    before = np.zeros_like(v)
    w0, w1, out = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    c0, c1 = np.ones(len(beta)), np.ones(len(beta))
    s0, s1 = np.zeros(len(beta)), np.zeros(len(beta))
    beta = np.zeros(len(beta))
    for _ in range(steps):
        if not live.any():
            break
        u = np.zeros_like(v)
        u[:, live] = product(v[:, live]) - v[:, live] * shift[live]
        u = project(u)
        alpha = (u * v).sum(axis=0)
        u = u - v * alpha - before * beta
        u = project(u)
        following = np.linalg.norm(u, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        rho1 = np.hypot(delta, following)
        rho2 = s1 * alpha + c0 * c1 * beta
        rho3 = s0 * beta
        live = live & (rho1 > 1e-300)
        safe = np.where(rho1 > 1e-300, rho1, 1.0)
        c, s = delta / safe, following / safe
        w = (v - w0 * rho3 - w1 * rho2) / safe
        out = np.where(live, out + w * (c * eta), out)
        eta = -s * eta
        live = live & (np.abs(eta) > tolerance * start) & (following > 1e-14 * np.abs(alpha) + 1e-300)
        before, v = v, u / np.where(following > 1e-300, following, 1.0)
        w0, w1, c0, c1, s0, s1, beta = w1, w, c1, c, s1, s, following
    return project(out)


def jacobi_davidson(product: Product, dim: int, wanted: int, basis: int = BASIS, inner: int = INNER, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive semidefinite operator.

    Raises RuntimeError if residuals stay above double precision.
    """
    wanted = min(wanted, dim)
    basis = max(basis, 2 * wanted + 8)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    w = _orthonormal(np.random.default_rng(seed).standard_normal((dim, min(dim, wanted + 8))))
    vw = product(w)
    for _ in range(rounds):
        h = w.T @ vw
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, image = w @ y, vw @ y
        norm = max(theta[0], values[0] if len(values) else 0.0, 1e-300)
        error = np.linalg.norm(image - ritz * theta, axis=0)
        # all directions are in the space: what is left of a residual is rounding
        bound = PRECISION * norm * (1 if len(values) + w.shape[1] < dim else 8)
        need = wanted - len(values)
        done = 0
        while done < min(need, len(theta)) and error[done] <= bound:
            done += 1
        locked, values = np.column_stack((locked, ritz[:, :done])), np.concatenate((values, theta[:done]))
        if len(values) == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        w, vw, theta = ritz[:, done:], image[:, done:], theta[done:]
        # what rounding left of the locked vectors goes, and the images with it
        vw = vw - locked @ (locked.T @ vw)
        need = wanted - len(values)
        if w.shape[1] + need > basis:
            w, vw = w[:, : need + 8], vw[:, : need + 8]
        open_ = w[:, :need]
        residual = vw[:, :need] - open_ * theta[:need]
        if len(values) + w.shape[1] < dim:
            step = minres_block(product, theta[:need], np.column_stack((locked, open_)), -residual, inner)
            more = _orthonormal(np.column_stack((step, residual)), locked, w)[:, : min(need, dim - len(values) - w.shape[1])]
        else:  # nothing to extend by: renew the images
            w = _orthonormal(w, locked)
            vw, more = product(w), np.zeros((dim, 0))
        if more.shape[1]:
            w, vw = np.column_stack((w, more)), np.column_stack((vw, product(more)))
    raise RuntimeError("eigenpairs did not reach double precision")


def fit_whitening(rows: DataFrame, wanted: int) -> tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray, float]:
    """n, exact sums, eigenvalues, components (columns), covariance of the whitened rows, trace of the covariance.

    ``rows.vector`` are usable vectors of one dimension. Components without
    variance (below 1e-12 of the largest) are left out.
    """
    entry = F.floor(F.col("v").cast("double") * SCALE) + OFFSET
    sums = rows.select(F.posexplode("vector").alias("k", "v")).groupBy("k").agg(F.sum(entry.cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).orderBy("k").collect()
    total, n, dim = [int(r.s) for r in sums], sums[0].n, len(sums)
    product = covariance_product(rows, total, n)
    values, vectors = jacobi_davidson(product, dim, wanted)
    keep = values > max(NOISE * values[0], 1e-20)  # entries are whole numbers: a real variance is not below 1 / n
    values, vectors = values[keep], vectors[:, keep]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    mean, rest = _mean(total, n)
    scaled, k = vectors / np.sqrt(values), len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = ((x - mean) - rest) @ scaled
        return np.vstack((white.T @ white, white.sum(axis=0), np.full(k, np.square((x - mean) - rest).sum())))

    if not k:
        return n, total, values, vectors, np.zeros((0, 0)), 0.0
    sums = _cells(rows, dim, moments, (k + 2, k)) / n
    return n, total, values, vectors, sums[:k] - np.outer(sums[k], sums[k]), float(sums[k + 1, 0])


def deviations(x: np.ndarray, total: list[int], n: int) -> list[int | None]:
    """Per row the sum over dimensions of (n x - S)**2, exact; None beyond 64 bits."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, total)) < 2**62:
        off = x * n - np.array(total, dtype=np.int64)
        if int(np.abs(off).max(initial=0)) ** 2 * len(total) < 2**62:
            return np.square(off).sum(axis=1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x.tolist())
    return [v if v < 2**63 else None for v in exact]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, eigenvalue double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, eigenvalue, identity_error.

    Entries are floor(64 c) + 1,000,000; all figures are of those, over all
    usable vectors. explained is the eigenvalue's share of the trace,
    identity_error the largest absolute entry of the whitened rows' covariance
    minus the identity. Each component's largest entry is positive.

    Left out: null and empty vectors, those with null, non-finite or very large
    (2**40) entries, those whose length isn't the table's most frequent one (of
    equally frequent ones the longest), and components without variance, so
    equal vectors, like a single one, give no rows. Repeated rows count each; a
    deviation beyond 64 bits is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).filter(on_grid(F.col("vector").cast("array<double>")))
    rows = materialize(rows, "vectors")
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], OUT)
    rows = rows.filter(F.size("vector") == lengths[0].d)
    n, total, values, basis, covariance, trace = fit_whitening(rows, components)
    if not len(values):
        return spark.createDataFrame([], OUT)
    mean, rest = _mean(total, n)
    scaled, k, dim = basis / np.sqrt(values), len(values), len(total)
    error = float(np.abs(covariance - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(at, TILE_ROWS)
                x = _entries(part.column(1), dim)
                white = ((x - mean) - rest) @ scaled
                m = len(x)
                repeat = lambda column: column.take(pa.array(np.repeat(np.arange(m), k)))
                each = lambda v: pa.array(np.tile(v, m))
                yield pa.RecordBatch.from_arrays([
                    repeat(part.column(0)), each(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(m * k, n)),
                    repeat(pa.array(deviations(x, total, n), pa.int64())), pa.array(white.ravel()), each(values / trace), each(values), pa.array(np.full(m * k, error)),
                ], names=[f.split()[0] for f in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)
