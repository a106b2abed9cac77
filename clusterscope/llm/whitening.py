"""Whitening of embeddings with a Jacobi-Davidson eigensolver over distributed products.

The covariance is never formed.  Spark holds the centred vectors in blocks; a product of the
covariance with a few columns is one pass over the blocks (each task multiplies its own and puts
out one dim x columns partial sum; the sums are added in two steps).  On the driver lie only arrays
of dim rows and a few dozen columns:

1. Rayleigh-Ritz in the search space gives approximate pairs and their residuals.
2. For every wanted pair that hasn't converged a correction equation, projected against the locked and the
   wanted vectors, is solved by a few MINRES steps.  All of them run in lockstep, so a step is one pass.
3. The corrections and the residuals extend the search space.  Pairs whose residual has come down to the rounding of the
   products are locked, largest first; a large search space is restarted from its best vectors.

At the end the locked vectors are multiplied afresh, and the residuals of that product must be at
rounding level too.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterscope.session import cut, ship_package

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LIMIT = float(1 << 52)       # scaled entries are clipped here; whole numbers are exact in a double up to it
BLOCK_BYTES = 1 << 21
LOW = 20                     # sums are added in two parts: the bits below, and the rest
INNER_STEPS, INNER_TOLERANCE = 10, 0.02
SPACE = 3                    # search space, in multiples of the wanted components, before a restart
ROUNDS = 300
ROUNDING = 64 * np.finfo(float).eps      # of the largest eigenvalue: where a residual counts as converged
NULL = 1e-13                 # of the largest eigenvalue: below, a direction has no variance


# --- the eigensolver -------------------------------------------------------------

def _orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of ``t`` made orthonormal to the others and each other; dependent ones are left out."""
    out = np.zeros((len(t), 0))
    for x in t.T:
        size = np.linalg.norm(x)
        for _ in range(3):
            for q in (*against, out):
                x = x - q @ (q.T @ x)
        left = np.linalg.norm(x)
        if size > 0 and left > 1e-10 * size:
            out = np.column_stack([out, x / left])
    return out


def _minres(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of ``product(x) = b``, column by column, all with the same products."""
    m = b.shape[1]
    x, before = np.zeros_like(b), np.zeros_like(b)
    first = np.linalg.norm(b, axis=0)
    live = first > 0
    safe = lambda v: np.where(v > 0, v, 1.0)
    v = b / safe(first)
    beta, phi = np.zeros(m), first.copy()
    c, s = -np.ones(m), np.zeros(m)
    delta, epsilon = np.zeros(m), np.zeros(m)
    w, w_before = np.zeros_like(b), np.zeros_like(b)
    for _ in range(steps):
        if not (live & (phi > tolerance * first)).any():
            break
        y = product(v) - before * beta
        alpha = (v * y).sum(axis=0)
        y = y - v * alpha
        before, beta = v, np.linalg.norm(y, axis=0)
        v = y / safe(beta)
        old = epsilon
        over = c * delta + s * alpha
        gamma_bar = s * delta - c * alpha
        epsilon, delta = s * beta, -c * beta
        gamma = safe(np.hypot(gamma_bar, beta))
        c, s = gamma_bar / gamma, beta / gamma
        step, phi = c * phi, s * phi
        w, w_before = (before - w_before * old - w * over) / gamma, w
        x = x + np.where(live, step, 0.0) * w
        live = live & (beta > 1e-14 * np.abs(alpha))
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors (columns) of the symmetric positive
    semidefinite operator behind ``product`` (dim x m to dim x m).  Raises if residuals don't reach rounding level."""
    k = min(k, dim)
    space = _orthonormal(np.random.default_rng(seed).normal(size=(dim, min(dim, k + 4))))
    image = product(space)
    locked, locked_image, top = np.zeros((dim, 0)), np.zeros((dim, 0)), 0.0
    best, stuck = math.inf, 0
    for _ in range(ROUNDS):
        h = space.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        top = max(top, float(values[0]) if len(values) else 0.0)
        residual = image - space * values
        residual -= locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)
        wanted = k - locked.shape[1]
        worst = sizes[:wanted].max(initial=0.0)
        best, stuck = (worst, 0) if worst < 0.5 * best else (best, stuck + 1)
        near = ROUNDING * top if stuck < 8 else 64 * ROUNDING * top
        done = 0
        while done < min(wanted, len(sizes)) and sizes[done] <= near:
            done += 1
        if done:
            locked, locked_image = np.column_stack([locked, space[:, :done]]), np.column_stack([locked_image, image[:, :done]])
            space, image, values, residual = space[:, done:], image[:, done:], values[done:], residual[:, done:]
            wanted -= done
            best, stuck = math.inf, 0
        if not wanted:
            # The locked vectors against a fresh product.
            locked_image = product(locked)
            h = locked.T @ locked_image
            values, turn = np.linalg.eigh((h + h.T) / 2)
            values, locked, locked_image = values[::-1], locked @ turn[:, ::-1], locked_image @ turn[:, ::-1]
            if np.linalg.norm(locked_image - locked * values, axis=0).max(initial=0.0) <= 128 * ROUNDING * max(top, np.finfo(float).tiny):
                return values, locked
            space, image = locked, locked_image
            locked, locked_image = np.zeros((dim, 0)), np.zeros((dim, 0))
            continue
        if space.shape[1] > SPACE * k:
            space, image = space[:, :wanted + 4], image[:, :wanted + 4]
        lead = min(wanted, space.shape[1])
        q = np.column_stack([locked, space[:, :lead]])
        project = lambda t: t - q @ (q.T @ t)
        shift = values[:lead]
        inner = lambda t: project(product(project(t)) - project(t) * shift)
        corrections = _minres(inner, project(-residual[:, :lead]), INNER_STEPS, INNER_TOLERANCE)
        more = _orthonormal(np.column_stack([corrections, residual[:, :lead]]), locked, space)[:, :max(0, dim - locked.shape[1] - space.shape[1])]
        if more.shape[1]:
            space, image = np.column_stack([space, more]), np.column_stack([image, product(more)])
        else:
            # Nothing new: the images are made afresh, which takes off their rounding.
            space = _orthonormal(space, locked)
            image = product(space)
    raise ArithmeticError(f"residuals of {best} after {ROUNDS} rounds")


# --- vectors in blocks ------------------------------------------------------------

def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose embedding holds finite numbers only."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))) + SHIFT)
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
            .where("x is not null and size(x) > 0").where(finite).select("vec_id", scaled.alias("x")))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for batch in batches:
            x = _matrix(batch, dim)
            high, low, n = high + (x >> LOW).sum(axis=0), low + (x & ((1 << LOW) - 1)).sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_pydict({"at": np.arange(dim), "high": high, "low": low, "n": np.full(dim, n)})
    return run


class Centre:
    """The fit list's mean, S / n, as a whole number and the rest of each dimension."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array([s // n for s in sums], np.int64)
        self.over = np.array([s - n * (s // n) for s in sums], np.int64)
        self.rest = self.over / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S) ** 2, exact; None beyond a long."""
        y = x - self.whole
        largest = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if largest * largest * x.shape[1] < 1 << 63:
            return ((self.n * y - self.over) ** 2).sum(axis=1).tolist()
        y = self.n * y.astype(object) - self.over.astype(object)
        return [d if d < 1 << 63 else None for d in (y * y).sum(axis=1)]


def _blocks(centre: Centre, dim: int):
    """Centred vectors in packed blocks of about ``BLOCK_BYTES``, with their sum of squares."""
    most = max(1, BLOCK_BYTES // (8 * dim))

    def put(parts):
        y = np.concatenate(parts)
        return pa.RecordBatch.from_pydict({"block": pa.array([struct.pack("<Q", len(y)) + y.astype("<f8").tobytes()], pa.binary()), "squares": [float((y * y).sum())]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            y = centre.centred(_matrix(batch, dim))
            for at in range(0, len(y), most):
                held.append(y[at:at + most])
                size += len(held[-1])
                if size >= most:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)
    return run


def _added(shape: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for raw in batch.column("sum").to_pylist():
                total += np.frombuffer(raw, "<f8").reshape(shape)
        yield pa.RecordBatch.from_pydict({"sum": pa.array([total.astype("<f8").tobytes()], pa.binary())})
    return run


class Blocks:
    """Centred vectors as rows of packed blocks, and sums over them."""

    def __init__(self, blocks: DataFrame, dim: int):
        self.rows, self.dim = blocks, dim
        self.ways = max(1, math.isqrt(blocks.rdd.getNumPartitions()))

    def total(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum of ``of(block)`` over all blocks: one array per task, added in two steps."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                for raw in batch.column("block"):
                    out += of(np.frombuffer(raw.as_buffer(), "<f8", offset=8).reshape(-1, dim))
            yield pa.RecordBatch.from_pydict({"sum": pa.array([out.astype("<f8").tobytes()], pa.binary())})
        parts = self.rows.select("block").mapInArrow(run, "sum binary")
        parts = parts.repartition(self.ways).mapInArrow(_added(shape), "sum binary").toArrow().column("sum").to_pylist()
        return sum((np.frombuffer(raw, "<f8").reshape(shape) for raw in parts), np.zeros(shape))


# --- whitening ---------------------------------------------------------------------

def _whitened(centre: Centre, dim: int, components: np.ndarray, explained: list[float], identity_error: float):
    k = components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            n, y = len(x), centre.centred(x) @ components
            take = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, centre.n)),
                 pa.array(centre.deviations(x), pa.int64()).take(take), pa.array(y.ravel()), pa.array(np.tile(explained, n)),
                 pa.array(np.full(n * k, identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


WHITE_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Every vector on the ``k`` leading principal components, each scaled to variance 1.

    ``vectors`` has vec_id and embedding; other columns are ignored.  An entry c counts as
    floor(64 * c) + 1000000 (64 * c clipped to 2^52 in size).  Means and covariances are over the distinct vectors, n of them.
    Returns vec_id, component (from 1), n, deviation (exact; null beyond a long), whitened, explained and
    identity_error.  Rows with a null or empty embedding, or one with a null or non-finite entry, are left out, and so
    are those whose length isn't the commonest one (of equally common lengths the longest).  A null vec_id and repeated rows
    stay.  A direction without variance is no component: with fewer than k others there are fewer
    components, and no rows at all if all vectors are equal or the table is empty.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    empty = spark.createDataFrame([], WHITE_SCHEMA)
    rows = whole_vectors(vectors)
    usual = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if usual is None:
        return empty
    dim = int(usual["dim"])
    rows = rows.where(F.size("x") == dim)
    fit = cut(rows.select("x").distinct())
    # A row per dimension.
    sums = fit.mapInArrow(_sums(dim), "at long, high long, low long, n long").groupBy("at").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).orderBy("at").collect()
    centre = Centre(int(sums[0]["n"]), [(int(r["high"]) << LOW) + int(r["low"]) for r in sums])
    stored = cut(fit.mapInArrow(_blocks(centre, dim), "block binary, squares double"))
    n, trace = centre.n, stored.agg(F.sum("squares")).first()[0] / centre.n
    if not trace > 0:
        return empty
    blocks = Blocks(stored, dim)
    values, components = jacobi_davidson(lambda q: blocks.total(lambda y: y.T @ (y @ q), (dim, q.shape[1])) / n, dim, k)
    held = values > NULL * values[0]
    values, components = values[held], components[:, held]
    scaled = components / np.sqrt(values)
    m = len(values)
    mean = blocks.total(lambda y: (y @ scaled).sum(axis=0), (m,)) / n

    def spread(y):
        w = y @ scaled - mean
        return w.T @ w
    identity_error = float(np.abs(blocks.total(spread, (m, m)) / n - np.eye(m)).max())
    return rows.mapInArrow(_whitened(centre, dim, scaled, (values / trace).tolist(), identity_error), WHITE_SCHEMA)
