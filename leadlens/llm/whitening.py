"""Embedding whitening: leading principal components by a block Jacobi-Davidson method whose products
with the covariance are sums over Spark's partitions; no covariance matrix is ever formed.

Vectors become whole numbers, written once as blocks.  Their exact sums give the mean.  A product
V Q is one pass: each block is centred (n x - S is exact, then divided by n), multiplied by Q and by
its own transpose, and the tasks' sums are added with compensation, in a tree of Spark stages where
there are many, so the driver adds at most ``FAN`` matrices of dimensions x columns.

The outer loop takes Rayleigh-Ritz pairs from a subspace, locks leading pairs whose residual has
reached double precision, and extends the subspace for all others at once by correction equations,
projected against locked and active vectors and solved by a few MINRES steps (all columns share a
pass).  Later pairs are sought orthogonally to locked ones; the subspace restarts with its best Ritz
vectors when it is full.

Defined results: a vector that is null or holds null or non-finite entries takes no part; rows with
a null or repeated vec_id are rows of their own; a missing component of a shorter vector counts as
0; entries beyond +-2^62 become that bound; components whose eigenvalue is zero within rounding
(fewer rows than components, constant or repeated dimensions) are not returned, so a table of one
row or of equal rows gives no rows, as does an empty one; a ``deviation`` beyond a long is null;
equal eigenvalues give some orthonormal basis of their space; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.session import materialize

from .common import column, table
from .vectors import pack, unpack, whole_numbers, widen

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
GUARD = 8  # Ritz vectors kept beyond the wanted ones
INNER = 6  # MINRES steps of one correction
OUTER = 200
BLOCK_ROWS = 4096
FAN = 64

_EPS = float(np.finfo(float).eps)
_BLOCK = "ids array<bigint>, n int, dims int, width int, vectors binary"
_MOST = (1 << 63) - 1


def blocks(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """The vectors that take part, as blocks of at most ``BLOCK_ROWS`` rows of floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = whole_numbers(column(batch, "embedding"), scale)
            ids, x = column(batch, "vec_id").filter(pa.array(good)), x[good]
            for lo in range(0, len(x), BLOCK_ROWS):
                part = x[lo:lo + BLOCK_ROWS]
                width, blob = pack(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.slice(lo, BLOCK_ROWS).to_pylist()], pa.list_(pa.int64())), pa.array([len(part)], pa.int32()),
                     pa.array([part.shape[1]], pa.int32()), pa.array([width], pa.int32()), pa.array([blob], pa.binary())],
                    names=[f.split(" ")[0] for f in _BLOCK.split(", ")])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, _BLOCK)


def _matrices(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for ids, n, width, blob in zip(column(batch, "ids"), column(batch, "n").to_pylist(), column(batch, "width").to_pylist(),
                                   column(batch, "vectors")):
        yield ids.values, widen(unpack(width, blob.as_buffer(), n), dims)


def _top(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


@dataclass
class Centre:
    """Number of vectors and exact sums of x = floor(scale * c) + offset."""

    n: int
    sums: list[int]
    offset: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S exactly: int64 where that fits, whole numbers of any size otherwise."""
        x = x.astype(object) if 2 * self.n * (_top(x) + self.offset) >= 1 << 62 else x
        sums = np.array(self.sums, object)
        return (x + self.offset) * self.n - (sums if x.dtype == object else sums.astype(np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n


def centre_of(found: DataFrame, offset: int = OFFSET) -> Centre:
    """Exact sums of whole numbers, added by Spark as decimals, one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [], 0
        for batch in batches:
            for _, x in _matrices(batch, 0 if not batch.num_rows else max(column(batch, "dims").to_pylist())):
                total += [0] * (x.shape[1] - len(total))
                safe = _top(x) * len(x) < 1 << 62
                for i, s in enumerate((x if safe else x.astype(object)).sum(axis=0).tolist()):
                    total[i] += s
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([n, *total], pa.decimal128(38, 0))],
                                         names=["dim", "total"])

    rows = found.mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    by_dim = {r.dim: int(r.total) for r in rows}  # one row per dimension
    n = by_dim.pop(-1, 0)
    return Centre(n, [by_dim[d] + n * offset for d in range(len(by_dim))], offset)


class _Sum:
    """Matrix sum with compensation."""

    def __init__(self) -> None:
        self.high: np.ndarray | None = None

    def add(self, m: np.ndarray, low: np.ndarray | None = None) -> None:
        if self.high is None:
            self.high, self.low = m.copy(), np.zeros_like(m) if low is None else low.copy()
            return
        total = self.high + m
        larger = np.abs(self.high) >= np.abs(m)
        self.low += np.where(larger, (self.high - total) + m, (m - total) + self.high) + (0 if low is None else low)
        self.high = total


class Passes:
    """Sums over all centred vectors, one Spark pass each."""

    def __init__(self, found: DataFrame, centre: Centre, n_blocks: int):
        self.found, self.centre, self.n_blocks = found, centre, n_blocks
        self.count = 0

    def total(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum of ``part`` (of a block's centred rows) over all blocks."""
        centre, dims = self.centre, len(self.centre.sums)
        schema = "task int, high binary, low binary"

        def row(task: int, held: _Sum) -> Iterator[pa.RecordBatch]:
            if held.high is not None:
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([held.high.tobytes()], pa.binary()),
                                                  pa.array([held.low.tobytes()], pa.binary())], names=["task", "high", "low"])

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held = _Sum()
            for batch in batches:
                for _, x in _matrices(batch, dims):
                    held.add(part(centre.centred(x)))
            yield from row(TaskContext.get().partitionId(), held)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held = _Sum()
            for batch in batches:
                for high, low in zip(column(batch, "high").to_pylist(), column(batch, "low").to_pylist()):
                    held.add(np.frombuffer(high).reshape(shape), np.frombuffer(low).reshape(shape))
            yield from row(TaskContext.get().partitionId(), held)

        parts, rows = self.found.mapInArrow(first, schema), self.n_blocks  # a task with blocks gives one row
        while rows > FAN:
            rows = -(-rows // FAN)
            parts = parts.repartition(rows, "task").mapInArrow(merge, schema)
        held = _Sum()
        for r in sorted(parts.collect(), key=lambda r: r.task):  # at most FAN matrices
            held.add(np.frombuffer(r.high).reshape(shape), np.frombuffer(r.low).reshape(shape))
        self.count += 1
        return np.zeros(shape) if held.high is None else held.high + held.low

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q for the covariance V (divisor n)."""
        return self.total(lambda x: x.T @ (x @ q), q.shape) / self.centre.n


def orthonormal(t: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of what the columns of ``t`` add to the spaces of ``against``."""
    norms = np.linalg.norm(t, axis=0)
    t = t[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for z in against:
            t = t - z @ (z.T @ t)
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, s > 1e-8 * max(1.0, s.max(initial=0))]
    return t


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, least: float = 0.05) -> np.ndarray:
    """Approximate solutions of the symmetric systems apply(x) = b, one per column, all columns in
    one ``apply`` a step; stops after ``steps`` or when every residual fell to ``least`` of b."""
    x, old, w0, w1 = (np.zeros_like(b) for _ in range(4))
    size = np.linalg.norm(b, axis=0)
    start = np.where(size > 0, size, 1.0)
    v, eta, beta = b / start, size.copy(), np.zeros(b.shape[1])
    c0, c1, s0, s1 = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * old
        after = np.linalg.norm(p, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        rho1, rho2, rho3 = np.hypot(delta, after), s1 * alpha + c0 * c1 * beta, s0 * beta
        live = (rho1 > 1e-300) & (np.abs(eta) > 1e-14 * start)
        safe = np.where(live, rho1, 1.0)
        w = np.where(live, (v - rho3 * w0 - rho2 * w1) / safe, 0.0)
        c0, c1, s0, s1 = c1, np.where(live, delta / safe, 1.0), s1, np.where(live, after / safe, 0.0)
        x += np.where(live, c1 * eta, 0.0) * w
        eta = np.where(live, -s1 * eta, 0.0)
        w0, w1 = w1, w
        old, v = v, np.where(live & (after > 0), p / np.where(after > 0, after, 1.0), 0.0)
        beta = after
        if (np.abs(eta) <= least * start).all():
            break
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 5,
                    inner: int = INNER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors, relative residuals) of the ``wanted`` largest eigenvalues of a
    symmetric operator, falling."""
    wanted = min(wanted, dims)
    tolerance = 8 * _EPS * max(dims, 1) ** 0.5
    space = min(dims, wanted + GUARD)
    most = min(dims, 3 * (wanted + GUARD))
    locked, values, residuals = np.zeros((dims, 0)), np.zeros(0), np.zeros(0)
    v = orthonormal(np.random.default_rng(seed).standard_normal((dims, space)), [])
    av = product(v) if space else v
    best, stalled = np.inf, 0
    for _ in range(OUTER):
        h = v.T @ av
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        v, av = v @ s, av @ s
        scale = max(float(np.max(np.abs(np.append(values, theta)), initial=0)), 1e-300)
        r = av - v * theta
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0) / scale
        need = wanted - len(values)
        # a residual that further corrections no longer lower has reached what the sums resolve
        worst = float(size[:need].max(initial=0))
        stalled = stalled + 1 if worst > best / 2 else 0
        best = min(best, worst)
        whole = locked.shape[1] + v.shape[1] == dims
        enough = max(tolerance, worst if (whole or stalled >= 3) and worst < _EPS ** 0.75 else 0.0)
        good = size[:need] <= enough
        done = len(good) if good.all() else int(np.argmin(good))
        if done:
            locked, values = np.concatenate((locked, v[:, :done]), axis=1), np.append(values, theta[:done])
            residuals = np.append(residuals, size[:done])
            v, av, r, theta = v[:, done:], av[:, done:], r[:, done:], theta[done:]
            best, stalled = np.inf, 0
        need = wanted - len(values)
        if not need:
            return values, locked, residuals
        if v.shape[1] + need > most:  # restart with the best Ritz vectors
            v, av = v[:, :need + GUARD], av[:, :need + GUARD]
        active = v[:, :need]
        against = np.concatenate((locked, active), axis=1)

        def project(t: np.ndarray) -> np.ndarray:
            return t - against @ (against.T @ t)

        shift = theta[:need]
        t = minres(lambda t: project(product(t) - t * shift), -project(r[:, :need]), inner)
        t = orthonormal(t, [locked, v])
        if t.shape[1] == 0:  # nothing left in this direction: a random one
            t = orthonormal(np.random.default_rng(seed + len(values) + 1).standard_normal((dims, GUARD)), [locked, v])
        if t.shape[1]:
            v, av = np.concatenate((v, t), axis=1), np.concatenate((av, product(t)), axis=1)
    raise RuntimeError("the eigenvectors did not converge")


@dataclass
class Whitening:
    """Fitted components; ``basis`` maps centred vectors to whitened ones."""

    centre: Centre
    eigenvalues: np.ndarray
    components: np.ndarray  # dimensions x components
    residuals: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def basis(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace

    def rows(self, found: DataFrame) -> DataFrame:
        """(vec_id, deviation, whitened array<double>) of the rows of ``found`` (:func:`blocks`)."""
        centre, basis, dims = self.centre, self.basis, len(self.centre.sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x in _matrices(batch, dims):
                    d = centre.deviations(x[:, :dims])
                    if d.dtype == object or _top(d) ** 2 * max(dims, 1) > _MOST:
                        d = d.astype(object)
                    square = (d * d).sum(axis=1).tolist()
                    white = (d.astype(float) / centre.n) @ basis
                    at = np.arange(len(x) + 1) * basis.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids.to_pylist(), pa.int64()), pa.array([s if s <= _MOST else None for s in square], pa.int64()),
                         pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(white.ravel()))],
                        names=["vec_id", "deviation", "whitened"])

        return found.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")

    def apply(self, vectors: DataFrame, scale: int = SCALE) -> DataFrame:
        """:meth:`rows` of any vectors; dimensions beyond the fitted ones do not count."""
        return self.rows(blocks(vectors, scale))


def fit(found: DataFrame, components: int = COMPONENTS, offset: int = OFFSET) -> Whitening | None:
    """The whitening of all vectors of a written table of blocks, None where nothing varies."""
    centre, n_blocks = centre_of(found, offset), found.count()
    dims = len(centre.sums)
    if not centre.n or not dims:
        return None
    passes = Passes(found, centre, n_blocks)
    trace = float(passes.total(lambda x: np.array([[(x * x).sum()]]), (1, 1))[0, 0]) / centre.n
    if trace <= 0:
        return None
    values, q, residuals = jacobi_davidson(passes.product, dims, components)
    there = values > 8 * dims * _EPS * values[0]
    q = q[:, there] * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)[there]
    model = Whitening(centre, values[there], q, residuals[there], trace)
    basis, k = model.basis, q.shape[1]
    mean = passes.total(lambda x: (x @ basis).sum(axis=0, keepdims=True), (1, k)) / centre.n

    def second_moment(x: np.ndarray) -> np.ndarray:
        w = x @ basis - mean
        return w.T @ w

    model.identity_error = float(np.abs(passes.total(second_moment, (k, k)) / centre.n - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, Whitening | None]:
    """(vec_id, deviation, whitened) of all vectors that take part, and the model fitted on them."""
    parts = max(1, -(-vectors.count() // BLOCK_ROWS))
    found = materialize(blocks(vectors.select("vec_id", "embedding").coalesce(parts), scale), "vector-blocks")
    model = fit(found, components, offset)
    if model is None:
        spark = vectors.sparkSession
        return spark.createDataFrame([], "vec_id long, deviation long, whitened array<double>"), None
    return model.rows(found), model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    n, error = (model.centre.n, model.identity_error) if model else (0, 0.0)
    explained = F.array(*[F.lit(float(e)) for e in (model.explained if model else [])]).cast("array<double>")
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return long.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
