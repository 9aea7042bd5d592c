"""Whitening of embeddings by a Jacobi-Davidson eigensolver that never forms the covariance.

Entries become integers ``floor(scale * c) + offset``, written once to the shared folder, so counts and sums are exact.
Centring is exact to rounding as well: the nearest integer to the mean is taken off first, then the small rest.
A product of the covariance with a block of directions is one pass: every task multiplies its centred rows, forward
and back, and one row per dimension is summed by Spark. Nothing of size dimension x dimension is made anywhere.

Outer loop: Rayleigh-Ritz in a subspace of at most ``SUBSPACE`` directions; Ritz pairs whose residual has reached the
rounding of the products are locked, in falling order. For the next ones, a block at once, the correction equation
``(I - QQ')(V - theta I)(I - QQ') t = -r`` (Q: locked and current directions) is solved roughly by MINRES, and the answers
widen the subspace, which restarts from its best directions when it is full. The residuals that end it are those of a
fresh product.

Per task: a batch of rows and a block of directions. The driver holds dimension x ``SUBSPACE`` numbers and sums.

Defined results: rows whose vector is NULL, or holds NULL, non-finite entries or ones beyond 2^52 / scale, are left out, as
are empty vectors. Vectors of each length are whitened on their own. Components whose variance is nothing but rounding
(fewer rows than dimensions, constant or equal columns) are left out, so a single row gives none. Equal
eigenvalues: any orthonormal directions. A deviation that no long can hold is NULL. Repeated rows count each, and
rows with a NULL id are kept. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.sources.staging import stage

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Directions of the subspace at most, kept at a restart, and MINRES steps of one correction.
SUBSPACE, KEPT, INNER = 64, 24, 8
#: Residual, relative to the largest eigenvalue, at which a pair counts as exact; products cannot do better.
EXACT = 2e-14
#: Best residual still accepted where rounding keeps a pair from getting there.
ROUNDED = 1e-11
OUTER = 200
Product = Callable[[np.ndarray], np.ndarray]


def integers(vectors: DataFrame, key: str, vector: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(key, dim, x)`` of the rows that stay."""
    most = float(2**52) / scale
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < most)) & (F.size(vector) > 0)
    kept = vectors.filter(F.coalesce(sound, F.lit(False)))
    return kept.select(F.col(key), F.size(vector).alias("dim"), F.transform(
        vector, lambda c: F.floor(c.cast("double") * scale) + offset).alias("x"))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass(frozen=True)
class Moments:
    """Row count and exact sums of one length; a row centred is ``(x - whole) - rest``."""

    dim: int
    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s - self.n * int(w)) / self.n for s, w in zip(self.sums, self.whole, strict=True)])


def moments(rows: DataFrame) -> list[Moments]:
    """Exact counts and sums of every length; one number per dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                x = _rows(batch.column(1).filter(pa.array(dims == dim)), dim)
                total = held.setdefault(dim, [0] * (dim + 1))
                for i, v in enumerate([len(x), *x.sum(0).tolist()]):
                    total[i] += v
        for dim, total in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * (dim + 1), pa.int32()), pa.array(range(-1, dim), pa.int32()), pa.array([str(t) for t in total])], names=["dim", "at", "s"])

    sums = rows.select("dim", "x").mapInArrow(add, "dim int, at int, s string")
    found: dict[int, dict[int, int]] = {}
    for r in sums.groupBy("dim", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        found.setdefault(r["dim"], {})[r["at"]] = int(r["s"])
    return [Moments(dim, s[-1], tuple(s[i] for i in range(dim))) for dim, s in sorted(found.items())]


def _summed(rows: DataFrame, dim: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of what ``of`` gives for each batch (any number of lines, ``width`` wide), line by line."""
    names = [f"c{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_rows(batch.column(0), dim))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(c) for c in total.T)], names=["at", *names])

    parts = rows.filter(F.col("dim") == dim).select("x").mapInArrow(run, "at int, " + ", ".join(f"{c} double" for c in names))
    out = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    whole = np.zeros((out.num_rows, width))
    whole[out["at"].to_numpy()] = np.stack([out[c].to_numpy() for c in names], axis=1)
    return whole


def covariance_product(rows: DataFrame, of: Moments) -> Product:
    """``V @ block`` as one pass over the rows, centred before multiplying."""
    whole, rest, n = of.whole, of.rest, of.n

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = (x - whole) - rest
            return centred.T @ (centred @ block)

        return _summed(rows, of.dim, block.shape[1], part) / n

    return product


def total_variance(rows: DataFrame, of: Moments) -> float:
    whole, rest = of.whole, of.rest
    return float(_summed(rows, of.dim, 1, lambda x: (((x - whole) - rest) ** 2).sum(0)[:, None]).sum() / of.n)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Directions of ``block`` outside ``against``; those that have nothing outside are left out."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-8] / size[size > 1e-8]
    if not block.shape[1]:
        return block
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-8]
    q = q - against @ (against.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def minres(product: Product, theta: np.ndarray, right: np.ndarray, outside: np.ndarray, steps: int, good: float = 0.05) -> np.ndarray:
    """Answers of the projected equations, one per column and shift, by MINRES; all columns share each product."""

    def project(z: np.ndarray) -> np.ndarray:
        return z - outside @ (outside.T @ z)

    b = project(right)
    beta = np.linalg.norm(b, axis=0)
    start, live = beta.copy(), beta > 0
    safe = np.where(live, beta, 1.0)
    v, before = b / safe, np.zeros_like(b)
    x, w, older = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    beta_before, phi = np.zeros_like(beta), beta.copy()
    c, s, c_before, s_before = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        z = project(product(v) - v * theta) - before * beta_before
        alpha = (v * z).sum(0)
        z = z - v * alpha
        beta_new = np.linalg.norm(z, axis=0)
        # Rotations of the tridiagonal matrix, two back.
        epsilon, middle = s_before * beta_before, c_before * beta_before
        delta, diagonal = c * middle + s * alpha, -s * middle + c * alpha
        rho = np.hypot(diagonal, beta_new)
        live &= rho > 0
        rho = np.where(live, rho, 1.0)
        w_new = (v - epsilon * older - delta * w) / rho
        c_before, s_before = c, s
        c, s = diagonal / rho, beta_new / rho
        x = x + np.where(live, c * phi, 0.0) * w_new
        phi = -s * phi
        older, w = w, w_new
        live &= (beta_new > 1e-14 * np.abs(theta)) & (np.abs(phi) > good * start)
        if not live.any():
            break
        # A column that is done stays still.
        w, beta_before = np.where(live, w, 0.0), np.where(live, beta_new, 0.0)
        before, v = v, np.where(live, z / np.where(live, beta_new, 1.0), 0.0)
    return project(x)


def leading(product: Product, dim: int, trace: float, count: int = COMPONENTS, subspace: int = SUBSPACE, kept: int = KEPT,
            inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues above rounding, falling, and their unit eigenvectors as columns."""
    count = min(count, dim)
    subspace, kept = min(dim, subspace), min(dim, kept, max(1, subspace - count))
    if not trace > 0:
        return np.zeros(0), np.zeros((dim, 0))
    q = np.linalg.qr(np.random.default_rng(11).normal(size=(dim, min(dim, 2 * count))))[0]
    vq, fresh = product(q), True
    best, still = np.full(count, np.inf), 0
    for _ in range(OUTER):
        middle = q.T @ vq
        theta, turn = np.linalg.eigh((middle + middle.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        u = q @ turn[:, :count]
        r = vq @ turn[:, :count] - u * theta[:count]
        size = np.linalg.norm(r, axis=0)
        wanted = theta[:count] > 1e-12 * trace
        still = 0 if (size < 0.5 * best)[wanted].any() else still + 1
        best = np.minimum(best, size)
        exact = (size <= EXACT * theta[0]) | ~wanted
        done = exact.all() or (still >= 3 and (size[wanted] <= ROUNDED * theta[0]).all())
        if done and fresh:
            break
        if done or q.shape[1] == dim:  # nothing left but rounding: begin again from the best directions
            q = np.linalg.qr(q @ turn[:, :dim if q.shape[1] == dim else kept])[0]
            vq, fresh = product(q), True
            continue
        locked = int(np.argmin(exact))
        todo = locked + np.flatnonzero(~exact[locked:])
        t = minres(product, theta[todo], -r[:, todo], np.linalg.qr(u)[0], inner)
        if q.shape[1] + len(todo) > subspace:
            q, tri = np.linalg.qr(q @ turn[:, :kept])
            vq = vq @ turn[:, :kept] @ np.linalg.inv(tri)
        more = _orthonormal(t, q)
        if not more.shape[1]:  # the answers lie in the subspace already
            more = _orthonormal(np.random.default_rng(q.shape[1]).normal(size=(dim, min(dim - q.shape[1], count))), q)
        q, vq, fresh = np.hstack([q, more]), np.hstack([vq, product(more)]), False
    else:
        raise ArithmeticError("eigenvectors did not reach double precision")
    keep = np.flatnonzero(wanted)
    u = u[:, keep]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0)
    return theta[:count][keep], u


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` for every row that stays and component."""
    spark = vectors.sparkSession
    rows = stage(integers(vectors, key, vector, scale, offset), "whitening-integers")
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = {}
    for of in moments(rows):
        trace = total_variance(rows, of)
        values, u = leading(covariance_product(rows, of), of.dim, trace, count)
        if not len(values):
            continue
        turned, whole, rest = u / np.sqrt(values), of.whole, of.rest
        mean = _summed(rows, of.dim, len(values), lambda x, w=whole, r=rest, t=turned: (((x - w) - r) @ t).sum(0)[None])[0] / of.n

        def spread(x: np.ndarray, w=whole, r=rest, t=turned, m=mean) -> np.ndarray:
            y = ((x - w) - r) @ t - m
            return y.T @ y

        error = float(np.abs(_summed(rows, of.dim, len(values), spread) / of.n - np.eye(len(values))).max())
        fitted[of.dim] = (of, turned, values / trace, error)
    if not fitted:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in fitted:
                    continue
                of, turned, explained, error = fitted[dim]
                some = batch.filter(pa.array(dims == dim))
                x, k = _rows(some.column(2), dim), len(explained)
                centred = (x - of.whole) - of.rest
                y = centred @ turned
                far = (centred**2).sum(1) * float(of.n) ** 2 > 9e18
                with np.errstate(over="ignore"):
                    deviation = ((of.n * (x - of.whole) - np.array([s - of.n * int(w) for s, w in zip(of.sums, of.whole, strict=True)], np.int64)) ** 2).sum(1)
                at = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, of.n)),
                     pa.array(deviation, mask=far).take(at), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, "dim", "x").mapInArrow(run, schema)
