"""Whitening of embeddings by Jacobi-Davidson.

Vectors become whole numbers and are stored in blocks of rows. The covariance matrix is
never formed: a product with it is a pass over the blocks, each centred before it is
multiplied, and only sums of the size of the factor come back. Jacobi-Davidson builds a
small subspace on the driver: Rayleigh-Ritz gives the best pairs in it, pairs whose
residual has reached double precision are locked, and for the others MINRES solves the
projected correction equations, all of them in the same passes. Sums, deviations and the
centre are exact whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import new_path

COMPONENTS = 8
SCALE = 1_024
SHIFT = 100_000
# Values of a stored block: small rows, so that an Arrow batch of them stays small.
BLOCK_VALUES = 1 << 15
# Rows that partial sums are brought to before the driver adds them.
SUMMED = 16
# Entries this large would leave a long after scaling.
LARGEST = float(1 << 50)
# Residuals and eigenvalues against the largest eigenvalue.
PRECISION = 64 * np.finfo(float).eps
LEAST_SHARE = 1e-11
INNER_STEPS = 3
ROUNDS = 200

_BLOCKS = "ids array<long>, x binary"

Product = Callable[[np.ndarray], np.ndarray]


def whole(embedding: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """``floor(scale * x) + shift`` of each entry; null where the vector or an entry is null or not finite."""
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST))
    return F.when(ok, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")) + F.lit(shift)))


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
        step = max(1, BLOCK_VALUES // x.shape[1])
        for start in range(0, len(x), step):
            ids = batch.column("vec_id").slice(start, step)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x[start : start + step].astype("<i8").tobytes()], pa.binary())],
                names=["ids", "x"],
            )


class Centred:
    """The stored blocks, how many rows they have, exact sums of each dimension, and passes over them."""

    def __init__(self, blocks: DataFrame, dim: int):
        self.blocks, self.dim, self.passes = blocks, dim, 0
        # Sums of the high and low halves stay far from the bounds of a long.
        found = self._summed(_moments, [("n", 1), ("high", dim), ("low", dim)], "long")
        self.n = int(found["n"][0])
        self.sums = [(int(h) << 32) + int(l) for h, l in zip(found["high"], found["low"])]
        self.most = max(map(abs, self.sums), default=0) + self.n * int(self._largest())

    def _largest(self) -> int:
        def largest(batches):
            for batch in batches:
                for x in batch.column("x").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([int(np.abs(np.frombuffer(x, "<i8")).max())])], names=["most"])

        return self.blocks.mapInArrow(largest, "most long").agg(F.max("most")).first()[0] or 0

    def _summed(self, partial, parts: list[tuple[str, int]], kind: str) -> dict[str, np.ndarray]:
        """Add up the arrays that ``partial(x)`` gives for each block of whole numbers."""
        self.passes += 1
        width, dim, dtype = sum(n for _, n in parts), self.dim, np.int64 if kind == "long" else np.float64
        arrow = pa.list_(pa.int64() if kind == "long" else pa.float64())

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width, dtype)
            for batch in batches:
                for x in batch.column("x"):
                    total += partial(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([pa.array([total], arrow)], names=["total"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width, dtype)
            for batch in batches:
                total += batch.column("total").flatten().to_numpy().reshape(-1, width).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total], arrow)], names=["total"])

        schema = f"total array<{kind}>"
        rows = self.blocks.select("x").mapInArrow(sums, schema).repartition(SUMMED).mapInArrow(added, schema).collect()
        total = np.sum([np.array(r[0], dtype) for r in rows], axis=0) if rows else np.zeros(width, dtype)
        cuts = np.cumsum([n for _, n in parts])[:-1]
        return dict(zip([name for name, _ in parts], np.split(total, cuts)))

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance matrix times ``vectors``, one pass over the rows."""
        centre, n, columns = self.centre(), self.n, vectors.shape[1]

        def partial(x: np.ndarray) -> np.ndarray:
            x = centre(x)
            return (x.T @ (x @ vectors)).ravel()

        return self._summed(partial, [("p", self.dim * columns)], "double")["p"].reshape(self.dim, columns) / n

    def trace(self) -> float:
        centre, n = self.centre(), self.n

        def partial(x: np.ndarray) -> np.ndarray:
            return np.array([np.square(centre(x)).sum()])

        return float(self._summed(partial, [("t", 1)], "double")["t"][0]) / n

    def identity_error(self, projector: np.ndarray) -> float:
        """Largest absolute entry of the covariance of the projected rows minus the identity."""
        centre, n, k = self.centre(), self.n, projector.shape[1]

        def partial(x: np.ndarray) -> np.ndarray:
            w = centre(x) @ projector
            return np.r_[w.sum(axis=0), (w.T @ w).ravel()]

        found = self._summed(partial, [("s", k), ("m", k * k)], "double")
        mean = found["s"] / n
        covariance = found["m"].reshape(k, k) / n - np.outer(mean, mean)
        return float(np.abs(covariance - np.eye(k)).max())

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows minus the mean, from the exact ``n * x - S``."""
        deviation, n = self.deviations(), self.n
        return lambda x: deviation(x).astype(float) / n

    def deviations(self) -> Callable[[np.ndarray], np.ndarray]:
        """Exact ``n * x - S`` of rows, in longs while they hold them."""
        n, sums = self.n, self.sums
        if self.most < 1 << 62:
            longs = np.array(sums, np.int64)
            return lambda x: x * n - longs
        return lambda x: x.astype(object) * n - np.array(sums, object)


def _moments(x: np.ndarray) -> np.ndarray:
    return np.r_[len(x), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """What ``new`` adds to the ``bases``, as orthonormal columns; columns that add nothing go."""
    out = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(2):
            for base in (*bases, out):
                column = column - base @ (base.T @ column)
        rest = np.linalg.norm(column)
        if rest > 1e-10:
            column = column / rest
            for base in (*bases, out):
                column = column - base @ (base.T @ column)
            out = np.c_[out, column / np.linalg.norm(column)]
    return out


def _minres(product: Product, shifts: np.ndarray, right: np.ndarray, away: np.ndarray, steps: int, accuracy: float) -> np.ndarray:
    """Solve ``P (A - shift) P t = right`` column by column, P projecting ``away``; every step is
    one product for all columns. Stops where all residuals are ``accuracy`` of the start's."""

    def project(x: np.ndarray) -> np.ndarray:
        return x - away @ (away.T @ x)

    def scaled(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.divide(x, by, out=np.zeros_like(x), where=by > 0)

    v = project(right)
    beta = np.linalg.norm(v, axis=0)
    start = beta.copy()
    v, before = scaled(v, beta), np.zeros_like(v)
    solution, d1, d2 = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    c1 = c2 = np.ones_like(beta)
    s1 = s2 = np.zeros_like(beta)
    left, beta = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        p = project(product(v) - v * shifts) - before * beta
        alpha = (v * p).sum(axis=0)
        p = project(p - v * alpha)
        after = np.linalg.norm(p, axis=0)
        # The two rotations before this one, then the one that removes ``after``.
        eps, rest = s2 * beta, c2 * beta
        delta, gamma = c1 * rest + s1 * alpha, c1 * alpha - s1 * rest
        size = np.hypot(gamma, after)
        c, s = np.where(size > 0, gamma / np.where(size > 0, size, 1), 1), np.where(size > 0, after / np.where(size > 0, size, 1), 0)
        d = scaled(v - d1 * delta - d2 * eps, size)
        solution = solution + d * (c * left)
        left = -s * left
        d1, d2, c1, c2, s1, s2 = d, d1, c, c1, s, s1
        before, v, beta = v, scaled(p, after), after
        if (np.abs(left) <= accuracy * start).all():
            break
    return solution


def leading(product: Product, dim: int, k: int, inner: int = INNER_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a positive semidefinite matrix, falling, and their unit
    eigenvectors, by Jacobi-Davidson; ``product`` multiplies the matrix with columns."""
    k, widest = min(k, dim), min(dim, max(8 * k, 64))
    rng = np.random.default_rng(0)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    basis = _orthonormal(rng.standard_normal((dim, min(dim, 4 * k))))
    image = product(basis)
    least, stuck = np.inf, 0
    for number in range(ROUNDS):
        ritz, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        want = k - len(values)
        top = max([*values, *ritz[:1]])
        residuals = image[:, :want] - basis[:, :want] * ritz[:want]
        residuals = residuals - locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        worst = float(sizes.max())
        stuck = 0 if worst < least / 2 else stuck + 1
        least = min(least, worst)
        # After rounds without progress rounding is all that is left.
        bound = PRECISION * top if stuck < 12 else 1e-12 * top
        whole_space = basis.shape[1] + locked.shape[1] == dim
        if (sizes <= bound).all():
            fresh = product(basis[:, :want])
            again = fresh - basis[:, :want] * (basis[:, :want] * fresh).sum(axis=0)
            again = again - locked @ (locked.T @ again)
            if (np.linalg.norm(again, axis=0) <= 4 * bound).all():
                vectors = np.c_[locked, basis[:, :want]]
                values = np.r_[values, ritz[:want]]
                order = np.argsort(-values, kind="stable")
                return values[order], vectors[:, order]
            image = np.c_[fresh, image[:, want:]]
        # Pairs are locked from the largest on, so that none is passed over.
        done = int(np.argmax(sizes > bound)) if (sizes > bound).any() else 0
        if done:
            locked, values = np.c_[locked, basis[:, :done]], np.r_[values, ritz[:done]]
            basis, image, ritz, residuals, sizes = basis[:, done:], image[:, done:], ritz[done:], residuals[:, done:], sizes[done:]
            want -= done
        if whole_space:
            image = product(basis)  # nothing can be added: only rounding of the image is left
            continue
        room = widest - locked.shape[1] - basis.shape[1]
        if room < want and basis.shape[1] > 3 * want:
            basis, image = basis[:, : 3 * want], image[:, : 3 * want]
        open_ = np.flatnonzero(sizes > bound)
        away = np.c_[locked, basis[:, :want]]
        found = _minres(product, ritz[open_], -residuals[:, open_], away, inner, 0.1 / (number + 2))
        new = _orthonormal(found, locked, basis)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((dim, 1)), locked, basis)
        basis, image = np.c_[basis, new], np.c_[image, product(new)]
    raise ArithmeticError(f"eigenvectors did not converge: residual {least:.3g} against {top:.3g}")


def _rows(n: int, deviation, projector: np.ndarray, shares: np.ndarray, error: float, dim: int):
    k = projector.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in zip(batch.column("ids").to_pylist(), batch.column("x").to_pylist()):
                exact = deviation(np.frombuffer(x, "<i8").reshape(-1, dim))
                most = int(np.abs(exact).max())
                if most * most * dim >= 1 << 63:
                    exact = exact.astype(object)
                squares = [d if d < 1 << 63 else None for d in (exact * exact).sum(axis=1).tolist()]
                whitened = exact.astype(float) / n @ projector
                m = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i in ids for _ in range(k)], pa.int64()),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        pa.array([d for d in squares for _ in range(k)], pa.int64()),
                        pa.array(whitened.ravel()),
                        pa.array(np.tile(shares, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened components of ``vectors(vec_id, embedding)`` after ``whole``.

    Returns per row and component (from 1, by falling eigenvalue of the covariance matrix, divisor n):
    ``vec_id, component, n`` (rows of the fit), ``deviation`` (exact sum of ``(n * x - S) ** 2`` over
    the dimensions; null where it leaves a long), ``whitened`` (the centred row projected on the
    unit eigenvector, over the root of the eigenvalue), ``explained`` (eigenvalue over trace) and
    ``identity_error`` (largest absolute entry of the whitened covariance minus the identity).

    Rows with a null vector, a null or non-finite entry, or one of 2 ** 50 or more take no part,
    nor do vectors that are not of the commonest dimension (of equally common ones the
    largest). Null and repeated ids and equal vectors are rows like others. Eigenvalues below
    ``LEAST_SHARE`` of the largest have no whitening: fewer components, none for one row, equal
    rows, empty vectors or an empty table, which give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    x = whole(F.col("embedding"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    nothing = spark.createDataFrame([], _OUT)
    if common is None:
        return nothing
    dim = common["dim"]
    path = new_path(spark, "whitening-blocks")
    rows.filter(F.size("x") == dim).mapInArrow(_blocked, _BLOCKS).write.parquet(path)
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    centred = Centred(blocks, dim)
    trace = centred.trace()
    if not trace:
        return nothing
    values, directions = leading(centred.product, dim, components)
    kept = values > LEAST_SHARE * values[0]
    values, directions = values[kept], directions[:, kept]
    projector = directions / np.sqrt(values)
    error = centred.identity_error(projector)
    return blocks.mapInArrow(_rows(centred.n, centred.deviations(), projector, values / trace, error, dim), _OUT)
