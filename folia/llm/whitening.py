"""Whitening of embeddings by a few leading components of their covariance, found by Jacobi-Davidson.

The covariance is never formed.  Each product of it with a block of vectors is a pass over the stored
vectors: tasks centre their rows, multiply and add up, and only blocks of ``dimension x columns`` numbers
come to the driver, which holds the search space.  Correction equations are projected against the
locked and the current Ritz vectors and solved by some steps of MINRES, all of a round in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import forget, fresh, lean, written

#: Whole numbers made of entries: floor(SCALE * c) + SHIFT.  Entries beyond BOUND count as not finite.
SCALE, SHIFT, BOUND = 1024, 100_000, float(1 << 40)
COMPONENTS = 8
#: MINRES steps a round, columns the search space may have (but for wide blocks), rounds, and the residual to reach as a share of the largest eigenvalue.
INNER, SPACE, ROUNDS, RESIDUAL = 5, 64, 200, 1e-13
#: Share of the largest eigenvalue under which a component is rounding, hence none.
RANK = 1e-12
#: Partial sums that come to the driver from one pass.
PARTS = 64


class Fit(NamedTuple):
    n: int
    sums: tuple[int, ...]  # of the whole numbers, by dimension
    trace: float
    values: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # a column each


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``key``, x array of long), written: rows without a vector, with a null or non-finite entry, or of another length than most (of
    equally frequent lengths the greatest) are dropped, as are empty vectors.  Repeated rows and rows without a key stay."""
    c = F.col(vector)
    fit = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < BOUND))
    (length,) = fresh([key, "x"], "length")
    rows = vectors.where(fit).select(key, F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + SHIFT).alias("x"), F.size(c).alias(length))
    stored = written(rows, "vectors")
    usual = stored.groupBy(length).count().orderBy(F.desc("count"), F.desc(length)).first()
    return stored.where(F.col(length) == (usual[0] if usual else 0)).select(key, "x")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _pass(stored: DataFrame, width: int, shape: tuple[int, int], make: Callable[[np.ndarray], np.ndarray], parts: int, kind=np.float64) -> np.ndarray:
    """The sum of ``make`` (of a batch of rows) over all rows; tasks add up first, and their sums are added in tasks again where they are many."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            total += make(_matrix(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    sums = stored.select("x").mapInArrow(part, "part binary")
    if parts > PARTS:
        sums = sums.repartition(PARTS).mapInArrow(add, "part binary")
    return sum((np.frombuffer(r["part"], kind).reshape(shape) for r in sorted(sums.collect())), np.zeros(shape, kind))


def _minres(multiply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of a symmetric equation for each column of ``right``, all columns a step at a time."""
    x, v_old, w, w_old = (np.zeros_like(right) for _ in range(4))
    beta = np.linalg.norm(right, axis=0)
    eta, v = beta.copy(), right / np.maximum(beta, 1e-300)
    beta, c, c_old, s, s_old = np.zeros_like(eta), np.ones_like(eta), np.ones_like(eta), np.zeros_like(eta), np.zeros_like(eta)
    for _ in range(steps):
        p = multiply(v)
        alpha = (v * p).sum(0)
        p -= alpha * v + beta * v_old
        after = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        first = np.maximum(np.hypot(delta, after), 1e-300)
        second, third = s * alpha + c_old * c * beta, s_old * beta
        c_old, c, s_old, s = c, delta / first, s, after / first
        w, w_old = (v - third * w_old - second * w) / first, w
        x += c * eta * w
        eta = -s * eta
        v, v_old, beta = p / np.maximum(after, 1e-300), v, after
    return x


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The part of ``new`` that is at right angles to all others, as unit columns at right angles; dependent columns go."""
    out = np.zeros((len(new), 0))
    for column in new.T:
        length = np.linalg.norm(column)
        column = column / length if length > 0 else column
        for _ in range(3):
            for other in (*against, out):
                column = column - other @ (other.T @ column)
            length = np.linalg.norm(column)
            if length < 1e-12:
                break
            column = column / length
        else:
            out = np.column_stack((out, column))
    return out


def jacobi_davidson(multiply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, inner: int = INNER, space: int = SPACE, residual: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator known by its products with blocks.

    Leading Ritz pairs are locked as their residuals reach ``residual`` times the largest eigenvalue, or
    when the search space holds all there is.  The search restarts with its best Ritz vectors at ``space`` columns.
    """
    wanted = min(wanted, width)
    locked, values = np.zeros((width, 0)), []
    basis = _orthonormal(np.random.default_rng(11).standard_normal((width, min(width, wanted + 4))))
    image, largest = multiply(basis), 0.0
    for _ in range(ROUNDS):
        h = basis.T @ image
        ritz, turn = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-ritz)
        ritz, basis, image = ritz[order], basis @ turn[:, order], image @ turn[:, order]
        largest = max(largest, abs(ritz[0]), *map(abs, values))
        left = image - basis * ritz
        full = locked.shape[1] + basis.shape[1] >= width
        norms, done = np.linalg.norm(left, axis=0), 0
        while done < min(wanted - len(values), len(ritz)) and (full or norms[done] <= residual * largest):
            done += 1
        locked, values = np.column_stack((locked, basis[:, :done])), [*values, *ritz[:done]]
        basis, image, ritz, left = basis[:, done:], image[:, done:], ritz[done:], left[:, done:]
        if len(values) >= wanted:
            order = np.argsort(-np.asarray(values), kind="stable")
            return np.asarray(values)[order], locked[:, order]
        goal = min(wanted - len(values), basis.shape[1])
        room = max(space, 3 * wanted + 4)
        if basis.shape[1] + goal > room:
            basis, image = basis[:, : room // 2], image[:, : room // 2]
        known, shift = np.column_stack((locked, basis[:, :goal])), ritz[:goal]

        def project(block: np.ndarray, known=known) -> np.ndarray:
            for _ in range(2):
                block = block - known @ (known.T @ block)
            return block

        corrections = _minres(lambda v: project(multiply(v) - v * shift), project(-left[:, :goal]), inner)  # noqa: B023
        new = _orthonormal(corrections, locked, basis)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(len(values) + 1).standard_normal((width, goal)), locked, basis)
        basis, image = np.column_stack((basis, new)), np.column_stack((image, multiply(new)))
    raise ArithmeticError(f"residuals of {norms.min() / largest:.1e} of the largest eigenvalue are left after {ROUNDS} rounds")


def fit(stored: DataFrame, components: int = COMPONENTS) -> Fit:
    """Number, sums and leading components of rows of ``whole_numbers``; of no rows, or equal ones, no component.

    Components whose eigenvalue is rounding (``RANK`` of the largest) are left out: nothing can be whitened along them.
    """
    parts, first = stored.rdd.getNumPartitions(), stored.select(F.size("x")).first()
    if first is None:
        return Fit(0, (), 0.0, np.zeros(0), np.zeros((0, 0)))
    width = first[0]
    counted = _pass(stored, width, (1, width + 1), lambda m: np.concatenate((m.sum(0), [len(m)]))[None], parts, np.int64)[0]
    n, sums = int(counted[-1]), tuple(map(int, counted[:-1]))
    mean = np.asarray([s / n for s in sums])
    trace = float(_pass(stored, width, (1, 1), lambda m: np.full((1, 1), np.square(m - mean).sum()), parts)[0, 0]) / n
    if trace <= 0:
        return Fit(n, sums, 0.0, np.zeros(0), np.zeros((width, 0)))

    def multiply(block: np.ndarray) -> np.ndarray:
        def product(m: np.ndarray) -> np.ndarray:
            centred = m - mean
            return centred.T @ (centred @ block)

        return _pass(stored, width, block.shape, product, parts) / n

    values, vectors = jacobi_davidson(multiply, width, components)
    some = values > RANK * values[0]
    return Fit(n, sums, trace, values[some], vectors[:, some])


def _projected(m: np.ndarray, fitted: Fit) -> np.ndarray:
    return (m - np.asarray([s / fitted.n for s in fitted.sums])) @ fitted.vectors / np.sqrt(fitted.values)


def identity_error(stored: DataFrame, fitted: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; 0 without components."""
    k, width, parts = len(fitted.values), len(fitted.sums), stored.rdd.getNumPartitions()
    if not k:
        return 0.0
    mean = _pass(stored, width, (1, k), lambda m: _projected(m, fitted).sum(0)[None], parts)[0] / fitted.n

    def square(m: np.ndarray) -> np.ndarray:
        own = _projected(m, fitted) - mean
        return own.T @ own

    return float(np.abs(_pass(stored, width, (k, k), square, parts) / fitted.n - np.eye(k)).max())


def _deviations(m: np.ndarray, fitted: Fit) -> list[int | None]:
    """Exact sums of squares of n * x - S; null where a long doesn't hold one."""
    safe = fitted.n * float(np.abs(m).max(initial=0)) < 2.0**61 and max(map(abs, fitted.sums)) < 2**61
    gaps = m * fitted.n - np.asarray(fitted.sums, np.int64) if safe else m.astype(object) * fitted.n - np.asarray(fitted.sums, object)
    if safe and np.square(gaps.astype(float)).sum(1).max(initial=0) < 2.0**62:
        return np.square(gaps).sum(1).tolist()
    exact = (sum(int(g) ** 2 for g in row) for row in gaps)
    return [x if x < 2**63 else None for x in exact]


def whiten(stored: DataFrame, fitted: Fit, error: float) -> DataFrame:
    """A row for each row of ``stored`` and component of ``fitted``, from 1."""
    key, k, width = stored.columns[0], len(fitted.values), len(fitted.sums)
    added = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([stored.schema[key], *(T.StructField(name, kind) for name, kind in added)])
    if not k:
        return stored.sparkSession.createDataFrame([], schema)
    shared = stored.sparkSession.sparkContext.broadcast((fitted, fitted.values / fitted.trace))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, explained = shared.value
        for batch in batches:
            m = _matrix(batch.column(1), width)
            again = np.repeat(np.arange(len(m)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                    pa.array(np.full(len(again), own.n)),
                    pa.array(_deviations(m, own), pa.int64()).take(pa.array(again)),
                    pa.array(_projected(m, own).ravel()),
                    pa.array(np.tile(explained, len(m))),
                    pa.array(np.full(len(again), error)),
                ],
                names=schema.names,
            )

    return stored.mapInArrow(lean(out), schema)


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained and identity_error of all fit rows of ``vectors``, written.

    The result has no rows where no row is fit or all fit rows are equal.  Other columns of ``vectors`` don't count.
    """
    stored = whole_numbers(vectors, key, vector)
    fitted = fit(stored, components)
    out = written(whiten(stored, fitted, identity_error(stored, fitted)), "whitened")
    forget(stored)
    return out
