"""Whitened embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance come from a small block of directions Q and passes over
the vectors: each pass sums centred XᵀXQ in the tasks, and Spark adds the tasks' matrices entry by
entry. A polynomial recurrence over such passes damps the spectrum below the block's least Ritz value;
QR and a Rayleigh-Ritz step turn the block into estimates. That repeats until the residuals of the
wanted components certify them. Nothing grows with the number of vectors but the passes' input.

Sums of the vectors' whole numbers are exact; the centre is divided once and taken off every vector
before anything is multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.llm.vectors import quantised
from dayledger.session import kept

COMPONENTS = 4
#: Directions of the block beside the wanted ones: the more, the better the spectrum is apart.
GUARD = 28
#: Passes of a filter at most, and filters.
DEGREE = 16
FILTERS = 40
#: Residual of a certified component, relative to the largest eigenvalue, and the largest one that is
#: accepted where rounding lets it fall no further.
CERTIFIED = 1e-13
ACCEPTED = 1e-11
#: Variance of a component that counts as none, relative to the largest.
NOTHING = 1e-12
SEED = 12

RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
    "identity_error double"
)


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a batch, one a row."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def totals(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums by dimension."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            x = matrix(batch.column(0), dim)
            # Parts whose sums fit 64 bits in any case.
            step = max(1, int(2**62 // max(1, float(np.abs(x.astype(float)).max(initial=0)))))
            for i in range(0, len(x), step):
                sums = [a + int(b) for a, b in zip(sums, x[i : i + step].sum(0), strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))],
                ["at", "total"],
            )

    parts = fit.select("x").mapInArrow(added, "at int, total decimal(38,0)")
    found = {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def summed(fit: DataFrame, centre: np.ndarray, of: Callable[[np.ndarray], np.ndarray], shape: tuple) -> np.ndarray:
    """The sum over all vectors of ``of`` a batch of centred ones; a task adds up its own batches."""
    dim = len(centre)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch.column(0), dim) - centre)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["part"])

    parts = fit.select("x").mapInArrow(added, "part array<double>").select(F.posexplode("part").alias("at", "value"))
    whole = np.zeros(int(np.prod(shape)))
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        whole[r["at"]] = r["value"]
    return whole.reshape(shape)


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, top: float, least: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times ``q``, small on [0, least] and 1 at ``top``."""
    half = middle = least / 2
    first = scale = half / (top - middle)
    before, now = q, (times(q) - middle * q) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, 2 * (times(now) - middle * now) * (following / half) - scale * following * before
        scale = following
    return now


def components(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and unit eigenvectors of the matrix that ``times`` applies.

    The largest entry of an eigenvector is positive.
    """
    block = min(dim, wanted + GUARD)
    q = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, block)))[0]
    best = np.inf
    for _ in range(FILTERS):
        image = times(q)
        inner = q.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residual = np.sqrt(((image - q * values) ** 2).sum(0))[:wanted].max(initial=0)
        largest = max(values[0], 0.0)
        if residual <= CERTIFIED * largest or block == dim:
            break
        if residual >= best / 2 and residual <= ACCEPTED * largest:
            break
        best, least = min(best, residual), max(values[-1], 0.0)
        if least <= NOTHING * largest:
            # No spectrum is left to damp: a plain power step.
            q = image
        else:
            # Passes that take the residual to the certified one, as the polynomial grows outside.
            growth = np.arccosh(max(2 * values[wanted - 1] / least - 1, 1 + 1e-12))
            degree = int(np.clip(np.log(residual / (CERTIFIED * largest)) / growth + 2, 2, DEGREE))
            q = filtered(times, q, largest, least, degree)
        q = np.linalg.qr(q)[0]
    else:
        raise ArithmeticError(f"components not certified: residual {residual:.3g} of {largest:.3g}")
    q = q[:, :wanted]
    q = q * np.where(q[np.abs(q).argmax(0), np.arange(q.shape[1])] < 0, -1.0, 1.0)
    return values[:wanted], q


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n * x - S) ** 2, exact; None where they are no 64-bit numbers."""
    most = n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)
    if most**2 * max(1, x.shape[1]) < 2**62:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(1).tolist()
    away = n * x.astype(object) - np.array(sums, object)
    return [v if v < 2**63 else None for v in map(int, (away * away).sum(1))]


def whitened_rows(own: DataFrame, dim: int, wanted: int) -> DataFrame:
    """The result for vectors (vec_id, x) of one length."""
    own = own.where(F.size("x") == dim)
    fit = kept(own.select("x").distinct(), "fit")
    n, sums = totals(fit, dim)
    centre = np.array([float(Fraction(s, n)) for s in sums])
    trace = float(summed(fit, centre, lambda y: np.array([np.einsum("ij,ij->", y, y)]), (1,))[0]) / n

    def times(q: np.ndarray) -> np.ndarray:
        return summed(fit, centre, lambda y: y.T @ (y @ q), q.shape) / n

    values, vectors = components(times, dim, min(wanted, dim))
    real = values > NOTHING * max(trace, 0.0)
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return own.sparkSession.createDataFrame([], RESULT)
    scaled = vectors / np.sqrt(values)

    def square(y: np.ndarray) -> np.ndarray:
        w = y @ scaled
        return np.concatenate([w.sum(0)[None, :], w.T @ w])

    both = summed(fit, centre, square, (len(values) + 1, len(values))) / n
    error = float(np.abs(both[1:] - np.outer(both[0], both[0]) - np.eye(len(values))).max())
    explained = values / trace

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            k = len(values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(x) * k, n), pa.int64()),
                    pa.array(np.repeat(np.array(deviations(x, n, sums), object), k), pa.int64()),
                    pa.array(((x - centre) @ scaled).ravel(), pa.float64()),
                    pa.array(np.tile(explained, len(x)), pa.float64()),
                    pa.array(np.full(len(x) * k, error), pa.float64()),
                ],
                [c.split()[0] for c in RESULT.split(", ")],
            )

    return own.select("vec_id", "x").mapInArrow(placed, RESULT)


def whiten(
    df: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Rows whose vector is null, empty or holds null or non-finite components are left out; rows
    without an id stay. Each different vector counts once in centre and covariance. Vectors of
    different lengths are whitened apart (one fit per length). A component without variance has no
    rows, so a table of equal vectors gives an empty result; ``deviation`` is null where it is no
    64-bit number. Repeated rows have a result each. Other columns are not read; an empty table
    gives an empty result.
    """
    own = kept(quantised(df, id_col, vector_col).where(F.size("x") > 0), "vectors")
    lengths = sorted(r[0] for r in own.select(F.size("x")).distinct().collect())
    result = df.sparkSession.createDataFrame([], RESULT)
    for dim in lengths:
        result = result.union(whitened_rows(own, dim, wanted))
    return result
