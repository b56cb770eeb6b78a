"""Embedding whitening: vectors projected on the leading components of their covariance, each scaled to variance one.

1. The fit list is each distinct whole-number vector once; its count and its sums per dimension are exact integers.
2. Tasks sum the outer products of the centred vectors; their partial matrices are added in a tree, FAN_IN at a time, so
   that neither one task nor the driver gets a matrix from every task. The driver holds one dim x dim matrix.
3. Householder reflections make it tridiagonal; bisection on Sturm counts gives the leading eigenvalues; inverse
   iteration, orthogonalised again within clusters of close eigenvalues, gives their vectors.
4. The projection (dim x components) is broadcast and applied to every row. The covariance of the whitened fit list is
   summed in the same way, and its distance from the identity is reported.

Defined cases: rows whose vector is null or holds a null or non-finite entry leave; an entry whose whole number needs more
than 32 bits counts as non-finite; entries missing from a shorter vector count as zero; a null id stays as a null id and
repeated rows give rows each; components without variance (an eigenvalue not above dim * 2**-52 of the largest) are
left out, so fewer come back for narrow or few vectors and none for a single one; an empty table gives no rows; other
columns are ignored. A component's sign is chosen so that its entry of largest size is positive. A deviation that
exceeds 64 bits is null. Vectors of more than MOST_DIMS entries raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.llm.common import small_batches
from cellsieve.session import cut

SCALE = 64
ORIGIN = 1_000_000
MOST_DIMS = 2048
FAN_IN = 8
EPS = float(np.finfo(np.float64).eps)


class Whitening(NamedTuple):
    """n: vectors fitted; sums: their exact sums by dimension; components: unit rows, by falling value; explained: values
    over the trace; identity_error: the largest entry of |covariance of the whitened fit list - identity|."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.values)[:, None]).T


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): floor(SCALE * entry) + ORIGIN of usable vectors."""
    parts = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))))
    least, most = float(-(2**31) - ORIGIN), float(2**31 - 1 - ORIGIN)
    scaled = lambda c: c.cast("double") * F.lit(float(SCALE))
    bad = F.exists(F.col(vector_col), lambda c: c.isNull() | F.isnan(c) | ~scaled(c).between(least, most))
    return vectors.where(F.col(vector_col).isNotNull() & ~bad).select(
        F.col(id_col).alias("id"), F.transform(parts, lambda c: c.cast("long") + F.lit(ORIGIN)).alias("x")
    )


def padded(numbers: DataFrame, dim: int) -> DataFrame:
    zeros = F.array_repeat(F.lit(ORIGIN).cast("long"), F.greatest(F.lit(0), F.lit(dim) - F.size("x")))
    return numbers.withColumn("x", F.when(F.size("x") < dim, F.concat("x", zeros)).otherwise(F.col("x")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once: the difference of the whole numbers n * x and sums is exact."""
    return (n * x - sums) / n


def tree_sum(table: DataFrame, start: np.ndarray, part: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """The sum over all tasks of part(rows), added FAN_IN at a time; start: a zero of the result's shape and type."""
    kind = "long" if start.dtype == np.int64 else "double"
    schema = f"task long, v array<{kind}>"

    def one(total: np.ndarray, task: int) -> pa.RecordBatch:
        flat = pa.array(total.ravel())
        values = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), values], names=["task", "v"])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_rows = start.copy(), False
        for batch in batches:
            if len(batch):
                total, any_rows = total + part(matrix(batch.column(0), dim)), True
        if any_rows:
            yield one(total, TaskContext.get().partitionId())

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        total = sum((np.asarray(v.values) for v in rows.column("v")), np.zeros(start.size, start.dtype))
        return pa.Table.from_batches([one(total, rows.column("task")[0].as_py() // FAN_IN)])

    parts = cut(table.select("x").mapInArrow(job, schema))
    while (last := parts.agg(F.max("task")).head()[0] or 0) > FAN_IN:
        parts = cut(parts.groupBy(F.floor(F.col("task") / FAN_IN)).applyInArrow(add, schema))
    rows = parts.orderBy("task").toArrow()
    return sum((np.asarray(v.values) for v in rows.column("v")), np.zeros(start.size, start.dtype)).reshape(start.shape)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and reflectors of a symmetric matrix by Householder's reduction."""
    a = np.array(a, np.float64)
    n, reflectors = len(a), []
    for k in range(n - 2):
        column = a[k + 1 :, k]
        scale = np.abs(column[1:]).max()
        if scale == 0.0:
            continue
        v = column / max(scale, abs(column[0]))
        size = np.sqrt(v @ v)
        v[0] += size if v[0] >= 0 else -size
        v /= np.sqrt(v @ v)
        reflectors.append((k + 1, v))
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = 2.0 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2.0 * (v @ a[k + 1 :, k]) * v
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(d: np.ndarray, e: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each shift."""
    squares = e * e
    least = max(float(squares.max(initial=0.0)), 1.0) * float(np.finfo(np.float64).tiny)
    q = d[0] - shifts
    q = np.where(np.abs(q) < least, -least, q)
    below = (q < 0).astype(np.int64)
    for i in range(1, len(d)):
        q = d[i] - shifts - squares[i - 1] / q
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until the interval can't be halved."""
    around = np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    spread = float(np.abs(d).max() + around.max())
    low = np.full(k, float((d - around).min()) - EPS * spread)
    high = np.full(k, float((d + around).max()) + EPS * spread)
    wanted = len(d) - 1 - np.arange(k)  # so many eigenvalues lie below
    for _ in range(2000):
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high) & (high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)))).any():
            break
        above = sturm_counts(d, e, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return low + (high - low) / 2


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """x with (T - shift) x = b, by elimination with row exchanges; pivots smaller than `least` become it."""
    n = len(d)
    diagonal, upper, second, x = (d - shift).tolist(), [*e.tolist(), 0.0], [0.0] * n, b.tolist()
    lower = e.tolist()
    for i in range(n - 1):
        if abs(lower[i]) > abs(diagonal[i]):
            f = diagonal[i] / lower[i]
            diagonal[i], upper[i], diagonal[i + 1] = lower[i], diagonal[i + 1], upper[i] - f * diagonal[i + 1]
            if i + 1 < n - 1:
                second[i], upper[i + 1] = upper[i + 1], -f * upper[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            if abs(diagonal[i]) < least:
                diagonal[i] = least
            f = lower[i] / diagonal[i]
            diagonal[i + 1] -= f * upper[i]
            x[i + 1] -= f * x[i]
    if abs(diagonal[-1]) < least:
        diagonal[-1] = least
    for i in range(n - 1, -1, -1):
        rest = x[i] - (upper[i] * x[i + 1] if i + 1 < n else 0.0) - (second[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = rest / diagonal[i]
    return np.array(x)


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) for falling eigenvalues, by inverse iteration; those of close values are made
    orthogonal to each other in every step."""
    n = len(d)
    around = np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    norm = max(float((np.abs(d) + around).max()), float(np.finfo(np.float64).tiny))
    random = np.random.default_rng(13)
    out = np.zeros((len(values), n))
    shift, cluster = np.inf, 0
    for j, value in enumerate(values.tolist()):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j
        shift = min(value, shift - 10 * EPS * norm) if j > cluster else value
        x = random.uniform(-1, 1, n)
        for _ in range(5):
            x /= np.abs(x).max()
            x = solve_shifted(d, e, shift, x, EPS * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[cluster:j].T @ (out[cluster:j] @ x)
            x /= np.sqrt(x @ x)
        out[j] = x
    return out


def leading_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors (rows) of a symmetric matrix."""
    k = min(k, len(covariance))
    if k == 0:
        return np.zeros(0), np.zeros((0, len(covariance)))
    scale = float(np.abs(covariance).max()) or 1.0
    d, e, reflectors = tridiagonal(covariance / scale)
    values = leading_values(d, e, k)
    vectors = leading_vectors(d, e, values)
    for start, v in reversed(reflectors):
        vectors[:, start:] -= 2.0 * np.outer(vectors[:, start:] @ v, v)
    vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)
    return values * scale, vectors * np.sign(largest)


def fit(numbers: DataFrame, dim: int, k: int) -> Whitening | None:
    """Components of the distinct vectors of (id, x); None without rows or entries."""
    if dim == 0:
        return None
    if dim > MOST_DIMS:
        raise ValueError(f"vectors of {dim} entries; at most {MOST_DIMS} are whitened")
    each = cut(numbers.select("x").distinct())
    with_count = lambda x: np.concatenate([[len(x)], (x - ORIGIN).sum(axis=0)])
    totals = tree_sum(each, np.zeros(dim + 1, np.int64), with_count, dim)
    n = int(totals[0])
    sums = totals[1:] + n * ORIGIN

    def scatter(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, sums)
        return c.T @ c

    covariance = tree_sum(each, np.zeros((dim, dim)), scatter, dim) / n
    covariance = (covariance + covariance.T) / 2
    values, components = leading_components(covariance, k)
    kept = values > dim * EPS * max(float(values.max(initial=0.0)), 0.0)
    values, components = values[kept], components[kept]
    trace = float(np.trace(covariance))
    found = Whitening(n, sums, components, values, values / trace if trace > 0 else values, 0.0)
    if not len(values):
        return found
    mean = tree_sum(each, np.zeros(len(values)), lambda x: found.project(x).sum(axis=0), dim) / n

    def whitened_scatter(x: np.ndarray) -> np.ndarray:
        w = found.project(x) - mean
        return w.T @ w

    spread = tree_sum(each, np.zeros((len(values), len(values))), whitened_scatter, dim) / n
    return found._replace(identity_error=float(np.abs(spread - np.eye(len(values))).max()))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """sum of (n * x - sums)**2 by row, exact; null beyond 64 bits."""
    off = n * x - sums
    most = int(np.abs(off).max(initial=0))
    if most * most * max(1, off.shape[1]) < 2**63:
        return pa.array((off * off).sum(axis=1))
    every = [sum(v * v for v in row) for row in off.tolist()]
    return pa.array([v if v < 2**63 else None for v in every], pa.int64())


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable row and component."""
    spark = vectors.sparkSession
    small_batches(spark)
    numbers = whole_numbers(vectors, id_col, vector_col)
    dim = int(numbers.agg(F.max(F.size("x"))).head()[0] or 0)
    numbers = padded(numbers, dim)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    model = fit(numbers, dim, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Whitening = shared.value
        k = len(m.values)
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1), dim)
            rows = pa.array(np.repeat(np.arange(len(batch)), k))
            size = len(batch) * k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))),
                    pa.array(np.full(size, m.n)),
                    deviations(x, m.n, m.sums).take(rows),
                    pa.array(m.project(x).ravel()),
                    pa.array(np.tile(m.explained, len(batch))),
                    pa.array(np.full(size, m.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return numbers.mapInArrow(job, schema)
