"""Embedding whitening: vectors turned to the leading principal components and scaled to unit variance.

The covariance is summed by the tasks over centred vectors; only the ``d x d`` matrix, whose size is set by the
vectors' length and not by their number, comes to the driver. There it is brought to tridiagonal form by Householder
reflections; Sturm counts bisect the leading eigenvalues; inverse iteration gives their vectors, those of close
eigenvalues made orthogonal to each other. The components are broadcast and the vectors projected in their tasks.

Vectors are whole numbers inside (``floor(scale * c) + shift``), so sums, means and the covariance are exact until the
last division.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeledger.llm.batches import bound_batches
from tapeledger.session import cut_lineage

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Rows of a batch that are multiplied at a time.
ROWS = 4096
#: Eigenvalues below this share of the largest one are zero within rounding: such directions cannot be whitened.
LEAST_SHARE = 1e-12
#: Eigenvalues nearer than this share of the matrix's norm form a cluster.
CLUSTER = 1e-3


# The eigenproblem of one symmetric matrix


def tridiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, off-diagonal, q)`` with ``q.T @ a @ q`` tridiagonal, by Householder reflections."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1:, k]
        scale = np.abs(x).max()
        if scale == 0 or not np.any(x[1:]):
            continue
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        w = a[k + 1:, k + 1:] @ v
        w -= (v @ w) * v
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, w) + np.outer(w, v))
        head = a[k + 1:, k] - 2 * v * (v @ a[k + 1:, k])
        a[k + 1:, k] = a[k, k + 1:] = head
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are smaller than each of ``x``: the sign changes of its Sturm sequence."""
    tiny = np.finfo(float).tiny ** 0.5 + np.finfo(float).eps * np.abs(off).max(initial=0.0) * 1e-3
    count = np.zeros(len(x), np.int64)
    ratio = np.ones(len(x))
    for i in range(len(diagonal)):
        ratio = diagonal[i] - x - (off[i - 1] ** 2 / ratio if i else 0.0)
        ratio = np.where(np.abs(ratio) < tiny, -tiny, ratio)
        count += ratio < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection to the last bits."""
    n = len(diagonal)
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    slack = 1e-15 * max(abs(low[0]), abs(high[0]), 1e-300)
    low, high = low - slack, high + slack
    rank = n - 1 - np.arange(k)  # as many eigenvalues are smaller than the wanted one, in rising order
    for _ in range(200):
        middle = (low + high) / 2
        up = below(diagonal, off, middle) <= rank
        low, high = np.where(up, middle, low), np.where(up, high, middle)
        if np.all((high - low) <= 2 * np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high))) or np.all((middle == low) & (middle == high)):
            break
    return (low + high) / 2


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, rhs: np.ndarray) -> np.ndarray:
    """``(T - shift) x = rhs`` by elimination with row exchanges."""
    n = len(diagonal)
    norm = np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)
    small = np.finfo(float).eps * (norm if norm > 0 else 1.0)
    main, upper, second = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    main, upper, x = main.copy(), upper.copy(), rhs.copy()
    for i in range(n - 1):
        lower = off[i]
        if abs(lower) > abs(main[i]):
            main[i], lower_row = lower, main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
            factor = lower_row / main[i]
            main[i + 1] -= factor * upper[i]
            upper[i + 1] -= factor * second[i]
        else:
            if abs(main[i]) < small:
                main[i] = small
            factor = lower / main[i]
            main[i + 1] -= factor * upper[i]
        x[i + 1] -= factor * x[i]
    if abs(main[-1]) < small:
        main[-1] = small
    x[-1] /= main[-1]
    for i in range(n - 2, -1, -1):
        x[i] = (x[i] - upper[i] * x[i + 1] - (second[i] * x[i + 2] if i + 2 < n else 0.0)) / main[i]
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one column for each of the falling ``values``.

    Within a cluster of close values each vector is made orthogonal to the earlier ones after every solve, and the
    shifts are moved apart, so that equal values get different vectors.
    """
    n = len(diagonal)
    norm = max(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    out = np.zeros((n, len(values)))
    start, shift = 0, 0.0
    for j, value in enumerate(values):
        if j == 0 or values[j - 1] - value > CLUSTER * norm:
            start, shift = j, value
        else:
            shift = min(value, shift - 4 * np.finfo(float).eps * norm)
        earlier = out[:, start:j]
        x = np.random.default_rng(j).standard_normal(n)
        x /= np.linalg.norm(x)
        for _ in range(rounds):
            x = _solve_shifted(diagonal, off, shift, x)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= earlier @ (earlier.T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)``: the ``k`` largest eigenvalues, falling, and unit eigenvectors as columns, the largest
    entry of each positive."""
    norm = np.abs(matrix).max()
    if norm == 0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, q = tridiagonalise(matrix / norm)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = q @ inverse_iteration(diagonal, off, values)
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values * norm, vectors


# The distributed part


def quantised(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """``floor(scale * c) + shift`` of every entry, as long."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale) + F.lit(shift).cast("long"))


def usable(vector: Column, scale: int = SCALE) -> Column:
    """A vector that is not null or empty, without null, non-finite or (``scale`` times it beyond 2^62) too large entries."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda v: F.coalesce(F.isnan(v) | (F.abs(v.cast("double")) > float(1 << 62) / scale), F.lit(True))), F.lit(False))


def _block(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _block(batch.slice(at, ROWS), d)


def _gram(rows: np.ndarray) -> np.ndarray:
    """``rows.T @ rows`` of whole numbers, exactly: by floating point where no partial sum can round, else by Python's numbers."""
    most = int(np.abs(rows).max(initial=0))
    if most * most * len(rows) < 1 << 53:
        return (rows.T.astype(float) @ rows.astype(float)).astype(np.int64).astype(object)
    big = rows.astype(object)
    return big.T @ big


def _sum_rows(parts: DataFrame) -> dict[int, list[int]]:
    """Sums of ``parts(i, row)``, numbers of any size as text, per ``i``: one row from each task and ``i``, summed in
    two turns so that no task reads the rows of all tasks."""
    def add(pdf):
        total = sum(np.array([int(v) for v in row.split(" ")], object) for row in pdf["row"])
        return pdf.iloc[:1].assign(row=" ".join(str(v) for v in total))

    once = parts.groupBy("i", "part").applyInPandas(add, parts.schema)
    return {r["i"]: [int(v) for v in r["row"].split(" ")] for r in once.groupBy("i").applyInPandas(add, parts.schema).collect()}


def _as_rows(rows: np.ndarray, task: int) -> pa.RecordBatch:
    text = [" ".join(str(v) for v in r) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([task % 32] * len(rows), pa.int32()), pa.array(text)], ["i", "part", "row"])


_PART = "i int, part int, row string"


@dataclass
class Whitener:
    """``n`` distinct vectors with sums ``total``; components as columns, falling ``values``, and the covariance's trace."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - total / n`` with the whole part taken off in whole numbers, so that nothing is lost to the shift."""
        whole = np.array([s // self.n for s in self.total], np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.total])
        return (x - whole).astype(float) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """``sum (n x - total)^2`` of each row, exactly; None where it is no long."""
        whole = np.array([s // self.n for s in self.total], np.int64)
        rest = [s % self.n for s in self.total]
        y = x - whole
        reach = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if reach * reach * x.shape[1] < 1 << 63:
            return ((y * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((y.astype(object) * self.n - np.array(rest, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def fit_whitener(vectors: DataFrame, k: int = COMPONENTS) -> Whitener | None:
    """Fit on the distinct rows of ``vectors(x array<long>)``, all of one length; None for an empty table.

    The covariance has divisor ``n`` and is summed over vectors less the whole part of their mean; the little that
    is left of the mean is taken off exactly at the end. Directions without variance give no component.
    """
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, total = 0, np.zeros(d, object)
        for x in _blocks(batches, d):
            n += len(x)
            whole = np.int64(1) << 40  # halves whose sums over a block fit a long
            total += (x // whole).sum(axis=0).astype(object) * int(whole) + (x % whole).sum(axis=0).astype(object)
        yield _as_rows(np.append(total, n)[None, :], TaskContext.get().partitionId())

    *total, n = _sum_rows(vectors.select("x").mapInArrow(totals, _PART))[0]
    mean = np.array([s // n for s in total], np.int64)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gram = np.zeros((d, d), object)
        for x in _blocks(batches, d):
            gram = gram + _gram(x - mean)
        yield _as_rows(gram, TaskContext.get().partitionId())

    gram = _sum_rows(vectors.select("x").mapInArrow(grams, _PART))
    rest = [s % n for s in total]  # sums of the vectors less the whole mean
    exact = [[n * gram[i][j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[float(Fraction(v, n * n)) for v in row] for row in exact])
    trace = float(Fraction(sum(exact[i][i] for i in range(d)), n * n))
    values, components = leading_eigenpairs(covariance, min(k, d))
    live = values > LEAST_SHARE * max(trace, 0.0)
    return Whitener(n, total, values[live], components[:, live], trace)


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """The largest entry of the whitened vectors' own covariance less the identity, over the rows that were fitted."""
    k, spark = len(model.values), vectors.sparkSession
    if not k:
        return 0.0
    known, d = spark.sparkContext.broadcast(model), len(model.total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, d):
            w = known.value.whitened(x)
            first += w.sum(axis=0)
            second += w.T @ w
        at, value = np.arange(k * (k + 1)), np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(value)], ["at", "value"])

    sums = vectors.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")["value"].to_numpy() / model.n
    mean = sums[:k]  # nearly zero: the vectors were centred before
    return float(np.abs(sums[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per usable row ``id_col``, ``n``, ``deviation``, ``whitened`` (array, one entry a component), ``explained`` (array
    alike) and ``identity_error``.

    Rows take no part if their vector is null, empty, holds null, non-finite or too large entries (``usable``), or has
    another length than the most frequent one (of equally frequent ones the shortest): such vectors have no covariance
    with the others. Repeated vectors are fitted once and all projected; ids may be null or repeated. ``deviation`` is
    null where it does not fit a long. A table in which all vectors are equal has no component and gives empty arrays;
    an empty one gives no rows.
    """
    spark = embeddings.sparkSession
    bound_batches(spark)
    vector = F.col(vector_col)
    rows = embeddings.filter(usable(vector, scale)).select(F.col(id_col).alias("id"), quantised(vector, scale, shift).alias("x"))
    width = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = width["d"] if width else 0
    rows = rows.filter(F.size("x") == d)
    fitted = cut_lineage(rows.select("x").distinct(), "whitening_fit")
    model = fit_whitener(fitted, k)
    error = identity_error(fitted, model) if model else 0.0
    known = spark.sparkContext.broadcast(model)  # d x k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        share = m.values / m.trace if m is not None and len(m.values) else np.zeros(0)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _block(batch, d)
                w = m.whitened(x)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(v)) for v in (w.ravel(), np.tile(share, len(x)))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([m.n] * len(x), pa.int64()), pa.array(m.deviation(x), pa.int64()), *lists, pa.array(np.full(len(x), error))], names)

    names = ["id", "n", "deviation", "whitened", "explained", "identity_error"]
    out = rows.mapInArrow(run, f"id {dict(embeddings.dtypes)[id_col]}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    return out.withColumnRenamed("id", id_col)


def component_rows(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row per vector and component, numbered from 1: ``id_col, component, n, deviation, whitened, explained, identity_error``."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "one")
    out = whitened.select(id_col, "n", "deviation", "identity_error", each)
    return out.select(id_col, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "one.whitened", "one.explained", "identity_error")
