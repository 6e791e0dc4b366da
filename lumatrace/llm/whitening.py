"""Whitening of embeddings: exact integer moments, a distributed centred covariance, its leading eigenvectors, and their projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums of one row of a matrix pass through this many intermediate sums.
SUM_BUCKETS = 64
#: Entries are multiplied by SCALE, floored, and raised by SHIFT.
SCALE, SHIFT = 1024.0, 100_000
#: Floored entries are exact in double precision, and fit a long, up to this.
_LARGEST = 2.0**53

_VECTORS = "vec_id long, dim int, x binary"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("embedding")
        size = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
        flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # null entries become nan
        good = np.abs(flat) < _LARGEST  # neither nan nor infinite
        whole = np.where(good, flat, 0).astype(np.int64) + SHIFT
        at = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        for d in np.unique(size[size >= 0]):
            rows = np.flatnonzero(size == d)
            places = at[rows][:, None] + np.arange(d)
            rows, places = rows[good[places].all(axis=1)], places[good[places].all(axis=1)]
            body = whole[places].tobytes()
            x = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * (8 * int(d))).tobytes()), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)), x], names=["vec_id", "dim", "x"])


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x: the usable rows of (vec_id, embedding) as longs floor(1024 * c) + 100000.

    Rows drop out whose vector is null or holds an entry that is null, not finite, or beyond 2**43 (its product would not be exact).
    """
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_integers, _VECTORS)


def _matrix(column: pa.Array | pa.ChunkedArray, kind, rows: np.ndarray | None = None) -> np.ndarray:
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    own = own if rows is None or len(rows) == len(own) else own.take(pa.array(rows))
    if own.type == pa.large_binary():
        own = own.cast(pa.binary())
    _, ends, body = own.buffers()
    at = np.frombuffer(ends, np.int32)[own.offset : own.offset + len(own) + 1]
    return np.frombuffer(body, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(own), -1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    dims = batch.column("dim").to_numpy()
    return (np.flatnonzero(dims == d) for d in np.unique(dims[dims > 0]))


#: Length of vectors -> their number and the exact sum of each entry.
Moments = dict[int, tuple[int, list[int]]]


def moments(x: DataFrame) -> Moments:
    """Number of vectors and exact sums of their entries, for each length of vectors (a few rows come to the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for rows in _by_dim(batch):
                v = _matrix(batch.column("x"), np.int64, rows)
                n, s = total.get(v.shape[1], (0, 0))
                halves = (v >> 26).sum(axis=0), (v & ((1 << 26) - 1)).sum(axis=0)  # neither sum of a batch leaves a long
                total[v.shape[1]] = n + len(v), s + halves[0].astype(object) * (1 << 26) + halves[1]
        rows = [(d, j, n, str(c)) for d, (n, s) in total.items() for j, c in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))], names=["dim", "j", "n", "s"])

    sums = x.mapInArrow(run, "dim int, j int, n long, s string").groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in sums.collect():
        out.setdefault(r.dim, (r.n, {}))[1][r.j] = int(r.s)
    return {d: (n, [s[j] for j in range(d)]) for d, (n, s) in out.items()}


def _second_moments(rows_of: DataFrame, centred, dims: dict[int, int]) -> dict[int, np.ndarray]:
    """Sums of outer products of centred(batch, rows), for each length: tasks add up, then rows of the matrices in two rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows in _by_dim(batch):
                d, y = centred(batch, rows)
                total[d] = total.get(d, 0.0) + y.T @ y
        task = TaskContext.get().partitionId() % SUM_BUCKETS
        out = [(d, i, task, row.tobytes()) for d, m in total.items() for i, row in enumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["dim", "i", "bucket", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = np.sort(_matrix(table.column("row"), np.float64), axis=0)  # a fixed order, so that a task run again adds up alike
        return table.slice(0, 1).set_column(3, "row", pa.array([rows.sum(axis=0).tobytes()], pa.binary()))

    names, schema = ["dim", "i", "bucket", "row"], "dim int, i int, bucket int, row binary"
    part = rows_of.mapInArrow(run, schema).groupBy("dim", "i", "bucket").applyInArrow(lambda t: add(t.select(names)), schema)
    out = {d: np.zeros((k, k)) for d, k in dims.items()}
    for r in part.groupBy("dim", "i").applyInArrow(lambda t: add(t.select(names)), schema).collect():  # as many rows as a vector has entries
        out[r.dim][r.i] = np.frombuffer(r.row)
    return out


# --- leading eigenvectors of one symmetric matrix -------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder's reduction: diagonal, side diagonal, and the unit vectors of the reflections (H = I - 2 u u', in order)."""
    a = matrix.copy()
    n, reflections = len(a), []
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        u[0] += np.copysign(np.linalg.norm(u), u[0] if u[0] else 1.0)
        size = np.linalg.norm(u)
        u = u / size if size else u
        reflections.append(u)
        part = a[k + 1 :, k + 1 :]
        p = part @ u
        w = 2 * (p - (u @ p) * u)
        a[k + 1 :, k + 1 :] = part - np.outer(u, w) - np.outer(w, u)
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def count_below(diagonal: np.ndarray, side: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm's count: how many eigenvalues of the tridiagonal matrix are below each x (signs of the sequence of pivots)."""
    least = np.finfo(np.float64).tiny * max(1.0, float(np.square(side).max(initial=0.0)))
    below, pivot = np.zeros(len(x), np.int64), np.ones(len(x))
    for d, e in zip(diagonal, np.concatenate([[0.0], side]), strict=True):
        pivot = d - x - e * e / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)  # a pivot of zero counts as below, everywhere alike
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until no double lies between its bounds."""
    reach = np.concatenate([np.abs(side), [0.0]]) + np.concatenate([[0.0], np.abs(side)])
    edge = np.abs(diagonal).max() + reach.max()
    low, high = np.full(k, -edge), np.full(k, edge + np.finfo(np.float64).tiny)
    want = len(diagonal) - np.arange(k)  # the i-th largest is the one below which n - i lie
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        over = count_below(diagonal, side, middle) >= want
        high, low = np.where(open_ & over, middle, high), np.where(open_ & ~over, middle, low)


def _solve(diagonal: np.ndarray, side: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - value I) y = right by elimination with row exchanges; pivots of zero are taken as `least`."""
    n = len(diagonal)
    upper = np.zeros((n, 3))
    b, row = right.copy(), np.array([diagonal[0] - value, side[0] if n > 1 else 0.0, 0.0])
    for i in range(n - 1):
        below = np.array([side[i], diagonal[i + 1] - value, side[i + 1] if i + 2 < n else 0.0])
        if abs(below[0]) > abs(row[0]):
            row, below = below, row
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(row[0]) < least:
            row[0] = least
        factor = below[0] / row[0]
        upper[i] = row
        b[i + 1] -= factor * b[i]
        row = np.array([below[1] - factor * row[1], below[2] - factor * row[2], 0.0])
    if abs(row[0]) < least:
        row[0] = least
    upper[n - 1] = row
    y = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        y[i] = (b[i] - upper[i, 1] * y[i + 1] - upper[i, 2] * y[i + 2]) / upper[i, 0]
    return y[:n]


def leading_eigenvectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) of a symmetric matrix and their unit eigenvectors (columns).

    Inverse iteration on the tridiagonal form; a vector is kept orthogonal to those before it whose values lie within a
    thousandth of the matrix's size (a cluster), or on the same value.
    """
    size = np.abs(matrix).max()
    if not size:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, side, reflections = tridiagonal(matrix / size)
    values = leading_values(diagonal, side, k)
    norm = np.abs(diagonal).max() + 2 * np.abs(side).max(initial=0.0)
    found: list[np.ndarray] = []
    for j, value in enumerate(values):
        cluster = [found[i] for i in range(j) if values[i] - value <= 1e-3 * norm]
        y = np.random.default_rng((j, len(diagonal))).standard_normal(len(diagonal))
        for _ in range(6):
            for z in cluster * 2:
                y -= (z @ y) * z
            y = _solve(diagonal, side, value, y / np.linalg.norm(y), np.finfo(np.float64).eps * norm)
            y /= np.linalg.norm(y)
        for z in cluster * 2:
            y -= (z @ y) * z
        found.append(y / np.linalg.norm(y))
    vectors = np.array(found).T
    for i in range(len(reflections) - 1, -1, -1):
        u = reflections[i]
        vectors[i + 1 :] -= 2 * np.outer(u, u @ vectors[i + 1 :])
    return values * size, vectors / np.linalg.norm(vectors, axis=0)


# --- the operator ---------------------------------------------------------------------------------------------------


def _deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sum of (n * x - S) ** 2 over the entries, in whole numbers; None where it leaves the range of a long."""
    largest = max(int(x.max()), -int(x.min())) * n + max(map(abs, s))
    if len(s) * largest * largest >= 1 << 63:
        rough = x.astype(object) * n - np.array(s, object)
        return [v if v < 1 << 63 else None for v in (rough * rough).sum(axis=1)]
    off = x * n - np.array(s, np.int64)
    return (off * off).sum(axis=1).tolist()


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_OUT_SCHEMA = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Usable vectors x are those of integer_vectors(); all of them make up the fit. n is their number, S their sums. A
    component is a unit eigenvector of the covariance (divisor n), numbered from 1 by falling eigenvalue e; whitened is
    (x - S/n) on it, over sqrt(e); explained is e / trace. deviation is the sum of (n*x - S)**2, exact (null where it leaves
    the range of a long). identity_error is measured: the largest entry of |covariance of all whitened rows - identity|.

    vectors needs vec_id and embedding; other columns are ignored. Vectors of different lengths are fitted apart, each
    length with its own n. Components without variance (e below 1e-12 of the trace) have no rows, so equal vectors, single
    ones and those without entries have none; shorter vectors have as many components as entries. Repeated rows count as
    often as they are there; a null vec_id is passed on. An empty table gives no rows.

    What reaches the driver and the tasks grows with the square of a vector's length, not with the number of vectors.
    """
    x = integer_vectors(vectors)
    spark = vectors.sparkSession
    fitted = moments(x)
    means = {d: np.array([c // n + c % n / n for c in s]) for d, (n, s) in fitted.items()}

    def centred(batch: pa.RecordBatch, rows: np.ndarray) -> tuple[int, np.ndarray]:
        v = _matrix(batch.column("x"), np.int64, rows)
        return v.shape[1], v - means[v.shape[1]]

    projection: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d, total in _second_moments(x, centred, {d: d for d in fitted}).items():
        covariance = (total + total.T) / (2 * fitted[d][0])
        trace = float(np.trace(covariance))
        values, axes = leading_eigenvectors(covariance, min(components, d))
        some = values > 1e-12 * trace
        if trace > 0 and some.any():
            projection[d] = axes[:, some] / np.sqrt(values[some]), values[some] / trace
    sent = spark.sparkContext.broadcast((fitted, means, projection))

    def projected(batch: pa.RecordBatch, rows: np.ndarray) -> tuple[int, np.ndarray]:
        _, means, projection = sent.value
        v = _matrix(batch.column("x"), np.int64, rows)
        d = v.shape[1]
        return d, (v - means[d]) @ projection[d][0]

    kept = x.filter(F.col("dim").isin(list(projection)))
    widths = {d: len(e) for d, (_, e) in projection.items()}
    error = {}
    for d, total in _second_moments(kept, projected, widths).items():
        error[d] = float(np.abs(total / fitted[d][0] - np.eye(widths[d])).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, _, projection = sent.value
        for batch in batches:
            for rows in _by_dim(batch):
                d, y = projected(batch, rows)
                n, s = fitted[d]
                k = y.shape[1]
                deviation = _deviations(_matrix(batch.column("x"), np.int64, rows), n, s)
                repeat = pa.array(np.repeat(np.arange(len(rows)), k))
                own = [batch.column("vec_id").take(pa.array(rows)).take(repeat), np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)), np.full(len(rows) * k, n), pa.array(deviation, pa.int64()).take(repeat)]
                own += [y.ravel(), np.tile(projection[d][1], len(rows)), np.full(len(rows) * k, error[d])]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(own, _OUT_SCHEMA, strict=True)], schema=_OUT_SCHEMA)

    return kept.mapInArrow(run, _OUT)
