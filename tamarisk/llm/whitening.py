"""Whitening of embeddings by incremental eigendecomposition.

Every task keeps the spectrum of the vectors that it has seen: their number, mean, and the
eigenvalues and eigenvectors of their scatter about the mean. A vector changes the scatter by one
centred rank-one term, whose new eigenvalues are the roots of a secular equation; equal eigenvalues
and directions that the term doesn't touch are deflated first. The spectra of two tasks are combined
in the same way, by one rank-one update for each eigenvector of the one and one for the distance
between the means; groups of spectra are combined in rounds, so that no task and not the driver
gets them all. A last pass over the vectors projects them on the eigenvectors found (Rayleigh-Ritz):
the small problem of the projections' exact covariance takes away what rounding has left in the
updates.

Entries are whole numbers x = floor(scale c) + shift, so that sums over all vectors are exact.

Nulls: vectors that are null or hold null or non-finite entries are dropped. Vectors shorter than the
longest are read as ending in zeros, the empty vector too. A component without variance (fewer
vectors than dimensions, or repeated ones only) has whitened and explained 0 and isn't part of the
identity error. Repeated rows each give their rows. Ties of eigenvalues give some orthonormal basis,
the same for all rows; the largest entry of a component is positive. Ids are passed on, null ones too.
Columns other than id and vector are not read, whatever their names. An empty table gives an empty
result. Entries whose exact sums leave 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import cut, map_arrow

#: Spectra that one task combines in a round.
GROUP = 8
EPS = float(np.finfo(float).eps)
SHIFT = 100_000

Spectrum = tuple[int, np.ndarray, np.ndarray, np.ndarray]
"""Number of vectors, their sum (whole numbers), eigenvalues of their scatter (rising), eigenvectors (columns)."""


def secular_roots(poles: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum of squares_j / (pole_j - t), each as the pole next to it and the distance from that.

    ``poles`` rise strictly and ``squares`` are positive; there is one root above each pole. A rational
    function through both neighbouring poles gives the step, and the interval is halved where the
    step would leave it.
    """
    n = len(poles)
    if n == 1:
        return np.zeros(1, int), squares.copy()
    rows, last = np.arange(n), np.arange(n) == n - 1
    gap = np.append(np.diff(poles), squares.sum())
    middle = 1 + (1 / (poles - (poles + gap / 2)[:, None])) @ squares
    at_left = (middle >= 0) | last
    origin = np.where(at_left, rows, rows + 1)
    delta = poles[None, :] - poles[origin][:, None]
    left = np.where(at_left, 0.0, -gap)
    right = np.where(last, np.inf, left + gap)
    low = np.where(at_left, 0.0, -gap / 2)
    high = np.where(last, gap, low + gap / 2)
    t = (low + high) / 2
    below = np.tril(np.broadcast_to(squares, (n, n)))
    for _ in range(60):
        inverse = 1 / (delta - t[:, None])
        value, psi = 1 + inverse @ squares, np.einsum("ij,ij->i", inverse, below)
        np.multiply(inverse, inverse, out=inverse)
        slope, down = inverse @ squares, np.einsum("ij,ij->i", inverse, below)
        negative = value < 0
        low, high = np.where(negative, t, low), np.where(negative, high, t)
        d1, d2 = left - t, right - t
        with np.errstate(all="ignore"):
            c = value - d1 * down - d2 * (slope - down)
            a = (d1 + d2) * value - d1 * d2 * slope
            b = d1 * d2 * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = d1[-1] + d1[-1] ** 2 * slope[-1] / (value[-1] - d1[-1] * slope[-1])
        new = t + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done = (np.abs(value) <= 8 * EPS * (value - 2 * psi)) | (np.abs(new - t) <= 2 * EPS * np.abs(new))
        t = np.where(done, t, new)
        if done.all():
            break
    return origin, t


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``vectors diag(values) vectors' + v v'``."""
    z = vectors.T @ v
    size = np.sqrt(z @ z)
    if not size:
        return values, vectors
    # Directions that the update hardly touches keep their pair; of equal eigenvalues one direction takes all of it.
    bound = 8 * EPS * max(np.abs(values).max(), size * size)
    same = np.append(False, np.diff(values) <= bound)
    if same.any():
        vectors, z = vectors.copy(), z.copy()
        starts = np.flatnonzero(~same)
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True):
            if high - low > 1 and (norm := np.sqrt(z[low:high] @ z[low:high])):
                mirror = z[low:high].copy()  # a reflection that leaves only the last of them
                mirror[-1] += norm if mirror[-1] >= 0 else -norm
                sign = -1.0 if z[high - 1] >= 0 else 1.0
                vectors[:, low:high] -= np.outer(vectors[:, low:high] @ mirror, 2 * mirror / (mirror @ mirror))
                z[low:high] = 0
                z[high - 1] = sign * norm
    live = np.abs(z) * size > bound
    if not live.any():
        return values, vectors
    poles, squares = values[live], z[live] ** 2
    origin, t = secular_roots(poles, squares)
    apart = (poles[None, :] - poles[origin][:, None]) - t[:, None]  # [root, pole]: pole - root
    # The vector for which these roots are exact, so that eigenvectors are orthogonal: for each pole the product of
    # (root - pole) / (other pole - pole), each root with its neighbour.
    k = np.arange(len(poles))
    partner = k[:-1] + (k[:-1] >= k[:, None])
    others = (-apart[:-1].T / (poles[partner] - poles[:, None])).prod(1)
    exact = np.sqrt(np.abs(-apart[-1] * others)) * np.sign(z[live])
    turn = exact[None, :] / apart
    turn /= np.sqrt((turn**2).sum(1))[:, None]
    values, vectors = values.copy(), vectors.copy()
    values[live] = poles[origin] + t
    vectors[:, live] = vectors[:, live] @ turn.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def empty_spectrum(d: int) -> Spectrum:
    return 0, np.zeros(d, np.int64), np.zeros(d), np.eye(d)


def with_vector(s: Spectrum, x: np.ndarray) -> Spectrum:
    """The spectrum of one vector more."""
    n, total, values, vectors = s
    if n:
        values, vectors = rank_one(values, vectors, (x - total / n) * np.sqrt(n / (n + 1)))
    return n + 1, total + x, values, vectors


def combined(a: Spectrum, b: Spectrum) -> Spectrum:
    """The spectrum of the vectors of both."""
    if a[0] < b[0]:
        a, b = b, a
    if not b[0]:
        return a
    n, total, values, vectors = a
    for value, vector in zip(b[2], b[3].T, strict=True):
        if value > 0:
            values, vectors = rank_one(values, vectors, vector * np.sqrt(value))
    apart = total / n - b[1] / b[0]
    values, vectors = rank_one(values, vectors, apart * np.sqrt(n / (n + b[0]) * b[0]))
    return n + b[0], total + b[1], values, vectors


def _folded(parts: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame]) -> pd.DataFrame:
    """Rows of (part, ...) merged in groups, in rounds, until one is left; none if there is none."""
    parts = cut(parts)
    while (n := parts.count()) > GROUP:
        numbered = parts.withColumn("part", F.expr(f"pmod(hash(part), {-(-n // GROUP)})").cast("long"))
        parts = cut(numbered.groupBy("part").applyInPandas(merge, parts.schema))
    found = parts.toPandas()
    return merge(found) if len(found) else found


def _whole(batch: pa.RecordBatch, d: int, scale: float, shift: int) -> np.ndarray:
    """The entries of a batch as whole numbers."""
    c = np.zeros((batch.num_rows, d))
    lists = batch["vector"]
    lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64) if batch.num_rows else np.zeros(0, np.int64)
    c[np.arange(d) < lengths[:, None]] = np.asarray(lists.flatten(), float)
    floors = np.floor(c * scale)
    if len(c) and np.abs(floors).max(initial=0) > 2.0**52:
        raise OverflowError("entries too large for whole numbers")
    return floors.astype(np.int64) + shift


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows whose vector has finite entries only."""
    odd = F.exists(vector_col, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return rows.where(F.col(vector_col).isNotNull() & ~odd).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))


def spectrum(rows: DataFrame, d: int, scale: float = 1024.0, shift: int = SHIFT) -> Spectrum:
    """The spectrum of all usable vectors of ``d`` entries at most."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = empty_spectrum(d)
        for batch in batches:
            for x in _whole(batch, d, scale, shift):
                s = with_vector(s, x)
        if s[0]:
            yield pa.RecordBatch.from_pandas(_as_row(TaskContext.get().partitionId(), s))

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        s = empty_spectrum(d)
        for r in parts.sort_values(["n", "part"]).itertuples():
            s = combined(s, _of_row(r, d))
        return _as_row(int(parts["part"].iloc[0]), s)

    parts = map_arrow(rows.select("vector"), task, "part long, n long, total array<long>, eigenvalues array<double>, eigenvectors array<double>")
    found = _folded(parts, merge)
    return _of_row(next(found.itertuples()), d) if len(found) else empty_spectrum(d)


def _as_row(part: int, s: Spectrum) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "n": [s[0]], "total": [s[1]], "eigenvalues": [s[2]], "eigenvectors": [s[3].ravel()]})


def _of_row(r, d: int) -> Spectrum:
    return int(r.n), np.array(r.total, np.int64), np.array(r.eigenvalues, float), np.array(r.eigenvectors, float).reshape(d, d)


def covariance(rows: DataFrame, d: int, basis: np.ndarray, mean: np.ndarray, n: int, scale: float = 1024.0, shift: int = SHIFT) -> np.ndarray:
    """Covariance (divisor n) of the projections of x - mean on the columns of ``basis``, centred before multiplying."""
    k = basis.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y = (_whole(batch, d, scale, shift) - mean) @ basis
            products += y.T @ y
            sums += y.sum(0)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [np.append(products.ravel(), sums)]}))

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(parts["part"].iloc[0])], "sums": [np.sum(parts["sums"].tolist(), axis=0)]})

    sums = np.array(_folded(map_arrow(rows.select("vector"), task, "part long, sums array<double>"), merge)["sums"].iloc[0])
    off = sums[k * k :] / n  # what rounding leaves of the mean
    return sums[: k * k].reshape(k, k) / n - np.outer(off, off)


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, shift: int = SHIFT) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component."""
    chosen = usable(rows, id_col, vector_col)
    kind = dict(rows.dtypes)[id_col]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = chosen.agg(F.max(F.size("vector"))).first()[0] or 0
    if not d:
        return rows.sparkSession.createDataFrame([], schema)
    n, total, _, vectors = spectrum(chosen, d, scale, shift)
    mean = total / n
    basis = np.linalg.qr(vectors[:, ::-1])[0]
    refined = covariance(chosen, d, basis, mean, n, scale, shift)
    values, turn = np.linalg.eigh((refined + refined.T) / 2)
    values, basis = values[::-1], basis @ turn[:, ::-1]
    trace, k = max(float(values.sum()), 0.0), min(components, d)
    basis = basis[:, :k] * np.where(basis[np.abs(basis).argmax(0), np.arange(d)] < 0, -1.0, 1.0)[:k]
    live = values[:k] > 16 * d * EPS * max(trace, 1e-300)
    explained = np.where(live, values[:k] / (trace or 1.0), 0.0)
    whitener = basis * np.where(live, 1 / np.sqrt(np.where(live, values[:k], 1.0)), 0.0)
    error = covariance(chosen, d, whitener, mean, n, scale, shift) - np.diag(live.astype(float))
    error = float(np.abs(error).max())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch, d, scale, shift)
            apart = x.astype(float) * n - total
            if (apart**2).sum(1).max(initial=0) > 9e18:
                raise OverflowError("deviations leave 64 bits")
            deviation = ((x * n - total) ** 2).sum(1)
            at = np.repeat(np.arange(len(x)), k)
            columns = {
                "vec_id": batch["vec_id"].take(pa.array(at)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(at), n, np.int64)),
                "deviation": pa.array(deviation[at]),
                "whitened": pa.array(((x - mean) @ whitener).ravel()),
                "explained": pa.array(np.tile(explained, len(x))),
                "identity_error": pa.array(np.full(len(at), error)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return map_arrow(chosen, task, schema)
