"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. All that meets the rows are passes that
multiply a block of a few columns: each task centres its rows and adds up
X'(XQ), and the parts of all tasks are summed. A Chebyshev polynomial of the
covariance, applied to the block by its recurrence, damps everything below the
block's smallest Ritz value; QR and Rayleigh-Ritz follow, until the residuals
certify the wanted vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a block; a block is what a task holds at a time.
ROWS = 4096
_BLOCK = "ids array<long>, x binary"
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
#: Scaled components beyond this don't fit a long and leave no room for a sum.
_LARGEST = float(1 << 61)


def _whole(lists: pa.Array, dim: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * c) + shift of the vectors that are whole, and which are."""
    good = (lists.value_lengths().fill_null(-1).to_numpy(False) == dim) & ~np.asarray(lists.is_null())
    flat = lists.filter(pa.array(good)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(False)
    scaled = np.floor(flat.reshape(-1, dim) * scale)
    with np.errstate(invalid="ignore"):
        fits = (np.abs(scaled) < _LARGEST).all(1)  # false of nan and infinity too
    good[np.flatnonzero(good)[~fits]] = False
    return scaled[fits].astype(np.int64) + shift, good


def _packed(dim: int, scale: float, shift: int):
    """Batches of (id, vector) as blocks of whole vectors."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, good = _whole(b.column(1), dim, scale, shift)
            ids = b.column(0).filter(pa.array(good))
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids.slice(at, ROWS))
                yield pa.RecordBatch.from_arrays([lists, pa.array([part.tobytes()], pa.binary())], ["ids", "x"])

    return step


class Rows:
    """Blocks of whole-number vectors with what all passes need of them."""

    def __init__(self, blocks: DataFrame, dim: int):
        self.blocks, self.dim = blocks, dim
        self.tasks = blocks.rdd.getNumPartitions()
        facts = self._summed(lambda x: [len(x), int(np.abs(x).max()), *map(int, x.sum(0, dtype=object))], [0, 0] + [0] * dim)
        self.n, self.sums, self.most = facts[0], facts[2:], facts[1]

    def _summed(self, of: Callable[[np.ndarray], list], none: list) -> list:
        """Exact sums over all blocks; of the second number the largest."""
        dim = self.dim

        def add(a: list, b: list) -> list:
            return [a[0] + b[0], max(a[1], b[1]), *(x + y for x, y in zip(a[2:], b[2:], strict=True))]

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = none
            for x in _matrices(batches, dim):
                total = add(total, of(x))
            yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in total]])], ["part"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = none
            for b in batches:
                for part in b.column(0).to_pylist():
                    total = add(total, [int(v) for v in part])
            yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in total]])], ["part"])

        kind = "part array<string>"
        total = none
        for r in self._merged(self.blocks.mapInArrow(step, kind), merge, kind):
            total = add(total, [int(v) for v in r[0]])
        return total

    def _merged(self, parts: DataFrame, merge, kind: str) -> list:
        """One part of each task, merged in as many tasks as the root of their
        number, so that the driver gets no more parts than that."""
        return parts.repartition(max(1, isqrt(self.tasks))).mapInArrow(merge, kind).collect()

    def centring(self) -> Callable[[np.ndarray], np.ndarray]:
        """x to n * x - sums, exact: in 64 bits where they hold it, else in
        Python's whole numbers."""
        n, sums = self.n, self.sums
        fits = n * self.most + max(map(abs, sums), default=0) < 1 << 62

        def centred(x: np.ndarray) -> np.ndarray:
            if fits:
                return x * n - np.array(sums, np.int64)
            return x.astype(object) * n - np.array(sums, object)

        return centred

    def added(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all blocks of an array of doubles; ``of`` gets a
        block's centred rows."""
        dim, centred, n = self.dim, self.centring(), self.n

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for x in _matrices(batches, dim):
                total += of((centred(x) / n).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                for part in b.column(0).to_pylist():
                    total += np.frombuffer(part).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        total = np.zeros(shape)
        for r in self._merged(self.blocks.mapInArrow(step, "part binary"), merge, "part binary"):
            total += np.frombuffer(r[0]).reshape(shape)
        return total

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times q: one pass over the rows."""
        return self.added(lambda c: c.T @ (c @ q), q.shape) / self.n


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for b in batches:
        for raw in b.column(b.schema.get_field_index("x")):
            yield np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, dim)


def _lower_bound(times, dim: int, steps: int, rng: np.random.Generator) -> float:
    """A lower bound of the spectrum by a few Lanczos steps: the smallest Ritz
    value less its residual; 0, which holds for any covariance, if that is more."""
    v = rng.standard_normal(dim)
    v /= np.linalg.norm(v)
    basis, diagonal, beside = [v], [], []
    for _ in range(min(steps, dim)):
        w = times(basis[-1][:, None])[:, 0]
        diagonal.append(float(basis[-1] @ w))
        for u in basis * 2:  # twice, so that the basis stays orthogonal
            w = w - (u @ w) * u
        rest = float(np.linalg.norm(w))
        beside.append(rest)
        if rest <= 1e-12 * max(map(abs, diagonal)):
            break
        basis.append(w / rest)
    small = np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1)
    values, vectors = np.linalg.eigh(small)
    return max(0.0, float(values[0] - beside[-1] * abs(vectors[-1, 0])))


def _filtered(times, q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of the covariance that is small between low and
    high, applied to q; scaled to 1 at top, so that nothing overflows."""
    centre, half = (low + high) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (times(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, 2 * (following / half) * (times(now) - centre * now) - sigma * following * before
        sigma = following
    return now


def leading(times, dim: int, wanted: int, block: int, degree: int = 8, rounds: int = 100, precision: float = 1e-11, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues, falling, and their unit eigenvectors
    of a symmetric positive semidefinite operator, given as a product.

    A vector is certified when its residual over the gap to its neighbours,
    which bounds its error, is below ``precision``, or when its residual is at
    the level of rounding (neighbours too close to tell apart)."""
    rng = np.random.default_rng(seed)
    width = min(dim, max(block, wanted))
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0] if width < dim else np.eye(dim)
    low = _lower_bound(times, dim, 10, rng) if width < dim else 0.0
    for _ in range(rounds):
        product = times(q)
        values, turn = np.linalg.eigh((m := q.T @ product) / 2 + m.T / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        rest = np.linalg.norm(product - q * values, axis=0)[:wanted]
        gaps = np.append(-np.diff(values), 0.0 if width < dim else np.inf)
        gap = np.minimum(gaps, np.append(np.inf, gaps[:-1]))[:wanted]
        if width == dim or values[0] <= 0 or (rest <= np.maximum(precision * gap, 1e-14 * values[0])).all():
            break
        high = max(values[-1], low + 1e-6 * (values[0] - low))
        if not low < high < values[0]:
            break  # all of the block's values are one
        q = np.linalg.qr(_filtered(times, q, degree, low, high, values[0]))[0]
    signs = np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])])
    return values[:wanted], (q * np.where(signs < 0, -1.0, 1.0))[:, :wanted]


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """A row for each whole vector and each of the first ``components``
    components: vec_id, component (from 1), n (whole vectors), deviation (sum
    over dimensions of (n * x - S) ** 2, exact), whitened (the centred vector
    on the component, over the root of its eigenvalue), explained (eigenvalue
    over trace) and identity_error (largest entry of the covariance of
    ``whitened`` less the identity).

    x is floor(scale * c) + shift of each entry c. Vectors that are null, hold
    null or non-finite entries or any beyond 2 ** 61 after scaling, or are
    shorter than the longest, take no part. Components with an eigenvalue of
    0 (as far as doubles tell) have no whitened values and are left out: those
    beyond the rank, and all if every vector is the same. Eigenvectors of equal
    eigenvalues are any basis of theirs. Ids may be null or repeat; a repeated
    row counts and returns as often as it is there. A deviation beyond 64 bits
    is null. Other columns are not read. An empty table gives an empty result.

    block: columns of the iteration, four times the components unless given;
    more converge in fewer passes. The driver holds arrays of dimensions times
    block; every pass reads the written blocks, so a lost task is done again.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    dim = own.agg(F.max(F.size("v"))).first()[0] or 0
    if dim < 1:
        return spark.createDataFrame([], _RESULT)
    rows = Rows(written(own.mapInArrow(_packed(dim, scale, shift), _BLOCK)), dim)
    if not rows.n:
        return spark.createDataFrame([], _RESULT)
    n, centred = rows.n, rows.centring()
    trace = float(rows.added(lambda c: np.array([(c * c).sum()]), (1,))[0]) / n
    values, vectors_ = leading(rows.times, dim, min(components, dim), block or 4 * components)
    kept = values > 1e-12 * max(trace, 0.0)
    values, basis = values[kept], vectors_[:, kept] / np.sqrt(values[kept])
    k = len(values)
    if not k:
        return spark.createDataFrame([], _RESULT)

    def moments(c: np.ndarray) -> np.ndarray:
        w = np.column_stack([c @ basis, np.ones(len(c))])
        return w.T @ w

    gram = rows.added(moments, (k + 1, k + 1)) / n
    error = float(np.abs(gram[:k, :k] - np.outer(gram[k, :k], gram[k, :k]) - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in zip(b.column(0), _matrices([b], dim), strict=True):
                exact = centred(x)
                if dim * int(np.abs(exact).max()) ** 2 < 1 << 63:
                    apart = pa.array((exact.astype(np.int64) ** 2).sum(1))
                else:
                    apart = pa.array([int(s) if s < 1 << 63 else None for s in (exact.astype(object) ** 2).sum(1)], pa.int64())
                made = ((exact / n).astype(np.float64) @ basis).ravel()
                row = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [ids.values.take(row), np.tile(np.arange(1, k + 1), len(x)), np.full(len(made), n), apart.take(row), made, np.tile(explained, len(x)), np.full(len(made), error)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(columns, _KINDS, strict=True)], [c.split()[0] for c in _RESULT.split(", ")])

    return rows.blocks.mapInArrow(project, _RESULT)
