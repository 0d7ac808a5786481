"""Embedding whitening: principal components by QDWH spectral divide and conquer, projected with broadcast weights.

Spark sums what the fit needs over all vectors: the sums of every dimension, then the products of the centred vectors.
The covariance has as many rows as a vector has entries, whatever the number of vectors. The driver halves it by
spectral projectors until its invariant subspaces are single components; every task then projects its own vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import discard, store, sum_tables

# An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: So many leading components are given.
COMPONENTS = 32
#: Entries from this on have no whole number that fits a long; their vectors count as not finite.
LARGEST = 2.0**62 / SCALE
_EPS = np.finfo(float).eps
#: Lengths of vectors whose sums a task holds before it passes them on.
_LENGTHS = 64
_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")


# ---- the eigenvectors of a symmetric matrix ---------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal factor of the polar decomposition of a symmetric matrix: QR-based dynamically weighted Halley steps.

    For eigenvalues away from zero it is the matrix sign function. Weights follow a lower bound of the smallest
    singular value, which starts at rounding level; from there seven steps reach one.
    """
    n, low = len(a), _EPS
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    for _ in range(20):
        s = low * low
        d = np.cbrt(4 * (1 - s) / (s * s))
        a_k = math.sqrt(1 + d) + 0.5 * math.sqrt(8 - 4 * d + 8 * (2 - s) / (s * math.sqrt(1 + d)))
        b_k = (a_k - 1) ** 2 / 4
        c_k = a_k + b_k - 1
        q, _ = np.linalg.qr(np.vstack((math.sqrt(c_k) * x, np.eye(n))))
        new = b_k / c_k * x + (a_k - b_k / c_k) / math.sqrt(c_k) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (a_k + b_k * s) / (1 + c_k * s), 1 - _EPS)
        if 1 - low < 4 * _EPS and moved < 1e-10:
            break
    return x


def _halves(a: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if all eigenvalues are equal.

    The mean of the eigenvalues always lies strictly between the least and the greatest. A shift that meets an
    eigenvalue has no sign there, so the next one is tried.
    """
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / math.sqrt(n)
    if spread <= noise:
        return None
    random = np.random.default_rng(n)
    for step in (0.0, 0.05, -0.05, 0.11, -0.11, 0.23, -0.23, 0.41, -0.41):
        projector = (np.eye(n) + polar_factor(a - (mean + step * spread) * np.eye(n))) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n or np.linalg.norm(projector @ projector - projector) > 1e-9 * n:
            continue
        upper = random.standard_normal((n, k))
        for _ in range(3):
            upper, _ = np.linalg.qr(projector @ upper)
        whole, _ = np.linalg.qr(upper, mode="complete")
        return whole[:, :k], whole[:, k:]
    return None


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The `most` greatest eigenvalues, falling, and their unit eigenvectors as columns, largest entry positive.

    Subspaces are split recursively, the upper one first; what lies below the components asked for is not split.
    Eigenvalues that differ by rounding only are taken as equal, and any orthonormal basis serves them.
    """
    size = len(covariance)
    noise = _EPS * float(np.linalg.norm(covariance))
    found: list[np.ndarray] = []
    waiting = [(covariance, np.eye(size))] if size else []
    while waiting and len(found) < min(most, size):
        a, basis = waiting.pop()
        parts = _halves(a, noise) if len(a) > 1 else None
        if parts is None:
            found.extend(basis.T)
            continue
        for half in reversed(parts):  # the upper one is taken next
            inner = half.T @ a @ half
            waiting.append(((inner + inner.T) / 2, basis @ half))
    if not found:
        return np.zeros(0), np.zeros((size, 0))
    vectors = np.array(found).T
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]
    return values, vectors / np.linalg.norm(vectors, axis=0) * np.where(top < 0, -1.0, 1.0)


# ---- sums over all vectors ----------------------------------------------------------------------

def _finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of the batch as doubles, the length of each vector (-1: null, empty, or holding a null or non-finite
    entry) and where it starts."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.concatenate(([0], np.cumsum(~(np.abs(flat) < LARGEST))))
    good = (bad[ends] == bad[ends - lengths]) & column.is_valid().to_numpy(zero_copy_only=False)
    return flat, np.where(good & (lengths > 0), lengths, -1), ends - lengths


def _whole(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that remain, and their entries as whole numbers without SHIFT."""
    flat, lengths, starts = _finite(batch.column("vector"))
    rows = np.flatnonzero(lengths == size)
    return rows, np.floor(flat[starts[rows][:, None] + np.arange(size)] * SCALE).astype(np.int64)


class Fit(NamedTuple):
    """What every task needs: number of vectors, exact sums without SHIFT, weights (length x components), shares."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors of the commonest length (the longer one of equally common ones) and their exact sums."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_pydict({
                "size": pa.array(keys, pa.int64()), "n": pa.array([held[k][0] for k in keys], pa.int64()),
                **{c: pa.array([held[k][i] for k in keys], pa.list_(pa.int64())) for i, c in ((1, "high"), (2, "low"))}})

        for batch in batches:
            for size in set(_finite(batch.column("vector"))[1].tolist()) - {-1}:
                rows, x = _whole(batch, size)
                n, high, low = held.get(size, (0, 0, 0))
                # two parts, so that no sum of 2^32 rows overflows
                held[size] = [n + len(rows), high + (x >> 31).sum(axis=0), low + (x & (2**31 - 1)).sum(axis=0)]
                if len(held) >= _LENGTHS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    parts = store(vectors.mapInArrow(own, "size long, n long, high array<long>, low array<long>"), "sums")
    size = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if size is None:
        discard(parts)
        return 0, []
    places = parts.where(F.col("size") == size["size"]).select(
        F.posexplode(F.arrays_zip("high", "low")).alias("at", "s")).groupBy("at").agg(
        F.sum("s.high").alias("high"), F.sum("s.low").alias("low")).orderBy("at").collect()  # a row for each dimension
    discard(parts)
    return size["n"], [int(r["high"]) * 2**31 + int(r["low"]) for r in places]


def _products(vectors: DataFrame, fit: Fit, weights: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Sum of the products of the projected, centred vectors, `less` their mean; its last row is their plain sum."""
    size, k = weights.shape

    def own(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = fit.centred(_whole(batch, size)[1]) @ weights - less
            total[:k] += y.T @ y
            total[k] += y.sum(axis=0)
        return total

    return sum_tables(vectors, own, (k + 1, k), "float64")


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Fit:
    """Learn the whitening from all rows of `vectors` (vector). The driver holds tables of length x length only.

    Components without variance beyond rounding cannot be whitened and are left out; without a vector, or with equal
    vectors only, there are none.
    """
    n, sums = _sums(vectors)
    size = len(sums)
    plain = Fit(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0)
    if not size:
        return plain
    covariance = _products(vectors, plain, np.eye(size), np.zeros(size))
    mean, covariance = covariance[size] / n, covariance[:size] / n
    values, directions = components((covariance + covariance.T) / 2, most)
    kept = values > 10 * size * _EPS * max(values.max(initial=0.0), 0.0)
    weights = directions[:, kept] / np.sqrt(values[kept])
    k = weights.shape[1]
    if not k:
        return plain
    white = _products(vectors, plain, weights, mean @ weights)[:k] / n
    return Fit(n, sums, weights, values[kept] / np.trace(covariance), float(np.abs(white - np.eye(k)).max()))


def whiten(rows: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each remaining row and component.

    Null vectors and vectors with a null, NaN or infinite entry are dropped, as are entries too large for a long (from
    2^56 on) and vectors whose length is not the commonest one, which share no space with the others. Repeated rows
    count, and come back, as often as they are there; a null vec_id stays null; other columns are ignored. A
    deviation that does not fit a long is null. An empty table, or one whose vectors are all equal, gives no rows.
    """
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{column}`").alias("vector"))
    learnt = rows.sparkSession.sparkContext.broadcast(fit(vectors.select("vector"), most))  # length x components

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Fit = learnt.value
        size, k = known.weights.shape
        if not k:
            return
        # modulo 2^64 the differences are exact whenever they fit
        sums = np.array([s % 2**64 for s in known.sums], np.uint64).view(np.int64)
        count = np.int64(known.n)
        for batch in batches:
            at, x = _whole(batch, size)
            if not len(at):
                continue
            y = known.centred(x)
            with np.errstate(over="ignore"):
                deviation = ((count * x - sums) ** 2).sum(axis=1)
            fits = (y * known.n / 2**31 * y * known.n / 2**31).sum(axis=1) < 1.99
            ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                pa.array(np.full(len(at) * k, known.n, np.int64)),
                pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)),
                pa.array((y @ known.weights).ravel()), pa.array(np.tile(known.explained, len(at))),
                pa.array(np.full(len(at) * k, known.identity_error))], [f.split()[0] for f in _OUT.split(", ")])

    return vectors.mapInArrow(project, _OUT)
