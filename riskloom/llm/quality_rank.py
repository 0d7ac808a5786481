"""Quality classifier: Bradley-Terry scores learnt from preference pairs, cut at a quantile of the scores.

All pairs of a good and a bad labelled row count. What a pair adds depends on the difference of two scores and is smooth, so
the rows of a stretch of scores act through their moments at its Chebyshev nodes: a Newton step over all pairs is one pass over
the rows, right to the last digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import blocks, discard, raw_bytes, store, text_of, word_hashes

#: What all pairs weigh together against the unit penalty on the weights, at most.
PAIRS = 200_000
#: Up to so many labelled rows are summed by the driver, more by tasks.
FEW_ROWS = 20_000
#: Scores in a bucket that one task sorts, about.
SORTED_ROWS = 1_000_000
#: Scores are taken in stretches of twice this length, with so many nodes; the error is below 1e-16 of a pair.
REACH, NODES = 2.0, 32
#: A document is predicted good from this score on.
CUT = 0.7
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256),
    "line": [10], "stop": map(ord, ".,;:?"), "cry": [33], "bar": [124], "symbol": map(ord, "#*$%&<>~^=_+@\\/{}[]"),
}
_MEMBER = np.zeros((len(_CLASSES), 256), np.int64)
for _i, _codes in enumerate(_CLASSES.values()):
    _MEMBER[_i, list(_codes)] = 1
FEATURES = 14


def features(column: pa.Array) -> np.ndarray:
    """Surface features of each text: shares of character classes, word lengths, repetition. All zero when empty."""
    data, offsets = raw_bytes(column)
    out = np.zeros((len(column), FEATURES))
    if not len(data):
        return out

    def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return np.diff(total[at])

    counts = np.array([sums(m[data], offsets) for m in _MEMBER])
    size = np.maximum(np.diff(offsets), 1)
    hashes, at = word_hashes(column)
    n = np.diff(at)
    word = np.maximum(n, 1)
    letters = np.maximum(counts[0] + counts[1] + counts[3], 1)
    out[:, 0] = counts[0] / letters
    out[:, 1] = counts[2] / size
    out[:, 2] = counts[3] / size
    for k, row in enumerate((4, 5, 6, 7, 8)):  # per word, and no more than once a word
        out[:, 3 + k] = np.minimum(counts[row] / word, 1)
    out[:, 8] = np.minimum((counts[0] + counts[1] + counts[3]) / word, 30)
    out[:, 9] = np.log1p(n)
    if len(hashes) > 2:
        for k, lag in ((10, 1), (11, 2)):
            same = np.concatenate((hashes[lag:] == hashes[:-lag], np.zeros(lag, bool)))
            same[(np.repeat(at[1:], n) - np.arange(len(hashes))) <= lag] = False
            out[:, k] = sums(same, at) / word
    for i, (a, b) in enumerate(zip(at, at[1:])):
        if b - a > 1:
            out[i, 12] = np.log(len(np.unique(hashes[a:b]))) / np.log(b - a)
    out[:, 13] = n > 0
    return out


@dataclass(frozen=True)
class QualityModel:
    """Score of a text = sigmoid(logit(CUT) + w . x - threshold), where `threshold` is the score at quantile `level`."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    level: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.log(CUT / (1 - CUT)) + self.raw(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_AT = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
_BASIS = chebvander(_AT, NODES - 1).T * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES
_UPPER = np.triu_indices(FEATURES)


class _Sums:
    """Sums over the labelled rows, as a table (good, x) or, of few rows, as arrays in the driver."""

    def __init__(self, rows: DataFrame):
        self.rows, self.few = rows, None
        if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
            x, good = _arrays(rows.toArrow())  # FEW_ROWS
            order = np.lexsort((*x.T, good))  # the fit does not depend on the order of tasks
            self.few = x[order], good[order]

    def total(self, make: Callable[[np.ndarray, np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
        """The arrays that `make` gives for blocks of rows, summed for each of its keys."""
        if self.few:
            return make(*self.few) if len(self.few[1]) else {}

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for key, part in (make(*_arrays(batch)) if batch.num_rows else {}).items():
                    sums[key] = sums[key] + part if key in sums else part
            for key, part in sums.items():
                yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "part": pa.array([part.tobytes()], pa.binary())})

        def add(parts: pa.Table) -> pa.Table:
            whole = sum(np.frombuffer(p.as_buffer()) for p in parts.column("part"))
            return pa.table({"key": pa.array([parts.column("key")[0].as_py()], pa.int64()),
                             "part": pa.array([whole.tobytes()], pa.binary())})

        kinds = "key long, part binary"
        summed = self.rows.select("good", "x").mapInArrow(own, kinds).groupBy("key").applyInArrow(add, kinds)
        return {r["key"]: np.frombuffer(r["part"]) for r in summed.collect()}  # a row for each stretch of scores


def _arrays(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(rows, pa.Table):
        rows = rows.combine_chunks()
        x = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("x").chunks)])
    else:
        x = rows.column("x").flatten().to_numpy(zero_copy_only=False)
    return x.reshape(-1, FEATURES), np.asarray(rows.column("good")) == 1


def _moments(s: np.ndarray, z: np.ndarray, good: np.ndarray) -> dict[int, np.ndarray]:
    """For each stretch of scores (twice its number, and 1 for good rows): count, sums and products of the rows at its nodes."""
    stretch = np.floor(s / (2 * REACH)).astype(np.int64)
    key = 2 * stretch + good
    out = {}
    for k in np.unique(key):
        own = key == k
        near = chebvander(s[own] / REACH - 2 * (k // 2) - 1, NODES - 1) @ _BASIS
        rows = z[own]
        terms = np.hstack((np.ones((len(rows), 1)), rows, rows[:, _UPPER[0]] * rows[:, _UPPER[1]]))
        out[int(k)] = (near.T @ terms).ravel()
    return out


def _slopes(moments: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the sum of log(1 + exp(s_bad - s_good)) over all pairs, from `_moments`."""
    width = 1 + FEATURES + len(_UPPER[0])

    def side(good: int) -> tuple[np.ndarray, np.ndarray]:
        keys = sorted(k for k in moments if k % 2 == good)
        at = np.concatenate([REACH * (_AT + 2 * (k // 2) + 1) for k in keys])
        return at, np.concatenate([moments[k].reshape(NODES, width) for k in keys])

    (here, a), (there, b) = side(1), side(0)
    down, products, cross = np.zeros(FEATURES), np.zeros(len(_UPPER[0])), np.zeros((FEATURES, FEATURES))
    pull, bend = np.zeros(len(there)), np.zeros(len(there))
    for i in range(0, len(here), NODES):
        p = 1 / (1 + np.exp(np.clip(here[i: i + NODES, None] - there[None, :], -700, 700)))
        q, own = p * (1 - p), a[i: i + NODES]
        down += own[:, 1: 1 + FEATURES].T @ (p @ b[:, 0])
        products += own[:, 1 + FEATURES:].T @ (q @ b[:, 0])
        cross += own[:, 1: 1 + FEATURES].T @ q @ b[:, 1: 1 + FEATURES]
        pull += own[:, 0] @ p
        bend += own[:, 0] @ q
    products += bend @ b[:, 1 + FEATURES:]
    square = np.zeros((FEATURES, FEATURES))
    square[_UPPER] = products
    square = square + square.T - np.diag(np.diag(square))
    return pull @ b[:, 1: 1 + FEATURES] - down, square - cross - cross.T


def _rank(sums: _Sums, mean: np.ndarray, scale: np.ndarray, pairs: float, l2: float = 1.0) -> np.ndarray:
    """Weights that minimise log(1 + exp(-w . (x_good - x_bad))) over all pairs, of which there are `pairs`, by Newton steps."""
    w, share = np.zeros(FEATURES), min(PAIRS, pairs) / pairs
    for _ in range(40):
        def make(x: np.ndarray, good: np.ndarray, w=w) -> dict[int, np.ndarray]:
            z = np.clip((x - mean) / scale, -8, 8)
            return _moments(z @ w, z, good)

        slope, curve = _slopes(sums.total(make))
        step = np.linalg.solve(share * curve + l2 * np.eye(len(w)), -share * slope - l2 * w)
        w = w + step * min(1, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _level(s: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """The quantile level that splits the labels with fewest errors, and the middle of the gap there (the widest)."""
    order = np.argsort(s, kind="stable")
    s, good = s[order], good[order]
    wrong = np.concatenate(([0], np.cumsum(good))) + np.concatenate(([0], np.cumsum(~good)))[-1] \
        - np.concatenate(([0], np.cumsum(~good)))
    gap = np.diff(s)
    at = 1 + np.flatnonzero(gap > 0)
    at = at[wrong[at] == wrong[at].min()] if len(at) else at
    if not len(at):
        return 0.0, float(s[0]) - 1
    k = at[np.argmax(gap[at - 1])]
    return k / len(s), float(s[k - 1] + s[k]) / 2


def _level_of_many(rows: DataFrame, model: QualityModel, n: int, bad: int) -> tuple[float, float]:
    """What `_level` gives, for any number of rows: buckets of scores are sorted by a task each."""
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _arrays(batch)
            s, which = np.unique(model.raw(x), return_inverse=True)
            yield pa.RecordBatch.from_pydict({
                "s": pa.array(s), "good": pa.array(np.bincount(which.ravel(), good, len(s)).astype(np.int64)),
                "n": pa.array(np.bincount(which.ravel(), minlength=len(s)))})

    scored = store(rows.select("good", "x").mapInArrow(scores, "s double, good long, n long"), "label-scores")
    count = n // SORTED_ROWS + 1
    cuts = scored.approxQuantile("s", [i / count for i in range(1, count)], 0.1 / count) if count > 1 else []
    bucket = F.lit(0)
    for cut in sorted(set(cuts)):
        bucket = bucket + (F.col("s") > cut).cast("int")
    equal = scored.groupBy(bucket.alias("bucket"), "s").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    seen = sorted(equal.groupBy("bucket").agg(
        F.min("s").alias("first"), F.sum("good").alias("good"), F.sum("n").alias("n")).collect())  # a row for each bucket
    before, at = {}, (0, 0)
    for r, after in zip(seen, [*seen[1:], None]):
        before[r.bucket] = (*at, after.first if after else None)
        at = at[0] + r.good, at[1] + r.n

    def best(own: pa.Table) -> pa.Table:
        good_before, n_before, after = before[own.column("bucket")[0].as_py()]
        s, good, rows_of = (own.column(c).to_numpy() for c in ("s", "good", "n"))
        order = np.argsort(s)
        s = np.append(s[order], [] if after is None else [after])
        good, place = good_before + np.cumsum(good[order]), n_before + np.cumsum(rows_of[order])
        cuts = len(s) - 1
        wrong, gap = (good + bad - (place - good))[:cuts], np.diff(s)
        of = np.flatnonzero(wrong == wrong.min()) if cuts else np.zeros(0, int)
        of = of[[np.argmax(gap[of])]] if cuts else of
        return pa.table({"wrong": wrong[of], "gap": gap[of], "k": place[of], "cut": (s[of] + s[of + 1]) / 2})

    found = equal.groupBy("bucket").applyInArrow(best, "wrong long, gap double, k long, cut double").collect()
    discard(scored)
    if not found:
        return 0.0, float(seen[0].first) - 1
    r = min(found, key=lambda r: (r.wrong, -r.gap, r.k))
    return r.k / n, r.cut


def _labelled(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    return labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), F.col(quality).cast("int").alias("good"))


def described(rows: DataFrame) -> DataFrame:
    """The columns of rows(..., text) but the text, and the text's features x."""
    keep = [c for c in rows.columns if c != "text"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            x = features(block.column("text"))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), cells], [*keep, "x"])

    return rows.mapInArrow(describe, T.StructType(
        [*(rows.schema[c] for c in keep), T.StructField("x", T.ArrayType(T.DoubleType()))]))


def fit(rows: DataFrame) -> QualityModel:
    """Fit on all rows(good, x), which are read a few times; without both classes every text scores CUT."""
    sums = _Sums(rows)
    first = sums.total(lambda x, good: {0: np.concatenate(([len(x), good.sum()], x.sum(0)))}).get(0, np.zeros(2 + FEATURES))
    n, good = int(first[0]), int(first[1])
    if not 0 < good < n:
        one = np.ones(FEATURES)
        return QualityModel(0 * one, one, 0 * one, 0.0, 0.0)
    mean = first[2:] / n
    scale = np.sqrt(sums.total(lambda x, good: {0: ((x - mean) ** 2).sum(0)})[0] / n) + 1e-6
    model = QualityModel(mean, scale, _rank(sums, mean, scale, float(good) * (n - good)), 0.0, 0.0)
    level, threshold = _level(model.raw(sums.few[0]), sums.few[1]) if sums.few else _level_of_many(rows, model, n, n - good)
    return QualityModel(mean, scale, model.weights, threshold, level)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> QualityModel:
    """Fit on all rows of `labels` with a 0/1 quality, whose texts are in `docs`."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), text_of().alias("text"))
    rows = store(described(texts.join(_labelled(labels, doc_id, quality), "id").select("good", "text")), "labelled")
    model = fit(rows)
    discard(rows)
    return model


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document's label is kept from the fit: crc32 of the id's text, modulo 4, is 2. False for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All columns of `docs` plus score (0 to 1) and predicted (1 from CUT on); replaces columns of those names.

    A null text counts as empty; an empty text has a score like any other. Repeated rows get the same score.
    """
    rows = docs.drop("score", "predicted")
    names = rows.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            s = model.score(features(block.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*block.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))], [*names, "score", "predicted"])

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(apply, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learnt from the labels that are not held out.

    The features of all texts are stored, a twentieth of the texts or so, and read by the fit and for the scores.
    """
    known = store(described(docs.select(
        F.col("doc_id").cast("long").alias("id"), held_out().alias("held_out"), text_of().alias("text"))), "features")
    rows = store(known.join(_labelled(labels.where(~held_out())), "id").select("good", "x"), "labelled")
    model = fit(rows)
    discard(rows)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return known.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
