import math

import numpy as np
import pytest

from riskloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, vector string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame(
        [(i, v, 0, 7, "c", "v") for i, v in zip(ids, vectors)], SCHEMA).repartition(3)


@pytest.mark.parametrize("spectrum", [
    np.arange(1, 41.0), 2.0 ** -np.arange(40), np.r_[np.ones(20), np.full(20, 5.0)], np.r_[100.0, np.zeros(39)],
    np.r_[np.linspace(1, 1.001, 39), 1e6], np.ones(40), np.r_[3.0, 3.0, np.linspace(0, 1, 38)]])
def test_divide_and_conquer_finds_the_eigenvectors(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((40, 40)))
    a = q * spectrum @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.components(a, 32)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:32]
    scale = spectrum.max()
    assert np.abs(values - want).max() < 1e-13 * scale
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-13


def test_polar_factor_is_the_sign():
    r = np.random.default_rng(5)
    q, _ = np.linalg.qr(r.standard_normal((30, 30)))
    e = np.r_[-np.logspace(-6, 3, 14), np.logspace(-5, 2, 16)]
    assert np.abs(whitening.polar_factor(q * e @ q.T) - q * np.sign(e) @ q.T).max() < 1e-8


def test_whole_table_against_plain_numpy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plain = rows.toPandas()
    x = np.floor(64 * np.array(plain["embedding"].tolist(), float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    got = whitening.whiten(rows).toPandas()
    assert len(got) == n * 32 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1
    assert got["identity_error"].max() < 1e-10
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[plain["vec_id"]].to_numpy()
    want = y @ u / np.sqrt(e)
    want *= np.sign((want * wide).sum(axis=0))
    assert np.abs(wide - want).max() < 1e-6
    shares = got.groupby("component")["explained"].first().to_numpy()
    assert np.abs(shares / (e / np.trace(v)) - 1).max() < 1e-10
    deviation = got.groupby("vec_id")["deviation"].first().loc[plain["vec_id"]].to_numpy()
    assert (deviation == ((n * x - sums) ** 2).sum(axis=1)).all()


def test_odd_vectors(spark):
    r = np.random.default_rng(1)
    good = r.normal(size=(12, 5)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [3e38] * 5]
    clean = whitening.whiten(table(spark, good + good[:1], [None, *range(1, 12), 1])).toPandas()
    got = whitening.whiten(table(spark, good + odd + good[:1], [None, *range(1, 19), 1])).toPandas()
    assert len(got) == 13 * 5 and set(got["n"]) == {13} and set(got["component"]) == set(range(1, 6))
    assert got["vec_id"].isna().sum() == 5 and (got["vec_id"] == 1).sum() == 10
    order = ["vec_id", "component", "deviation"]
    assert np.allclose(got.sort_values(order)["whitened"], clean.sort_values(order)["whitened"])


def test_no_variance_no_components(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).collect() == []
    line = whitening.whiten(table(spark, [[float(i), 2.0 * i, 0.0] for i in range(6)])).collect()
    assert len(line) == 6 and {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)


def test_deviation_beyond_a_long_is_null(spark):
    rows = whitening.whiten(table(spark, [[1e9, 0.0], [-1e9, 1.0], [0.0, 3.0]])).toPandas()
    assert rows.groupby("vec_id")["deviation"].first().isna().sum() >= 2
