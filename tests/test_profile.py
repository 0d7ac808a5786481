import numpy as np
import pandas as pd
import pytest

from riskloom.operators import correlation, distribution, profile
from riskloom.plans.eda import profile_tables


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(42)
    n = 200
    return pd.DataFrame({
        "SK_ID_CURR": np.arange(100001, 100001 + n),
        "TARGET": (rng.random(n) < 0.08).astype(int),
        "AMT_INCOME_TOTAL": rng.lognormal(11, 0.5, n),
        "EXT_SOURCE_1": np.where(rng.random(n) < 0.4, np.nan, rng.random(n)),
        "CODE_GENDER": rng.choice(["M", "F"], n),
        "FLAG_OWN_CAR": rng.choice(["Y", "N"], n),
        "HIGH_MISSING_COL": np.where(rng.random(n) < 0.9, np.nan, 1.0 + rng.random(n)),
    })


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


def indexed(table, key):
    return table.toPandas().set_index(key)


def test_numeric_summary_matches_pandas(df, pdf):
    got = indexed(profile.numeric_summary(df), "column")
    for c in ["AMT_INCOME_TOTAL", "EXT_SOURCE_1", "HIGH_MISSING_COL", "TARGET"]:
        want = pdf[c].describe()
        assert got.loc[c, "count"] == want["count"]
        for a, b in [("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert got.loc[c, a] == pytest.approx(want[b], abs=1e-4)
        assert got.loc[c, "skewness"] == pytest.approx(pdf[c].skew(), abs=1e-4)
        assert got.loc[c, "kurtosis"] == pytest.approx(pdf[c].kurtosis(), abs=1e-4)
        assert got.loc[c, "unique_count"] == pdf[c].nunique()


def test_approximate_numeric_summary_is_close(df, pdf):
    got = indexed(profile.numeric_summary(df, exact=False), "column")
    assert got.loc["AMT_INCOME_TOTAL", "p50"] == pytest.approx(pdf["AMT_INCOME_TOTAL"].median(), rel=0.02)
    assert got.loc["AMT_INCOME_TOTAL", "unique_count"] == pytest.approx(200, rel=0.1)


def test_nan_counts_as_missing(df, pdf):
    got = indexed(profile.missing_values(df), "column")
    assert list(got.index) == ["HIGH_MISSING_COL", "EXT_SOURCE_1"]
    assert got.loc["EXT_SOURCE_1", "missing_count"] == pdf["EXT_SOURCE_1"].isna().sum()


def test_tiny_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    got = indexed(profile.numeric_summary(df), "column")
    assert got.loc["a", "std"] == 0 and np.isnan(got.loc["a", "skewness"]) and got.loc["b", "count"] == 0


def test_duplicates_null_equals_null_and_hot_row(spark):
    rows = [(1, None), (1, None), (2, "x")] + [(3, "hot")] * 50
    df = spark.createDataFrame(rows, "SK_ID_CURR int, v string")
    got = profile.duplicates(df).first()
    assert (got.total_rows, got.duplicate_rows, got.id_duplicates, got.is_unique) == (53, 50, 50, False)
    assert got.duplicate_pct == round(50 / 53 * 100, 4)
    unique = profile.duplicates(spark.createDataFrame([(1, "a"), (2, "a")], "SK_ID_CURR int, v string")).first()
    assert unique.is_unique and unique.duplicate_rows == 0
    sub = profile.duplicates(spark.createDataFrame([(1, "a"), (2, "a")], "SK_ID_CURR int, v string"), ["v"]).first()
    assert sub.duplicate_rows == 1


def test_duplicates_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(profile, "BROADCAST_HASHES", 3)
    df = spark.createDataFrame([(i % 40, "x") for i in range(100)], "k int, v string")
    assert profile.duplicates(df).first().duplicate_rows == 60


def test_target_distribution(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "TARGET int")
    r = profile.target_distribution(df).first()
    assert (r.zero_count, r.one_count, r.zero_pct, r.default_rate, r.imbalance_ratio, r.null_count) == (3, 1, 75.0, 25.0, 3.0, 1)
    assert profile.target_distribution(df.withColumnRenamed("TARGET", "x")) is None


def test_categorical_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string").selectExpr("c", "cast(null as string) n")
    got = indexed(profile.categorical_summary(df), "column")
    assert got.loc["c", "top_value"] == "a" and got.loc["c", "top_value_pct"] == 50.0 and got.loc["c", "missing_pct"] == 20.0
    assert got.loc["n", "top_value"] is None and got.loc["n", "top_value_count"] == 0 and got.loc["n", "top_value_pct"] == 0


def test_column_types(df):
    got = indexed(profile.column_types(df), "column")
    assert got.loc["CODE_GENDER", "sample_values"] == "F, M" and got.loc["CODE_GENDER", "kind"] == "string"
    assert got.loc["SK_ID_CURR", "unique_count"] == 200
    approx = indexed(profile.column_types(df, exact=False), "column")
    assert approx.loc["TARGET", "unique_count"] == 2
    kinds = {r.kind: r.column_count for r in profile.kind_counts(profile.column_types(df)).collect()}
    assert kinds == {"integer": 2, "float": 3, "string": 2}


def test_target_correlation_matches_numpy(df, pdf):
    got = indexed(correlation.target_correlation(df, 10), "feature")
    x = pdf["EXT_SOURCE_1"].fillna(pdf["EXT_SOURCE_1"].median())
    assert got.loc["EXT_SOURCE_1", "correlation"] == pytest.approx(np.corrcoef(x, pdf["TARGET"])[0, 1], abs=1e-4)
    assert list(got["abs_correlation"]) == sorted(got["abs_correlation"], reverse=True)


@pytest.mark.parametrize("r,n,p", [
    # t = r*sqrt((n-2)/(1-r^2)); two-sided tails of Student's t from printed tables
    (0.5760, 12, 0.05), (0.6319, 10, 0.05), (0.7646, 10, 0.01), (0.1946, 102, 0.05), (0.0, 50, 1.0), (1.0, 9, 0.0),
])
def test_p_value(r, n, p):
    assert correlation.correlation_p_value(r, n) == pytest.approx(p, abs=2e-4)


def test_p_value_large_n_is_continuous():
    a, b = (correlation.correlation_p_value(0.002, n) for n in (1_000_000, 1_000_001))
    assert a == pytest.approx(b, abs=1e-6)


def test_correlation_matrix_is_pairwise_complete(df, pdf):
    got = correlation.correlation_matrix(df, 4).toPandas()
    want = pdf[["TARGET", "AMT_INCOME_TOTAL", "EXT_SOURCE_1", "HIGH_MISSING_COL"]].corr()
    assert len(got) == 10
    for r in got.itertuples():
        assert r.correlation == pytest.approx(want.loc[r.feature_x, r.feature_y], abs=1e-4)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    values, labels = rng.normal(size=500), rng.integers(0, 2, 500)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, values)], "label int, value double")
    got = distribution.class_histogram(df, 20).toPandas()
    for k in (0, 1):
        n, edges = np.histogram(values[labels == k], bins=20)
        mine = got[got.label == k].sort_values("bin")
        assert list(mine.n) == list(n)
        np.testing.assert_allclose(mine.bin_start, edges[:-1], atol=1e-4)
        np.testing.assert_allclose(mine.density, np.histogram(values[labels == k], bins=20, density=True)[0], atol=1e-8)


def test_histogram_of_one_value(spark):
    got = distribution.class_histogram(spark.createDataFrame([(0, 3.0), (0, 3.0)], "label int, value double"), 10).toPandas()
    assert got.n.sum() == 2 and got.bin_start.min() == 2.5 and got.bin_end.max() == 3.5


def test_quantile_cap_bounds(df):
    with pytest.raises(ValueError, match="between 0.5 and 1.0"):
        distribution.keep_below_quantile(df, "AMT_INCOME_TOTAL", 0.4)
    assert distribution.keep_below_quantile(df, "AMT_INCOME_TOTAL", 1.0).count() == 200
    assert distribution.keep_below_quantile(df, "AMT_INCOME_TOTAL", 0.99).count() == 198


def test_profile_tables_skip_what_is_absent(spark):
    tables = profile_tables(spark.createDataFrame([("a",), ("b",)], "c string"))
    assert "numeric_summary" not in tables and "target_distribution" not in tables and "categorical_summary" in tables


def test_wide_table_is_profiled_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(profile, "CHUNK", 7)
    df = spark.range(10).selectExpr(*[f"if(id < {i % 10}, null, id) c{i}" for i in range(30)])
    got = indexed(profile.missing_values(df), "column")
    assert len(got) == 27 and got.loc["c9", "missing_pct"] == 90.0
