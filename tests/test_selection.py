import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from riskloom.operators.selection import exact_quantiles, exact_quantiles_long, order_statistics

PS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.98, 0.99, 1.0]


def frame(spark):
    rng = np.random.default_rng(5)
    n = 20_000
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 3, n))
    return pd.DataFrame(
        {
            "smooth": rng.lognormal(3, 2, n),
            "hot": hot,
            "steps": rng.integers(0, 4, n).astype(float),
            "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.random(n)),
            "one": np.full(n, 3.0),
        }
    )


@pytest.mark.parametrize("limit", [100_000, 500, 64])
def test_quantiles_match_pandas_with_and_without_refinement(spark, limit):
    pdf = frame(spark)
    df = spark.createDataFrame(pdf).repartition(6)
    got = exact_quantiles(df, list(pdf.columns), PS, limit=limit)
    for c in pdf:
        np.testing.assert_allclose(got[c], pdf[c].quantile(PS).to_numpy(), rtol=1e-12, err_msg=c)


def test_rank_counts_tell_rows_below_and_equal(spark):
    values = [1.0] * 5 + [2.0] * 900 + [3.0] * 7
    df = spark.createDataFrame([(0, v) for v in values], "g int, v double")
    _, stats = order_statistics(df, lambda n: {0: [4, 5, 904, 905]}, limit=50)
    assert [(s.value, s.following, s.below, s.equal) for s in stats[0]] == [
        (1.0, 2.0, 0, 5), (2.0, 2.0, 5, 900), (2.0, 3.0, 5, 900), (3.0, 3.0, 905, 7),
    ]


def test_absent_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [1.5]}


@settings(derandomize=True, phases=[Phase.generate], max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=400), st.floats(0, 1))
def test_any_list(spark, values, p):
    df = spark.createDataFrame([(0, float(v)) for v in values], "g int, v double")
    got = exact_quantiles_long(df, [p], limit=64)[0][0]
    assert got == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-6)
