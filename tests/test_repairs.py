"""Types beyond numbers and text, equal margins, NaN scores, large samples, and the advised features."""

import datetime as dt
import os
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import correlation, extras, features, insights, metrics, models, profile, shapley
from riskloom.operators.quality import SchemaValidationError
from riskloom.sources import tables
from riskloom.sources.binding import application
from riskloom.sources.registry import ModelRegistry


def test_pipeline_takes_booleans_dates_and_times(spark):
    rows = [(i, i % 2, None if i % 5 == 0 else i % 3 == 0, None if i % 7 == 0 else dt.date(2020, 1, 1 + i % 28),
             dt.datetime(2020, 1, 1, i % 24), float(i)) for i in range(60)]
    df = spark.createDataFrame(
        rows, "SK_ID_CURR int, TARGET int, flag boolean, day date, at timestamp, x double")
    fitted = features.preprocessing().fit(df)
    out, names = fitted.transform(df), features.feature_names(fitted)
    assert {"flag_le", "day", "at", "x"} <= set(names)
    assert out.where(" or ".join(f"`{c}` is null" for c in names)).count() == 0
    assert models.assemble(out, names).count() == 60
    with pytest.raises(SchemaValidationError, match="list array"):
        features.PlainTypes().transform(df.withColumn("list", F.array("x")))


def test_equal_margins_keep_their_attribution():
    inf = np.inf
    leaves = [shapley.Leaf(np.array([f]), np.array([lo]), np.array([hi]), v)
              for f, lo, hi, v in [(0, -inf, 0.0, -1.0), (0, 0.0, inf, 1.0), (1, -inf, 0.0, 1.0), (1, 0.0, inf, -1.0)]]
    explainer = shapley.Explainer(leaves, np.array([[-1.0, -1.0]]))
    same = explainer.values(np.array([[1.0, 1.0]]))[0]
    assert same == pytest.approx([0.5, -0.5])
    leaves[0] = shapley.Leaf(np.array([0]), np.array([-inf]), np.array([0.0]), -1.0 + 1e-6)
    near = shapley.Explainer(leaves, np.array([[-1.0, -1.0]])).values(np.array([[1.0, 1.0]]))[0]
    assert near == pytest.approx(same, abs=1e-5)


def test_nan_scores_are_missing(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (0, float("nan")), (1, None)], "y int, p double")
    r = metrics.classification_metrics(df, "p", "y").first()
    assert (r["roc_auc"], r["tp"], r["tn"], r["fp"], r["fn"]) == (1.0, 1, 1, 0, 0)
    assert metrics.confusion_matrix(df, "p", "y").agg(F.sum("n")).first()[0] == 2


def test_ladder_buckets_follow_the_data(spark):
    df = spark.range(3000).selectExpr("cast(id % 3 = 0 as int) y", "cast(hash(id) as double) p")
    a = metrics.score_ladder(df, "p", "y", per_bucket=50).orderBy("score").collect()
    assert a == metrics.score_ladder(df, "p", "y", per_bucket=10_000).orderBy("score").collect()


def test_p_value_is_one_formula_at_every_size():
    for n in (50, 1_000, 999_999, 1_000_001, 10**9):
        r = 2.5 / math.sqrt(n)
        p = correlation.correlation_p_value(r, n)
        if n >= 1_000:
            assert p == pytest.approx(math.erfc(2.5 / math.sqrt(2)), rel=0.02)
        assert 0.005 < p < 0.03
    a, b = (correlation.correlation_p_value(0.0025, n) for n in (999_999, 1_000_001))
    assert a == pytest.approx(b, rel=1e-4)


def test_decimals_are_ordered_as_numbers(spark):
    df = spark.createDataFrame([("2",), ("9",), ("10",), ("100",)], "d string").selectExpr("cast(d as decimal(9,2)) d")
    assert profile.column_types(df).first()["sample_values"] == "2.00, 9.00, 10.00"


def test_too_deep_trees_are_refused():
    with pytest.raises(ValueError, match="max_depth 20"):
        models.boosted_trees({"max_depth": 20})


def test_advised_features(spark):
    apps = spark.createDataFrame(
        [(1, 100.0, 10.0, None, 0.2, 0.4, 1, 0), (2, 50.0, 0.0, None, None, None, 1, 1)],
        "SK_ID_CURR int, AMT_CREDIT double, AMT_ANNUITY double, EXT_SOURCE_1 double, EXT_SOURCE_2 double, "
        "EXT_SOURCE_3 double, FLAG_DOCUMENT_2 int, FLAG_DOCUMENT_3 int")
    a, b = extras.extra_features(apps).orderBy("SK_ID_CURR").collect()
    assert a["credit_term"] == 10 and a["ext_source_mean"] == pytest.approx(0.3) and a["document_count"] == 1
    assert b["credit_term"] is None and b["ext_source_mean"] is None and b["document_count"] == 2
    bureau = spark.createDataFrame(
        [(1, "Active", 3, 5.0), (1, "Closed", 0, 6.0)],
        "SK_ID_CURR int, CREDIT_ACTIVE string, CREDIT_DAY_OVERDUE int, AMT_CREDIT_SUM double")
    a, b = extras.with_bureau(apps, bureau).orderBy("SK_ID_CURR").collect()
    assert (a["bureau_records"], a["bureau_active"], a["bureau_overdue"], a["bureau_credit_sum"]) == (2, 1, 1, 11.0)
    assert (b["bureau_records"], b["bureau_credit_sum"]) == (0, None)
    scores = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.3), (1, 0.15)], "TARGET int, p double")
    r = extras.rank_statistics(scores, "p").first()
    assert (r["ks"], r["gini"]) == (0.5, 0.5)


def test_a_failing_value_stops_only_its_insight(spark, sf_dir):
    app = application(spark, sf_dir)
    broken = app.withColumn("AMT_CREDIT", F.when(F.col("SK_ID_CURR") > 0, F.raise_error(F.lit("bad cell")).cast("double")))
    with pytest.raises(Exception, match="bad cell"):
        insights.all_insights(broken).collect()
    # the rows are written once in a plan; here the value fails in each pass that reads it
    found = {r.position for r in insights.isolated_insights(broken).collect()}
    whole = {r.position for r in insights.isolated_insights(app).collect()}
    assert found and found < whole


def test_scratch_is_removed(spark, tmp_path):
    with tables.scratch(spark):
        kept = tables.settle(spark.range(5))
        folder = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file:")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_versions_are_published_whole(spark, tmp_path):
    r = ModelRegistry(spark, str(tmp_path))
    assert r.versions("notes") == []
    with pytest.raises(FileNotFoundError):
        r.load_json("notes")
    first, second = r.save_json("notes", {"a": 1}), r.save_json("notes", {"a": 2})
    assert first.endswith("v000001") and second.endswith("v000002") and r.load_json("notes")["a"] == 2
    assert r.load_json("notes", 1)["a"] == 1
    with pytest.raises(FileNotFoundError, match="version 7"):
        r.load_json("notes", 7)

    def broken(path):
        os.makedirs(path)
        raise RuntimeError("writer lost")

    with pytest.raises(RuntimeError):
        r._publish("notes", broken)
    assert r.versions("notes") == [1, 2] and r.load_json("notes")["a"] == 2
    # a writer that finds its number taken goes on to the next one
    taken, seen = iter([[1, 2], [1, 2, 3]]), []
    os.makedirs(tmp_path / "notes" / "v000003")
    r.versions = lambda name: seen.append(1) or next(taken)
    assert r._publish("notes", lambda path: os.makedirs(path)).endswith("v000004") and len(seen) == 2
