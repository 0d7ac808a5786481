import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskloom.operators import features as fe
from riskloom.operators import profile
from riskloom.operators.quality import SchemaValidationError


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(42)
    out = []
    for i in range(200):
        out.append((
            100001 + i, int(rng.random() < 0.3), float(rng.integers(1, 9)) * 1e4, float(rng.integers(1, 9)) * 1e5,
            None if i % 7 == 0 else float(rng.integers(1, 9)) * 1e3, -int(rng.integers(8000, 20000)),
            365243 if i % 5 == 0 else -int(rng.integers(1, 9000)), "FM"[i % 2],
            None if i % 11 == 0 else ["Cash loans", "Revolving loans", "Other"][i % 3],
            "Y" if i % 4 else "N", None if i % 20 else 1.0 + i, 3.0,
        ))
    return spark.createDataFrame(
        out, "SK_ID_CURR long, TARGET int, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, DAYS_BIRTH int, "
        "DAYS_EMPLOYED int, CODE_GENDER string, NAME_CONTRACT_TYPE string, FLAG_OWN_CAR string, MOSTLY_NULL double, CONSTANT_COL double",
    )


def test_ratio_values(spark):
    df = spark.createDataFrame(
        [(1, 100000.0, 500000.0, 25000.0, -12000, -2000), (2, 0.0, 1.0, 1.0, -10000, 365243), (3, 5.0, None, 1.0, -10000, -1)],
        "SK_ID_CURR int, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, DAYS_BIRTH int, DAYS_EMPLOYED int",
    )
    a, b, c = fe.RatioFeatures().fit(df).transform(df).orderBy("SK_ID_CURR").collect()
    assert (a.credit_to_income_ratio, a.annuity_to_income_ratio, a.debt_to_income_ratio) == (5.0, 0.25, 5.25)
    assert a.employment_age_ratio == pytest.approx(2000 / 12000)
    assert b.credit_to_income_ratio is None and b.employment_age_ratio is None
    assert c.credit_to_income_ratio is None and c.debt_to_income_ratio is None and c.annuity_to_income_ratio == 0.2


def test_ratios_without_sources_are_reported(spark):
    m = fe.RatioFeatures().fit(spark.createDataFrame([(1.0, 2.0)], "AMT_CREDIT double, AMT_INCOME_TOTAL double"))
    assert m.learnt["created"] == ["credit_to_income_ratio"]
    assert m.learnt["skipped"]["annuity_to_income_ratio"] == "missing columns: ['AMT_ANNUITY']"


def test_selector(spark, rows):
    m = fe.ColumnSelector().fit(rows)
    report = m.learnt["report"]
    assert report["dropped_high_missing"] == [{"column": "MOSTLY_NULL", "missing_pct": 95.0}]
    assert report["dropped_zero_variance"] == ["CONSTANT_COL"] and report["total_dropped"] == 2
    out = m.transform(rows)
    assert {"SK_ID_CURR", "TARGET"} <= set(out.columns) and "MOSTLY_NULL" not in out.columns
    assert "TARGET" not in m.transform(rows.drop("TARGET")).columns
    assert m.transform(rows.drop("SK_ID_CURR")).count() == 200  # the id is carried, never required
    with pytest.raises(SchemaValidationError, match="AMT_CREDIT"):
        m.transform(rows.drop("AMT_CREDIT"))
    table = {r.column: r.decision for r in fe.selection_report(rows).collect()}
    assert table["MOSTLY_NULL"] == "high_missing" and table["CONSTANT_COL"] == "zero_variance" and table["AMT_CREDIT"] == "kept"


def test_selector_threshold_and_all_null(spark):
    df = spark.createDataFrame([(i, None, 1.0 if i else None) for i in range(5)], "SK_ID_CURR int, a double, b double")
    assert fe.ColumnSelector(1.0).fit(df).learnt["selected"] == []
    assert fe.ColumnSelector(0.5).fit(df).learnt["report"]["dropped_high_missing"][0]["column"] == "a"


def test_selector_in_chunks(spark, rows, monkeypatch):
    whole = fe.ColumnSelector().fit(rows).learnt
    monkeypatch.setattr(profile, "CHUNK", 2)
    assert fe.ColumnSelector().fit(rows).learnt == whole


def test_large_integers_that_differ_are_not_constant(spark):
    df = spark.createDataFrame([(1, 2**60), (2, 2**60 + 1)], "SK_ID_CURR int, big long")
    assert fe.ColumnSelector().fit(df).learnt["selected"] == ["big"]


def test_filler(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "b", None, None), (2, None, "a", None, None), (3, 4.0, None, None, None), (4, 2.0, "b", None, None), (5, 3.0, "a", None, None)],
        "SK_ID_CURR int, x double, c string, e string, n double",
    )
    m = fe.MissingFiller().fit(df)
    assert m.learnt["fills"] == {"x": 2.5, "n": 0.0, "c": "a", "e": "MISSING"}
    out = m.transform(df)
    assert out.where("x is null or c is null or e is null or n is null").count() == 0
    stats = {r.column: r for r in m.stats(spark).collect()}
    assert (stats["x"].missing_count, stats["x"].missing_pct, stats["x"].imputed_number) == (1, 20.0, 2.5)
    assert stats["c"].imputed_text == "a" and m.learnt["total_imputed"] == 1 + 5 + 1 + 5
    nan = spark.createDataFrame([(9, float("nan"), "z", "q", 1.0)], df.schema)
    assert m.transform(nan).first().x == 2.5


def test_encoder(spark, rows):
    filled = fe.MissingFiller().fit(rows).transform(rows)
    m = fe.CategoryEncoder().fit(filled)
    assert m.learnt["coded"] == ["CODE_GENDER", "FLAG_OWN_CAR"] and m.learnt["spread"] == ["NAME_CONTRACT_TYPE"]
    out = m.transform(filled)
    assert out.columns[0] == "SK_ID_CURR" and out.columns[-1] == "TARGET" and "NAME_CONTRACT_TYPE_Cash_loans" in out.columns
    assert {r[0] for r in out.select("CODE_GENDER_le").distinct().collect()} == {0.0, 1.0}
    new = filled.limit(1).withColumns({"CODE_GENDER": F.lit("X"), "NAME_CONTRACT_TYPE": F.lit("new")})
    r = m.transform(new).first()
    assert r.CODE_GENDER_le == -1.0 and r.NAME_CONTRACT_TYPE_Cash_loans == 0.0 == r.NAME_CONTRACT_TYPE_Other


def test_a_column_with_many_values_becomes_one_vector(spark):
    df = spark.range(50).selectExpr("id SK_ID_CURR", "cast(id as string) c")
    model = fe.CategoryEncoder(max_categories=20).fit(df)
    assert model.learnt["wide"] == {"c": 50} and model.transform(df).columns == ["SK_ID_CURR", "c_values"]


def test_names():
    assert fe.sanitise(["a b", "a_b", "a[b]", "_x__y_", "ok"]) == ["a_b", "a_b_1", "a_b_2", "x_y", "ok"]


def test_whole_pipeline_leaves_no_nulls_and_survives_saving(spark, rows, tmp_path):
    fitted = fe.preprocessing().fit(rows)
    out = fitted.transform(rows)
    names = fe.feature_names(fitted)
    assert out.columns == ["SK_ID_CURR", *names, "TARGET"]
    assert out.where(" or ".join(f"`{c}` is null or isnan(`{c}`)" for c in names)).count() == 0
    fitted.write().overwrite().save(f"{tmp_path}/p")
    again = PipelineModel.load(f"{tmp_path}/p").transform(rows)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    meta = fe.preprocessing_metadata(fitted)
    assert meta["encoding"]["output_feature_count"] == len(names) and len(meta["created_features"]) == 4
