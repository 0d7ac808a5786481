import logging

import pytest
from pyspark.sql import functions as F

from riskloom.operators import insights


@pytest.fixture(scope="module")
def app(spark):
    rows = []
    for i in range(120):
        y = int(i % 12 == 0)
        rows.append((i, y, 1000.0 + i, 5000.0 if y else 900.0, -(8000 + 150 * i), 365243 if i % 4 == 0 else -(100 + 30 * i),
                     None if i % 2 else y * -1.0 + i / 1000, 1 if y else 0, None if i % 10 else 1.0))
    return spark.createDataFrame(
        rows, "SK_ID_CURR int, TARGET int, AMT_INCOME_TOTAL double, AMT_CREDIT double, DAYS_BIRTH int, DAYS_EMPLOYED int, "
        "EXT_SOURCE_1 double, FLAG_DOCUMENT_3 int, HIGH_MISSING_A double",
    )


@pytest.fixture(scope="module")
def bureau(spark):
    return spark.createDataFrame(
        [(1, 10, 0, "a"), (1, 11, 5, "a"), (2, 12, 0, "b"), (3, 13, 9, None)],
        "SK_ID_CURR int, SK_ID_BUREAU int, CREDIT_DAY_OVERDUE int, CREDIT_TYPE string",
    )


def test_imbalance_levels(spark, app):
    r = insights.insight(app, "class_imbalance").first()
    assert r.imbalance_ratio == 11.0 and r.severity == "critical" and "which is 11.0 to 1" in r.finding
    for zeros, level in ((5, "info"), (6, "warning"), (10, "warning"), (11, "critical")):
        df = spark.createDataFrame([(0,)] * zeros + [(1,)], "TARGET int")
        assert insights.insight(df, "class_imbalance").first().severity == level


def test_credit_and_income(app):
    r = insights.insight(app, "credit_patterns").first()
    assert r.high_credit_income_ratio_count == 10 and r.severity == "warning" and "a larger mean" in r.finding
    r = insights.insight(app, "income_patterns").first()
    assert r.median_income_default == 1054.0 and r.outlier_count == 2


def test_income_is_skipped_when_a_class_has_none(app):
    gone = app.withColumn("AMT_INCOME_TOTAL", F.when(F.col("TARGET") == 0, F.col("AMT_INCOME_TOTAL")))
    assert insights.insight(gone, "income_patterns") is None


def test_zero_income_gives_no_ratio(app):
    r = insights.insight(app.withColumn("AMT_INCOME_TOTAL", F.lit(0.0)), "credit_patterns").first()
    assert r.high_credit_income_ratio_count == 0


def test_employment(app):
    r = insights.insight(app, "employment_patterns").first()
    assert r.anomaly_count == 30 and r.anomaly_pct == 25.0 and r.severity == "warning"


def test_external_scores(app):
    r = insights.insight(app, "external_scores").first()
    assert r.corr_EXT_SOURCE_1 < -0.9 and r.null_pct_EXT_SOURCE_1 == 50.0 and r.strongest_negative == "EXT_SOURCE_1"


def test_missing(app):
    r = insights.insight(app, "missing_values").first()
    assert (r.high_missing_count, r.moderate_missing_count) == (1, 1) and "`HIGH_MISSING_A` (90.0%)" in r.finding
    none = insights.insight(app.select("TARGET"), "missing_values").first()
    assert none.severity == "info" and "Emptiest: none." in none.finding


def test_documents(app):
    r = insights.insight(app, "document_flags").first()
    assert r.rate_FLAG_DOCUMENT_3 == 100.0 and "FLAG_DOCUMENT_3 (100.0%)" in r.finding
    few = insights.insight(app.where("SK_ID_CURR < 100"), "document_flags").first()
    assert few.rate_FLAG_DOCUMENT_3 is None and "No flag stands out" in few.finding


def test_age_without_any_bin(app):
    assert insights.insight(app.withColumn("DAYS_BIRTH", F.lit(-40000)), "age_patterns").first().peak_age_bin == "N/A"


def test_bureau(bureau):
    r = insights.bureau_overview(bureau).first()
    assert (r.total_bureau_records, r.unique_clients, r.avg_entries_per_client, r.overdue_record_count) == (4, 3, 1.3, 2)
    assert "Commonest credit types: {'a': 2, 'b': 1}." in r.finding
    assert insights.bureau_overview(None) is None
    assert "Commonest credit types" not in insights.bureau_overview(bureau.drop("CREDIT_TYPE")).first().finding


@pytest.mark.parametrize("name", [n for n in insights.ANALYSES if n != "missing_values"])
def test_absent_columns_give_nothing(spark, name):
    assert insights.insight(spark.createDataFrame([(1,)], "x int"), name) is None


def test_all_in_order_and_severity_counts(app, bureau):
    rows = insights.all_insights(app, bureau).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(9)) and rows[7].title.startswith("Bureau")
    assert all(r.severity in ("info", "warning", "critical") and r.finding and r.recommendation for r in rows)
    counts = {r.severity: r.insight_count for r in insights.severity_counts(insights.all_insights(app)).collect()}
    assert sum(counts.values()) == 8


def test_one_broken_insight_does_not_stop_the_others(app, monkeypatch, caplog):
    def broken(df):
        raise RuntimeError("boom")

    monkeypatch.setitem(insights.ANALYSES, "age_patterns", broken)
    with caplog.at_level(logging.CRITICAL):
        assert insights.all_insights(app).count() == 7


def test_unknown_severity():
    with pytest.raises(ValueError, match="severity"):
        insights.Text("a", "b", F.lit("c"), "d", "fatal")
