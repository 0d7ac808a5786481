import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom.functions import expressions as X
from riskloom.functions.text import driver_phrases, feature_label, mitigants, narrative
from riskloom.operators.scoring import band_counts, risk_columns


def test_safe_ratio_zero_null_nan_infinite(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (1.0, 0.0), (1.0, None), (None, 2.0), (1.0, float("nan")), (1.0, float("inf"))], "a double, b double"
    )
    got = [r.r for r in df.select(X.safe_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [0.5, None, None, None, None, None]


def test_age_and_tenure(spark):
    df = spark.createDataFrame([(-12000, 365243), (-10958, -1461)], "b int, e int")
    rows = df.select(X.age_years(F.col("b")).alias("a"), X.tenure_years(F.col("e"), 1).alias("t")).collect()
    assert rows[0].a == pytest.approx(12000 / 365.25) and rows[0].t is None
    assert rows[1].t == 4.0


def test_bins_are_closed_on_the_left(spark):
    df = spark.createDataFrame([(19.9,), (20.0,), (24.9,), (25.0,), (69.9,), (70.0,)], "v double")
    assert [r[0] for r in df.select(X.age_bin(F.col("v"))).collect()] == [
        None, "[20, 25)", "[20, 25)", "[25, 30)", "[65, 70)", None,
    ]
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (9.9,), (20.0,), (None,)], "v double")
    assert [r[0] for r in df.select(X.tenure_band(F.col("v"))).collect()] == [
        "<1yr", "1-3yr", "3-5yr", "5-10yr", "20+yr", None,
    ]


@pytest.mark.parametrize(
    "p,score,band",
    [(0.12, 120, "Low Risk"), (0.38, 380, "Medium Risk"), (0.82, 820, "High Risk"), (0.0, 0, "Low Risk"),
     (0.2, 200, "Medium Risk"), (0.5, 500, "High Risk"), (1.0, 1000, "High Risk"), (0.1999, 199, "Low Risk"),
     (0.4999, 499, "Medium Risk")],
)
def test_score_and_band(spark, p, score, band):
    row = risk_columns(spark.createDataFrame([(p,)], "p double"), F.col("p"), []).first()
    assert (row.default_probability, row.risk_score, row.risk_band) == (p, score, band)


@pytest.mark.parametrize("p", [-0.01, 1.01, float("nan")])
def test_probability_outside_range_fails(spark, p):
    with pytest.raises(PySparkException, match="probability must be in"):
        risk_columns(spark.createDataFrame([(p,)], "p double"), F.col("p"), []).collect()


def test_band_counts(spark):
    scored = risk_columns(spark.createDataFrame([(0.1,), (0.15,), (0.9,)], "p double"), F.col("p"), [])
    assert {r.risk_band: r.row_count for r in band_counts(scored).collect()} == {"Low Risk": 2, "High Risk": 1}


@pytest.mark.parametrize(
    "name,label",
    [("AMT_CREDIT", "credit amount requested"), ("ext_source_2", "external credit score (bureau 2)"),
     ("NAME_INCOME_TYPE_Working", "income type"), ("AMT_CREDIT_SUM", "total outstanding credit"),
     ("AMT_CREDIT_SUM_X", "credit amount requested"), ("SOME_new_thing", "Some New Thing"), ("f_1a", "F 1A")],
)
def test_feature_label(spark, name, label):
    df = spark.createDataFrame([(name,)], "f string")
    assert df.select(feature_label(F.col("f"))).first()[0] == label
    assert df.select(feature_label(F.col("f"), {name.lower(): "mine"})).first()[0] == "mine"


def text(spark, band, p, score, up, down):
    one = "array<struct<label:string,impact:double>>"
    df = spark.createDataFrame([(band, p, score, up, down)], f"b string, p double, s int, u {one}, d {one}")
    df = df.withColumns({"ph": driver_phrases(F.col("u")), "re": mitigants(F.col("d"))})
    return df.select(narrative(F.col("b"), F.col("p"), F.col("s"), F.col("ph"), F.col("re"))).first()[0]


def test_narrative_high(spark):
    got = text(spark, "High Risk", 0.82, 820, [("a", 0.1), ("b", 0.05), ("c", 0.01), ("d", 0.001)], [("e", -0.2), ("f", -0.1), ("g", -0.05)])
    assert "HIGH default risk: the probability of default is 82.0%." in got
    assert "primarily on significantly elevated a, significantly elevated b, and slightly elevated c." in got
    assert "mitigating side, e and f bring" in got and "Risk score: 820 / 1000." in got


def test_narrative_one_and_two_drivers_and_no_mitigants(spark):
    got = text(spark, "High Risk", 0.9, 900, [("a", 0.1)], [])
    assert "on significantly elevated a." in got and "Nothing mitigates" in got
    got = text(spark, "Low Risk", 0.1, 100, [("a", 0.1), ("b", 0.03)], [])
    assert "partly on significantly elevated a and moderately elevated b." in got
    assert "Nothing mitigates" not in got and "LOW default risk" in got


def test_narrative_without_drivers_and_unknown_band(spark):
    got = text(spark, "??", 0.3, 300, [], [("e", -0.2)])
    assert "MODERATE" in got and "It rests" not in got and "side, e bring" in got
