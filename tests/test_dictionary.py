import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array

from riskloom.operators import dictionary, features, models


@pytest.fixture(scope="module")
def rows(spark):
    values = ["hot"] * 60 + [f"v{i % 25:02d}" for i in range(100)] + [None, "", "\x00 3"]
    return spark.createDataFrame([(i, i % 2, float(i), v, "x" if i % 3 else "y") for i, v in enumerate(values)],
                                 "SK_ID_CURR int, TARGET int, n double, wide string, narrow string").repartition(7)


def test_values_are_numbered_in_order(spark, rows, monkeypatch):
    table = spark.read.parquet(dictionary.build(rows, ["wide", "narrow"]))
    got = {(r.column, r.value): (r.number, r.n) for r in table.collect()}
    want = sorted({r.wide for r in rows.collect() if r.wide is not None})
    assert {v: got["wide", v][0] for v in want} == {v: i for i, v in enumerate(want)}
    assert got["wide", "hot"][1] == 60 and got["narrow", "x"][0] == 0
    assert dictionary.sizes(rows, ["wide", "narrow"]) == {"wide": len(want), "narrow": 2}


@pytest.mark.parametrize("hot", [1, 5, 10_000])
def test_rows_take_their_numbers(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(dictionary, "HOT_VALUES", hot)
    table = spark.read.parquet(dictionary.build(rows.where("SK_ID_CURR < 150"), ["wide"]))
    known = {r.value: r.number for r in table.collect()}
    got = dictionary.attach(rows, table, "wide", "at").collect()
    assert len(got) == rows.count() and all(r["at"] == known.get(r.wide) for r in got)


def test_wide_columns_become_sparse_vectors_that_are_saved(spark, rows, tmp_path):
    fit = rows.where("SK_ID_CURR < 150")
    model = Pipeline(stages=[features.MissingFiller(), features.CategoryEncoder(max_categories=10)]).fit(fit)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    names = features.feature_names(again)
    assert names == ["n", "narrow_le", "wide_values"]
    known = sorted({r.wide for r in fit.collect()})
    for m in (model, again):
        out = m.transform(rows)
        assert out.count() == rows.count()
        given = {r.SK_ID_CURR: r.wide if r.wide is not None else "hot" for r in rows.collect()}
        for r in out.select("SK_ID_CURR", vector_to_array("wide_values").alias("v")).collect():
            want = [float(v == given[r.SK_ID_CURR]) for v in known]
            assert r.v == want, r
    whole = models.assemble(out, names)
    assert models.vector_names(whole)[:3] == ["n", "narrow_le", "wide_values_0"]
    assert len(models.vector_names(whole)) == 2 + len(known)
    fitted = models.train_boosted(whole, {"n_estimators": 2, "num_leaves": 4, "min_child_samples": 2}, watched=0)
    assert fitted.numFeatures == 2 + len(known)


def test_no_rows(spark, rows):
    empty = rows.where("false")
    assert dictionary.sizes(empty, ["wide"]) == {"wide": 0}
    model = features.CategoryEncoder().fit(empty)
    assert model.transform(rows).count() == rows.count()
