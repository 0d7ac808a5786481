import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from riskloom.operators import boosting, models

NAMES = ["a", "b", "c", "d", "flag", "level", "same"]


@pytest.fixture(scope="module")
def table(spark):
    """Rows of two kinds of weight, zeros, few values, a constant, repeated ids; more than MLlib's sample."""
    rng = np.random.default_rng(3)
    n = 12_500
    x = np.round(rng.normal(size=(n, 7)), 4)
    x[:, 1] = np.where(rng.random(n) < 0.4, 0, x[:, 1])
    x[:, 4], x[:, 5], x[:, 6] = rng.integers(0, 2, n), rng.integers(-2, 4, n), 5
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * x[:, 5] - 1)))).astype(int)
    rows = [(i - i % 2, int(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "SK_ID_CURR int, TARGET int, " + ", ".join(f"{n} double" for n in NAMES))
    return models.assemble(df, NAMES).repartition(4).localCheckpoint()


def _nodes(spark, model, path):
    model.write().overwrite().save(path)
    found = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    return found, [r[2] for r in spark.read.parquet(f"{path}/treesMetadata").orderBy("_1").collect()]


@pytest.mark.parametrize("strategy", [models.UNWEIGHTED, models.WEIGHTED])
@pytest.mark.parametrize("rows_alone", [1_000_000, 0])
def test_trees_are_those_of_mllib(spark, table, tmp_path, monkeypatch, strategy, rows_alone):
    params = {"n_estimators": 12, "num_leaves": 16, "learning_rate": 0.3, "min_child_samples": 30}
    monkeypatch.setattr(boosting, "LOCAL_ROWS", rows_alone)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 1000)
    monkeypatch.setattr(boosting, "CUT_ROUNDS", 3)
    mine = models.train_boosted(table, params, strategy)
    monkeypatch.setattr(boosting.HistogramBoosting, "_fit", GBTClassifier._fit)
    theirs = models.train_boosted(table, params, strategy)
    assert 1 < mine.getNumTrees == theirs.getNumTrees and mine.numFeatures == theirs.numFeatures
    (got, weights), (want, given) = (_nodes(spark, m, str(tmp_path / n)) for m, n in ((mine, "mine"), (theirs, "theirs")))
    assert weights == given and len(got) == len(want)
    for a, b in zip(got, want):
        assert (a.treeID, a.id, a.rawCount, a.leftChild, a.rightChild, a.split) == (
            b.treeID, b.id, b.rawCount, b.leftChild, b.rightChild, b.split)
        np.testing.assert_allclose([a.prediction, a.impurity, a.gain, *a.impurityStats],
                                   [b.prediction, b.impurity, b.gain, *b.impurityStats], rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)
    both = [models.positive_probability(m.transform(table)).orderBy("SK_ID_CURR", "features").select("probability_1").toArrow()
            for m in (mine, theirs)]
    np.testing.assert_allclose(*(t.column(0).to_numpy() for t in both), atol=1e-12)
    known = {p.name: v for p, v in theirs.extractParamMap().items()}
    assert {p.name: v for p, v in mine.extractParamMap().items()} == known


def test_rounds_of_a_small_fit_are_no_jobs(spark, table):
    """MLlib runs a job for each level of each tree; here one task grows all trees."""
    def jobs(rounds):
        group = f"rounds-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        models.train_boosted(table, {"n_estimators": rounds, "num_leaves": 8}, watched=0)
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(9) < 20


def test_equal_splits_are_the_first_and_leaves_that_agree_are_one(spark):
    """Whatever lies in which task: two columns that say the same, and rows that no split tells apart."""
    rows = [(i, int(i % 8 < 3), float(i % 8), float(i % 8) * 7, 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "SK_ID_CURR int, TARGET int, a double, b double, c double")
    model = models.train_boosted(models.assemble(df, ["a", "b", "c"]).repartition(3), {"n_estimators": 3, "num_leaves": 8}, watched=0)
    assert model.featureImportances.toArray()[0] == pytest.approx(1) and model.trees[0].depth == 1
    flat = models.train_boosted(models.assemble(df, ["c"]), {"n_estimators": 2, "num_leaves": 8}, watched=0)
    assert [t.numNodes for t in flat.trees] == [1, 1]


def test_odd_rows_are_refused_as_mllib_refuses_them(spark, table):
    for bad in (F.lit(None).cast("int"), F.lit(2)):
        with pytest.raises(Exception):  # noqa: B017 - MLlib's own errors
            models.train_boosted(table.withColumn("TARGET", F.when(F.col("SK_ID_CURR") == 4, bad).otherwise(F.col("TARGET"))),
                                 {"n_estimators": 2, "num_leaves": 4})
