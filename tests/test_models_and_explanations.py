from itertools import combinations
from math import factorial
from threading import Barrier

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import explanations, models, scoring, shapley
from riskloom.plans import explain, preprocess, train
from riskloom.plans.eda import run as run_eda
from riskloom.sources.binding import application, bureau
from riskloom.sources.registry import ModelRegistry

K = 4
NAMES = [f"f_{i}" for i in range(K)]


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(42)
    x = np.round(rng.normal(size=(300, K)), 3)
    y = (x[:, 0] + x[:, 1] + 0.3 * x[:, 2] > 0).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "SK_ID_CURR int, TARGET int, " + ", ".join(f"{n} double" for n in NAMES))
    return df, x, y


@pytest.fixture(scope="module")
def fitted(spark, toy, tmp_path_factory):
    df, x, _ = toy
    rows = models.assemble(df, NAMES)
    model = models.train_boosted(rows, {"n_estimators": 5, "num_leaves": 8, "min_child_samples": 5, "learning_rate": 0.3}, watched=0)
    registry = ModelRegistry(spark, str(tmp_path_factory.mktemp("registry")))
    registry.save_model(model)
    leaves = shapley.read_leaves(spark, registry.model_path)
    return rows, model, registry, leaves, shapley.background_rows(df, NAMES, 25)


def test_id_and_label_cannot_be_features(toy):
    with pytest.raises(ValueError, match="must not be features"):
        models.assemble(toy[0], [*NAMES, "TARGET"])


def test_leaves_rebuild_the_model(spark, fitted, toy):
    rows, model, _, leaves, background = fitted
    got = {r.SK_ID_CURR: r.probability_1 for r in models.positive_probability(model.transform(rows)).collect()}
    e = shapley.Explainer(leaves, background)
    margins = e._margins([g.codes(toy[1]) for g in e.groups], 300)
    np.testing.assert_allclose(shapley._logistic(margins), [got[i] for i in range(300)], atol=1e-12)


def brute_values(leaves, x, background):
    """Shapley values straight from the definition, over all feature subsets, pair by pair."""

    def margin(v):
        return sum(l.value for l in leaves if all(l.low[j] < v[f] <= l.high[j] for j, f in enumerate(l.features)))

    def p(m):
        return 1 / (1 + np.exp(-m))

    out = np.zeros(K)
    for z in background:
        mx, mz = margin(x), margin(z)
        if mx == mz:
            continue
        scale = (p(mx) - p(mz)) / (mx - mz)
        for i in range(K):
            others = [f for f in range(K) if f != i]
            for size in range(K):
                for s in combinations(others, size):
                    a = np.where(np.isin(np.arange(K), s), x, z)
                    b = a.copy()
                    b[i] = x[i]
                    out[i] += scale * factorial(size) * factorial(K - size - 1) / factorial(K) * (margin(b) - margin(a))
    return out / len(background)


def test_values_equal_brute_force_and_add_up(spark, fitted, toy):
    rows, model, _, leaves, background = fitted
    scored = models.positive_probability(model.transform(rows)).select("SK_ID_CURR", "probability_1", "features")
    got = shapley.shapley_values(scored, leaves, background).orderBy("SK_ID_CURR").collect()
    assert len(got) == 300
    for r in got:
        assert r.expected_value + sum(r.shap_values) == pytest.approx(r.probability_1, abs=1e-12)
    for r in got[:12]:
        np.testing.assert_allclose(r.shap_values, brute_values(leaves, toy[1][r.SK_ID_CURR], background), atol=1e-12)
    importance = np.abs(np.array([r.shap_values for r in got])).mean(axis=0)
    assert importance[:2].min() > importance[2:].max()


def test_many_leaves_in_small_blocks(monkeypatch):
    r = np.random.default_rng(2)
    leaves = []
    for _ in range(300):
        f = np.sort(r.choice(K, r.integers(0, K + 1), replace=False))
        low = np.where(r.random(len(f)) < 0.5, -np.inf, r.choice([-0.5, 0.0], len(f)))
        leaves.append(shapley.Leaf(f, low, np.where(np.isinf(low), 0.3, np.inf), float(r.normal())))
    x, background = r.normal(size=(6, K)), r.normal(size=(9, K))
    whole = shapley.Explainer(leaves, background)
    assert sum(len(g.values) for g in whole.groups) < 300  # equal paths are one
    got = whole.values(x)
    for i in range(6):
        np.testing.assert_allclose(got[i], brute_values(leaves, x[i], background), atol=1e-12)
    monkeypatch.setattr(shapley, "LEAVES", 7)
    monkeypatch.setattr(shapley, "CODES", 1)
    np.testing.assert_allclose(shapley.Explainer(leaves, background).values(x), got, atol=1e-12)
    assert shapley.Explainer(leaves, background).block == 32


def test_scales_of_many_rows_are_few_factors_and_exact(toy):
    r = np.random.default_rng(3)
    leaves = [shapley.Leaf(np.array([f]), np.array([c]), np.array([np.inf]), float(r.normal() / 8))
              for f in range(K) for c in r.normal(size=12)]
    e = shapley.Explainer(leaves, r.normal(size=(200, K)))
    m = np.concatenate([e.margins[:50], e.margins[:50] + 3e-8, e._margins([g.codes(toy[1]) for g in e.groups], 300)])
    left, right = e._factors(m)
    assert left.shape[1] < 20  # the work for a row no longer grows with the background
    p, q = 1 / (1 + np.exp(-m))[:, None], 1 / (1 + np.exp(-e.margins))
    gap = m[:, None] - e.margins
    far = np.abs(gap) > 0.1
    np.testing.assert_allclose((left @ right * 200)[far], ((p - q) / np.where(far, gap, 1))[far], atol=1e-13)
    # a quotient of differences has eight right digits at a gap of 3e-8; the slope midway has sixteen
    middle = 1 / (1 + np.exp(-(m[50:100] + e.margins[:50]) / 2))
    np.testing.assert_allclose(np.diag(left[50:100] @ right[:, :50]) * 200, middle * (1 - middle), atol=1e-13)


def test_background_is_bounded_filled_and_not_empty(spark, toy):
    df = toy[0].withColumn("f_0", F.lit(None).cast("double"))
    b = shapley.background_rows(df, NAMES, 50)
    assert b.shape == (50, K) and (b[:, 0] == 0).all()
    with pytest.raises(ValueError, match="empty"):
        shapley.Explainer([], np.zeros((0, K)))


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame(
        [(1, 0.82, [0.3, -0.2, 0.0, 0.1], [1.0, 2.0, 3.0, 4.0], 0.62), (2, 0.1, [0.0, 0.0, 0.0, 0.0], [1.0] * 4, 0.1)],
        "SK_ID_CURR int, probability_1 double, shap_values array<double>, feature_values array<double>, expected_value double",
    )


def test_local_drivers(given):
    a, b = explanations.local_explanation(given, NAMES, 1).orderBy("SK_ID_CURR").collect()
    assert a.predicted_probability == pytest.approx(0.82) and [x.feature for x in a.positive_drivers] == ["f_0"]
    assert [x.impact for x in a.negative_drivers] == [-0.2] and b.positive_drivers == []
    both = explanations.local_explanation(given, NAMES).first()
    assert [x.feature for x in both.positive_drivers] == ["f_0", "f_3"]


def test_contributions(given):
    got = {(r.SK_ID_CURR, r.feature): r for r in explanations.contribution_table(given, NAMES).collect()}
    assert (got[1, "f_0"].impact_direction, got[1, "f_0"].impact_strength) == ("Increases Risk", "Strong")
    assert (got[1, "f_1"].impact_direction, got[1, "f_3"].impact_strength) == ("Decreases Risk", "Moderate")
    assert (got[2, "f_0"].impact_direction, got[2, "f_0"].impact_strength) == ("Neutral", "Weak")


def test_global_importance(given):
    rows = explanations.global_importance(given, NAMES).orderBy("rank").collect()
    assert [(r.rank, r.feature, r.importance) for r in rows] == [(1, "f_0", 0.15), (2, "f_1", 0.1), (3, "f_3", 0.05), (4, "f_2", 0.0)]
    assert rows[-1].cumulative_pct == 100.0 and explanations.global_importance(given, NAMES, 2).count() == 2


def test_explanation_rows(given):
    a = explanations.explain_scores(given, NAMES, with_values=True).orderBy("SK_ID_CURR").first()
    assert (a.default_probability, a.risk_score, a.risk_band) == (0.82, 820, "High Risk")
    assert a.positive_risk_drivers[0].asDict() == {"feature": "f_0", "impact": 0.3, "feature_value": 1.0}
    assert "significantly elevated F 0" in a.business_narrative and len(a.shap_values) == 4


def test_draws_are_distinct_and_seeded():
    draws = models.draw_params()
    assert len(draws) == 30 and len({tuple(d.items()) for d in draws}) == 30 and draws == models.draw_params()
    assert len(models.draw_params({"a": [1, 2]}, 30)) == 2


def test_points_that_grow_equal_trees_are_one():
    a = {"num_leaves": 70, "max_depth": -1, "n_estimators": 9}
    assert models.effective(a) == models.effective({**a, "num_leaves": 100}) != models.effective({**a, "num_leaves": 31})
    assert len({models.effective(p) for p in models.draw_params()}) == 30


def test_folds_are_fitted_once_and_a_run_goes_on_where_it_ended(spark, toy, tmp_path):
    folded = models.with_folds(models.assemble(toy[0], NAMES), 3)
    fitted = []

    def score(rows, params, strategy, fold):
        if fail and fold == 2:
            raise RuntimeError("lost")
        fitted.append((params["num_leaves"], fold))
        noise = F.lit(params["num_leaves"]) * F.col("SK_ID_CURR") % 7 / 100
        return rows.where(F.col("_fold") == fold).select("TARGET", (F.col("TARGET") * 0.05 + noise).alias("probability_1"))

    points = [{"num_leaves": 8}, {"num_leaves": 7}, {"num_leaves": 20}]  # the first two grow equal trees
    fail = True
    with pytest.raises(RuntimeError):
        models.fold_scores(folded, points, k=3, parallelism=1, results=str(tmp_path), score=score)
    assert (8, 2) not in fitted and (8, 0) in fitted
    fail = False
    best, table = models.random_search(folded, points, k=3, results=str(tmp_path), score=score)
    assert sorted(fitted) == [(8, 0), (8, 1), (8, 2), (20, 0), (20, 1), (20, 2)]
    rows = {r.draw: r for r in table.collect()}
    assert rows[0].mean_roc_auc == rows[1].mean_roc_auc and rows[2].n_folds == 3 and not rows[1].selected
    assert best == points[next(i for i in rows if rows[i].selected)]


def test_watched_rows_stop_a_fit(spark, toy):
    rows = models.assemble(toy[0], NAMES)
    params = {"n_estimators": 60, "num_leaves": 4, "learning_rate": 0.5, "min_child_samples": 5}
    stopped = models.train_boosted(rows, params)
    assert stopped.getNumTrees < 60 and spark.sparkContext.getCheckpointDir()
    assert models.train_boosted(rows, {**params, "n_estimators": 6}, watched=0).getNumTrees == 6


def test_fits_scan_equal_parts(spark, toy, monkeypatch):
    """A table that lies in one file is dealt out before the fit, repeated and missing ids included."""
    rows = models.assemble(toy[0].withColumn("SK_ID_CURR", F.expr("CASE WHEN SK_ID_CURR > 9 THEN 3 END")), NAMES).coalesce(1)
    parts = []

    def fit(self, given):
        parts.append([len(p) for p in given.rdd.glom().collect()])

    monkeypatch.setattr(models.GBTClassifier, "fit", fit)
    models.train_boosted(rows, {"n_estimators": 2, "num_leaves": 4})
    assert parts == [[300]]  # too few to be worth it
    monkeypatch.setattr(models, "DEAL_ROWS", 100)
    models.train_boosted(rows, {"n_estimators": 2, "num_leaves": 4})
    assert sum(parts[1]) == 300 and len(parts[1]) >= spark.sparkContext.defaultParallelism
    assert max(parts[1]) - min(parts[1]) <= 1
    models.train_boosted(rows.where("false"), {"n_estimators": 2, "num_leaves": 4})
    assert sum(parts[2]) == 0


def test_both_arms_are_fitted_side_by_side(spark, toy, monkeypatch):
    both, plain = Barrier(2, timeout=60), models.train_boosted

    def fit(*args):
        both.wait()
        return plain(*args)

    monkeypatch.setattr(models, "train_boosted", fit)
    winner, table = models.compare_strategies(
        models.assemble(toy[0], NAMES), {"n_estimators": 2, "num_leaves": 4, "min_child_samples": 5})
    rows = {r.strategy: r for r in table.collect()}
    assert set(rows) == {models.WEIGHTED, models.UNWEIGHTED} and [s for s in rows if rows[s].selected] == [winner]


def test_parameter_mapping():
    g = models.boosted_trees({"n_estimators": 7, "num_leaves": 31, "max_depth": -1, "colsample_bytree": 0.8, "min_child_samples": 9})
    assert (g.getMaxIter(), g.getMaxDepth(), g.getFeatureSubsetStrategy(), g.getMinInstancesPerNode()) == (7, 5, "0.8", 9)
    assert models.boosted_trees({"num_leaves": 150, "max_depth": 5}).getMaxDepth() == 5


def test_weight_of_the_positive_class(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)] * 3, "TARGET int")
    assert models.scale_pos_weight(df).first().scale_pos_weight == 3.0
    assert models.scale_pos_weight(df.where("TARGET = 0")).first().scale_pos_weight == 9.0
    with pytest.raises(ValueError, match="strategy"):
        models.train_boosted(df, {}, "smote")


def test_everything_end_to_end(spark, sf_dir, tmp_path):
    """Raw rows -> saved stages -> training -> saved model -> scores and explanations of raw rows."""
    app = application(spark, sf_dir)
    registry = ModelRegistry(spark, f"{tmp_path}/models")
    preprocess.run(app, f"{tmp_path}/data", registry)
    meta = registry.load_json("feature_metadata")
    assert meta["split"]["train_rows"] + meta["split"]["test_rows"] == app.count()
    assert "MOSTLY_NULL" in [c["column"] for c in meta["feature_selection_report"]["dropped_high_missing"]]

    small = {"n_estimators": 3, "num_leaves": 8, "learning_rate": 0.2}
    result = train.run(
        spark, f"{tmp_path}/data", registry, base=small, draws=2, k=2,
        space={"n_estimators": [2, 3], "num_leaves": [8], "learning_rate": [0.2]},
    )
    assert result["final"]["roc_auc"] > 0.6 and result["baseline"]["roc_auc"] > 0.6
    assert result["cross_validation"]["n_folds"] == 2 and result["hyperparameter_search"]["draws"] == 2
    assert registry.load_json("training_metrics")["imbalance_comparison"]["selected"] in ("unweighted", "scale_pos_weight")
    assert "SK_ID_CURR" not in registry.load_json("model_metadata")["training_feature_names"]

    saved = explain.SavedModel(registry, spark.read.parquet(f"{tmp_path}/data/train"), 40)
    raw = app.drop("TARGET", "AMT_ANNUITY").withColumn("EXTRA", F.lit(1))  # one column lacking, one too many
    scores = saved.score(raw)
    assert scores.columns == ["SK_ID_CURR", "default_probability", "risk_score", "risk_band"]
    assert scores.count() == app.count() and scores.where("risk_score != int(default_probability * 1000 + 0.0005)").count() <= 1
    one = saved.score(raw.limit(1)).first()
    assert 0 <= one.default_probability <= 1
    paths = saved.write_reports(raw.where("SK_ID_CURR < 200"), f"{tmp_path}/out")
    assert spark.read.parquet(paths["explanations"]).where("business_narrative is null").count() == 0
    assert spark.read.option("header", True).csv(paths["importance"]).count() == len(saved.features)
    with pytest.raises(scoring.SchemaValidationError, match="missing after preprocessing"):
        scoring.prepared(raw, saved.pipeline, saved.schema, ["nope"])


def test_eda_writes_every_table(spark, sf_dir, tmp_path):
    paths = run_eda(application(spark, sf_dir), bureau(spark, sf_dir), str(tmp_path), sample=300)
    assert {"numeric_summary", "target_correlations", "correlation_matrix", "insights", "age_rates", "credit_sample",
            "kind_counts", "insight_severities"} <= set(paths)
    assert spark.read.json(paths["insights"]).count() == 9
    assert spark.read.json(paths["dimensions"]).first().rows == 300
