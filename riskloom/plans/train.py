"""Training end to end: baseline, imbalance strategy, cross-validation, search, final model, records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from riskloom import domain as d
from riskloom.operators import metrics as curves
from riskloom.operators import models
from riskloom.operators.correlation import importance_table
from riskloom.sources.registry import ModelRegistry
from riskloom.sources.tables import read_train_test, scratch, settle, write_table


def run(
    spark: SparkSession, data_dir: str, registry: ModelRegistry, base: Mapping[str, float] = models.BASE_PARAMS,
    space: Mapping[str, Sequence] = d.SEARCH_SPACE, draws: int = d.SEARCH_DRAWS, k: int = d.CV_FOLDS,
    parallelism: int = 2, results: str | None = None,
) -> dict:
    """Records of the whole run. `results` keeps the scores of finished folds, so a run started again goes on with them."""
    with scratch(spark):
        return _run(spark, data_dir, registry, base, space, draws, k, parallelism, results)


def _run(
    spark: SparkSession, data_dir: str, registry: ModelRegistry, base: Mapping[str, float],
    space: Mapping[str, Sequence], draws: int, k: int, parallelism: int, results: str | None,
) -> dict:
    train, test, warnings = read_train_test(spark, data_dir, d.LABEL)
    features = [c for c in train.columns if c not in (d.ID, d.LABEL)]
    # every fit below scans the folds again, so they are written once
    folded = settle(models.with_folds(models.assemble(train, features), k), "folds")
    labelled = d.LABEL in test.columns
    judge = models.assemble(test, features) if labelled else folded.drop("_fold")

    def metrics(model) -> dict:
        return models.evaluate(model, judge).first().asDict()

    baseline = metrics(models.train_baseline(folded))
    strategy, comparison = models.compare_strategies(folded, base)
    cv = models.cv_summary(models.cross_validate(
        folded, base, strategy, k, parallelism=parallelism, results=results)).first()
    best, tried = models.random_search(
        folded, models.draw_params(space, draws), strategy, k, parallelism, results)
    tried = tried.collect()  # a row for each draw
    final = models.train_boosted(folded, best, strategy)
    registry.save_model(final)
    importance = importance_table(models.feature_importance(spark, final, models.vector_names(folded)), 30)
    scored = settle(models.positive_probability(final.transform(judge)).select(d.LABEL, "probability_1"), "scored")
    for name, table in {
        "roc_curve": curves.roc_curve(scored, "probability_1", d.LABEL),
        "pr_curve": curves.pr_curve(scored, "probability_1", d.LABEL),
        "confusion_matrix": curves.confusion_matrix(scored, "probability_1", d.LABEL),
        "feature_importance": importance,
    }.items():
        write_table(table, f"{data_dir}/evaluation/{name}")
    result = {
        "baseline": baseline, "final": metrics(final), "cross_validation": cv.asDict(),
        "imbalance_comparison": {r.strategy: r.roc_auc for r in comparison.collect()} | {"selected": strategy},
        "hyperparameter_search": {
            "best_params": best, "best_cv_roc_auc": max(t.mean_roc_auc for t in tried), "draws": len(tried),
        },
        "warnings": warnings,
    }
    registry.save_json("model_metadata", {
        "model_type": type(final).__name__, "training_strategy": strategy, "best_hyperparameters": best,
        "training_feature_names": features, "n_features": len(features), "train_rows": folded.count(),
        "target_column": d.LABEL, "feature_importance": [r.asDict() for r in importance.collect()],
    })
    registry.save_json("training_metrics", result)
    return result
