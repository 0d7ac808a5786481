"""Every operator as a named query over the test tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import domain as d
from riskloom.functions import expressions as X
from riskloom.functions.columns import col
from riskloom.functions.text import feature_label
from riskloom.operators import (
    correlation, dictionary, distribution, explanations, extras, features, insights, metrics, models, profile, quality, sampling,
    scoring, shapley, sketches,
)
from riskloom.plans import eda, preprocess
from riskloom.sources import tables
from riskloom.sources.binding import application, bureau
from riskloom.sources.registry import ModelRegistry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}



def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _on_application(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: f(application(spark, sf))


# ---- sources ---------------------------------------------------------------------------------

@query
def src_scan(spark, sf):
    return application(spark, sf)


@query
def profile_sketch(spark, sf):
    """Every column's profile from sketches kept by partition, the last partition added later, and how close it is."""
    app = application(spark, sf)
    names = app.columns
    parts = app.withColumn("_part", (col(d.ID) % 6).cast("string"))
    root = tables.work_path(spark, "sketches")
    sketches.refresh(parts.where("_part <> '5'"), "_part", root)
    if sorted(sketches.refresh(parts, "_part", root)) != ["p0", "p1", "p2", "p3", "p4"]:
        raise RuntimeError("the first five partitions are kept")
    found = sketches.merged(spark, root)
    close = sketches.accuracy(app, found, names)
    return found.select("column", "n", "missing_count").join(close, "column")


@query
def csv_scan(spark, sf):
    """The applications written as CSV and read back with inferred types."""
    app = application(spark, sf)
    path = tables.write_table(app, tables.work_path(spark, "applications"), "csv")
    back = tables.read_table(spark, path)
    return back.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in app.schema])


@query
def csv_types(spark, sf):
    """The types that are inferred from the applications written as CSV."""
    path = tables.write_table(application(spark, sf), tables.work_path(spark, "applications"), "csv")
    found = [(f.name, f.dataType.simpleString()) for f in tables.read_table(spark, path).schema]
    return spark.createDataFrame(found, "column string, type string")


@query
def src_catalog_counts(spark, sf):
    listed = [tables.Dataset(n, f"{n}.parquet", n == "orders") for n in ("orders", "customer", "lineitem", "absent")]
    loaded = tables.load_datasets(spark, sf, tuple(listed), "parquet")
    counts = [df.agg(F.lit(n).alias("dataset"), F.count("*").alias("row_count")) for n, df in loaded.items()]
    return reduce(DataFrame.unionByName, counts)


@query
def narrow_types(spark, sf):
    out = tables.type_summary(tables.narrow_types(application(spark, sf)))
    return out.select("column", "type", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"))


@query
def saved_split(spark, sf):
    """Processed train and test, written, read back and summarised."""
    p = _prepared(spark, sf)
    root = tables.work_path(spark, "processed")
    tables.write_train_test(p.train, p.test, root)
    train, test, _ = tables.read_train_test(spark, root, d.LABEL)
    sides = [("train", train), ("test", test)]
    return reduce(DataFrame.unionByName, [
        df.agg(
            F.lit(name).alias("side"), F.count("*").alias("row_count"), F.lit(len(df.columns) - 2).alias("features"),
            F.round(F.avg(d.LABEL) * 100, 4).alias("default_rate_pct"),
        )
        for name, df in sides
    ])


@query
def saved_profile(spark, sf):
    path = eda.write_json(profile.missing_values(application(spark, sf)), tables.work_path(spark, "profile"))
    return spark.read.schema("column string, missing_count long, missing_pct double").json(path)


# ---- projections, filters, checks ------------------------------------------------------------

_on_application("safe_ratio", lambda a: a.select(
    d.ID, F.round(X.safe_ratio(col("AMT_CREDIT"), col("AMT_INCOME_TOTAL")), 6).alias("ratio")
))
_on_application("feature_engineering", lambda a: features.RatioFeatures().fit(a).transform(a).select(
    d.ID, *[F.round(c, 6).alias(c) for c in features.RATIO_SOURCES]
))
_on_application("age_tenure_years", lambda a: a.select(
    d.ID,
    F.round(X.age_years(col("DAYS_BIRTH")), 6).alias("age"), X.age_years(col("DAYS_BIRTH"), 1).alias("age_1dp"),
    F.round(X.tenure_years(col("DAYS_EMPLOYED")), 6).alias("tenure"),
    X.tenure_years(col("DAYS_EMPLOYED"), 1).alias("tenure_1dp"),
))
_on_application("clip_quantile", lambda a: distribution.clip_upper(
    a.select(d.ID, X.tenure_years(col("DAYS_EMPLOYED"), 1).alias("tenure")), "tenure", d.TENURE_CLIP_QUANTILE
))
_on_application("filter_quantile_cap", lambda a: distribution.keep_below_quantile(
    a.select(d.ID, "AMT_INCOME_TOTAL"), "AMT_INCOME_TOTAL"
))
_on_application("bin_age", lambda a: a.select(
    d.ID, X.age_bin(X.age_years(col("DAYS_BIRTH"))).alias("age_bin"),
    X.age_bin(X.age_years(col("DAYS_BIRTH"), 1)).alias("age_bin_1dp"),
))
_on_application("bin_tenure", lambda a: a.select(
    d.ID, X.tenure_band(X.tenure_years(col("DAYS_EMPLOYED"), 1)).alias("tenure_band")
))
_on_application("validate_load", quality.label_checks)
_on_application("validate_train", quality.validation_report)


@query
def align_schema(spark, sf):
    """Input that lacks two columns and has one too many, shaped like the training input."""
    app = application(spark, sf)
    given = app.drop("AMT_ANNUITY", "CODE_GENDER", d.LABEL).withColumn("EXTRA", F.lit(1))
    return quality.align_to_schema(given, features.raw_schema(app))


# ---- profile ---------------------------------------------------------------------------------

_on_application("profile_dimensions", profile.dimensions)
_on_application("profile_column_types", profile.column_types)
_on_application("profile_kind_counts", lambda a: profile.kind_counts(profile.column_types(a)))
_on_application("profile_missing", profile.missing_values)
_on_application("profile_duplicates", profile.duplicates)
_on_application("profile_duplicates_subset", lambda a: profile.duplicates(
    a, ["DAYS_BIRTH", "CODE_GENDER", "NAME_INCOME_TYPE"]
))
_on_application("profile_target", profile.target_distribution)
_on_application("profile_numeric", profile.numeric_summary)
_on_application("profile_categorical", profile.categorical_summary)
_on_application("profile_feature_categories", profile.feature_categories)
_on_application("target_correlation_filled", correlation.target_correlation)
_on_application("correlation_matrix", correlation.correlation_matrix)
_on_application("hist_income", lambda a: distribution.class_histogram(distribution.capped_income(a), 70))
_on_application("box_income", lambda a: distribution.class_box(distribution.capped_income(a)))
_on_application("hist_credit", lambda a: distribution.class_histogram(distribution.credit_values(a), 70))
_on_application("hist_age", lambda a: distribution.class_histogram(distribution.ages(a), 40))
_on_application("hist_tenure", lambda a: distribution.class_histogram(distribution.clipped_tenure(a), 50))
_on_application("rate_by_age_bin", distribution.rate_by_age)
_on_application("rate_by_tenure", distribution.rate_by_tenure)


# ---- insights --------------------------------------------------------------------------------

def _insight(key: str, name: str) -> None:
    _on_application(key, lambda a: insights.insight(a, name).drop("recommendation"))


for _key, _name in {
    "insight_imbalance": "class_imbalance", "insight_income": "income_patterns",
    "insight_age": "age_patterns",
    "insight_employment": "employment_patterns", "insight_external_scores": "external_scores",
    "insight_missing": "missing_values", "insight_document_flags": "document_flags",
}.items():
    _insight(_key, _name)


@query
def insight_credit(spark, sf):
    """The means are sums of doubles, whose last digits depend on the order of adding."""
    found = insights.insight(application(spark, sf), "credit_patterns").drop("recommendation")
    means = ("mean_credit_default", "mean_credit_non_default")
    return found.withColumns({c: F.round(c, 6) for c in means})


@query
def insight_bureau(spark, sf):
    return insights.bureau_overview(bureau(spark, sf)).drop("recommendation")


@query
def insights_all(spark, sf):
    return insights.all_insights(application(spark, sf), bureau(spark, sf)).drop("recommendation")


@query
def insight_severity_counts(spark, sf):
    return insights.severity_counts(insights.all_insights(application(spark, sf), bureau(spark, sf)))


# ---- splits and samples ----------------------------------------------------------------------

_on_application("split_stratified", lambda a: sampling.split_flag(a.select(d.ID, d.LABEL)))
_on_application("split_report", lambda a: sampling.split_report(sampling.split_flag(a.select(d.ID, d.LABEL))))
_on_application("stratified_folds", lambda a: sampling.stratified_folds(a.select(d.ID, d.LABEL)))
_on_application("sample_n", lambda a: sampling.sample_rows(a, 500).select(d.ID, d.LABEL, "AMT_CREDIT"))
_on_application("sample_credit", lambda a: sampling.sample_rows(
    distribution.credit_rows(a).select(d.ID, d.LABEL, "AMT_CREDIT", "AMT_ANNUITY"), 5000
))


# ---- feature stages --------------------------------------------------------------------------

def _train_part(a: DataFrame) -> DataFrame:
    return sampling.stratified_split(a)[0]


_on_application("feature_selection", lambda a: features.selection_report(
    features.RatioFeatures().fit(a).transform(_train_part(a))
))


def _filled(a: DataFrame, names: list[str]) -> DataFrame:
    rows = a.select(d.ID, d.LABEL, *names)
    return features.MissingFiller().fit(_train_part(rows)).transform(rows).drop(d.LABEL)


_on_application("impute_numeric", lambda a: _filled(a, ["AMT_ANNUITY", "EXT_SOURCE_1", "EXT_SOURCE_3"]))
_on_application("impute_categorical", lambda a: _filled(a, ["CODE_GENDER", "NAME_CONTRACT_TYPE"]))


@query
def imputation_stats(spark, sf):
    return features.MissingFiller().fit(_train_part(application(spark, sf))).stats(spark)


def _encoded(a: DataFrame, names: list[str]) -> DataFrame:
    rows = a.select(d.ID, d.LABEL, *names)
    return features.CategoryEncoder().fit(_train_part(rows)).transform(rows).drop(d.LABEL)


_on_application("encode_label", lambda a: _encoded(a, ["CODE_GENDER", "FLAG_OWN_CAR"]))
_on_application("encode_onehot", lambda a: _encoded(a, ["NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE"]))


@query
def typed_features(spark, sf):
    """Booleans and dates as features: made plain, then filled."""
    k = col(d.ID)
    rows = application(spark, sf).select(
        d.ID, d.LABEL, F.when(k % 7 != 0, col("FLAG_OWN_CAR") == "Y").alias("OWNS_CAR"),
        F.when(k % 11 != 0, F.date_add(F.lit("2020-01-01"), (k % 1000).cast("int"))).alias("APPLIED"))
    plain = features.PlainTypes().transform(rows)
    return features.MissingFiller().fit(plain).transform(plain).drop(d.LABEL)


@query
def bureau_features(spark, sf):
    joined = extras.with_bureau(application(spark, sf).select(d.ID, d.LABEL), bureau(spark, sf))
    return joined.withColumn("bureau_credit_sum", F.round("bureau_credit_sum", 2))


_on_application("extra_features", lambda a: extras.extra_features(a).select(
    d.ID, F.round("credit_term", 6).alias("credit_term"), F.round("ext_source_mean", 6).alias("ext_source_mean"),
    "document_count",
))
FLAGGED = ["EXT_SOURCE_1", "AMT_ANNUITY", "CODE_GENDER"]
_on_application("missing_flags", lambda a: extras.missing_flags(a, FLAGGED).select(
    d.ID, *[f"{c}_missing" for c in FLAGGED], F.round("income_capped", 6).alias("income_capped")
))

_memo: dict[tuple, object] = {}


def _once(kind: str, spark: SparkSession, sf: str, make: Callable[[], object]):
    """Fitted stages and models are made once per session and shared by the queries that need them."""
    key = (kind, spark.sparkContext.applicationId, sf)
    if key not in _memo:
        _memo[key] = make()
    return _memo[key]


def _prepared(spark, sf) -> preprocess.Prepared:
    return _once("prepared", spark, sf, lambda: preprocess.prepare(application(spark, sf)))


def _ratios_rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in features.RATIO_SOURCES})


@query
def preprocess_train(spark, sf):
    return _ratios_rounded(preprocess.prepare(application(spark, sf)).train)


@query
def registry_pipeline(spark, sf):
    """Test rows through fitted stages that were saved twice and loaded from the newest version."""
    registry = ModelRegistry(spark, tables.work_path(spark, "registry"))
    p = _prepared(spark, sf)
    registry.save_pipeline(p.pipeline)
    registry.save_pipeline(registry.load_pipeline())
    if registry.versions("preprocessing") != [1, 2]:
        raise RuntimeError("two saves make two versions")
    return _ratios_rounded(registry.load_pipeline().transform(p.parts.where("is_test").drop("is_test")))


@query
def preprocess_test(spark, sf):
    return _ratios_rounded(_prepared(spark, sf).test)


def _wide(a: DataFrame) -> DataFrame:
    """Applications with a text column of thousands of values, one of which a third of all rows share."""
    k = col(d.ID)
    branch = F.when(k % 3 == 0, F.lit("branch 1")).otherwise(F.concat(F.lit("branch "), ((k * 7919) % 5003).cast("string")))
    return a.select(d.ID, d.LABEL, col("AMT_CREDIT"), branch.alias("BRANCH"), (k % 10 < 8).alias("_fit"))


@query
def encode_wide(spark, sf):
    """Sums of the sparse vectors of a column with over 1,000 values, fitted to four fifths of the rows: how many rows
    have each value, by its number, and how many have a value the fit has not seen."""
    rows = _wide(application(spark, sf))
    model = features.CategoryEncoder(max_categories=100).fit(rows.where("_fit").drop("_fit"))
    encoded = model.transform(rows.drop("_fit"))
    sums = encoded.agg(Summarizer.sum(F.col("BRANCH_values")).alias("v"), F.count("*").alias("n"))
    seen = sums.select(F.posexplode(vector_to_array("v")).alias("number", "n_rows"))
    unseen = sums.select(F.lit(-1).alias("number"), (F.col("n") - F.aggregate(
        vector_to_array("v"), F.lit(0.0), lambda x, y: x + y)).alias("n_rows"))
    names = dictionary.value_names(spark.read.parquet(model.learnt["dictionary"]), "BRANCH")
    return seen.unionByName(unseen).join(names, "number", "left").select(
        "number", F.col("n_rows").cast("long").alias("n_rows"), F.coalesce("name", F.lit("unseen")).alias("name"))


# ---- metrics on a given score ----------------------------------------------------------------

def _scored(a: DataFrame) -> DataFrame:
    return a.select(d.ID, d.LABEL, (F.lit(1.0) - col("EXT_SOURCE_2")).alias("p"))


_on_application("risk_scoring", lambda a: scoring.risk_columns(_scored(a), F.col("p"), [d.ID]))
_on_application("risk_band_counts", lambda a: scoring.band_counts(scoring.risk_columns(_scored(a), F.col("p"), [])))
_on_application("scale_pos_weight", models.scale_pos_weight)
_on_application("classification_metrics", lambda a: metrics.classification_metrics(_scored(a), "p", d.LABEL))
_on_application("roc_auc", lambda a: metrics.roc_auc(_scored(a), "p", d.LABEL))
_on_application("roc_curve", lambda a: metrics.roc_curve(_scored(a), "p", d.LABEL))
_on_application("pr_curve", lambda a: metrics.pr_curve(_scored(a), "p", d.LABEL))
_on_application("average_precision", lambda a: metrics.average_precision(_scored(a), "p", d.LABEL))
_on_application("rank_statistics", lambda a: extras.rank_statistics(_scored(a), "p"))
_on_application("confusion_matrix", lambda a: metrics.confusion_matrix(_scored(a), "p", d.LABEL))


# ---- explanations of given contributions -----------------------------------------------------

GIVEN = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "DAYS_EMPLOYED", "EXT_SOURCE_2", "FLAG_OWN_CAR_le"]


def _given(a: DataFrame) -> DataFrame:
    """Contributions computed from the row itself, standing in for a model's."""
    k = col(d.ID)

    def wave(factor: int) -> Column:
        return ((k * factor) % 101 - 50).cast("double") / 1000

    return a.select(
        d.ID, (F.lit(1.0) - col("EXT_SOURCE_2")).alias("probability_1"),
        F.array(
            col("AMT_CREDIT"), col("AMT_INCOME_TOTAL"), col("DAYS_EMPLOYED").cast("double"), col("EXT_SOURCE_2"),
            F.when(col("FLAG_OWN_CAR") == "Y", 1.0).otherwise(0.0),
        ).alias("feature_values"),
        F.array(*[wave(f) for f in (7, 11, 13, 17, 19)]).alias("shap_values"),
        F.lit(0.1).alias("expected_value"),
    )


_on_application("contribution_table", lambda a: explanations.contribution_table(_given(a), GIVEN))
_on_application("local_drivers", lambda a: explanations.local_explanation(_given(a), GIVEN, 3).select(
    d.ID, F.round("predicted_probability", 6).alias("predicted_probability"),
    F.array_join(F.transform("positive_drivers", lambda x: x["feature"]), ",").alias("positive_features"),
    F.array_join(F.transform("negative_drivers", lambda x: x["feature"]), ",").alias("negative_features"),
))
_on_application("narrative", lambda a: explanations.explain_scores(_given(a), GIVEN).select(
    d.ID, "risk_score", "risk_band", "business_narrative"
))
_on_application("shap_global_given", lambda a: explanations.global_importance(_given(a), GIVEN))
LABEL_SAMPLES = ["AMT_CREDIT", "AMT_CREDIT_SUM_X", "NAME_CONTRACT_TYPE_Cash_loans", "flag_document_3", "f_0",
                 "debt_to_income_ratio", "A__b1c"]


def _named(a: DataFrame) -> DataFrame:
    pool = F.array(*[F.lit(x) for x in LABEL_SAMPLES], F.concat(F.lit("NAME_HOUSING_"), col("NAME_INCOME_TYPE")))
    name = F.get(pool, (col(d.ID) % (len(LABEL_SAMPLES) + 1)).cast("int"))
    return a.select(d.ID, name.alias("feature"))


_on_application("feature_labels", lambda a: _named(a).withColumn("label", feature_label(F.col("feature"))))


INF = float("inf")
# A small ensemble over EXT_SOURCE_2 and AMT_CREDIT: features, lower and upper bounds, value of each leaf.
SMALL_LEAVES = [
    ([0], [-INF], [0.5], 0.7), ([0], [0.5], [INF], -0.4), ([0, 1], [-INF, -INF], [0.3, 100000.0], 0.2),
    ([0, 1], [-INF, 100000.0], [0.3, INF], -0.3), ([0], [0.3], [INF], 0.1),
]
SMALL_BACKGROUND = [(0.2, 50000.0), (0.45, 150000.0), (0.9, 80000.0)]


@query
def shap_exact(spark, sf):
    """Shapley values of every application for a small given ensemble."""
    leaves = [shapley.Leaf(np.array(f), np.array(lo), np.array(hi), v) for f, lo, hi, v in SMALL_LEAVES]
    rows = application(spark, sf).select(d.ID, array_to_vector(F.array("EXT_SOURCE_2", "AMT_CREDIT")).alias("features"))
    out = shapley.shapley_values(rows, leaves, np.array(SMALL_BACKGROUND))
    return out.select(
        d.ID, F.round(F.col("shap_values")[0], 9).alias("value_score"),
        F.round(F.col("shap_values")[1], 9).alias("value_credit"), F.round("expected_value", 9).alias("expected_value"))


# ---- models ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class _Trained:
    model: GBTClassificationModel
    features: list[str]
    leaves: list
    background: object


def _matrix(spark, sf) -> DataFrame:
    """Training rows as vectors with fold numbers, written once: every fit scans them many times."""

    def make() -> DataFrame:
        p = _prepared(spark, sf)
        rows = models.assemble(p.train, features.feature_names(p.pipeline))
        return tables.settle(models.with_folds(rows), "folds")

    return _once("matrix", spark, sf, make)


def _test_matrix(spark, sf) -> DataFrame:
    p = _prepared(spark, sf)
    return models.assemble(p.test, features.feature_names(p.pipeline))


def _trained(spark, sf) -> _Trained:
    def make() -> _Trained:
        p = _prepared(spark, sf)
        registry = ModelRegistry(spark, tables.work_path(spark, "registry"))
        registry.save_model(models.train_boosted(_matrix(spark, sf), models.BASE_PARAMS))
        names = features.feature_names(p.pipeline)
        return _Trained(
            registry.load_model(), names, shapley.read_leaves(spark, registry.model_path),
            shapley.background_rows(p.train, names),
        )

    return _once("trained", spark, sf, make)


def _shap(spark, sf) -> DataFrame:
    def make() -> DataFrame:
        p, t = _prepared(spark, sf), _trained(spark, sf)
        rows = scoring.prepared(application(spark, sf), p.pipeline, p.schema, t.features)
        scored = models.positive_probability(t.model.transform(rows)).select(d.ID, "probability_1", "features")
        return tables.settle(shapley.shapley_values(scored, t.leaves, t.background), "shap")

    return _once("shap", spark, sf, make)


@query
def model_lr(spark, sf):
    return models.evaluate(models.train_baseline(_matrix(spark, sf)), _test_matrix(spark, sf))


@query
def model_lr_gradient(spark, sf):
    """The certificate of the baseline: all components of its objective's gradient are next to nothing."""
    rows = _matrix(spark, sf).drop("_fold")
    gradient = models.logistic_gradient(models.train_baseline(rows), rows)
    return gradient.agg(F.count("*").alias("components"), (F.max(F.abs("gradient")) < 1e-4).alias("all_below"))


@query
def model_gbt_compare(spark, sf):
    return _once("compare", spark, sf, lambda: tables.settle(
        models.compare_strategies(_matrix(spark, sf), models.BASE_PARAMS)[1], "strategies"))


@query
def model_cv(spark, sf):
    return _once("folds-auc", spark, sf, lambda: tables.settle(models.cv_summary(models.cross_validate(
        _matrix(spark, sf), models.BASE_PARAMS, parallelism=models.FOLD_FITS)), "folds-auc"))


def given_fold(folded: DataFrame, params, strategy: str, fold: int) -> DataFrame:
    """A score computed from the row and the parameters, standing in for a fitted model."""
    steps = F.floor((F.lit(1.0) - col("EXT_SOURCE_2")) * F.lit(params["num_leaves"] // 10)) / F.lit(params["num_leaves"] // 10)
    shift = F.lit(params["learning_rate"]) * F.coalesce(col("EXT_SOURCE_3"), F.lit(0.5))
    return folded.where(F.col("_fold") == fold).select(d.LABEL, F.round((steps + shift) / 2, 9).alias("probability_1"))


@query
def model_search(spark, sf):
    """The draws of the whole search space on all folds, and which one is selected, for a given score."""
    folded = tables.settle(models.with_folds(application(spark, sf).select(
        d.ID, d.LABEL, "EXT_SOURCE_2", "EXT_SOURCE_3")), "folds")
    return models.random_search(folded, models.draw_params(), parallelism=4, score=given_fold)[1]


@query
def feature_importance(spark, sf):
    t = _trained(spark, sf)
    return correlation.importance_table(models.feature_importance(spark, t.model, t.features), 30)


@query
def score_batch(spark, sf):
    p, t = _prepared(spark, sf), _trained(spark, sf)
    return scoring.score(application(spark, sf), p.pipeline, t.model, p.schema, features=t.features)


@query
def shap_values(spark, sf):
    return _shap(spark, sf).select(d.ID, "probability_1", "shap_values", "expected_value")


@query
def shap_global(spark, sf):
    return explanations.global_importance(_shap(spark, sf), _trained(spark, sf).features, d.TOP_FEATURES)


@query
def shap_local(spark, sf):
    return explanations.local_explanation(_shap(spark, sf), _trained(spark, sf).features).select(
        d.ID, "predicted_probability", "positive_drivers", "negative_drivers"
    )


@query
def explain_batch(spark, sf):
    return explanations.explain_scores(_shap(spark, sf), _trained(spark, sf).features)


# ---- properties that every right fit has ---------------------------------------------------------

@query
def score_checks(spark, sf):
    """Scores of all applications: every id once, probabilities in range, score and band as the probability says."""
    p = F.col("default_probability")
    scored = score_batch(spark, sf)
    return scored.agg(
        F.count("*").alias("n_rows"), F.sum(d.ID).cast("double").alias("id_sum"), F.count_distinct(d.ID).alias("n_ids"),
        F.count_if(p.isNull() | ~p.between(0, 1)).alias("out_of_range"),
        F.count_if(F.abs(F.col("risk_score") - p * 1000) > 1.001).alias("wrong_score"),
        F.count_if((p < 0.1999) & (F.col("risk_band") != "Low Risk") | (p > 0.5001) & (F.col("risk_band") != "High Risk")
                   ).alias("wrong_band"))


@query
def explain_checks(spark, sf):
    """Explanations of all applications: every id once, values that add up to the probability, few drivers of one sign."""
    total = F.aggregate("shap_values", F.lit(0.0), lambda a, v: a + v)
    added = _shap(spark, sf).agg(F.count_if(F.abs(F.col("expected_value") + total - F.col("probability_1")) > 1e-9).alias("not_additive"))
    return explain_batch(spark, sf).agg(
        F.count("*").alias("n_rows"), F.sum(d.ID).cast("double").alias("id_sum"),
        F.count_if((F.size("positive_risk_drivers") > 5) | (F.size("negative_risk_drivers") > 5)).alias("too_many_drivers"),
        F.count_if(F.exists("positive_risk_drivers", lambda x: x["impact"] < 0)
                   | F.exists("negative_risk_drivers", lambda x: x["impact"] > 0)).alias("wrong_sign"),
        F.count_if(F.coalesce(F.length("business_narrative"), F.lit(0)) == 0).alias("no_narrative"),
    ).crossJoin(F.broadcast(added))  # one row each


@query
def background_checks(spark, sf):
    """The background: so many different training rows, none of the test rows, all features, no gaps."""
    p, t = _prepared(spark, sf), _trained(spark, sf)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(t.background)], "i int, x array<double>")
    known = models.assemble(p.train, t.features).select(vector_to_array("features").alias("x")).distinct()
    return rows.join(known, "x", "left_semi").agg(
        F.count("*").alias("n_rows"), F.max(F.size("x")).alias("n_features"),
        F.count_if(F.exists("x", lambda v: v.isNull() | F.isnan(v))).alias("gaps"))


@query
def fit_checks(spark, sf):
    """Both imbalance arms and all folds: one selected arm with the greater AUC, and folds whose mean is the one given."""
    arms = model_gbt_compare(spark, sf).agg(
        F.count("*").alias("arms"), F.count_if("selected").alias("n_selected"),
        (F.max_by("selected", "roc_auc") & (F.min("roc_auc") > 0.5)).alias("best_selected"))
    folds = model_cv(spark, sf).select(
        F.col("n_folds"), (F.abs(F.aggregate("fold_scores", F.lit(0.0), lambda a, v: a + v) / F.size("fold_scores")
                                 - F.col("mean_roc_auc")) < 1e-6).alias("mean_agrees"),
        F.forall("fold_scores", lambda v: v.between(0.5, 1)).alias("folds_in_range"))
    return arms.crossJoin(F.broadcast(folds))  # one row each


@query
def importance_checks(spark, sf):
    """Importances of the fitted model: ranked, falling, shares of the whole that add up."""
    table = correlation.importance_table(models.feature_importance(
        spark, _trained(spark, sf).model, _trained(spark, sf).features))
    before = F.lag("importance").over(Window.orderBy("rank"))  # a row for each feature
    return table.withColumn("rises", F.coalesce(F.col("importance") > before, F.lit(False))).agg(
        F.count("*").alias("n_features"), F.max("rank").alias("last_rank"), F.count_if("rises").alias("rising"),
        (F.abs(F.sum("share_pct") - 100) < 0.3).alias("shares_add_up"),
        (F.abs(F.max("cumulative_pct") - 100) < 0.01).alias("ends_at_100"))
