"""From Shapley values to importances, drivers, contribution tables and narratives."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import domain as d
from riskloom.functions import expressions as X
from riskloom.functions.columns import text_array
from riskloom.functions.text import driver_phrases, feature_label, mitigants, narrative
from riskloom.operators.correlation import importance_table


def _names(features: Sequence[str]) -> Column:
    return F.expr(text_array(features))


def global_importance(shap: DataFrame, features: Sequence[str], top_n: int | None = None) -> DataFrame:
    """Mean absolute value per feature with rank, share and running share.

    A task adds up the values of its rows as whole arrays and hands on one row per feature, so neither a row for each
    value nor a shuffle of the rows is ever made.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(features)), 0
        for batch in batches:
            values = batch.column("shap_values").flatten().to_numpy(zero_copy_only=False)
            total += np.abs(values).reshape(-1, len(features)).sum(axis=0)
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(range(len(features)), pa.int32()), "total": pa.array(total),
                "rows": pa.array([rows] * len(features), pa.int64())})

    parts = shap.select("shap_values").mapInArrow(add, "i int, total double, rows long")
    means = parts.groupBy("i").agg((F.sum("total") / F.sum("rows")).alias("importance")).select(
        F.element_at(_names(features), F.col("i") + 1).alias("feature"), "importance")
    return importance_table(means, top_n)


def feature_labels(
    spark: SparkSession, features: Sequence[str], labels: Mapping[str, str] | None = None
) -> list[str]:
    """Labels of the model's features, found once per feature instead of once per row."""
    named = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "i int, feature string")
    found = named.select("i", feature_label(F.col("feature"), labels).alias("label")).collect()
    return [r.label for r in sorted(found)]


def _impacts(features: Sequence[str], labels: Sequence[str], values: Column, given: Column) -> Column:
    """One struct per feature, led by its sort keys."""
    cells = F.arrays_zip(
        _names(features).alias("feature"), _names(labels).alias("label"), values.alias("v"), given.alias("x")
    )
    return F.transform(cells, lambda c, i: F.struct(
        c["v"].alias("k"), i.alias("i"), c["feature"].alias("feature"), c["label"].alias("label"),
        F.round(c["v"], 6).alias("impact"), F.round(c["x"], 6).alias("feature_value"),
    ))


def _strongest(cells: Column, sign: int, top_n: int) -> Column:
    """Top drivers of one sign, ties in feature order; zero impacts belong to neither side."""
    if sign < 0:
        return F.slice(F.sort_array(F.filter(cells, lambda c: c["k"] < 0)), 1, top_n)
    flipped = F.transform(F.filter(cells, lambda c: c["k"] > 0), lambda c: c.withField("k", -c["k"]))
    return F.slice(F.sort_array(flipped), 1, top_n)


def _bare(drivers: str) -> Column:
    return F.transform(drivers, lambda c: F.struct(c["feature"], c["impact"], c["feature_value"]))


def local_explanation(
    shap: DataFrame, features: Sequence[str], top_n: int = 10, labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Predicted probability (base + sum, kept within 0..1) and signed top drivers per row."""
    texts = feature_labels(shap.sparkSession, features, labels)
    total = F.aggregate("shap_values", F.lit(0.0), lambda a, v: a + v)
    staged = shap.withColumn(
        "_cells", _impacts(features, texts, F.col("shap_values"), F.col("feature_values"))
    )
    return staged.withColumns({
        "predicted_probability": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("expected_value") + total)),
        "positive_drivers": _strongest(F.col("_cells"), 1, top_n),
        "negative_drivers": _strongest(F.col("_cells"), -1, top_n),
    }).drop("_cells")


def contribution_table(shap: DataFrame, features: Sequence[str], key: str = d.ID) -> DataFrame:
    """One line per row and feature: value, direction and strength relative to the row's strongest."""
    return contributions_long(
        shap.select(
            key, F.array_max(F.transform("shap_values", lambda v: F.abs(v))).alias("row_max"), "feature_values",
            F.posexplode("shap_values").alias("i", "impact"),
        ).select(
            key, F.element_at(_names(features), F.col("i") + 1).alias("feature"),
            F.element_at("feature_values", F.col("i") + 1).alias("feature_value"), "impact", "row_max",
        )
    )


def contributions_long(rows: DataFrame) -> DataFrame:
    """Direction and strength for rows(…, feature_value, impact, row_max)."""
    keep = [c for c in rows.columns if c not in ("feature_value", "impact", "row_max")]
    return rows.select(
        *keep, F.round("feature_value", 6).alias("feature_value"), F.round("impact", 6).alias("shap_value"),
        X.impact_direction(F.col("impact")).alias("impact_direction"),
        X.impact_strength(F.col("impact"), F.col("row_max")).alias("impact_strength"),
    )


def explain_scores(
    shap: DataFrame, features: Sequence[str], key: str = d.ID, top_n: int = d.TOP_DRIVERS,
    labels: Mapping[str, str] | None = None, with_values: bool = False,
) -> DataFrame:
    """Score, band, drivers and narrative per row of shap(key, probability_1, shap_values, …)."""
    p = F.col("probability_1")
    local = local_explanation(shap, features, top_n, labels).withColumns({
        "risk_score": X.risk_score(p), "risk_band": X.risk_band(p),
        "phrases": driver_phrases(F.col("positive_drivers")), "relief": mitigants(F.col("negative_drivers")),
    })
    text = narrative(F.col("risk_band"), p, F.col("risk_score"), F.col("phrases"), F.col("relief"))
    extra = [F.transform("shap_values", lambda v: F.round(v, 6)).alias("shap_values")] if with_values else []
    return local.select(
        key, F.round("probability_1", 6).alias("default_probability"), "risk_score", "risk_band",
        _bare("positive_drivers").alias("positive_risk_drivers"),
        _bare("negative_drivers").alias("negative_risk_drivers"),
        F.round("expected_value", 6).alias("expected_value"), text.alias("business_narrative"), *extra,
    )
