"""Batch scoring: one narrow job from raw rows to bands, with the id carried along."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import domain as d
from riskloom.functions import expressions as X
from riskloom.operators.features import feature_names
from riskloom.operators.models import assemble, positive_probability
from riskloom.operators.quality import SchemaValidationError, align_to_schema


def prepared(
    raw: DataFrame, pipeline: PipelineModel, schema: Mapping[str, str], features: Sequence[str], key: str = d.ID
) -> DataFrame:
    """Raw rows -> (key, features): label dropped, columns aligned, fitted stages applied, width checked."""
    ready = pipeline.transform(align_to_schema(raw, schema, carry=(key,)))
    absent = [f for f in features if f not in ready.columns]
    if absent:
        raise SchemaValidationError(f"{len(absent)} model features are missing after preprocessing: {absent[:5]}")
    return assemble(ready, features, key)


def score(
    raw: DataFrame, pipeline: PipelineModel, model: Model, schema: Mapping[str, str], key: str = d.ID,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """key, default_probability (6 decimals), risk_score, risk_band."""
    rows = prepared(raw, pipeline, schema, features or feature_names(pipeline), key)
    return risk_columns(positive_probability(model.transform(rows)), F.col("probability_1"), [key])


def risk_columns(df: DataFrame, p: Column, keep: Sequence[str]) -> DataFrame:
    return df.select(
        *[c for c in keep if c in df.columns], F.round(p, 6).alias("default_probability"),
        X.risk_score(p).alias("risk_score"), X.risk_band(p).alias("risk_band"),
    )


def band_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_band").agg(F.count("*").alias("row_count"))
