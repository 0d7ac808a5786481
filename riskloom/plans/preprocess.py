"""Raw applications to model input: validate, split, fit on the training side, transform both, save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from riskloom import domain as d
from riskloom.operators.features import preprocessing, preprocessing_metadata, raw_schema
from riskloom.operators.quality import validate
from riskloom.operators.sampling import split_flag, split_report
from riskloom.sources.registry import ModelRegistry
from riskloom.sources.tables import scratch, settle, write_train_test


@dataclass(frozen=True)
class Prepared:
    pipeline: PipelineModel
    train: DataFrame
    test: DataFrame
    schema: dict[str, str]
    parts: DataFrame


def prepare(df: DataFrame, test_size: float = d.TEST_SIZE, missing_limit: float = d.MISSING_LIMIT) -> Prepared:
    # every fitting pass and both outputs read the split rows, so the source is joined and split once
    parts = settle(split_flag(df, test_size), "split")
    train, test = parts.where("NOT is_test").drop("is_test"), parts.where("is_test").drop("is_test")
    fitted = preprocessing(missing_limit).fit(train)
    return Prepared(fitted, fitted.transform(train), fitted.transform(test), raw_schema(df), parts)


def run(df: DataFrame, data_dir: str, registry: ModelRegistry, test_size: float = d.TEST_SIZE) -> dict[str, str]:
    report = validate(df, mode="train")
    with scratch(df.sparkSession):
        p = prepare(df, test_size)
        metadata = {
            "validation": report,
            "split": {**split_report(p.parts).first().asDict(), "test_size": test_size, "random_state": d.SEED},
            "raw_schema": p.schema,
            **preprocessing_metadata(p.pipeline),
        }
        return {
            **write_train_test(p.train, p.test, data_dir),
            "pipeline": registry.save_pipeline(p.pipeline),
            "metadata": registry.save_json("feature_metadata", metadata),
        }
