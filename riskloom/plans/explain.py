"""Scoring and explaining raw applications with a saved model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskloom import domain as d
from riskloom.operators import explanations, scoring, shapley
from riskloom.operators.features import feature_names
from riskloom.operators.models import positive_probability
from riskloom.sources.registry import ModelRegistry
from riskloom.sources.tables import scratch, settle, write_table


class SavedModel:
    """Everything scoring needs, loaded once from a registry."""

    def __init__(self, registry: ModelRegistry, background: DataFrame, background_n: int = d.BACKGROUND_ROWS):
        self.spark = registry.spark
        self.pipeline = registry.load_pipeline()
        self.model = registry.load_model()
        self.schema = registry.load_json("feature_metadata")["raw_schema"]
        self.features = feature_names(self.pipeline)
        self.leaves = shapley.read_leaves(self.spark, registry.model_path)
        self.background = shapley.background_rows(background, self.features, background_n)

    def score(self, raw: DataFrame) -> DataFrame:
        return scoring.score(raw, self.pipeline, self.model, self.schema, features=self.features)

    def shap(self, raw: DataFrame) -> DataFrame:
        """key, probability_1, feature_values, shap_values, expected_value."""
        rows = scoring.prepared(raw, self.pipeline, self.schema, self.features)
        scored = positive_probability(self.model.transform(rows)).select(d.ID, "probability_1", "features")
        return shapley.shapley_values(scored, self.leaves, self.background)

    def explain(self, raw: DataFrame, with_values: bool = False) -> DataFrame:
        return explanations.explain_scores(self.shap(raw), self.features, with_values=with_values)

    def write_reports(self, raw: DataFrame, out_dir: str) -> dict[str, str]:
        """Importance, contribution and explanation tables; the values are computed once."""
        with scratch(self.spark):
            shap = settle(self.shap(raw), "shap")
            return {
                "importance": write_table(explanations.global_importance(shap, self.features), f"{out_dir}/importance", "csv"),
                "contributions": write_table(explanations.contribution_table(shap, self.features), f"{out_dir}/contributions"),
                "explanations": write_table(explanations.explain_scores(shap, self.features), f"{out_dir}/explanations"),
            }
