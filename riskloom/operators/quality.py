"""Checks that gate loading, training and scoring."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import domain as d
from riskloom.functions.columns import col, is_missing


class SchemaValidationError(ValueError):
    """A table lacks what an operator needs, or holds values it must not."""


def _require(df: DataFrame, names: tuple[str, ...]) -> None:
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise SchemaValidationError(f"missing required column(s): {absent}")


def label_checks(df: DataFrame, key: str = d.ID, label: str = d.LABEL) -> DataFrame:
    """One row of facts about label and id.

    Duplicates come from one count per id, so a single very frequent id is combined before the shuffle.
    """
    _require(df, (key, label))
    y = col(label)
    valid = ~is_missing(df, label)
    per_id = df.groupBy(col(key).alias("id")).agg(
        F.count("*").alias("n"),
        F.count_if(~valid).alias("nulls"),
        F.count_if(valid & ~y.isin(0, 1)).alias("bad"),
        F.count_if(y == 0).alias("n0"),
        F.count_if(y == 1).alias("n1"),
    )
    total = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_label_count"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("unexpected_label_count"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicate_id_count"),
        F.coalesce(F.sum("n0"), F.lit(0)).alias("negatives"),
        F.coalesce(F.sum("n1"), F.lit(0)).alias("positives"),
    )
    pct = F.try_divide(F.col("null_label_count") * 100.0, F.col("row_count"))
    rate = F.try_divide(F.col("positives") * 100.0, F.col("negatives") + F.col("positives"))
    return total.withColumns({
        "null_label_pct": F.round(pct, 2),
        "default_rate_pct": F.round(rate, 4),
    })


def validate(df: DataFrame, mode: str = "load", key: str = d.ID, label: str = d.LABEL) -> dict:
    """Run the checks and raise on failure.

    mode 'load' only warns about NULL labels; mode 'train' refuses them and non-numeric labels.
    """
    if mode not in ("load", "train"):
        raise ValueError(f"unknown mode {mode!r}")
    _require(df, (key, label))
    if mode == "train" and not isinstance(df.schema[label].dataType, T.NumericType):
        raise SchemaValidationError(f"'{label}' must be numeric, got {df.schema[label].dataType.simpleString()}")
    facts = label_checks(df, key, label).first().asDict()
    if mode == "train" and facts["null_label_count"]:
        raise SchemaValidationError(f"{facts['null_label_count']} NULL values in '{label}'")
    if facts["unexpected_label_count"]:
        raise SchemaValidationError(f"'{label}' holds values other than 0 and 1")
    warnings = []
    if facts["null_label_count"]:
        warnings.append(f"{facts['null_label_count']} NULL values in '{label}'")
    if facts["duplicate_id_count"]:
        warnings.append(f"{facts['duplicate_id_count']} duplicate values in '{key}'")
    return facts | {"warnings": warnings, "checks_passed": ["schema", "target", "dtypes"]} | type_counts(df)


def type_counts(df: DataFrame) -> dict[str, int]:
    numeric = sum(isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in df.schema)
    text = sum(isinstance(f.dataType, T.StringType) for f in df.schema)
    return {"numeric_columns": numeric, "text_columns": text, "other_columns": len(df.columns) - numeric - text}


def validation_report(df: DataFrame, key: str = d.ID, label: str = d.LABEL) -> DataFrame:
    """The strict checks as a one-row table with a pass flag instead of an exception."""
    ok = (F.col("null_label_count") == 0) & (F.col("unexpected_label_count") == 0)
    kinds = {k: F.lit(v) for k, v in type_counts(df).items()}
    return label_checks(df, key, label).withColumns(
        {"column_count": F.lit(len(df.columns)), **kinds, "passed": ok}
    )


def align_to_schema(df: DataFrame, schema: Mapping[str, str], carry: tuple[str, ...] = (d.ID,)) -> DataFrame:
    """Shape scoring input like the training input: absent columns become typed NULLs, extra ones go.

    `schema` maps raw feature names to Spark types, in order.
    """
    if not schema:
        raise SchemaValidationError("the training schema is empty")
    have = set(df.columns)
    keep = [col(c) for c in carry if c in have]
    features = [
        (col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in schema.items() if c not in carry
    ]
    return df.select(*keep, *features)
