"""Exploratory analysis end to end: profile, distributions and insights written as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskloom import domain as d
from riskloom.operators import correlation, distribution, insights, profile
from riskloom.operators.quality import validate
from riskloom.operators.sampling import sample_rows
from riskloom.sources.tables import scratch, settle


CREDIT_SAMPLE = 5000


def profile_tables(df: DataFrame, top_n: int = d.CORRELATION_TOP_N, exact: bool = True) -> dict[str, DataFrame]:
    """Every profile table that applies to `df`, by name. Without `exact`, distinct counts are sketches and no cell is
    shuffled for them."""
    types = profile.column_types(df, exact=exact)
    tables = {
        "dimensions": profile.dimensions(df),
        "column_types": types,
        "kind_counts": profile.kind_counts(types),
        "missing_values": profile.missing_values(df),
        "duplicates": profile.duplicates(df),
        "target_distribution": profile.target_distribution(df),
        "numeric_summary": profile.numeric_summary(df, exact=exact),
        "categorical_summary": profile.categorical_summary(df),
        "feature_categories": profile.feature_categories(df),
        "target_correlations": correlation.target_correlation(df, top_n),
    }
    return {name: t for name, t in tables.items() if t is not None}


def distribution_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the usual charts, for the columns that exist."""
    have = set(df.columns)
    out: dict[str, DataFrame] = {}
    if d.LABEL not in have:
        return out
    if "AMT_INCOME_TOTAL" in have:
        income = distribution.capped_income(df)
        out |= {"income_histogram": distribution.class_histogram(income, 70), "income_box": distribution.class_box(income)}
    if {"AMT_CREDIT", "AMT_ANNUITY"} <= have:
        out["credit_histogram"] = distribution.class_histogram(distribution.credit_values(df), 70)
        points = distribution.credit_rows(df).select(d.ID, d.LABEL, "AMT_CREDIT", "AMT_ANNUITY")
        out["credit_sample"] = sample_rows(points, CREDIT_SAMPLE)
    if "DAYS_BIRTH" in have:
        out |= {"age_histogram": distribution.class_histogram(distribution.ages(df), 40), "age_rates": distribution.rate_by_age(df)}
    if "DAYS_EMPLOYED" in have:
        tenure = distribution.clipped_tenure(df)
        out |= {"tenure_histogram": distribution.class_histogram(tenure, 50), "tenure_rates": distribution.rate_by_tenure(df)}
    out["correlation_matrix"] = correlation.correlation_matrix(df)
    return out


def run(
    application: DataFrame, bureau: DataFrame | None, out_dir: str, sample: int | None = None, exact: bool = True
) -> dict[str, str]:
    """Validate, optionally sample, and write every table as JSON below `out_dir`."""
    validate(application, mode="load")
    with scratch(application.sparkSession):
        # all tables read the same rows, written once; the executors keep nothing
        df = settle(sample_rows(application, sample) if sample else application, "application")
        found = insights.isolated_insights(df, bureau)
        tables = {
            **profile_tables(df, exact=exact), **distribution_tables(df), "insights": found,
            "insight_severities": insights.severity_counts(found),
        }
        return {name: write_json(t, f"{out_dir}/{name}") for name, t in tables.items()}


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path
