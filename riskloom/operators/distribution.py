"""Per-class distributions: capping, histograms, boxes, and rates by bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import domain as d
from riskloom.functions import expressions as X
from riskloom.functions.columns import col
from riskloom.operators.selection import exact_quantiles, exact_quantiles_long


def upper_quantile(df: DataFrame, value: Column, q: float) -> float | None:
    found = exact_quantiles(df.select(value.alias("x")), ["x"], [q])
    return found["x"][0] if found else None


def clip_upper(df: DataFrame, name: str, q: float) -> DataFrame:
    """Values above the quantile are pulled down to it."""
    cap = upper_quantile(df, col(name), q)
    return df if cap is None else df.withColumn(name, F.when(col(name) > cap, F.lit(cap)).otherwise(col(name)))


def keep_below_quantile(df: DataFrame, name: str, q: float = d.OUTLIER_QUANTILE) -> DataFrame:
    """Rows whose value is at most the quantile. The cap is a literal, so it reaches the file scan."""
    if not 0.5 <= q <= 1.0:
        raise ValueError(f"the outlier quantile must be between 0.5 and 1.0, got {q}")
    cap = upper_quantile(df, col(name), q)
    return df.where(F.lit(False)) if cap is None else df.where(col(name) <= cap)


def class_histogram(rows: DataFrame, bins: int) -> DataFrame:
    """Density histogram of `rows(label, value)` per class, on the class's own range, empty bins kept."""
    rows = rows.where(F.col("label").isin(0, 1) & F.col("value").isNotNull())
    ranges = rows.groupBy("label").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total")
    )
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(
        "label", "total",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    position = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = (
        rows.join(F.broadcast(ranges), "label")  # two rows
        .groupBy("label", F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    n = F.coalesce("n", F.lit(0))
    return grid.join(F.broadcast(counts), ["label", "bin"], "left").select(
        "label", "bin",
        F.round(F.col("lo") + F.col("bin") * width, 4).alias("bin_start"),
        F.round(F.col("lo") + (F.col("bin") + 1) * width, 4).alias("bin_end"),
        n.alias("n"),
        F.round(n / (F.col("total") * width), 9).alias("density"),
    )


def class_box(rows: DataFrame) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers of `rows(label, value)` per class."""
    rows = rows.where(F.col("label").isin(0, 1) & F.col("value").isNotNull())
    found = exact_quantiles_long(
        rows.select(F.col("label").cast("int").alias("g"), F.col("value").cast("double").alias("v")),
        [0.25, 0.5, 0.75],
    )
    spark = rows.sparkSession
    quartiles = spark.createDataFrame(
        [(g, *q) for g, q in found.items()], "label int, q1 double, median double, q3 double"
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    joined = rows.join(F.broadcast(quartiles), "label")  # two rows
    v = F.col("value")
    return joined.groupBy("label", "q1", "median", "q3").agg(
        F.count("*").alias("n"),
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
        F.count_if((v < F.col("q1") - reach) | (v > F.col("q3") + reach)).alias("outliers"),
    ).withColumn("status", X.label_name(F.col("label")))


def rate_by_bin(rows: DataFrame) -> DataFrame:
    """Default rate and rows per bin of `rows(bin, label)`, beside the rate over all rows."""
    rows = rows.where(F.col("label").isNotNull())
    per_bin = rows.groupBy("bin").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy()  # a handful of bins
    return (
        per_bin.select(
            "bin", F.col("n").alias("row_count"),
            F.round(F.col("s") / F.col("n") * 100, 4).alias("default_rate_pct"),
            F.round(F.sum("s").over(every) / F.sum("n").over(every) * 100, 4).alias("overall_rate_pct"),
        )
        .where(F.col("bin").isNotNull())
    )


# ---- the domain's own distributions ----------------------------------------------------------

def _pair(df: DataFrame, value: Column, label: str) -> DataFrame:
    out = df.select(col(label).cast("int").alias("label"), value.cast("double").alias("value"))
    return out.where(F.col("label").isNotNull() & F.col("value").isNotNull())


def capped_income(df: DataFrame, q: float = d.OUTLIER_QUANTILE, label: str = d.LABEL) -> DataFrame:
    rows = _pair(df, col("AMT_INCOME_TOTAL"), label)
    return keep_below_quantile(rows, "value", q)


def credit_rows(df: DataFrame, label: str = d.LABEL) -> DataFrame:
    return df.where(col("AMT_CREDIT").isNotNull() & col("AMT_ANNUITY").isNotNull() & col(label).isNotNull())


def credit_values(df: DataFrame, label: str = d.LABEL) -> DataFrame:
    return _pair(credit_rows(df, label), col("AMT_CREDIT"), label)


def ages(df: DataFrame, label: str = d.LABEL, round_to: int | None = 1) -> DataFrame:
    return _pair(df, X.age_years(col("DAYS_BIRTH"), round_to), label)


def clipped_tenure(
    df: DataFrame, q: float = d.TENURE_CLIP_QUANTILE, label: str = d.LABEL, round_to: int | None = 1
) -> DataFrame:
    tenure = X.tenure_years(col("DAYS_EMPLOYED"), round_to)
    named = df.select(col(label).alias("label"), tenure.alias("value"))
    return _pair(clip_upper(named, "value", q), F.col("value"), "label")


def rate_by_age(df: DataFrame, label: str = d.LABEL, round_to: int | None = 1) -> DataFrame:
    return rate_by_bin(ages(df, label, round_to).select(X.age_bin(F.col("value")).alias("bin"), "label"))


def rate_by_tenure(df: DataFrame, label: str = d.LABEL) -> DataFrame:
    return rate_by_bin(clipped_tenure(df, label=label).select(X.tenure_band(F.col("value")).alias("bin"), "label"))
