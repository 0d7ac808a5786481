"""A profile kept as mergeable sketches, a set for each partition of a table.

Only partitions that have no sketches yet are read; the profile of the whole table is the union of what is kept, so it
costs rows by column and partition, not by row. Distinct counts come from HyperLogLog sketches, quantiles from KLL sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import col, is_missing, numeric_columns, quoted

#: Sizes of the sketches: about 1.6 % error of a distinct count, and 0.3 % of a rank.
LOG_REGISTERS, QUANTILE_SIZE = 12, 800
QUARTILES = (0.25, 0.5, 0.75)
_PART = "part"


def _part(by: str) -> Column:
    """Name of a row's partition: p and the value, or n for null."""
    return F.coalesce(F.concat(F.lit("p"), col(by).cast("string")), F.lit("n"))


def sketch_partitions(df: DataFrame, by: str) -> DataFrame:
    """(part, column, n, missing, distinct_sketch, quantile_sketch) for every column but `by`; null without numbers."""
    names = [c for c in df.columns if c != by]
    numbers = set(numeric_columns(df))
    cells = F.array(*[F.struct(
        F.lit(c).alias("column"), F.when(~is_missing(df, c), col(c).cast("string")).alias("text"),
        (F.when(~is_missing(df, c), col(c).cast("double")) if c in numbers else F.lit(None).cast("double")).alias("number"),
    ) for c in names])
    rows = df.select(_part(by).alias(_PART), F.explode(cells).alias("cell")).select(_PART, "cell.*")
    return rows.groupBy(_PART, "column").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("missing"),
        F.hll_sketch_agg("text", LOG_REGISTERS).alias("distinct_sketch"),
        F.when(F.count("number") > 0, F.kll_sketch_agg_double("number", QUANTILE_SIZE)).alias("quantile_sketch"))


def kept_partitions(spark: SparkSession, root: str) -> list[str]:
    """Names of the partitions that have sketches."""
    try:
        return [r[0] for r in spark.read.parquet(root).select(_PART).distinct().collect()]
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return []
        raise


def refresh(df: DataFrame, by: str, root: str) -> list[str]:
    """Add the sketches of the partitions of `df` that `root` does not have yet; the names of those it had.

    The filter is on the partition column alone, so a partitioned source is read only where it is new. Rows whose
    partition is null are one more partition.
    """
    had = kept_partitions(df.sparkSession, root)
    new = df.where(~_part(by).isin(had)) if had else df
    sketch_partitions(new, by).write.mode("append").partitionBy(_PART).parquet(root)
    return had


def merged(spark: SparkSession, root: str) -> DataFrame:
    """column, n, missing_count, missing_pct, unique_count (estimate), p25, p50, p75 (estimates) of the whole table."""
    union = spark.read.parquet(root).groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing_count"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("unique_count"),
        F.kll_merge_agg_double("quantile_sketch", QUANTILE_SIZE).alias("q"))
    usable = F.col("q").isNotNull() & (F.coalesce(F.kll_sketch_get_n_double("q"), F.lit(0)) > 0)
    return union.select(
        "column", "n", "missing_count", F.round(F.col("missing_count") / F.col("n") * 100, 2).alias("missing_pct"),
        "unique_count", *[F.when(usable, F.kll_sketch_get_quantile_double("q", F.lit(p))).alias(f"p{int(100 * p)}")
                          for p in QUARTILES])


def accuracy(df: DataFrame, profile: DataFrame, names: Sequence[str], share: float = 0.05, rank: float = 0.02) -> DataFrame:
    """(column, distinct_close, median_close): whether the estimates are within `share` of the distinct count and `rank` of
    the median's rank, by exact counts over all rows. A column without numbers has no median."""
    numbers = set(numeric_columns(df))
    cells = ", ".join(
        f"struct('{c}' as column, cast({quoted(c)} as string) as text, "
        + (f"cast({quoted(c)} as double)" if c in numbers else "cast(null as double)") + " as number)" for c in names)
    rows = df.select(F.expr(f"inline(array({cells}))")).where("text is not null")
    exact = rows.select("column", "text").distinct().groupBy("column").agg(F.count("*").alias("exact"))
    medians = F.broadcast(profile.select("column", "p50"))  # a row for each column
    ranks = rows.join(medians, "column").groupBy("column").agg(
        F.avg((F.col("number") < F.col("p50")).cast("int")).alias("below"),
        F.avg((F.col("number") <= F.col("p50")).cast("int")).alias("upto"))
    return profile.join(exact, "column", "left").join(ranks, "column", "left").select(
        "column", (F.abs(F.col("unique_count") - F.coalesce("exact", F.lit(0))) <= F.lit(share) * F.coalesce("exact", F.lit(0))
                   ).alias("distinct_close"),
        ((F.col("below") <= 0.5 + rank) & (F.col("upto") >= 0.5 - rank)).alias("median_close"))
