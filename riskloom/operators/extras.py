"""Features that the insights advise: bureau history of a client, further ratios and flags; rank statistics of a score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import domain as d
from riskloom.functions import expressions as X
from riskloom.functions.columns import col, is_missing
from riskloom.operators.distribution import clip_upper
from riskloom.operators.metrics import score_ladder


def bureau_history(bureau: DataFrame, key: str = d.ID) -> DataFrame:
    """One row per client: records, active ones, overdue ones, most days overdue, sum of credits."""
    return bureau.groupBy(key).agg(
        F.count("*").alias("bureau_records"), F.count_if(col("CREDIT_ACTIVE") == "Active").alias("bureau_active"),
        F.count_if(col("CREDIT_DAY_OVERDUE") > 0).alias("bureau_overdue"),
        F.max("CREDIT_DAY_OVERDUE").alias("bureau_most_days_overdue"), F.sum("AMT_CREDIT_SUM").alias("bureau_credit_sum"),
    )


def with_bureau(applications: DataFrame, bureau: DataFrame, key: str = d.ID) -> DataFrame:
    """Applications with their client's history; counts are 0 and the rest null without any."""
    counts = ["bureau_records", "bureau_active", "bureau_overdue"]
    joined = applications.join(bureau_history(bureau, key), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})


def extra_features(df: DataFrame) -> DataFrame:
    """credit_term (credit over annuity), ext_source_mean (of the known scores), document_count."""
    scores = F.array_compact(F.array(*[X.number(col(c)) for c in d.EXTERNAL_SCORES if c in df.columns]))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    papers = [F.when(col(c) == 1, 1).otherwise(0) for c in df.columns if c.startswith("FLAG_DOCUMENT_")]
    return df.withColumns({
        "credit_term": X.safe_ratio(col("AMT_CREDIT"), col("AMT_ANNUITY")),
        "ext_source_mean": F.when(F.size(scores) > 0, total / F.size(scores)),
        "document_count": sum(papers, F.lit(0)),
    })


def missing_flags(df: DataFrame, names: Sequence[str], income: str = "AMT_INCOME_TOTAL", q: float = 0.99) -> DataFrame:
    """A 0/1 column `<name>_missing` for each name, and `income_capped` at the quantile q of the income."""
    flagged = df.withColumns({f"{c}_missing": is_missing(df, c).cast("int") for c in names})
    return clip_upper(flagged.withColumn("income_capped", X.number(col(income))), "income_capped", q)


def rank_statistics(df: DataFrame, score: str, label: str = d.LABEL) -> DataFrame:
    """ks (largest gap of the two classes' distributions of the score) and gini (2 AUC - 1)."""
    won = F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0)
    pairs = F.first("p_all").cast("double") * F.first("n_all").cast("double")
    gap = F.abs(F.try_divide(F.col("tp").cast("double"), F.col("p_all")) - F.try_divide(F.col("fp").cast("double"), F.col("n_all")))
    return score_ladder(df, score, label).agg(
        F.round(F.max(gap), 6).alias("ks"), F.round(2 * F.try_divide(F.sum(won), pairs) - 1, 6).alias("gini"))
