"""Exact ranking and threshold metrics from one ladder of distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import col
from riskloom.functions.expressions import number
from riskloom.sources.tables import settle

STEPS_PER_BUCKET = 100_000


def score_ladder(
    df: DataFrame, score: str, label: str, groups: Sequence[str] = (), per_bucket: int = STEPS_PER_BUCKET
) -> DataFrame:
    """One row per distinct score, best first: positives and negatives at it (`pos`, `neg`) and down to
    it (`tp`, `fp`), the totals (`p_all`, `n_all`), and the step below (`next_pos`, `next_neg`).

    A running sum over all scores would sit in one task. Equal scores are combined first; then steps are
    cut into buckets of about equal size at quantiles of the distinct scores, and only bucket totals are
    summed across buckets.
    """
    groups = list(groups)
    y, value = col(label), number(col(score))
    steps = (
        df.where(value.isNotNull() & y.isNotNull())
        .groupBy(*groups, value.alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    steps = settle(steps, "score-steps")  # read several times from here on; scoring is done once
    size = steps.count()
    wanted = max(1, size // per_bucket)
    points = [i / wanted for i in range(1, wanted)]
    exact = max(10_000, 10 * wanted)
    inner = sorted(set(steps.agg(F.percentile_approx("score", points, exact).alias("q")).first().q)) if points else []
    if inner:
        edges = [-float("inf"), *inner, float("inf")]
        steps = Bucketizer(splits=edges, inputCol="score", outputCol="bucket").transform(steps)
    else:
        steps = steps.withColumn("bucket", F.lit(0.0))

    down = Window.partitionBy(*groups).orderBy(F.desc("bucket"))  # a row for each bucket
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*groups)
    totals = (
        steps.groupBy(*groups, "bucket")
        .agg(
            F.sum("pos").alias("bp"), F.sum("neg").alias("bn"),
            F.max_by(F.struct("pos", "neg"), "score").alias("top"),
        )
        .select(
            *groups, "bucket",
            F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("tp0"),
            F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("fp0"),
            F.sum("bp").over(every).alias("p_all"), F.sum("bn").over(every).alias("n_all"),
            F.lead("top").over(down).alias("next_top"),
        )
    )
    inside = Window.partitionBy(*groups, "bucket").orderBy(F.desc("score"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(totals, [*groups, "bucket"]).select(
        *groups, "score", "pos", "neg", "p_all", "n_all",
        (F.col("tp0") + F.sum("pos").over(running)).alias("tp"),
        (F.col("fp0") + F.sum("neg").over(running)).alias("fp"),
        F.coalesce(F.lead("pos").over(inside), F.col("next_top.pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(inside), F.col("next_top.neg")).alias("next_neg"),
    )


def _ratio(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def _auc():
    """Share of (positive, negative) pairs ranked rightly, ties counting half."""
    won = F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0)
    pairs = F.first("p_all").cast("double") * F.first("n_all").cast("double")
    return F.try_divide(F.sum(won), pairs)


def _precision_at_step():
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def _average_precision():
    return F.sum(_ratio(F.col("pos"), F.col("p_all")) * _precision_at_step())


def roc_auc(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    ladder = score_ladder(df, score, label, groups)
    return ladder.groupBy(*groups).agg(F.round(_auc(), 6).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    return score_ladder(df, score, label).agg(
        F.round(_average_precision(), 6).alias("average_precision"),
        F.round(_ratio(F.first("p_all"), F.first("p_all") + F.first("n_all")), 6).alias("prevalence"),
    )


def roc_curve(df: DataFrame, score: str, label: str, drop_collinear: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) from (inf, 0, 0) on; points inside a straight stretch are left out."""
    ladder = score_ladder(df, score, label)
    if drop_collinear:
        # a point bends the curve when the next step differs; the first and last points always stay
        bends = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        ladder = ladder.where(F.col("next_pos").isNull() | bends)
    points = ladder.select(
        F.col("score").alias("threshold"),
        F.round(_ratio(F.col("fp"), F.col("n_all")), 6).alias("fpr"),
        F.round(_ratio(F.col("tp"), F.col("p_all")), 6).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], points.schema)
    return origin.unionByName(points)


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the closing point (NULL, 1, 0)."""
    points = score_ladder(df, score, label).select(
        F.col("score").alias("threshold"),
        F.round(_precision_at_step(), 6).alias("precision"),
        F.round(_ratio(F.col("tp"), F.col("p_all")), 6).alias("recall"),
    )
    closing = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], points.schema)
    return points.unionByName(closing)


def classification_metrics(
    df: DataFrame, score: str, label: str, threshold: float = 0.5, groups: Sequence[str] = ()
) -> DataFrame:
    """AUC with precision, recall, F1 (0 when undefined) and the confusion counts at a threshold."""
    hit = F.col("score") >= F.lit(threshold)
    counts = score_ladder(df, score, label, groups).groupBy(*groups).agg(
        F.round(_auc(), 6).alias("roc_auc"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~hit, F.col("neg"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(~hit, F.col("pos"))), F.lit(0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def safe(a, b):
        return F.round(F.coalesce(_ratio(a, b), F.lit(0.0)), 6)

    return counts.select(
        *groups, "roc_auc",
        safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"),
        safe(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        F.lit(float(threshold)).alias("threshold"), "tn", "fp", "fn", "tp",
    )


def confusion_matrix(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Counts and percent of all rows for each (actual, predicted) pair."""
    value = number(col(score))
    cells = df.where(value.isNotNull() & col(label).isNotNull()).groupBy(
        col(label).cast("int").alias("actual"), (value >= F.lit(threshold)).cast("int").alias("predicted"),
    ).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # four cells
    return cells.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(every), 1))
