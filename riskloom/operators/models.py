"""Training and model choice with MLlib.

A boosted fit holds rows out by their id and stops when they no longer gain. Fits of folds and of search candidates are
tasks of one pool; each writes its score as it ends, and a run that starts again fits only what is missing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import ceil, log2, prod

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import domain as d
from riskloom.functions.columns import col
from riskloom.functions.expressions import KEY_RANGE, order_digest, order_number
from riskloom.operators.boosting import HistogramBoosting
from riskloom.operators.metrics import classification_metrics, roc_auc
from riskloom.operators.sampling import split_flag, stratified_folds
from riskloom.sources.tables import work_path

DEPTH_CAP = 15
WEIGHTED, UNWEIGHTED = "scale_pos_weight", "unweighted"
BASE_PARAMS = {"n_estimators": 400, "num_leaves": 63, "learning_rate": 0.05}
#: Share of the rows that watch a boosted fit, and the relative gain of their loss under which it stops.
WATCHED, LEAST_GAIN = 0.1, 1e-4
#: Rows in a task of a boosted fit, at most, and rows in the largest part from which on dealing them out pays.
FIT_ROWS, DEAL_ROWS = 500_000, 50_000
#: Fits that run side by side where a whole machine or cluster is free for them.
FOLD_FITS = 5


def assemble(df: DataFrame, features: Sequence[str], key: str = d.ID, label: str = d.LABEL) -> DataFrame:
    """(id, label if present, features vector). Id and label can never be features."""
    leaked = {key, label} & set(features)
    if leaked:
        raise ValueError(f"{sorted(leaked)} must not be features")
    keep = [c for c in df.columns if c in (key, label) or c.startswith("_fold")]
    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return vector.transform(df).select(*keep, "features")


def vector_names(rows: DataFrame) -> list[str]:
    """Names of the entries of `features`: of the assembled columns, and `<column>_<number>` inside a vector column."""
    kinds = rows.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    return [a["name"] for a in sorted((a for k in kinds.values() for a in k), key=lambda a: a["idx"])]


def class_counts(df: DataFrame, label: str = d.LABEL) -> tuple[int, int]:
    r = df.agg(F.count_if(col(label) == 0).alias("n"), F.count_if(col(label) == 1).alias("p")).first()
    return r.n, r.p


def scale_pos_weight(df: DataFrame, label: str = d.LABEL) -> DataFrame:
    return df.agg(
        F.count_if(col(label) == 0).alias("negatives"), F.count_if(col(label) == 1).alias("positives")
    ).withColumn("scale_pos_weight", F.round(F.col("negatives") / F.greatest("positives", F.lit(1)), 4))


def positive_probability(scored: DataFrame, name: str = "probability_1") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1])


def train_baseline(rows: DataFrame, label: str = d.LABEL, max_iter: int = 1000) -> Model:
    """Logistic regression with balanced class weights and unit L2 strength."""
    neg, pos = class_counts(rows, label)
    n = neg + pos
    weight = F.when(col(label) == 1, n / (2 * max(pos, 1))).otherwise(n / (2 * max(neg, 1)))
    # the loss here is a weighted mean, so a unit penalty on the weighted sum is 1/n (weights sum to n)
    lr = LogisticRegression(
        labelCol=label, weightCol="_w", maxIter=max_iter, regParam=1.0 / n, standardization=False
    )
    return lr.fit(rows.withColumn("_w", weight))


def boosted_trees(params: Mapping[str, float], label: str = d.LABEL, weight: str | None = None) -> GBTClassifier:
    """GBTClassifier from the usual boosting names. Trees grow by level here, so a leaf limit becomes the
    depth that can hold as many leaves, and depth -1 (unlimited) the cap."""
    p = {**BASE_PARAMS, **params}
    depth = int(p.get("max_depth", -1))
    if depth > DEPTH_CAP:
        raise ValueError(f"max_depth {depth} is beyond {DEPTH_CAP}, the deepest that trees grown by level can be")
    depth = DEPTH_CAP if depth < 0 else depth
    share = float(p.get("colsample_bytree", 1.0))
    gbt = HistogramBoosting(
        labelCol=label, maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]),
        maxDepth=max(1, min(depth, ceil(log2(p["num_leaves"])))),
        minInstancesPerNode=int(p.get("min_child_samples", 20)), subsamplingRate=float(p.get("subsample", 1.0)),
        featureSubsetStrategy="all" if share >= 1 else str(share), seed=d.SEED,
    )
    return gbt.setWeightCol(weight) if weight else gbt


def _weight(strategy: str, neg: int, pos: int, label: str) -> Column:
    return F.when(col(label) == 1, neg / max(pos, 1) if strategy == WEIGHTED else 1.0).otherwise(1.0)


def _with_checkpoints(spark: SparkSession) -> None:
    """Boosting cuts its lineage every ten rounds, if the session names a shared folder; where it does not, set one."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_path(spark, "checkpoints"))


def dealt_out(rows: DataFrame) -> DataFrame:
    """Rows in equal parts. Each level of each tree scans all parts, which takes as long as the largest of them takes, and
    the files of a table may have most rows in one. Parts that are small or about equal stay as they are."""
    sizes = rows.groupBy(F.spark_partition_id().alias("part")).count().agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    n, most = (x or 0 for x in sizes.first())
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, ceil(n / FIT_ROWS))
    return rows.repartition(tasks) if most > max(DEAL_ROWS, 1.25 * n / tasks) else rows


def train_boosted(
    rows: DataFrame, params: Mapping[str, float], strategy: str = UNWEIGHTED, label: str = d.LABEL, key: str = d.ID,
    watched: float = WATCHED,
) -> GBTClassificationModel:
    """A fit of up to n_estimators trees. `watched` is the share of rows, chosen by id, that do not train but watch: when
    their loss gains less than LEAST_GAIN in a round, the fit ends with the best round so far. 0: all rounds."""
    if strategy not in (WEIGHTED, UNWEIGHTED):
        raise ValueError(f"unknown strategy {strategy!r}")
    _with_checkpoints(rows.sparkSession)
    gbt = boosted_trees(params, label, "_w" if strategy == WEIGHTED else None)
    if strategy == WEIGHTED:
        neg, pos = class_counts(rows, label)
        rows = rows.withColumn("_w", _weight(strategy, neg, pos, label))
    if watched:
        place = order_number(order_digest(col(key), d.SEED + 2))
        rows = rows.withColumn("_watch", place < watched * KEY_RANGE)
        gbt = gbt.setValidationIndicatorCol("_watch")
        gbt.set(gbt.validationTol, LEAST_GAIN)
    return gbt.fit(dealt_out(rows))


def evaluate(model: Model, rows: DataFrame, label: str = d.LABEL, threshold: float = 0.5) -> DataFrame:
    scored = positive_probability(model.transform(rows)).select(label, "probability_1")
    return classification_metrics(scored, "probability_1", label, threshold)


def compare_strategies(
    rows: DataFrame, params: Mapping[str, float], key: str = d.ID, label: str = d.LABEL, holdout: float = 0.2,
    parallelism: int = 2,
) -> tuple[str, DataFrame]:
    """Weighted against unweighted training, judged by AUC on rows held out of the training set (never the
    test set). A tie goes to unweighted. Both arms are fitted side by side."""
    parts = split_flag(rows, holdout, key, label, d.SEED + 1)
    fit, judge = parts.where("NOT is_test").drop("is_test"), parts.where("is_test").drop("is_test")

    def arm(strategy: str) -> DataFrame:
        model = train_boosted(fit, params, strategy, label)
        out = positive_probability(model.transform(judge)).select(label, "probability_1")
        return out.withColumn("strategy", F.lit(strategy))

    with ThreadPoolExecutor(parallelism) as pool:
        both = reduce(DataFrame.unionByName, pool.map(arm, (WEIGHTED, UNWEIGHTED)))
    table = classification_metrics(both, "probability_1", label, groups=["strategy"])
    auc = {r.strategy: r.roc_auc for r in table.collect()}
    winner = WEIGHTED if auc[WEIGHTED] > auc[UNWEIGHTED] else UNWEIGHTED
    return winner, table.withColumn("selected", F.col("strategy") == winner)


def with_folds(rows: DataFrame, k: int = d.CV_FOLDS, key: str = d.ID, label: str = d.LABEL) -> DataFrame:
    return stratified_folds(rows, k, key, label, name="_fold")


def logistic_gradient(model: Model, rows: DataFrame, label: str = d.LABEL) -> DataFrame:
    """(component, gradient) of the objective that `train_baseline` states, at the fitted weights; -1 is the intercept.

    The objective is the weighted mean of the log loss and half the squared weights over n. Components are taken in
    units of their feature's standard deviation, in which the optimiser works. One aggregate over the rows.
    """
    neg, pos = class_counts(rows, label)
    n = neg + pos
    weight = F.when(col(label) == 1, n / (2 * max(pos, 1))).otherwise(n / (2 * max(neg, 1)))
    p = vector_to_array("probability")[1]
    # the residual's sign is the label's, so two sums with positive weights make its gradient
    pull = F.when(col(label) == 1, weight * (1 - p)).otherwise(weight * p)
    sums = model.transform(rows).select(col(label).alias("y"), "features", pull.alias("pull")).groupBy("y").agg(
        vector_to_array(Summarizer.sum(F.col("features"), F.col("pull"))).alias("x"), F.sum("pull").alias("pull")).collect()
    sides = {int(r.y): (np.array(r.x), r.pull) for r in sums}
    zero = (np.zeros(model.numFeatures), 0.0)
    (above, a), (below, b) = sides.get(0, zero), sides.get(1, zero)
    spread = rows.select(Summarizer.std(F.col("features")).alias("s")).first().s.toArray()
    weights = model.coefficients.toArray()
    gradient = ((above - below) / n + weights / n) / np.where(spread > 0, spread, 1.0)
    table = [(-1, float((a - b) / n)), *((i, float(g)) for i, g in enumerate(gradient))]
    return rows.sparkSession.createDataFrame(table, "component int, gradient double")


# ---- folds and search ------------------------------------------------------------------------

#: Scores the rows of a fold with a model that has not seen them: (rows, parameters, strategy, fold) -> (label, probability_1).
FoldScorer = Callable[[DataFrame, Mapping[str, float], str, int], DataFrame]


def boosted_fold(folded: DataFrame, params: Mapping[str, float], strategy: str, fold: int) -> DataFrame:
    model = train_boosted(folded.where(F.col("_fold") != fold), params, strategy)
    out = positive_probability(model.transform(folded.where(F.col("_fold") == fold)))
    return out.select(d.LABEL, "probability_1")


def effective(params: Mapping[str, float]) -> str:
    """A digest of what the trees are grown with; points of a grid that differ in name only have the same."""
    gbt = boosted_trees(params)
    grown = {p.name: gbt.getOrDefault(p) for p in gbt.params if gbt.isSet(p)}
    return hashlib.md5(json.dumps(grown, sort_keys=True, default=str).encode()).hexdigest()


class FoldResults:
    """The AUC of each (point, fold) in a folder of its own, which counts once Spark has marked it as whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, point: str, fold: int) -> str:
        return f"{self.root}/point={point}/fold={fold}"

    def has(self, point: str, fold: int) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(point, fold)}/_SUCCESS")
        return mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    def add(self, point: str, fold: int, score: DataFrame) -> None:
        row = score.select(F.lit(point).alias("of_point"), F.lit(fold).alias("of_fold"), "roc_auc")
        row.coalesce(1).write.mode("overwrite").parquet(self._path(point, fold))

    def table(self, asked: Sequence[tuple[str, int]]) -> DataFrame:
        read = self.spark.read.schema("of_point string, of_fold int, roc_auc double")
        return read.parquet(*[self._path(*a) for a in asked]).select(
            F.col("of_point").alias("point"), F.col("of_fold").alias("fold"), "roc_auc")


def fold_scores(
    folded: DataFrame, candidates: Sequence[Mapping[str, float]], strategy: str = UNWEIGHTED, k: int = d.CV_FOLDS,
    parallelism: int = 2, results: str | None = None, score: FoldScorer = boosted_fold, label: str = d.LABEL,
) -> DataFrame:
    """(draw, fold, roc_auc) of every candidate on every fold.

    All (point, fold) pairs are one pool, `parallelism` at a time; equal points are fitted once. Scores lie in the
    folder `results`: a run that is started again with it goes on where the last one ended.
    """
    spark = folded.sparkSession
    store = FoldResults(spark, results or work_path(spark, "fold-scores"))
    points = [effective(p) for p in candidates]
    asked = [(point, fold) for point in dict.fromkeys(points) for fold in range(k)]
    first = {point: p for point, p in reversed(list(zip(points, candidates)))}

    def fit(pair: tuple[str, int]) -> None:
        point, fold = pair
        scored = score(folded, first[point], strategy, fold)
        store.add(point, fold, roc_auc(scored, "probability_1", label))

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(fit, [a for a in asked if not store.has(*a)]))
    draws = spark.createDataFrame(list(enumerate(points)), "draw int, point string")
    return draws.join(store.table(asked), "point").select("draw", "fold", "roc_auc")


def cross_validate(
    folded: DataFrame, params: Mapping[str, float], strategy: str = UNWEIGHTED, k: int = d.CV_FOLDS,
    label: str = d.LABEL, parallelism: int = 2, results: str | None = None,
) -> DataFrame:
    """AUC of each fold; see fold_scores."""
    return fold_scores(folded, [params], strategy, k, parallelism, results, label=label).drop("draw")


def cv_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(
        F.round(F.avg("roc_auc"), 6).alias("mean_roc_auc"),
        F.round(F.coalesce(F.stddev_pop("roc_auc"), F.lit(0.0)), 6).alias("std_roc_auc"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "roc_auc"))), lambda s: s["roc_auc"])
        .alias("fold_scores"),
        F.count("*").alias("n_folds"),
    )


def draw_params(
    space: Mapping[str, Sequence] = d.SEARCH_SPACE, draws: int = d.SEARCH_DRAWS, seed: int = d.SEED
) -> list[dict]:
    """Distinct points of the grid, all of it when it is smaller than `draws`: those whose numbers have the least digests.
    Point i has value i % n of the first parameter's n values, then i // n goes on with the next parameter."""
    total = prod(len(v) for v in space.values())
    order = sorted(range(total), key=lambda i: hashlib.md5(f"{seed}-{i}".encode()).hexdigest())
    points = []
    for index in order[:draws]:
        point = {}
        for name, values in space.items():
            index, i = divmod(index, len(values))
            point[name] = values[i]
        points.append(point)
    return points


def selection(scores: DataFrame, candidates: Sequence[Mapping[str, float]]) -> DataFrame:
    """(draw, parameters, mean_roc_auc, std_roc_auc, n_folds, selected): the best mean is selected, of equal ones the
    earliest draw. A row for each draw."""
    names = list(candidates[0])
    drawn = scores.sparkSession.createDataFrame(
        [(i, *[float(p[n]) for n in names]) for i, p in enumerate(candidates)],
        "draw int, " + ", ".join(f"{n} double" for n in names))
    means = scores.groupBy("draw").agg(
        F.round(F.avg("roc_auc"), 6).alias("mean_roc_auc"),
        F.round(F.coalesce(F.stddev_pop("roc_auc"), F.lit(0.0)), 6).alias("std_roc_auc"), F.count("*").alias("n_folds"))
    best = Window.partitionBy().orderBy(F.desc_nulls_last("mean_roc_auc"), "draw")
    return drawn.join(means, "draw").withColumn("selected", F.row_number().over(best) == 1)


def random_search(
    folded: DataFrame, candidates: Sequence[Mapping[str, float]], strategy: str = UNWEIGHTED, k: int = d.CV_FOLDS,
    parallelism: int = 2, results: str | None = None, score: FoldScorer = boosted_fold,
) -> tuple[dict, DataFrame]:
    """(best parameters, the table of `selection`)."""
    scores = fold_scores(folded, candidates, strategy, k, parallelism, results, score)
    table = selection(scores, candidates)
    return dict(candidates[table.where("selected").first()["draw"]]), table


def feature_importance(spark, model: GBTClassificationModel, features: Sequence[str]) -> DataFrame:
    """Importances of the fitted model, one row per feature."""
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")
