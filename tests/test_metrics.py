import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from riskloom.operators import metrics


def frame(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gap = pos[:, None] - neg[None, :]
    return ((gap > 0).sum() + 0.5 * (gap == 0).sum()) / gap.size


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    y = (rng.random(3000) < 0.3).astype(int)
    p = np.round(np.clip(0.3 * y + rng.random(3000) * 0.7, 0, 1), 3)
    p[:1000] = 0.5  # a third of the rows share one score
    return y, p


@pytest.mark.parametrize("per_bucket", [100_000, 40])
def test_ladder_is_the_same_in_one_or_many_buckets(spark, data, per_bucket):
    y, p = data
    rows = metrics.score_ladder(frame(spark, y, p), "p", "y", per_bucket=per_bucket).orderBy("score").collect()
    values = np.unique(p)
    assert [r.score for r in rows] == list(values)
    for r in rows[::50] + rows[-2:]:
        assert r.tp == ((p >= r.score) & (y == 1)).sum() and r.fp == ((p >= r.score) & (y == 0)).sum()
    for a, b in zip(rows[1:], rows):
        assert (a.next_pos, a.next_neg) == (b.pos, b.neg)
    assert rows[0].next_pos is None


def test_auc_matches_pairs_and_mllib(spark, data, monkeypatch):
    y, p = data
    df = frame(spark, y, p)
    want = round(brute_auc(y, p), 6)
    assert metrics.roc_auc(df, "p", "y").first().roc_auc == want
    monkeypatch.setattr(metrics, "STEPS_PER_BUCKET", 50)
    assert metrics.roc_auc(df, "p", "y").first().roc_auc == want
    e = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    assert e.evaluate(df) == pytest.approx(want, abs=1e-6)


def test_auc_per_group(spark, data):
    y, p = data
    df = frame(spark, y, p).selectExpr("*", "if(p < 0.5, 'low', 'high') g")
    got = {r.g: r.roc_auc for r in metrics.roc_auc(df, "p", "y", ["g"]).collect()}
    assert got == {"low": round(brute_auc(y[p < 0.5], p[p < 0.5]), 6), "high": round(brute_auc(y[p >= 0.5], p[p >= 0.5]), 6)}


def test_average_precision_textbook(spark):
    r = metrics.average_precision(frame(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]), "p", "y").first()
    assert r.average_precision == 0.833333 and r.prevalence == 0.5


def test_curves(spark):
    df = frame(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    roc = [(r.threshold, r.fpr, r.tpr) for r in metrics.roc_curve(df, "p", "y", False).orderBy("threshold", ascending=False).collect()]
    assert roc == [(float("inf"), 0, 0), (0.8, 0, 0.5), (0.4, 0.5, 0.5), (0.35, 0.5, 1.0), (0.1, 1.0, 1.0)]
    straight = frame(spark, [1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1])
    kept = {r.threshold for r in metrics.roc_curve(straight, "p", "y").collect()}
    assert kept == {float("inf"), 0.8, 0.1}
    pr = {(r.threshold, r.precision, r.recall) for r in metrics.pr_curve(df, "p", "y").collect()}
    assert (None, 1.0, 0.0) in pr and (0.8, 1.0, 0.5) in pr and (0.1, 0.5, 1.0) in pr


def test_metrics_and_zero_division(spark):
    r = metrics.classification_metrics(frame(spark, [0, 1, 1, 0], [0.6, 0.7, 0.2, 0.5]), "p", "y").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 2, 1, 0) and r.precision == 0.333333 and r.recall == 0.5 and r.f1_score == 0.4
    r = metrics.classification_metrics(frame(spark, [0, 1], [0.1, 0.2]), "p", "y").first()
    assert (r.precision, r.recall, r.f1_score) == (0, 0, 0) and r.roc_auc == 1.0


def test_confusion_percentages(spark):
    got = {(r.actual, r.predicted): (r.n, r.pct) for r in metrics.confusion_matrix(frame(spark, [0, 1, 1, 0], [0.6, 0.7, 0.2, 0.5]), "p", "y").collect()}
    assert got == {(0, 1): (2, 50.0), (1, 1): (1, 25.0), (1, 0): (1, 25.0)}
