import hashlib

import pytest
from pyspark.sql import functions as F

from riskloom.operators import sampling


def table(spark, n=500, positives=70):
    return spark.range(n).selectExpr("id as SK_ID_CURR", f"cast(id < {positives} as int) as TARGET")


def test_split_is_exact_and_reproducible(spark):
    df = table(spark)
    train, test = sampling.stratified_split(df)
    assert (train.count(), test.count()) == (400, 100)
    assert test.agg(F.sum("TARGET")).first()[0] == 14
    assert train.join(test, "SK_ID_CURR").count() == 0
    again = sampling.stratified_split(df.repartition(7))[1]
    assert {r[0] for r in again.collect()} == {r[0] for r in test.collect()}
    other = sampling.stratified_split(df, seed=7)[1]
    assert {r[0] for r in other.collect()} != {r[0] for r in test.collect()}


def test_split_takes_the_smallest_digests(spark):
    got = {r.SK_ID_CURR for r in sampling.stratified_split(table(spark))[1].collect()}
    for label, quota in ((1, 14), (0, 86)):
        ids = [i for i in range(500) if (i < 70) == bool(label)]
        ids.sort(key=lambda i: hashlib.md5(f"42-{i}".encode()).hexdigest())
        assert set(ids[:quota]) <= got


@pytest.mark.parametrize("counts,size,want", [
    ({0: 10, 1: 10}, 0.25, {0: 3, 1: 2}), ({0: 9, 1: 2}, 0.2, {0: 2, 1: 1}), ({0: 13229, 1: 1771}, 0.2, {0: 2646, 1: 354}),
])
def test_quotas_add_up(counts, size, want):
    assert sampling.split_quotas(counts, size) == want


def test_split_errors(spark):
    with pytest.raises(ValueError, match="at least 2"):
        sampling.stratified_split(table(spark, 50, 1))
    with pytest.raises(ValueError, match="without NULLs"):
        sampling.stratified_split(spark.createDataFrame([(1, 0), (2, None)], "SK_ID_CURR int, TARGET int"))
    with pytest.raises(ValueError, match="column required"):
        sampling.stratified_split(spark.range(5).withColumnRenamed("id", "SK_ID_CURR"))


def test_folds_balance_classes(spark):
    got = sampling.stratified_folds(table(spark, 203, 43)).groupBy("TARGET", "fold").count().toPandas()
    for _, part in got.groupby("TARGET"):
        assert len(part) == 5 and part["count"].max() - part["count"].min() <= 1


def test_sample_size_is_exact(spark):
    df = table(spark)
    assert sampling.sample_rows(df, 37).count() == 37
    assert sampling.sample_rows(df, 10_000).count() == 500
    assert sampling.sample_rows(df, 0).count() == 0


def test_a_third_of_rows_share_one_key(spark):
    """Cuts inside a run of equal keys still give exact sizes, and nothing is lost."""
    df = spark.range(900).selectExpr("if(id % 3 = 0, 7, id) as SK_ID_CURR", "cast(id % 2 as int) as TARGET", "id as row")
    for seed in range(3):
        parts = sampling.split_flag(df, 0.3, seed=seed)
        counts = {(r.TARGET, r.is_test): r["count"] for r in parts.groupBy("TARGET", "is_test").count().collect()}
        assert counts == {(0, True): 135, (0, False): 315, (1, True): 135, (1, False): 315}
        assert parts.select("row").distinct().count() == 900
    folds = sampling.stratified_folds(df).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [180] * 5


def test_rows_without_a_key_are_kept(spark):
    df = spark.range(100).selectExpr("if(id < 40, null, id) as SK_ID_CURR", "0 as TARGET", "id as row")
    assert sampling.sample_rows(df, 25).count() == 25
    parts = sampling.split_flag(df, 0.2)
    assert parts.where("is_test").count() == 20 and parts.select("row").distinct().count() == 100
