import collections

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import mixture
from tests.llm.conftest import prose


def test_targets_are_capped_and_the_excess_is_shared_anew():
    assert mixture.fill_targets([100, 100], [1, 2]) == [200 / 3, 400 / 3]
    targets = mixture.fill_targets([10, 1000, 990], [1, 1, 1])
    assert targets[0] == 30 and targets[1] == targets[2] == 985
    assert mixture.cycle_weights(5) == [1, 2, 3, 1, 2]


def test_tree_keeps_exact_quotas(spark, monkeypatch):
    quotas = np.array([5, 0, 17, 40])
    split = np.array([q for _, _, q in sorted(mixture.split_quotas(quotas, 0, 7), key=lambda x: x[0])])
    assert (split.sum(0) == quotas).all() and (split >= 0).all()
    assert split.sum(1).max() - split.sum(1).min() <= 3
    monkeypatch.setattr(mixture, "NODE_SHARDS", 2)  # the same tree, level by level
    grown = np.zeros((7, 4), int)
    for r in mixture.grow_tree(spark, quotas.tolist(), 7).collect():
        grown[r["shard"], r["key"]] = r["n"]
    assert (grown.sum(0) == quotas).all() and grown.sum(1).max() - grown.sum(1).min() <= 3
    large = np.array([3 * 10**9, 10**9, 7])
    halves = [q for _, _, q in mixture.split_quotas(large, 0, 2)]
    assert (sum(halves) == large).all() and abs(int(halves[0].sum()) - int(halves[1].sum())) < 10


def test_draws_follow_the_hypergeometric_distribution():
    first = [next(iter(mixture.split_quotas(np.array([40, 60]), 2 * i, 2 * i + 2)))[2][0] for i in range(2000)]
    assert abs(np.mean(first) - 20) < 0.25 and abs(np.var(first) - 50 * 0.4 * 0.6 * 50 / 99) < 0.6


def test_running_sums_by_neighbours(spark, monkeypatch):
    monkeypatch.setattr(mixture, "NEIGHBOURS", 3)
    rows = [(k, i, i * 7 % 5) for k in (0, 1) for i in range(20)]
    for r in mixture._running(spark.createDataFrame(rows, "key int, at long, v long"), "at", ["v"]).collect():
        assert r["before_v"] == sum(v for k, i, v in rows if k == r["key"] and i < r["at"])


def test_words_taken_come_near_targets(texts, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK_WORDS", 200)
    docs = texts({i: prose(i, 20 + i % 30) for i in range(300)}).selectExpr(
        "doc_id", "text", "case when doc_id % 3 = 0 then null else concat('s', doc_id % 3) end as source")
    rows = mixture.allot(docs).collect()
    again = mixture.allot(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    taken, target = collections.Counter(), {}
    for r in rows:
        assert r["taken"] == r["size"] * len(r["shards"]) <= 3 * r["size"]
        taken[r["target"]] += r["taken"]
        target[r["target"]] = r["source_size"]
    assert all(abs(t - n) < 50 for t, n in taken.items()) and len(target) == 3
    assert abs(sum(target) - sum(r["size"] for r in rows)) < 1e-6
    mixed = mixture.mix(docs).collect()
    copies = collections.Counter(r["doc_id"] for r in mixed)
    assert copies == {r["doc_id"]: len(r["shards"]) for r in rows if r["shards"]} and max(copies.values()) > 1
    assert any(not r["shards"] for r in rows) and len({r["shard"] for r in mixed}) > 1
    words = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == words[r["doc_id"]] for r in mixed)
    shards = collections.defaultdict(list)
    for r in mixed:
        shards[r["shard"]].append(r["slot"])
    assert all(s == sorted(s) for s in shards.values())


def test_odd_rows(odd, none):
    rows = mixture.allot(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixture.allot(none).collect() == []
    mixed = mixture.mix(odd.withColumn("copy", F.lit("c")).withColumn("slot", F.lit(None))).collect()
    assert collections.Counter(r["doc_id"] for r in mixed) == collections.Counter(
        i for r in rows for i in [r["doc_id"]] * len(r["shards"])) and mixture.mix(none).collect() == []
    assert all(r["score"] == 0.5 for r in mixed)


def test_given_documents_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixture.allot(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    assert (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(
        taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), most=("size", "max"),
        source_size=("source_size", "first")).sort_index()
    assert (abs(by["taken"] - by["target"]) <= by["most"]).all() and (by["size"] == by["source_size"]).all()
    want = mixture.fill_targets(by["size"].tolist(), mixture.cycle_weights(len(by)))
    assert by["target"].tolist() == want
