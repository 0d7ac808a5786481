import random

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import components as stars
from riskloom.llm import decontamination, ngram_join
from riskloom.llm.common import blocks, high_bits, sum_tables
from riskloom.llm.components import components
from tests.llm.conftest import prose


def _plain(values, size, percent):
    sets, root = {}, {}
    for i, text in values.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    ids = sorted(values)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_links_equal_brute_force(texts, size, percent):
    r = random.Random(3)
    base, values = prose(1, 120).split(), {1: None, 2: "", 3: "one two", 4: "ONE two", 5: "two one"}
    for k in range(120):  # chains and a dense group of near copies, at and about the threshold
        words = list(base if k < 80 else prose(k % 5 + 10, 60).split())
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = r.choice("xyz") * r.randrange(1, 4)
        values[100 + k] = " ".join(words[: len(words) - r.randrange(10)])
    values |= {300 + k: prose(99, 40) + " " + prose(200 + k, 60) for k in range(20)}  # a shared passage
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"])
           for x in ngram_join.link_documents(texts(values), size, percent / 100).collect()}
    assert got == _plain(values, size, percent)


def test_links_of_odd_rows(odd, none):
    rows = ngram_join.link_documents(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[7]["component_id"] == 6 and by[5]["component_id"] == 4 and by[1]["component_id"] == 1
    assert by[None]["component_id"] is None and by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert ngram_join.link_documents(none).collect() == []


def test_one_id_with_several_texts_ties_them(spark):
    rows = [(1, prose(1)), (2, prose(2)), (3, prose(1)), (3, prose(2)), (4, prose(2) + " more"), (5, prose(3)), (5, prose(3))]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.link_documents(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}


@pytest.mark.parametrize("limit", [1, 10_000])
def test_hot_texts(texts, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "HOT_TEXTS", limit)
    values = {i: prose(7) for i in range(50)} | {100 + i: prose(7) + f" w{i}" for i in range(30)} | {200 + i: prose(i + 50) for i in range(5)}
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(texts(values)).collect()}
    assert got == {i: 0 if i < 200 else i for i in values}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(500, 500 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {500 + i: 500 for i in range(30)}


def _jobs(spark, group, run):
    """What `run` returns, and how many jobs it took."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


@pytest.mark.parametrize("most", [0, 40, 200_000])
def test_components_by_rounds_and_in_one_task_are_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(stars, "TASK_EDGES", most or 7)
    rng = random.Random(most)
    edges = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(120)] + [(5, 5), (None, 3), (9, 10), (10, 9)]
    known = {x: x for a, b in edges if a is not None and a != b for x in (a, b)}
    for _ in known:
        for a, b in edges:
            if a in known and b in known:
                known[a] = known[b] = min(known[a], known[b])
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == known
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == []


def test_a_long_chain_of_few_edges_takes_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    got, jobs = _jobs(spark, "chain", lambda: components(edges).collect())
    assert {r["component"] for r in got} == {0} and len(got) == 301
    assert jobs <= 6  # rounds took several each


def test_a_job_does_not_come_with_every_part_of_few_items(spark, texts):
    items = spark.createDataFrame([(i, prose(700 + i, 40)) for i in range(60)], "item_id long, text string")
    docs = texts({i: prose(700 + i, 90) for i in range(0, 60, 3)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found, jobs = _jobs(spark, "items", lambda: decontamination.find(docs, items.repartition(8)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert jobs < 20
    assert {r["item_id"] for r in found.collect()} == set(range(0, 60, 3))


@pytest.mark.parametrize("few", [5, 10_000])
def test_items_in_parts_and_in_one_give_the_same(spark, texts, monkeypatch, few):
    monkeypatch.setattr(decontamination, "SORTED_ITEMS", few)
    items = spark.createDataFrame([(i % 20, prose(700 + i, 40)) for i in range(25)] + [(None, "one two")], "item_id long, text string")
    found = decontamination.find(texts({i: prose(700 + i, 90) for i in range(25)}), items.repartition(5)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i % 20) for i in range(25)}


def test_bits_of_sums_equal_the_sums_above_the_limit(spark):
    def count(batches):
        table = np.zeros(1000, np.uint8)
        for batch in batches:
            np.add.at(table, batch.column("at").to_numpy(), 1)
        return table

    rng = random.Random(1)
    rows = spark.createDataFrame([(min(int(rng.expovariate(0.01)), 799),) for _ in range(2000)], "at int").repartition(3)
    sums = sum_tables(rows, count, (1000,), "uint8", chunk=64)
    for limit in (lambda mean: 0, lambda mean: mean + 2):
        want = np.packbits(sums > limit(float(sums.mean())))
        assert want.any() and (high_bits(rows, count, 1000, "uint8", limit, chunk=64) == want).all()
    assert not high_bits(rows.where("at < 0"), count, 1000, "uint8", lambda mean: mean, chunk=64).any()


def test_the_driver_gets_no_table_of_counters(texts, monkeypatch):
    got, plain = [], np.frombuffer
    monkeypatch.setattr(np, "frombuffer", lambda x, *a, **b: got.append(len(x)) or plain(x, *a, **b))
    bits = ngram_join._frequent(texts({i: prose(i) for i in range(30)}), 5)
    assert len(bits) == ngram_join.COUNTERS // 8 and sum(got) <= len(bits)  # counters took four bytes each


def test_leaks_are_found(spark, texts, odd, none):
    items = {k: prose(1000 + k, 15 + 3 * k) for k in range(12)}
    r = random.Random(5)
    values = {i: prose(i, 150) for i in range(60)}
    for k, item in items.items():
        words = item.split()
        reworded = [w if r.random() > 0.12 else "zz" for w in words]
        values[100 + k] = prose(300 + k, r.randrange(100)) + " " + item.upper() + ". " + prose(400 + k, 70)
        values[200 + k] = prose(500 + k, r.randrange(100)) + " " + ", ".join(reworded) + " " + prose(600 + k, 70)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.find(texts(values), bench).collect()}
    exact, near = {(100 + k, k) for k in items}, {(200 + k, k) for k in items}
    assert exact <= got <= exact | near and len(got & near) >= 0.8 * len(near)
    assert decontamination.find(none, bench).collect() == decontamination.find(odd, bench.limit(0)).collect() == []
    more = bench.unionByName(spark.createDataFrame([(None, None), (99, "")], bench.schema)).withColumn("doc_id", bench["item_id"])
    assert decontamination.clean(odd, more).count() == odd.count()


def test_blocks_of_items_give_the_same(spark, texts, monkeypatch):
    items = {k: prose(1000 + k, 30) for k in range(7)}
    docs = texts({k: prose(k, 40) + " " + t for k, t in items.items()})
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 3)
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.find(docs, bench).collect()} == {(k, k) for k in items}


def test_many_items_take_one_scan(spark, texts, monkeypatch):
    items = {k: prose(40_000 + k, 40) for k in range(1600)}
    docs = texts({k: prose(50_000 + k, 20) + " " + items[k] for k in range(0, 1600, 40)} | {5000 + k: prose(k, 60) for k in range(30)})
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontamination.find(docs, bench)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {(k, k) for k in range(0, 1600, 40)}
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want
    monkeypatch.setattr(decontamination, "HELD_BYTES", 1)  # a scan for each block
    again = decontamination.find(docs, bench)
    assert again._jdf.queryExecution().executedPlan().toString().count("MapInArrow") > 3
    assert {(x["doc_id"], x["item_id"]) for x in again.collect()} == want


def test_blocks_of_a_given_size_keep_every_text_whole():
    given = [None, "a" * 30, "", "b" * 99, "c", "d" * 12, None, "e" * 40, "f" * 500]
    parts = list(blocks(iter([pa.RecordBatch.from_pydict({"text": pa.array(given, pa.string())})] * 2), size=50))
    assert [x for p in parts for x in p.column("text").to_pylist()] == given * 2
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()[1:]) <= 50 for p in parts)
    assert decontamination.TEXT_BYTES < 1 << 20  # the arrays of a block stay in a core's cache


def test_repeated_items(spark, texts):
    docs = texts({1: prose(1, 50) + " " + prose(2, 30), 2: prose(3, 60)})
    bench = spark.createDataFrame([(7, prose(2, 30)), (7, prose(2, 30)), (7, prose(4, 30))], "item_id long, text string")
    assert [(x["doc_id"], x["item_id"]) for x in decontamination.find(docs, bench).collect()] == [(1, 7)] * 2


def test_every_copy_of_a_large_benchmark_is_found(spark, texts):
    items = {k: prose(5000 + k, 100) for k in range(520)}
    docs = texts({k: prose(7000 + k, k % 40) + " " + t for k, t in items.items()})
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.find(docs, bench).collect()} == {(k, k) for k in items}


def test_an_item_in_a_third_of_all_documents_is_found(spark, texts):
    items = {k: prose(9000 + k, n) for k, n in enumerate((15, 33, 100))}  # the words around a copy are all rare
    held = set(range(0, 180, 3))
    docs = texts({i: prose(10_000 + i, 40 + i % 29) + (f" {items[0]} {items[1]} {items[2]} " if i in held else " ")
                  + prose(20_000 + i, 50) for i in range(180)})
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.find(docs, bench).collect()} == {
        (i, k) for i in held for k in items}
