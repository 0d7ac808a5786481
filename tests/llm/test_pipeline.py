from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import decontamination, mixture, ngram_join, quality_rank
from riskloom.llm.common import read, words

SF = "/root/testdata/sf0.001"


def test_stages_decide_as_their_operators(spark, tmp_path):
    docs = read(spark, SF, "documents")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            scored = quality_rank.classify(before, read(spark, SF, "labels"))
            assert set(kept[0]) == {r["doc_id"] for r in scored.where("predicted = 1").collect()}
        if i == 1:
            links = ngram_join.link_documents(before, 5, 0.8).collect()
            assert set(kept[1]) == {r["doc_id"] for r in links if r["doc_id"] == r["component_id"]}
        if i == 2:
            held = {r["doc_id"] for r in decontamination.find(before, read(spark, SF, "benchmark")).collect()}
            assert held and set(kept[2]) == set(kept[1]) - held
        if i == 3:
            assert docs.where("text rlike '(?i)token\\\\s*=\\\\s*.?[0-9a-f]{24}'").count() == 0
        if i == 4:
            told = {r["doc_id"]: len(r["shards"]) for r in mixture.allot(before).collect()}
            assert kept[4] == Counter({d: n for d, n in told.items() if n})
            assert set(docs.columns) == {*columns, "copy", "shard", "slot"}
            sizes = before.withColumn("size", F.size(words(F.col("text")))).groupBy("source").agg(F.sum("size").alias("n"))
            mixed = docs.withColumn("size", F.size(words(F.col("text")))).groupBy("source").agg(F.sum("size").alias("m"))
            ratio = {r["source"]: r["m"] / r["n"] for r in sizes.join(mixed, "source").collect()}
            assert min(ratio.values()) < 0.9 and max(ratio.values()) > 1.5
    assert kept[3] == kept[2] and max(kept[4].values()) > 1 and set(kept[4]) < set(kept[3])


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.select("doc_id", "copy", "shard", "text").collect()
    assert rows and len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and all(r["text"] for r in rows)


def test_stages_bear_odd_rows(spark, odd, none):
    for table in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, SF).count() <= table.count() * (mixture.MOST_REPEATS if stage is corpus_pipeline.mixed else 1)
