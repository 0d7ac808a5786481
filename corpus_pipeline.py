"""From raw documents to a training mixture: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontamination, mixture, ngram_join, quality_rank, secret_scan
from riskloom.llm.common import discard, read, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels that are not held out, does not reject."""
    labels = read(spark, sf_dir, "labels").where(~quality_rank.held_out())
    scored = quality_rank.score(docs, quality_rank.learn(docs, labels))
    return scored.where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles the document with the least id, and all rows without an id."""
    linked = ngram_join.link_documents(docs, size=5, threshold=0.8)
    gone = linked.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in a text replaced and its length counted anew."""
    return secret_scan.redact(docs, secret_scan.train(spark, docs), length="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document for each copy taken, with its shard and its place there. What the targets cut is left out."""
    return mixture.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", secrets),
    ("mixing sources", mixed),
]
#: SQL expresses neither the fitted models nor the drawn mixture; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "stage")
        if last is not None:
            discard(last)  # nothing reads a stage's documents once the next ones are written
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
