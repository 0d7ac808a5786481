"""Connected components by alternating large and small stars, until one task holds the edges that are left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import Scratch, discard, store

#: Edges for each task of a round. A round's tasks follow its edges, not the session's shuffle partitions. So many edges
#: or fewer need no rounds, whose jobs and plans cost the driver more than the edges: one task unites them.
TASK_EDGES = 200_000


def _seen(edges: DataFrame):
    """Count and two order-free digests of a stored table of edges."""
    pair = F.xxhash64("node", "other")
    return edges.agg(F.count("*").alias("n"), F.sum(pair % 1000003).alias("s"),
                     F.bit_xor(F.xxhash64("other", "node")).alias("x")).first()


def _united(edges: DataFrame) -> DataFrame:
    """(node, component) of at most TASK_EDGES edges, in one task. The lesser of two roots becomes that of both."""
    kind = edges.schema["node"].dataType

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for a, b in zip(*[batch.column(c).to_pylist() for c in ("node", "other")]):
                low, high = sorted((root(a), root(b)))
                above[high] = low
        if above:
            own = batch.column("node").type
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(above), own), pa.array([root(x) for x in above], own)], ["node", "component"])

    return edges.select("node", "other").coalesce(1).mapInArrow(unite, T.StructType(
        [T.StructField("node", kind), T.StructField("component", kind)]))


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node in `edges` (a, b): the least node reachable. Null ends and loops are ignored.

    While the edges are more than one task takes, each round links larger neighbours to the least one (large star), then
    smaller ones (small star); the number of rounds grows with the logarithm of the longest chain. The work per round is
    linear in the edges, and a node's rows stream through one sorted window. The edges of each round are written to shared
    storage, those of the round before are removed, and the last ones go with `scratch`.
    """
    now = store(edges.where("a <> b").select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct(), "edges")
    at_node = Window.partitionBy("node")
    seen = _seen(now)
    settled = False
    while seen["n"] > TASK_EDGES and not settled:
        tasks = -(-seen["n"] // TASK_EDGES)
        both = now.unionByName(now.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = both.repartition(tasks, "node").withColumn(
            "low", F.least("node", F.min("other").over(at_node))).where("other > node").select(
            F.col("other").alias("node"), F.col("low").alias("other"))
        small = large.repartition(tasks, "node").withColumn("low", F.min("other").over(at_node)).select(F.explode(F.array(
            F.struct(F.col("other").alias("node"), F.col("low").alias("other")),
            F.struct("node", F.col("low").alias("other")))).alias("e")).select("e.*").where("node <> other")
        after = store(small.repartition(tasks, "node").dropDuplicates(["node", "other"]), "edges")
        last, seen = seen, _seen(after)
        discard(now)
        now, settled = after, seen == last
    if scratch:
        scratch.tables.append(now)
    if not settled:
        return _united(now)
    roots = now.select(F.col("other").alias("node")).distinct()
    return now.select("node", F.col("other").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
