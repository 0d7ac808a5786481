"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by the hash of its rows, a permutation. A source's quota is so many passes over all of
its blocks and part of one more. A tree of draws splits the exact block quotas of all sources among the output shards;
each source then deals its permuted blocks, so shards are disjoint, and every shard is shuffled on its own.

Blocks and shards keep their size however large the corpus is: the tree grows level by level as a table, a task splitting
its nodes many ways, and blocks meet shards by a join. The driver gets one row for each source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Scratch, text_of

#: A source's words never come more often than this.
MOST_REPEATS = 3
#: Words of a block, at most (on average), and blocks in an output shard.
BLOCK_WORDS, SHARD_BLOCKS = 50_000, 16
#: Shards under a node that a task splits to the end, and neighbours whose running sums one task takes.
NODE_SHARDS, NEIGHBOURS = 1024, 1024
SEED = 11


def cycle_weights(n: int) -> list[int]:
    """Weights 1, 2, 3, repeating, of n sources in code point order."""
    return [1 + i % 3 for i in range(n)]


def fill_targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of the whole by weight; none above MOST_REPEATS times its source, the excess shared anew by weight."""
    targets, full = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        left = sum(sizes) - sum(t for t, f in zip(targets, full) if f)
        free = sum(w for w, f in zip(weights, full) if not f)
        for i, f in enumerate(full):
            if not f:
                targets[i] = left * weights[i] / free
        above = [i for i, f in enumerate(full) if not f and targets[i] > MOST_REPEATS * sizes[i]]
        if not above:
            return targets
        for i in above:
            targets[i], full[i] = float(MOST_REPEATS * sizes[i]), True


def split_quotas(quotas: np.ndarray, low: int, high: int, least: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, quotas) of the nodes with at most `least` shards under the node of shards low to high.

    A node draws its left half's blocks without replacement from its own. The draw depends on the node alone, so a tree
    grown by many tasks, or once more, is the same.
    """
    todo = [(low, high, quotas)]
    while todo:
        a, b, have = todo.pop()
        if b - a <= least:
            yield a, b, have
            continue
        middle = (a + b) // 2
        rng = np.random.default_rng((SEED, a, b))
        share = int(have.sum()) * (middle - a) // (b - a)
        # the generator takes up to 10^9 of each kind at a time; larger quotas are drawn in equal parts
        parts = int(have.sum()) // 900_000_000 + 1
        drawn = sum(rng.multivariate_hypergeometric(
            have * (i + 1) // parts - have * i // parts, min(
                share * (i + 1) // parts - share * i // parts,
                int((have * (i + 1) // parts - have * i // parts).sum())), method="marginals") for i in range(parts))
        todo += [(middle, b, have - drawn), (a, middle, drawn)]


def grow_tree(spark, quotas: list[int], shards: int) -> DataFrame:
    """(shard, key, n): the blocks that each shard takes from each source."""
    kinds = "low long, high long, quotas array<long>"

    def split(least_of):
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, have in zip(*[c.to_pylist() for c in batch.columns]):
                    held = list(split_quotas(np.array(have, np.int64), low, high, least_of(high - low)))
                    for i in range(0, len(held), 1024):
                        a, b, q = zip(*held[i: i + 1024])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                             pa.array([x.tolist() for x in q], pa.list_(pa.int64()))], ["low", "high", "quotas"])
        return own

    nodes, width = spark.createDataFrame([(0, shards, [int(q) for q in quotas])], kinds), shards
    while width > 1:  # a round for every factor of NODE_SHARDS
        nodes = nodes.repartition("low").mapInArrow(split(lambda n: max(1, -(-n // NODE_SHARDS))), kinds)
        width = -(-width // NODE_SHARDS)
    return nodes.select(F.col("low").alias("shard"), F.posexplode("quotas").alias("key", "n")).where("n > 0")


def _running(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Add `before_` columns: sums of `values` over the rows of the same key that come before in `order`, whole numbers.

    Neighbours are summed first, then their sums, so no task goes through all rows of a key.
    """
    near = df.withColumn("_near", F.floor(F.col(order) / NEIGHBOURS).cast("long"))
    before = Window.partitionBy("key").orderBy("_near").rowsBetween(Window.unboundedPreceding, -1)
    sums = near.groupBy("key", "_near").agg(*[F.sum(v).alias(f"_{v}") for v in values]).select(
        "key", "_near", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("key", "_near").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return near.join(sums, ["key", "_near"]).withColumns({
        f"before_{v}": F.col(f"_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).drop(
        "_near", *[f"_{v}" for v in values])


def _permuted(doc_id: str) -> Column:
    return F.xxhash64(F.lit(SEED), F.col(doc_id))


def _block(bits: Column) -> Column:
    """The leading bits of the permutation's hash, signed order made unsigned."""
    return F.when(bits == 0, F.lit(0)).otherwise(
        F.expr("shiftright(place, 64 - bits)") + F.expr("shiftleft(1L, bits - 1)")).cast("long")


def _allot(docs: DataFrame, weights, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    rows = scratch.store(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.xxhash64(text_of()).alias("content"),
    ).withColumn("place", _permuted("doc_id")), "sizes")
    totals = [(r["source"], r["size"] or 0) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    totals.sort(key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [n for _, n in totals]
    targets = fill_targets(sizes, weights(len(sizes))) if sum(sizes) else [0.0] * len(sizes)
    bits = [max(0, math.ceil(math.log2(max(1, n / BLOCK_WORDS)))) for n in sizes]
    passes = [int(t // n) if n else 0 for t, n in zip(targets, sizes)]
    plan = [(s, i, bits[i], n, targets[i], passes[i], targets[i] - passes[i] * n) for i, (s, n) in enumerate(totals)]
    sources = spark.createDataFrame(
        plan, "_source string, key int, bits int, source_size long, target double, passes int, due double")
    known = F.broadcast(sources)  # a row for each source
    rows = rows.join(known.drop("passes", "due"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("block", _block(F.col("bits")))

    # blocks in order; the pass that is not whole takes them up to the words that are due
    blocks = rows.groupBy("key", "block").agg(F.sum("size").alias("n")).withColumn("one", F.lit(1).cast("long"))
    blocks = _running(blocks, "block", ["n", "one"]).join(known.select("key", "passes", "due"), "key").select(
        "key", "block", F.col("before_one").alias("rank"), "passes", (F.col("before_n") < F.col("due")).alias("extra"),
        (F.col("due") - F.col("before_n")).alias("rest"), (F.col("before_n") + F.col("n") > F.col("due")).alias("over"))
    blocks = scratch.store(blocks, "blocks")
    counted = {r["key"]: r for r in blocks.groupBy("key").agg(
        F.count("*").alias("n"), F.count_if("extra").alias("extra")).collect()}
    counts = [counted[i]["n"] for i in range(len(sizes))]
    quotas = [passes[i] * counts[i] + counted[i]["extra"] for i in range(len(sizes))]

    # the tree says how many blocks a shard takes from a source, the source's order which ones
    shards = max(1, -(-sum(quotas) // SHARD_BLOCKS))
    dealt = _running(grow_tree(spark, quotas, shards), "shard", ["n"]).select(
        "key", "shard", F.explode(F.sequence("before_n", F.col("before_n") + F.col("n") - 1)).alias("unit"))
    number = spark.createDataFrame(list(enumerate(counts)), "key int, of long")
    copies = F.sequence(F.lit(0), F.col("passes") + F.col("extra").cast("int") - 1)
    units = blocks.join(F.broadcast(number), "key").where("passes > 0 or extra").select(
        "key", "block", "rank", "of", F.explode(copies).alias("copy")).withColumn(
        "unit", F.col("copy") * F.col("of") + F.col("rank"))
    taken = units.join(dealt, ["key", "unit"]).groupBy("key", "block").agg(F.transform(F.array_sort(
        F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))  # at most MOST_REPEATS + 1
    told = blocks.select("key", "block", (F.col("extra") & F.col("over")).alias("edge"), "rest").join(
        taken, ["key", "block"], "left")
    rows = scratch.store(rows.join(told, ["key", "block"]), "told")

    # the one block of a source that is taken in part: its documents in permuted order up to what is due, then the one
    # document that comes nearest to the words still missing, if that is nearer than without it
    upto = Window.partitionBy("key").orderBy("place", "doc_id", "size", "content").rowsBetween(
        Window.unboundedPreceding, 0)
    part = rows.where("edge and size > 0").withColumn("sum", F.sum("size").over(upto))
    part = part.withColumn("last", F.col("sum") <= F.col("rest"))
    part = part.withColumn("miss", F.col("rest") - F.coalesce(
        F.max(F.when(F.col("last"), F.col("sum"))).over(Window.partitionBy("key")), F.lit(0)))
    nearest = Window.partitionBy("key").orderBy("last", F.abs(F.col("size") - F.col("miss")), "place", "doc_id", "content")
    part = part.withColumn("best", F.row_number().over(nearest) == 1)
    part = part.withColumn("last", F.col("last") | (
        F.col("best") & (F.abs(F.col("size") - F.col("miss")) < F.col("miss")))).drop("miss", "best")
    rest = rows.where("not edge or size = 0").withColumn("last", ~F.col("edge"))
    whole = part.drop("sum").unionByName(rest)
    chosen = F.coalesce("shards", F.array().cast("array<long>"))
    chosen = F.when(F.col("last"), chosen).otherwise(F.slice(chosen, F.lit(1), F.greatest(F.size(chosen) - 1, F.lit(0))))
    return whole.withColumn("shards", chosen).select(
        "doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).alias("taken"), "shards", "content", "source")


def allot(docs: DataFrame, weights=cycle_weights) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (one for each copy taken) for every row of `docs`.

    A size is the number of words; null and empty texts have none and are taken without cost. A null source is a
    source of its own, the last. The words taken from a source come within one document of its target. An empty
    table gives no rows; without words all targets are 0. Repeated rows are rows of their own. Sources are few, as
    their weights are set by hand: the driver gets a row for each.
    """
    return _allot(docs, weights, Scratch()).drop("content", "source")


def mix(docs: DataFrame, weights=cycle_weights) -> DataFrame:
    """The mix itself: a row with all columns of `docs` for each copy taken, with copy, shard and slot.

    Rows come in shards, each shuffled by slot; a shard has about SHARD_BLOCKS * BLOCK_WORDS words, so one task takes it
    whole. Documents that are not taken are not in the mix. Columns named copy, shard or slot are replaced.
    """
    own = [c for c in docs.columns if c not in ("copy", "shard", "slot")]
    free = "_" * (1 + max(map(len, docs.columns), default=0))  # no column is called so
    key = [free + c for c in ("id", "content", "number")]
    # rows that repeat both id and text are told apart by number, whichever of them is which
    held = docs.select(*[F.col(f"`{c}`") for c in own], F.col("doc_id").cast("long").alias(key[0]),
                       F.xxhash64(text_of()).alias(key[1]))
    taken = _allot(docs, weights, Scratch()).select(
        F.col("doc_id").alias(key[0]), F.col("content").alias(key[1]), "source", "shards")
    same = Window.partitionBy(*key[:2]).orderBy("source")
    held, taken = (t.withColumn(key[2], F.row_number().over(same)) for t in (held, taken))
    taken = taken.where(F.size("shards") > 0).select(*[F.col(k).alias(k + "_") for k in key], "shards")
    both = held.join(taken, F.col(key[0]).eqNullSafe(F.col(key[0] + "_")) & (F.col(key[1]) == F.col(key[1] + "_"))
                     & (F.col(key[2]) == F.col(key[2] + "_")))
    copies = both.select(*[F.col(f"`{c}`") for c in own], key[0], F.posexplode(taken["shards"]).alias("copy", "shard"))
    copies = copies.withColumn("slot", F.xxhash64(key[0], "copy", "shard", F.lit(SEED))).drop(key[0])
    return copies.repartition("shard").sortWithinPartitions("shard", "slot")
