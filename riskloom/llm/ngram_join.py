"""N-gram Jaccard join by vertical partitioning: the global n-gram order is cut into fragments, and the overlap of a
pair is counted in each fragment on its own and summed.

The order of n-grams is (frequent or not, hash). Frequent ones come last, so a passage that many documents share does
not bring them together. The prefix of each set in that order names the pairs. The overlap in the quarter of the n-grams
with the least hashes bounds the whole one and rules most pairs out. For pairs that are left, both sets are cut by ranges of
the hash; fragments meet by (set, range), in as many tasks as a pair has fragments, and their overlaps are summed.
Every bound is exact: no linked pair is lost. Pairs that are already connected are not compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Scratch, blocks, discard, high_bits, mix, shingle_sets, store, text_of
from riskloom.llm.components import components

#: Counters of the frequency sketch; it costs each task so many bytes, and the driver one bit each.
COUNTERS = 1 << 22
#: An n-gram counts as frequent beyond so many occurrences more than an average counter holds.
FREQUENT = 48
#: Independent least hashes by which members of dense groups first meet a centre.
STARS = 4
#: The first fragment: n-grams with a hash below this, told by 16 bits of it, which can only raise the bound.
FRAGMENT = np.uint64(2**64 // 4)
#: Ranges of the hash by which the sets of a pair are compared; a power of two.
RANGES = 8
#: Pairs whose fragments one task compares. The tasks follow the pairs, not the session's shuffle partitions.
TASK_PAIRS = 2000
#: Texts with more copies than one in so many rows are told by a broadcast table, which has no more rows than that.
HOT_TEXTS = 10_000
#: Centres with more pairs than one in so many are compared in several tasks, their set copied to each.
HOT_CENTRES = 1000
#: A set is told by its document and a tag, as one doc_id may have several texts.
_SETS = ("doc_id long, n int, rare int, digest binary, tag int, stars array<long>, prefix array<long>, inner int, "
         "sketch array<smallint>")


def _ratio(threshold: float) -> tuple[int, int]:
    """The threshold as whole per cents, so that 100 * overlap >= t * union is decided without rounding."""
    return round(threshold * 100), 100


def _frequent(docs: DataFrame, size: int) -> np.ndarray:
    """Which counters of a sketch over all n-grams of all documents are high, as bytes of bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table, waiting, rows = np.zeros(COUNTERS, np.uint8), [], 0

        def add() -> None:
            at, n = np.unique(np.concatenate(waiting) & np.uint64(COUNTERS - 1), return_counts=True)
            table[at] = np.minimum(table[at] + n, 255)

        for block in blocks(batches):
            for s in shingle_sets(block.column("text"), size):
                waiting.append(s)
                rows += len(s)
                if rows > 1_000_000:
                    add()
                    waiting, rows = [], 0
        if waiting:
            add()
        return table

    return high_bits(docs.select("text"), count, COUNTERS, "uint8", lambda mean: mean + max(FREQUENT, 8 * math.sqrt(mean)))


def _tag(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "big", signed=True)


def _sets(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """One narrow row for each document: size of its set, digest, prefix and the sketch of the first fragment."""
    t, whole = _ratio(threshold)
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, size))  # COUNTERS bits
    seeds = mix(np.arange(1, STARS + 1, dtype=np.uint64))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        bits = frequent.value
        for block in blocks(batches):
            rows = []
            for doc, s in zip(block.column("doc_id").to_pylist(), shingle_sets(block.column("text"), size)):
                n, at = len(s), s & np.uint64(COUNTERS - 1)
                often = (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7)))) & np.uint64(1) > 0
                rare = s[~often]
                order = np.concatenate((rare, s[often]))
                inner = s[: np.searchsorted(s, FRAGMENT)]
                digest = hashlib.sha256(s.tobytes()).digest() if n else None
                rows.append((
                    doc, n, len(rare), digest, _tag(digest) if n else None,
                    [mix(s ^ x).min().astype(np.int64) for x in seeds] if n else [],
                    order[: n - -(-t * n // whole) + 1 if n else 0].view(np.int64), len(inner),
                    (inner & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)))
            names = [f.split()[0] for f in _SETS.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()),
                     pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int16())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds],
                names)

    return docs.mapInArrow(describe, _SETS)


def _needed(n_a: Column, n_b: Column, threshold: float) -> Column:
    """The least overlap of linked sets of these sizes: 100 o >= t (a + b - o)."""
    t, whole = _ratio(threshold)
    return F.ceil((n_a + n_b) * F.lit(t) / F.lit(t + whole) - F.lit(1e-9))


def _marked(ids: DataFrame) -> np.ndarray:
    """Bits of a fixed table, set where the hash of an id falls; an id whose bit is not set is not among `ids`."""

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(COUNTERS, np.uint8)
        for batch in batches:
            table[_bit(batch.column("doc_id"))] = 1
        return table

    return high_bits(ids, mark, COUNTERS, "uint8", lambda mean: 0)


def _bit(ids: pa.Array) -> np.ndarray:
    return (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _fragments(texts: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(doc_id, tag, part, grams): the n-grams of the asked texts by range of the hash. Ranges without any have no row.

    Which texts are asked for is told by bits, so the others are neither shuffled nor cut; a few more than asked may come.
    """
    shift = np.uint64(64 - (RANGES - 1).bit_length())
    marked = texts.sparkSession.sparkContext.broadcast(_marked(asked))  # COUNTERS bits

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        bits = marked.value
        for block in blocks(batches):
            at = _bit(block.column("doc_id"))
            block = block.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0))
            for doc, s in zip(block.column("doc_id").to_pylist(), shingle_sets(block.column("text"), size)):
                if not len(s):
                    continue
                part = s >> shift  # the set is in order of its hashes, so its fragments are slices
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                offsets = pa.array(np.append(starts, len(s)).astype(np.int32))
                grams = pa.ListArray.from_arrays(offsets, pa.array(s.view(np.int64)))
                tag = _tag(hashlib.sha256(s.tobytes()).digest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(starts), pa.int64()), pa.array([tag] * len(starts), pa.int32()),
                     pa.array(part[starts].astype(np.int32)), grams], ["doc_id", "tag", "part", "grams"])

    return texts.select("doc_id", "text").mapInArrow(cut, "doc_id long, tag int, part int, grams array<long>")


def verify(
    pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, threshold: float, scratch: Scratch
) -> DataFrame:
    """The pairs that are linked, of pairs of sets (a, tag_a, b, tag_b); other columns stay.

    The first fragment's overlap rules most out, the sum of the overlaps in all ranges decides the rest.
    """
    t, whole = _ratio(threshold)

    def named(table: DataFrame, s: str, columns: list[str], *plain: str) -> DataFrame:
        return table.select(F.col("doc_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns], *plain)

    left, right = (named(sets, s, ["tag", "n", "inner", "sketch"]) for s in "ab")
    most = F.least(F.col("n_a") - F.col("inner_a"), F.col("n_b") - F.col("inner_b"))
    # two n-grams of one set with the same 16 bits may both be shared
    alike = F.col("inner_a") - F.size(F.array_distinct("sketch_a"))
    # all sides grow with the corpus, so none is ever broadcast
    likely = scratch.store(pairs.join(left.hint("merge"), ["a", "tag_a"]).join(right.hint("merge"), ["b", "tag_b"]).where(
        F.size(F.array_intersect("sketch_a", "sketch_b")) + alike + most
        >= _needed(F.col("n_a"), F.col("n_b"), threshold)).select(*pairs.columns, "n_a", "n_b"), "pairs")
    asked = likely.select(F.explode(F.array("a", "b")).alias("doc_id"))
    total = likely.count()
    count, limit = total // TASK_PAIRS + 1, total // HOT_CENTRES + 1
    cut = _fragments(docs, asked, size).repartition(count, "doc_id", "tag", "part").groupBy("doc_id", "tag", "part").agg(
        F.first("grams").alias("grams"))  # repeated rows have the same
    # counted before the shuffle, as one centre may have most pairs; at most HOT_CENTRES rows are left
    hot = F.broadcast(likely.groupBy("a", "tag_a").agg(F.count("*").alias("m")).where(F.col("m") > limit).select(
        "a", "tag_a", F.ceil(F.col("m") / limit).cast("int").alias("tasks")))
    tasks = F.coalesce("tasks", F.lit(1))
    spread = likely.join(hot, ["a", "tag_a"], "left").withColumn("salt", F.pmod(F.xxhash64("b"), tasks).cast("int")).drop(
        "tasks").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))))
    first = named(cut, "a", ["tag", "grams"], "part").join(hot, ["a", "tag_a"], "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("tasks")
    one, two = ["a", "tag_a", "part", "salt"], ["b", "tag_b", "part"]
    met = spread.repartition(count, *one).join(first.repartition(count, *one).hint("merge"), one).repartition(
        count, *two).join(named(cut, "b", ["tag", "grams"], "part").repartition(count, *two).hint("merge"), two)
    shared = met.select(*likely.columns, F.size(F.array_intersect("grams_a", "grams_b")).alias("n")).repartition(
        count, "a", "b").groupBy(likely.columns).agg(F.sum("n").alias("shared"))
    return shared.where(F.col("shared") * whole >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * t).select(
        pairs.columns)


def _star_pairs(reps: DataFrame) -> DataFrame:
    """Each set with a centre for each of its least hashes: the one with the smallest share of rare n-grams."""
    keyed = reps.select("doc_id", "tag", (F.col("rare") / F.col("n")).alias("share"),
                        F.posexplode("stars").alias("k", "key"))
    centre = keyed.groupBy("k", "key").agg(F.min(F.struct("share", "doc_id", "tag")).alias("c"), F.count("*").alias("m"))
    centre = centre.where("m > 1").select("k", "key", F.col("c.doc_id").alias("a"), F.col("c.tag").alias("tag_a"))
    return keyed.join(centre.hint("merge"), ["k", "key"]).where("doc_id <> a or tag <> tag_a").select(
        "a", "tag_a", F.col("doc_id").alias("b"), F.col("tag").alias("tag_b")).distinct()


def _prefix_pairs(reps: DataFrame, known: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs not yet connected that share an n-gram where linked sets of their sizes must share one, with components."""
    joined = reps.join(known.hint("merge"), F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "tag", "n", F.coalesce("component", "doc_id").alias("component"), "prefix")
    posts = joined.select("doc_id", "tag", "component", "n", F.posexplode("prefix").alias("at", "gram")).select(
        "gram", "doc_id", "tag", "component", (F.col("n").cast("long") * 2**32 + F.col("at")).alias("place"))
    # one shuffle tells which n-grams bring unconnected documents together; only these are joined with themselves
    group = Window.partitionBy("gram")
    mixed = F.min("component").over(group) < F.max("component").over(group)
    posts = scratch.store(posts.withColumn("mixed", mixed).where("mixed").drop("mixed"), "posts").withColumns({
        "n": F.shiftright("place", 32).cast("int"), "at": (F.col("place") % 2**32).cast("int")}).drop("place")
    a, b = (posts.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "tag", "component", "n", "at")])
            for s in "ab")
    need = _needed(F.col("n_a"), F.col("n_b"), threshold)
    return a.join(b.hint("merge"), "gram").where(
        (F.col("component_a") < F.col("component_b")) & (F.least("n_a", "n_b") >= need)
        & (F.col("n_a") - F.col("at_a") >= need) & (F.col("n_b") - F.col("at_b") >= need)
    ).select(F.col("doc_id_a").alias("a"), "tag_a", "component_a", F.col("doc_id_b").alias("b"), "tag_b",
             "component_b").distinct()


def link_documents(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked by n-gram sets with Jaccard similarity >= threshold.

    Texts without words (null, empty, blank) have no n-grams and are linked with nothing. Texts with fewer words than
    `size` have one, the whole sequence. Copies are one set. `component_id` is the least doc_id reachable; a row whose
    doc_id is null is returned with a null component. Other columns of `docs` are ignored. Repeated rows are
    returned as often as they come; rows with one doc_id but different texts count as one document that has the links
    of all of them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    scratch = Scratch()
    sets = store(_sets(rows, size, threshold), "sets")
    whole = store(sets.select("doc_id", "n", "digest"), "sizes")
    keyed = whole.where("doc_id is not null and n > 0")
    first = scratch.store(keyed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "texts")
    one = (sets["doc_id"] == first["rep"]) & (sets["digest"] == first["digest"])
    reps = scratch.store(sets.join(first.hint("merge"), one, "left_semi").dropDuplicates(["doc_id", "digest"]), "reps")
    discard(sets)  # the wide rows are in reps now, the narrow ones in whole
    texts = rows.where("doc_id is not null")
    # a document with several texts ties them
    several = keyed.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y")
    tied = keyed.join(several, "doc_id").join(first, "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    stars = verify(_star_pairs(reps), reps, texts, size, threshold, scratch).select("a", "b")
    known = scratch.store(components(stars.unionByName(tied), scratch), "components")
    near = verify(_prefix_pairs(reps, known, threshold, scratch), reps, texts, size, threshold, scratch)
    merged = components(near.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")), scratch)

    # every text's component, then every row's: a text with very many copies is told by broadcast
    start = F.coalesce("component", "rep")
    told = first.join(known, F.col("rep") == F.col("node"), "left").select("digest", "copies", start.alias("start")).join(
        merged, F.col("start") == F.col("node"), "left").select(
        "digest", "copies", F.coalesce("component", "start").alias("told"))
    told = store(told, "told")
    scratch.clear()
    limit = whole.count() // HOT_TEXTS + 1
    hot = told.where(F.col("copies") > limit).select("digest", F.col("told").alias("hot"))
    rest = told.where(F.col("copies") <= limit).select("digest", "told")
    part = whole.join(F.broadcast(hot), "digest", "left")
    cold = part.where("hot is null").drop("hot").join(rest, "digest", "left")
    every = part.where("hot is not null").withColumnRenamed("hot", "told").unionByName(cold)
    return every.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("told", "doc_id")).alias("component_id"))
