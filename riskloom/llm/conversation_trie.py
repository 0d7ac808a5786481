"""Prefix trie of conversations; subtree totals by time-forward processing.

Spark names every prefix by a running sum of digests and groups equal prefixes into nodes. Totals then travel from
the leaves to the root as messages: the nodes of a shard are sorted by reverse level order, and a priority queue that
spills to disk holds the messages to parents. A shard is a set of whole subtrees; the few nodes above them, with many
members each, form the top of the trie and take the totals of the shard roots in a last pass.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import store, text_of

# Conversations share the start of the first one of their group; the hash bounds how many turns.
GROUP, MOST_SHARED = 5, 9
#: The top of the trie holds nodes with more than one in so many of all turns. It has no more nodes than that.
TOP_NODES = 10_000
#: Nodes that a shard holds on average.
SHARD_NODES = 200_000
#: Messages that a task's queue keeps in memory; the rest lies in sorted files.
QUEUE = 100_000
_PIECE = 2**31
#: A node: its address (depth, a, b), that of its parent, and what it brings to the totals.
_NODE = ("depth long, a long, b long, pa long, pb long, conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long")
_DONE = _NODE + ", parent_conv_id long, placed boolean"
_NAMES = [f.split()[0] for f in _DONE.split(", ")]


# ---- from rows to the turns of rebuilt conversations --------------------------------------------

def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its group, at most."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("long")


def rebuild(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth, digest, bytes) and all conversations (conv_id, length).

    Only the order needs the texts; what follows carries their digests. A group shares at most MOST_SHARED - 1 turns,
    so handing them out adds no more than that to a conversation.
    """
    told = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text_of("role").alias("role"), text_of().alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = store(told.withColumn("pos", F.row_number().over(order).cast("long")).select(
        "conv_id", "pos", _digest(F.col("role"), F.col("text")).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes")), "turns")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": shared_turns(F.col("conv_id"))})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = store(sizes.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own")), "convs")
    own = turns.join(convs.where("own > 0").select("conv_id", "h", "taken"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "bytes")
    first = turns.where(F.col("pos") < MOST_SHARED).select(
        F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "bytes")
    taken = convs.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where("depth <= taken")
    rebuilt = own.unionByName(taken.select("conv_id", "depth", "digest", "bytes"))
    return rebuilt, convs.select("conv_id", (F.col("taken") + F.col("own")).alias("length"))


def paths(rebuilt: DataFrame) -> DataFrame:
    """Each turn with the name (a, b) of the prefix that it ends, and of the one before it (pa, pb), and if it is the last.

    The name sums digests of (depth, turn) modulo 2^31, in four parts of 31 bits: equal prefixes have equal names, others do
    not but for a chance of about 2^-124 a pair. The empty prefix is (0, 0).
    """
    sha = _digest(F.col("depth").cast("string"), F.col("digest"))
    parts = [(F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long") % _PIECE).alias(f"g{i}") for i in range(4)]
    along = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    after = F.lead("depth").over(Window.partitionBy("conv_id").orderBy("depth"))
    rows = rebuilt.select("conv_id", "depth", "bytes", *parts).select("*", after.isNull().alias("last"), *[
        F.sum(f"g{i}").over(along).alias(f"s{i}") for i in range(4)])

    def joined(x: Column, y: Column) -> Column:
        return x % _PIECE * _PIECE + y % _PIECE

    now, before = [F.col(f"s{i}") for i in range(4)], [F.col(f"s{i}") - F.col(f"g{i}") for i in range(4)]
    return rows.select("conv_id", "depth", "bytes", "last", joined(*now[:2]).alias("a"), joined(*now[2:]).alias("b"),
                       joined(*before[:2]).alias("pa"), joined(*before[2:]).alias("pb"))


# ---- time-forward processing --------------------------------------------------------------------

class SpillingQueue:
    """Least item first. Beyond `limit` items in memory, the queue is sorted into a file of the task's own, without a
    name, which goes when the task ends, however it ends."""

    def __init__(self, limit: int = QUEUE, block: int = 1000):
        self.limit, self.block, self.items, self.runs, self.count = limit, block, [], [], 0

    def push(self, item: tuple) -> None:
        if len(self.items) >= self.limit:
            self._spill()
        heapq.heappush(self.items, item)

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]  # where Spark's own sorts spill
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        self.items.sort()
        for i in range(0, len(self.items), self.block):
            pickle.dump(self.items[i: i + self.block], file, pickle.HIGHEST_PROTOCOL)
        file.seek(0)
        self.items = []
        self.count += 1
        self._next(file, self.count)

    def _next(self, file, number: int) -> None:
        """Read a run's next block; the run waits under its first item."""
        try:
            held = pickle.load(file)
        except EOFError:
            file.close()
            return
        heapq.heappush(self.runs, (held[0], number, 0, held, file))

    def peek(self) -> tuple | None:
        heads = [h for h in (self.items[:1], [self.runs[0][0]] if self.runs else []) if h]
        return min(h[0] for h in heads) if heads else None

    def pop(self) -> tuple:
        if not self.runs or self.items and self.items[0] <= self.runs[0][0]:
            return heapq.heappop(self.items)
        item, number, at, held, file = heapq.heappop(self.runs)
        if at + 1 < len(held):
            heapq.heappush(self.runs, (held[at + 1], number, at + 1, held, file))
        else:
            self._next(file, number)
        return item


def forward(nodes: Iterator[tuple], limit: int = QUEUE) -> Iterator[tuple]:
    """Finished nodes, from nodes in order of falling depth, then of a and b.

    A node's message to its parent is the node itself with its totals. The parent takes it when its turn comes, adds
    it up and lets the child go with the parent's conv_id; where the parent is not among the nodes, the child is a
    root of its shard and goes without.
    """
    queue = SpillingQueue(limit)

    def left_behind(before: tuple | None) -> Iterator[tuple]:
        while (m := queue.peek()) is not None and (before is None or m[:3] < before):
            yield (*queue.pop()[3:], None, False)

    for node in nodes:
        depth, a, b, pa_, pb, conv, n, children, leaves, saved = node
        here = (-depth, a, b)
        yield from left_behind(here)
        while (m := queue.peek()) is not None and m[:3] == here:
            child = queue.pop()[3:]
            children, leaves, saved = children + 1, leaves + child[8], saved + child[9]
            yield (*child, conv, True)
        leaves = leaves if children else 1
        queue.push((1 - depth, pa_, pb, depth, a, b, pa_, pb, conv, n, children, leaves, saved))
    yield from left_behind(None)


def _in_batches(rows: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.bool_() if f.endswith("boolean") else pa.int64() for f in _DONE.split(", ")]
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], _NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], _NAMES)


def _forward_all(sorted_nodes: DataFrame, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        yield from _in_batches(forward(rows, limit))

    return sorted_nodes.select(*_NAMES[:10]).mapInArrow(run, _DONE)


def _ends(ended: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): digest of the ids of the conversations that end at each node.

    A digest has to see its ids in order. They are put together in pieces of at most 4,096 neighbouring ids first, in
    as many tasks as there are; the last pass streams the pieces of a node in constant memory.
    """
    span = F.floor(F.col("conv_id") / 4096.0)
    pieces = ended.groupBy("depth", "a", "b", span.alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if key != last:
                    if last:
                        out.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("depth", "a", "b", "ends_sha256"), r)) for r in out], schema)
        if last:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "a", "b", "ends_sha256"), (*last, state.hexdigest())))],
                                             schema)

    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    return pieces.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "piece").select(
        "depth", "a", "b", "ids").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def build(rows: DataFrame, top_nodes: int = TOP_NODES, shard_nodes: int = SHARD_NODES, queue: int = QUEUE) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation and are left out. Null turns come first, null roles and texts
    are empty; rows of one conversation with one turn number go by role, then by text, and repeated rows are turns of
    their own. Other columns are ignored. An empty table has no node, the root included, as nobody is its member.
    Each turn of a conversation is read in order by one task, in constant memory.
    """
    rebuilt, convs = rebuild(rows)
    steps = store(paths(rebuilt), "paths")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), "conv_id", "n_convs",
        zero.alias("bytes"))
    least = F.min(F.struct("conv_id", "pa", "pb", "bytes")).alias("m")
    nodes = steps.groupBy("depth", "a", "b").agg(least, F.count("*").alias("n_convs")).select(
        "depth", "a", "b", "m.pa", "m.pb", "m.conv_id", "n_convs", "m.bytes").unionByName(root)
    nodes = store(nodes.select(
        "depth", "a", "b", "pa", "pb", "conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), "nodes")

    # a node with more than limit members: at most top_nodes of them, as every turn is a member of one node
    limit = steps.count() // top_nodes + 1
    top = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    above = nodes.where(top)
    address = above.select(F.col("depth").alias("td"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    # a shard root is the first node of a path below the top; its path's least member is in all nodes further down
    is_top = (F.col("depth") == F.col("td")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb"))
    under_top = (F.col("depth") - 1 == F.col("td")) & (F.col("pa") == F.col("ta")) & (F.col("pb") == F.col("tb"))
    starts = steps.join(F.broadcast(address), is_top, "left_anti").join(
        F.broadcast(address), under_top, "left_semi").select(
        "conv_id", F.xxhash64("depth", "a", "b").alias("subtree"))
    below = nodes.where(~top)
    count = max(1, -(-below.count() // shard_nodes))
    count = max(count, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shards = below.join(starts, "conv_id").repartition(count, "subtree").sortWithinPartitions(
        F.desc("depth"), "a", "b")
    done = store(_forward_all(shards, queue), "subtrees")

    # across shard roots: their totals are summed for each node of the top, whose nodes one small task goes through
    arrived = done.where("not placed").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"),
                                               F.col("pb").alias("b")).agg(
        F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    full = above.join(arrived, ["depth", "a", "b"], "left").select(
        "depth", "a", "b", "pa", "pb", "conv_id", "n_convs", F.coalesce("c", zero).alias("n_children"),
        F.coalesce("l", zero).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", zero)).alias("saved_tokens"))
    tops = store(_forward_all(full.coalesce(1).sortWithinPartitions(F.desc("depth"), "a", "b"), queue), "top")
    parents = tops.select(F.col("depth").alias("td"), F.col("a").alias("ta"), F.col("b").alias("tb"),
                          F.col("conv_id").alias("top_conv"))
    named = done.join(F.broadcast(parents), ~F.col("placed") & under_top, "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "top_conv")).select(*_NAMES)

    last = steps.where("last").select("depth", "a", "b", "conv_id").unionByName(
        convs.where("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
    return named.unionByName(tops).join(_ends(last), ["depth", "a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: The same nodes in SQL, with whole paths of digests as keys and every node joined to those below it.
SQL = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
told AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, max(pos) AS n,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]))) % 9 AS h
  FROM told, crc GROUP BY conv_id, t),
convs AS (
  SELECT s.conv_id, s.base, s.h, least(s.h, coalesce(b.n, 0)) AS taken, greatest(s.n - s.h, 0) AS own
  FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
rebuilt AS (
  SELECT c.conv_id, c.taken + t.pos - c.h AS depth, role, text FROM convs c JOIN told t USING (conv_id) WHERE t.pos > c.h
  UNION ALL
  SELECT c.conv_id, t.pos, role, text FROM convs c JOIN told t ON t.conv_id = c.base AND t.pos <= c.h),
steps AS (
  SELECT conv_id, depth, strlen(text) AS bytes, string_agg(sha256(length(role) || ':' || role || text), '') OVER (
    PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes
          FROM steps GROUP BY depth, path),
family AS (SELECT c.*, p.conv_id AS parent_conv_id, p.path AS parent_path
           FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = left(c.path, 64 * (c.depth::INT - 1))),
kids AS (SELECT n.*, (SELECT count(*) FROM family c WHERE c.depth = n.depth + 1 AND c.parent_path = n.path) AS n_children
         FROM family n),
ends AS (SELECT s.path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
         FROM steps s JOIN convs c USING (conv_id) WHERE s.depth = c.taken + c.own GROUP BY s.path)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children,
       count(*) FILTER (x.n_children = 0) AS n_leaves, CAST(sum((x.n_convs - 1) * x.bytes) AS BIGINT) AS saved_tokens,
       sha256(coalesce(any_value(e.ids), '')) AS ends_sha256
FROM kids n JOIN kids x ON starts_with(x.path, n.path) LEFT JOIN ends e ON e.path = n.path
GROUP BY n.path, n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children"""
