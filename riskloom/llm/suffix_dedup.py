"""Suffix-array deduplication: remove every byte covered by a long string that also starts earlier.

A string of `length` bytes is filed under the least hash of the short grams in it, so equal strings are filed alike,
wherever they stand. Neighbouring strings of a document with one such hash are a unit, which is what is shuffled: about
one for every 39 bytes. Units with equal bytes are settled by their digest. What differs is compared, in shards of
units, by suffix arrays refined as Larsson and Sadakane do, up to exactly `length` bytes. A group of units too large for
one shard is cut, and its shards are merged by the strings that come first in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import _BASE, _BYTE, blocks, mix, powers, raw_bytes, store, text_of

LENGTH = 100
GRAM = 24
#: Bytes that one suffix array covers; a single unit that is longer is taken whole.
SHARD_BYTES = 3 << 20
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _sliding(values: np.ndarray, width: int, low: bool) -> np.ndarray:
    """Least (or greatest) of each `width` neighbours, by running extremes within blocks of that width."""
    f, pad = (np.minimum, np.uint64(2**64 - 1)) if low else (np.maximum, np.uint64(0))
    n = len(values)
    rows = np.append(values, np.full(-n % width + width, pad)).reshape(-1, width)
    ahead = f.accumulate(rows, axis=1).ravel()
    back = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - width + 1], ahead[width - 1: n])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def units(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, digest, start in the text, strings, whether strings inside may be equal) of each unit."""
    width, n = length - GRAM + 1, len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    forward, inverse = powers(n), _powers(_INVERSE, n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * forward, dtype=np.uint64)))
    gram = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    least = _sliding(gram, width, True)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = text[: len(least)] == text[length - 1:]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (text[1: len(least)] != text[: len(least) - 1])
    at = np.flatnonzero(first)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    ends = np.flatnonzero(valid & np.append(first[1:] | ~valid[1:], True)) + 1
    count = ends - at
    high = ends - 1 + length
    digest = mix((total[high] - total[at]) * inverse[at] + (high - at).astype(np.uint64) * _BASE)
    # grams that are the least of some string: two with one hash in a unit mean that its strings may repeat
    none = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate((none, np.where(valid, least, np.uint64(0)), none)), width, False)
    chosen = np.flatnonzero(gram == best)
    twice = np.flatnonzero(gram[chosen[1:]] == gram[chosen[:-1]])
    k = np.searchsorted(chosen[twice], at)
    right = np.append(chosen[twice + 1], n)[k]
    again = right <= ends + width - 2
    return text[at], least[at], digest, at - offsets[text[at]], count, again


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every position by the `length` bytes from it on (fewer at the end): equal ranks are equal strings.

    Larsson-Sadakane: a rank is the place of the first of its group in the suffix array; groups of more than one are
    sorted anew by the rank of what follows, which doubles the depth. The last step is as short as needed.
    """
    n = len(data)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)))
    key, depth = np.zeros(n, np.uint64), 7
    for i in range(depth):  # nine bits a byte, so the end comes before every byte
        key = (key << np.uint64(9)) | padded[i: i + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    while depth < length:
        sizes = np.bincount(rank, minlength=n)
        active = np.flatnonzero(sizes[rank] > 1)
        if not len(active):
            break
        step = min(depth, length - depth)
        after = active + step
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[active] * (n + 1) + follow
        order = np.argsort(pair, kind="stable")
        active, pair, old = active[order], pair[order], rank[active[order]]
        group = np.append(True, old[1:] != old[:-1])
        part = np.append(True, pair[1:] != pair[:-1])
        begin = np.flatnonzero(group)[np.cumsum(group) - 1]
        rank[active] = old + np.flatnonzero(part)[np.cumsum(part) - 1] - begin
        depth += step
    return rank


def _runs(flags: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags within one unit."""
    same = np.append(False, flags[1:] & flags[:-1] & (unit[1:] == unit[:-1]))
    start = np.flatnonzero(flags & ~same)
    return start, np.flatnonzero(flags & ~np.append(same[1:], False))


def _compare(rows: list[tuple], length: int, cut_groups: set[int]) -> tuple[list, list]:
    """Of one shard: spans (doc, start, end) to remove; and of groups that are cut, the strings that come first here."""
    data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    begin = np.cumsum([0, *(len(r[4]) for r in rows[:-1])])
    count = np.array([r[3] for r in rows])
    unit = np.repeat(np.arange(len(rows)), count)
    inner = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[unit] + inner
    doc, start = np.array([r[1] for r in rows])[unit], np.array([r[2] for r in rows])[unit] + inner
    rank = suffix_ranks(data, length)[at]
    order = np.lexsort((start, doc, rank))
    # the same string of one place may be in two units; it is not earlier than itself
    leader = np.append(True, rank[order][1:] != rank[order][:-1])
    head = order[np.flatnonzero(leader)[np.cumsum(leader) - 1]]
    later = np.zeros(len(unit), bool)
    later[order] = (doc[order] != doc[head]) | (start[order] != start[head])
    a, b = _runs(later, unit)
    spans = list(zip(doc[a].tolist(), start[a].tolist(), (start[b] + length).tolist()))
    firsts = []
    if cut_groups:
        of = np.array([r[0] in cut_groups for r in rows])[unit]
        for i in np.flatnonzero(~later & of):
            p = at[i]
            firsts.append((hashlib.sha256(data[p: p + length].tobytes()).digest()[:16], int(doc[i]), int(start[i])))
    return spans, firsts


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc_id, at, n, bytes) in order of h, compared shard by shard; a shard ends with a group if it can."""

    def out(spans: list, firsts: list) -> Iterator[pa.RecordBatch]:
        if spans or firsts:
            docs, starts, ends, digests = [], [], [], []
            for d, s, e in spans:
                docs.append(d), starts.append(s), ends.append(e), digests.append(None)
            for g, d, s in firsts:
                docs.append(d), starts.append(s), ends.append(s + length), digests.append(g)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
                 pa.array(digests, pa.binary())], ["doc_id", "start", "end", "string"])

    rows, size, going_on = [], 0, set()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("h", "doc_id", "at", "n", "bytes")]
        for row in zip(*columns):
            if size >= SHARD_BYTES:
                cut = {row[0]} & {rows[-1][0]}  # a group that goes on in the next shard
                yield from out(*_compare(rows, length, going_on | cut))
                rows, size, going_on = [], 0, cut
            rows.append(row)
            size += len(row[4])
    if rows:
        yield from out(*_compare(rows, length, going_on))


def removal_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, end): byte spans, which may overlap, whose union is all that an earlier string covers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            text, gram, digest, at, count, again = units(*raw_bytes(block.column("text")), length)
            ids = block.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.astype(np.uint64).view(np.int64)), pa.array(digest.astype(np.uint64).view(np.int64)),
                 pa.array(ids[text].astype(np.int64)), pa.array(at * 2**32 + count * 2 + again)],
                ["h", "digest", "doc_id", "place"])

    found = docs.mapInArrow(cut, "h long, digest long, doc_id long, place long")
    group = Window.partitionBy("h")
    ordered = group.orderBy("digest", "doc_id", "place")
    here = F.struct("doc_id", "place")
    begins = F.when(~F.lag("digest").over(ordered).eqNullSafe(F.col("digest")), here)
    found = found.select("*", begins.alias("begins"),
                         (F.min("digest").over(group) != F.max("digest").over(group)).alias("mixed"))
    # the first unit with these bytes; a repeated row is that unit again and no copy of it
    first = F.last("begins", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("copy", first != here).drop("begins")
    found = found.withColumns({"at": F.shiftright("place", 32), "n": F.expr("(place % 4294967296) div 2"),
                               "again": F.expr("place % 2 = 1")}).where("copy or mixed or again")
    found = store(found.drop("place", "digest"), "units")
    copies = found.where("copy").select(
        "doc_id", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + length).alias("end"))
    open_units = found.where("not copy").groupBy("doc_id").agg(
        F.collect_list(F.struct("h", "at", "n")).alias("units"))  # of one document

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, own in zip(*(batch.column(c) for c in ("doc_id", "text", "units"))):
                raw, own = text.as_py(), own.as_py()
                for i in range(0, len(own), 2000):
                    part = own[i: i + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([u["h"] for u in part], pa.int64()), pa.array([doc.as_py()] * len(part), pa.int64()),
                         pa.array([u["at"] for u in part], pa.int64()), pa.array([u["n"] for u in part], pa.int64()),
                         pa.array([raw[u["at"]: u["at"] + u["n"] - 1 + length] for u in part], pa.binary())],
                        ["h", "doc_id", "at", "n", "bytes"])

    brought = docs.join(open_units, "doc_id").select("doc_id", "text", "units").mapInArrow(
        bring, "h long, doc_id long, at long, n long, bytes binary")
    compared = store(brought.repartition("h").sortWithinPartitions("h", "doc_id", "at").mapInArrow(
        lambda b: _shards(b, length), "doc_id long, start long, end long, string binary"), "compared")
    strings = compared.where("string is not null")
    first = strings.groupBy("string").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("m"))
    later = strings.join(first.where("m > 1"), "string").where(
        (F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    return copies.unionByName(compared.where("string is null").drop("string")).unionByName(
        later.select("doc_id", "start", "end"))


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes; null where nothing is removed) of every row.

    Texts are UTF-8 bytes, a null is empty. Texts shorter than `length` lose nothing. Order is by doc_id, then start. A
    null doc_id comes after all others and its rows are one document; rows that repeat a doc_id are one document too,
    and lose the same spans. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"),
                       text_of().cast("binary").alias("text"))
    spans = removal_spans(rows, length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, own in zip(*(batch.column(c) for c in ("doc_id", "text", "spans"))):
                raw, kept, last, runs = text.as_py(), [], 0, 0
                for s in sorted((u["start"], u["end"]) for u in own.as_py()):
                    if s[0] > last or not runs:
                        kept.append(raw[last: s[0]])
                        runs += 1
                        last = s[1]
                    last = max(last, s[1])
                kept = b"".join((*kept, raw[last:]))
                out.append((doc.as_py(), hashlib.sha256(raw).hexdigest(), len(raw) - len(kept), runs,
                            hashlib.sha256(kept).hexdigest(), kept))
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["doc_id", "sha", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = rows.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(
        remove, "doc_id long, sha string, n_removed long, n_spans long, kept_sha256 string, kept binary"
    ).dropDuplicates(["doc_id", "sha"])
    whole = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    return whole.join(changed, ["doc_id", "sha"], "left").select(
        F.when(F.col("doc_id") < 2**63 - 1, F.col("doc_id")).alias("doc_id"), "n_bytes",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")],
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")
