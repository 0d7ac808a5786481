"""Benchmark decontamination by latent semantic retrieval, with a check of the longest common subsequence.

Texts are cut into overlapping passages. Term weights come from all documents. A randomised SVD of the benchmark's
TF-IDF passages, spread over Spark tasks by blocks of items, gives the latent spaces. Every passage of every document is
searched there by cosine, in one scan for thousands of items. What comes near an item is compared with it word by word,
in order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import PUNCTUATION, blocks, sum_tables, text_of, word_hashes

#: Words of a passage and from one to the next.
PASSAGE, STRIDE = 32, 16
#: Terms are hashed to so many columns. All weigh something, those in every document least.
TERMS = 1 << 18
#: Share of its squared norm that each passage keeps in latent space, at least: the rank grows until all do.
KEPT = 0.99
#: Further columns and power iterations of the randomised SVD.
OVERSAMPLE, ITERATIONS = 16, 2
#: Least cosine of a passage and an item's passage to be compared; or least share of the item's passage that it covers, by
#: squared weights. Of two passages that hold a copy between them, one covers half, whatever else stands in it.
COSINE, COVERAGE = 0.3, 0.45
#: Share of an item's words found in order: enough alone, or together with its answer word for word.
SUBSEQUENCE, PARAPHRASE = 0.8, 0.6
#: Without an `answer` column an item's answer is so many last words.
ANSWER_WORDS = 5
#: Items, and passages of items, that share a latent space. The passages bound the rank. An item with more is alone.
BLOCK_ITEMS, BLOCK_PASSAGES = 500, 512
#: Bytes of the latent spaces that are broadcast together; a larger benchmark takes another scan of the documents.
HELD_BYTES = 128 << 20
#: So many items are sorted by one task and read in one job; more are sorted by range and read in a job for each range.
SORTED_ITEMS = 10_000
#: Bytes of text whose terms are sorted and counted at a time: their arrays stay in a core's cache.
TEXT_BYTES = 512 << 10
#: Words of a document whose similarities are held at a time.
PIECE = 64 * STRIDE
SEED = 5


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(pc.utf8_lower(column), PUNCTUATION)


def _column(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(TERMS - 1)).astype(np.int64)


def term_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each hashed term over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(TERMS + 1, np.int32)
        for block in blocks(batches, size=TEXT_BYTES):
            hashes, at = _terms(block.column("text"))
            doc = np.repeat(np.arange(block.num_rows), np.diff(at))
            pairs = np.unique(doc * TERMS + _column(hashes))
            table[:TERMS] += np.bincount(pairs % TERMS, minlength=TERMS).astype(np.int32)
            table[TERMS] += block.num_rows
        return table

    table = sum_tables(docs.select("text"), count, (TERMS + 1,), "int32")
    n, found = float(table[TERMS]), table[:TERMS].astype(np.float64)
    return (np.log((n + 1) / (found + 1)) + 1).astype(np.float32)


@dataclass(frozen=True)
class Index:
    """A block of items in latent space: one column of `similarity` for each passage of an item."""

    vocabulary: np.ndarray  # sorted columns of the items' terms
    similarity: np.ndarray  # weighted terms and a last row of zeros x passages: the latent basis times unit vectors
    norms: np.ndarray       # of each passage, before it was made a unit vector
    owner: np.ndarray       # item of each passage
    ids: list[int]
    places: np.ndarray      # of all items' words in the vocabulary, item after item
    ends: np.ndarray        # where each item ends there, after a first 0
    words: list[np.ndarray]
    answers: list[np.ndarray]


def _cut(n: int) -> range:
    """Where the passages of a text of n words start; the last one reaches its end."""
    return range(0, max(n - PASSAGE + STRIDE, 1), STRIDE)


def _matrix(columns: np.ndarray, weights: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which terms of the vocabulary one text has, the TF-IDF rows of its passages over these, and the rows' norms."""
    at = np.searchsorted(vocabulary, columns)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == columns
    own = np.unique(at[known])
    place = np.searchsorted(own, at)
    out = np.zeros((len(_cut(len(columns))), len(own)), np.float32)
    for i, s in enumerate(_cut(len(columns))):
        part = place[s: s + PASSAGE][known[s: s + PASSAGE]]
        np.add.at(out[i], part, weights[vocabulary[own[part]]])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return own, out / np.where(norm > 0, norm, 1), norm[:, 0]


def build_index(items: list[tuple[int, str, str | None]], weights: np.ndarray) -> Index | None:
    """Fit the latent space of a block of items, inside a task: subspace iterations on A^T A, passage by passage.

    The subspace has room for every passage; of its directions the leading ones are taken, as many as each passage needs
    to keep the share KEPT of its squared norm. An aligned copy word for word so has a cosine of at least its root.
    """
    words = _split([t for _, t, _ in items])
    vocabulary = np.unique(_column(np.concatenate(words))) if words else np.zeros(0, np.int64)
    if not len(vocabulary):
        return None
    rows = [_matrix(_column(w), weights, vocabulary) for w in words]
    owner = np.repeat(np.arange(len(rows)), [len(a) for _, a, _ in rows])
    rank = min(len(owner) + OVERSAMPLE, len(vocabulary))

    def product(basis: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vocabulary), basis.shape[1]))
        for terms, a, _ in rows:
            out[terms] += a.T @ (a @ basis[terms])
        return out

    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(vocabulary), rank)))[0]
    for _ in range(ITERATIONS):
        basis = np.linalg.qr(product(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ product(basis))
    basis = (basis @ turn[:, ::-1])[:, values[::-1] > 1e-9]
    latent = np.concatenate([a @ basis[terms] for terms, a, _ in rows])
    kept = np.cumsum(latent ** 2, axis=1)[np.concatenate([a.any(axis=1) for _, a, _ in rows])].min(axis=0)
    rank = min(int(np.searchsorted(kept, KEPT)) + 1, basis.shape[1])
    norm = np.linalg.norm(latent[:, :rank], axis=1, keepdims=True)
    unit = latent[:, :rank] / np.where(norm > 0, norm, 1)
    similarity = np.zeros((len(vocabulary) + 1, len(owner)), np.float32)
    similarity[:-1] = weights[vocabulary][:, None] * (basis[:, :rank] @ unit.T)
    answers = _split([a or "" for _, _, a in items])
    answers = [a if len(a) else w[-ANSWER_WORDS:] for a, w in zip(answers, words)]
    norms = np.concatenate([n for _, _, n in rows])
    return Index(vocabulary, similarity, norms, owner, [i for i, _, _ in items],
                 np.searchsorted(vocabulary, _column(np.concatenate(words))),
                 np.cumsum([0, *map(len, words)]), words, answers)


def build_indexes(blocks_of_items: list[list[tuple]], spark, weights: np.ndarray) -> list[Index]:
    """The indexes of some blocks, a task for each; the driver holds as many as HELD_BYTES allow."""
    shared = spark.sparkContext.broadcast(weights)
    rows = spark.createDataFrame([(pickle.dumps(b),) for b in blocks_of_items], "items binary")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for items in batch.column("items"):
                index = build_index(pickle.loads(items.as_py()), shared.value)
                if index is not None:
                    yield pa.RecordBatch.from_pydict({"index": pa.array([pickle.dumps(index)], pa.binary())})

    spread = rows.repartition(len(blocks_of_items)) if len(blocks_of_items) > 1 else rows.coalesce(1)
    out = [pickle.loads(r["index"]) for r in spread.mapInArrow(fit, "index binary").toLocalIterator()]
    shared.unpersist()
    return sorted(out, key=lambda x: x.ids[0] if x.ids[0] is not None else -1)


def _split(texts: list[str]) -> list[np.ndarray]:
    hashes, at = _terms(pa.array(texts, pa.string()))
    return [hashes[a:b] for a, b in zip(at, at[1:])]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; each step is one pass over b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        # a match extends the best before it; the running maximum carries the rest
        row[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return int(row[-1])


def _contains(text: np.ndarray, part: np.ndarray) -> bool:
    n = len(text) - len(part) + 1
    if not len(part) or n < 1:
        return False
    return bool(np.logical_and.reduce([text[i: i + n] == part[i] for i in range(len(part))]).any())


def _hits(words: np.ndarray, index: Index, weights: np.ndarray) -> Iterator[tuple[int, float, float]]:
    """(item, cosine, share of its words found in order) of each item that one text holds."""
    columns = _column(words)
    w = weights[columns]
    at = np.searchsorted(index.vocabulary, columns)
    at[at == len(index.vocabulary)] = 0
    known = index.vocabulary[at] == columns
    starts = np.array(_cut(len(words)))
    ends = np.minimum(starts + PASSAGE, len(words))
    total = np.concatenate(([0], np.cumsum(w.astype(np.float64) ** 2)))
    norm = np.sqrt(total[ends] - total[starts])
    if not known.any():
        return
    # a passage is two strides, so each stride is summed once
    at = np.append(np.where(known, at, len(index.vocabulary)), np.full(-len(at) % STRIDE, len(index.vocabulary)))
    hits, sizes = [], np.diff(index.ends)
    longest = int(sizes.max())
    for a in range(0, len(starts), PIECE // STRIDE):
        b = min(a + PIECE // STRIDE, len(starts))
        # an item that has too few of its words in all of this is in no part of it
        present = np.zeros(len(index.vocabulary) + 1, bool)
        present[at[max(0, starts[a] - longest): ends[b - 1] + longest]] = True
        shared = np.concatenate(([0], np.cumsum(present[index.places])))[index.ends]
        possible = (np.diff(shared) >= PARAPHRASE * sizes) & (sizes > 0)
        if not possible.any():
            continue
        own = at[starts[a]: starts[b - 1] + PASSAGE]
        sums = index.similarity[own].reshape(-1, STRIDE, len(index.owner)).sum(axis=1)
        sums = sums[:-1] + sums[1:] if len(sums) > 1 else sums
        r, c = np.nonzero((sums >= np.minimum(COSINE * norm[a:b, None], COVERAGE * index.norms))
                          & (sums > 0) & possible[index.owner])
        hits.append((r + a, c, sums[r, c] / norm[r + a]))
    if not hits:
        return
    rows, columns, cosines = map(np.concatenate, zip(*hits))
    order = np.argsort(-cosines, kind="stable")
    found: set[int] = set()
    for r, c, cosine in zip(rows[order], columns[order], cosines[order]):
        item = int(index.owner[c])
        if item in found:
            continue
        target, n = index.words[item], len(index.words[item])
        region = words[max(0, starts[r] - n): ends[r] + n]
        if np.isin(target, region).sum() < PARAPHRASE * n:
            continue
        share = common_subsequence(target, region) / n
        if share >= SUBSEQUENCE or share >= PARAPHRASE and _contains(region, index.answers[item]):
            found.add(item)
            yield item, float(cosine), share


def _item_blocks(items: Iterator[tuple]) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_ITEMS items and BLOCK_PASSAGES passages, or of one item."""
    block, passages = [], 0
    for item in items:
        n = len(_cut(len(_split([item[1]])[0])))
        if block and (len(block) == BLOCK_ITEMS or passages + n > BLOCK_PASSAGES):
            yield block
            block, passages = [], 0
        block.append(item)
        passages += n
    if block:
        yield block


def _groups(blocks_of_items: Iterator[list[tuple]]) -> Iterator[list[list[tuple]]]:
    """Blocks whose indexes take HELD_BYTES together, at most, or one block."""
    group, held = [], 0
    for block in blocks_of_items:
        words = _split([t for _, t, _ in block])
        size = 4 * len(np.unique(_column(np.concatenate(words)))) * sum(len(_cut(len(w))) for w in words)
        if group and held + size > HELD_BYTES:
            yield group
            group, held = [], 0
        group.append(block)
        held += size
    if group:
        yield group


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, subsequence): every document and benchmark item that it holds, also reworded.

    Words are runs of letters and digits in lower case. Null and empty texts hold nothing and are
    held by none. Repeated rows give repeated pairs, and so do rows that repeat an item_id, each with its own text;
    `benchmark` may have an `answer` column, other columns are ignored. An empty table on either side gives no pairs. Of
    passages with the same cosine the first one is compared first. The documents are scanned once for as many items
    as HELD_BYTES hold, thousands of the usual ones.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), text_of().alias("t"), answer.alias("a"))
    few = items.count() <= SORTED_ITEMS
    items = items.coalesce(1).sortWithinPartitions("i", "t") if few else items.orderBy("i", "t")
    kinds = "doc_id long, item_id long, cosine double, subsequence double"
    out, weights = spark.createDataFrame([], kinds), None
    for group in _groups(_item_blocks(map(tuple, items.toLocalIterator()))):
        weights = term_weights(rows) if weights is None else weights
        indexes = build_indexes(group, spark, weights)
        if not indexes:
            continue
        held = spark.sparkContext.broadcast((indexes, weights))  # HELD_BYTES of indexes and TERMS weights

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            indexes, weights = held.value
            for part in blocks(batches, size=TEXT_BYTES):
                hashes, at = _terms(part.column("text"))
                got = [(doc, index.ids[i], c, s)
                       for doc, a, b in zip(part.column("doc_id").to_pylist(), at, at[1:]) if b > a
                       for index in indexes for i, c, s in _hits(hashes[a:b], index, weights)]
                if got:
                    columns = list(zip(*got))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if i < 2 else pa.float64()) for i, c in enumerate(columns)],
                        ["doc_id", "item_id", "cosine", "subsequence"])

        out = out.unionByName(rows.mapInArrow(search, kinds))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item; rows with a null doc_id stay only if no such row holds one."""
    found = find(docs, benchmark).select(F.col("doc_id").alias("held")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["held"]), "left_anti")
