"""Helpers shared by the corpus operators: shared storage, native word splitting, vectorised hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.tables import settle

# Fixed value: a word is a run of bytes other than space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text that a task hashes at a time. A longer text is taken alone, and whole.
BLOCK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(c: str | Column = "text") -> Column:
    """The text as a string, a null as the empty one."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back, which cuts the lineage and survives lost executors."""
    return settle(df, name)


def discard(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Stored tables of one run, to be removed together when its last table has been written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(store(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        for table in self.tables:
            discard(table)
        self.tables = []


# ---- vectorised hashing of Arrow batches -----------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words without punctuation.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `size` bytes of text (BLOCK_BYTES)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // (size or BLOCK_BYTES)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each text starts and the last one ends; nulls are empty."""
    filled = pc.cast(pc.fill_null(column, "" if pa.types.is_string(column.type) else b""), pa.large_binary())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset: filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(column: pa.Array, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z lower-cased, in order, and for each text where its words start (and the end).

    `between` says for each byte whether it separates words.
    """
    data, offsets = raw_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    inside = ~between[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = inside & (first | np.concatenate(([True], ~inside[:-1])))
    begin = np.flatnonzero(starts)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    packed = data[inside]
    at = np.cumsum(inside)[begin] - 1
    lengths = np.diff(np.append(at, len(packed)))
    place = np.arange(len(packed)) - np.repeat(at, lengths)
    hashed = np.add.reduceat(_BYTE[packed] * powers(int(lengths.max()))[place], at)
    return mix(hashed + lengths.astype(np.uint64) * _BASE), np.searchsorted(begin, offsets)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its word n-grams; of a shorter text, the whole sequence as one."""
    hashes, offsets = word_hashes(column)
    scale = powers(size + 1)[1:]
    if len(hashes) >= size:
        grams = mix(sum(hashes[i: len(hashes) - size + 1 + i] * scale[i] for i in range(size)) + np.uint64(size))
    for a, b in zip(offsets, offsets[1:]):
        if b - a >= size:
            yield np.unique(grams[a: b - size + 1])
        elif b > a:
            yield mix(np.array([np.sum(hashes[a:b] * scale[: b - a])], np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


# ---- tables of numbers summed over all tasks -------------------------------------------------

def _summed(df: DataFrame, make, size: int, kind: str, chunk: int) -> DataFrame:
    """(chunk, part, amount): the sum of the arrays that `make` gives for the batches of each task, stored in chunks.

    Whole numbers are summed to int32 and stop at its end; `amount` is what a chunk of them adds up to.
    """
    whole_numbers = not kind.startswith("float")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = make(batches)
        if table is not None:
            flat = table.ravel()
            for i in range(0, size, chunk):
                if flat[i: i + chunk].any():
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([i], pa.int64()), "part": pa.array([flat[i: i + chunk].tobytes()], pa.binary())})

    def total(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = None, None
        for batch in group:
            at = batch.column("chunk")[0].as_py()
            for c in batch.column("part"):
                part = np.frombuffer(c.as_buffer(), kind).astype(np.int64 if whole_numbers else np.float64)
                out = part if out is None else out + part
        out = np.minimum(out, 2**31 - 1).astype(np.int32) if whole_numbers else out
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([at], pa.int64()), "part": pa.array([out.tobytes()], pa.binary()),
            "amount": pa.array([int(out.sum(dtype=np.int64)) if whole_numbers else None], pa.int64())})

    kinds = "chunk long, part binary"
    return store(df.mapInArrow(own, kinds).groupBy("chunk").applyInArrow(total, f"{kinds}, amount long"), "sums")


def sum_tables(df: DataFrame, make, shape: tuple[int, ...], kind: str, chunk: int = 1 << 16) -> np.ndarray:
    """Sum of the arrays that `make` gives for the batches of each task; `shape`, not the input, bounds the result.

    Arrays travel in chunks, so that many tasks add up, and the driver takes one chunk of the sum after the other.
    Whole numbers are summed to int32 and stop at its end.
    """
    size, sums = int(np.prod(shape)), np.float64 if kind.startswith("float") else np.int32
    whole, summed = np.zeros(size, sums), _summed(df, make, size, kind, chunk)
    # as large as `shape`; one job, not one for each partition
    for row in summed.select("chunk", "part").coalesce(1).toLocalIterator():
        part = np.frombuffer(row["part"], sums)
        whole[row["chunk"]: row["chunk"] + len(part)] = part
    discard(summed)
    return whole.reshape(shape)


def high_bits(df: DataFrame, make, size: int, kind: str, limit, chunk: int = 1 << 16) -> np.ndarray:
    """Which of the summed whole numbers are above `limit(mean)`, 0 at least, as bytes of bits.

    The sums are as those of `sum_tables` but stay in the tasks; the driver gets their mean and a bit for each.
    """
    summed = _summed(df, make, size, kind, chunk)
    most = limit((summed.agg(F.sum("amount")).first()[0] or 0) / size)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.packbits(np.frombuffer(c.as_buffer(), np.int32) > most).tobytes() for c in batch.column("part")]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(parts, pa.binary())], ["chunk", "part"])

    bits = np.zeros(-(-size // 8), np.uint8)
    packed = summed.select("chunk", "part").mapInArrow(pack, "chunk long, part binary")
    for row in packed.coalesce(1).toLocalIterator():
        part = np.frombuffer(row["part"], np.uint8)
        bits[row["chunk"] // 8: row["chunk"] // 8 + len(part)] = part
    discard(summed)
    return bits
