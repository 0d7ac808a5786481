"""Reproducible splits, folds and samples that never sort or shuffle the table.

Rows are ordered by a seeded digest of their key. The digest value at each cut is found by exact
selection, and rows are then placed by comparing with the cuts: a filter, whatever the size. Only rows
that share the very digest prefix of a cut are ranked against each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import domain as d
from riskloom.functions import expressions as X
from riskloom.functions.columns import col
from riskloom.operators.selection import order_statistics

Sizes = Mapping[int, Sequence[int]]
TIE_SALTS = 1024


def assign_buckets(
    df: DataFrame,
    sizes: Callable[[dict[int, int]], Sizes],
    key: str = d.ID,
    label: str | None = d.LABEL,
    seed: int = d.SEED,
    name: str = "bucket",
) -> DataFrame:
    """Add `name`: bucket number 0.. so that, per label class, bucket i holds exactly sizes[i] rows.

    `label` holds small non-negative integers (None: one class). `sizes` maps class counts to the
    bucket sizes of each class, which must add up to the count.
    """
    digest = X.order_digest(col(key), seed)
    group = F.lit(0) if label is None else col(label).cast("int")
    keyed = df.withColumns({"_d": digest, "_k": X.order_number(digest), "_g": group})
    plan: dict[int, list[int]] = {}

    def cut_ranks(counts: dict[int, int]) -> dict[int, list[int]]:
        if any(g is None or g < 0 for g in counts):
            raise ValueError(f"'{label}' must hold non-negative integers, without NULLs")
        plan.update({g: list(s) for g, s in sizes(counts).items()})
        for g, s in plan.items():
            if sum(s) != counts[g] or min(s) < 0:
                raise ValueError(f"bucket sizes {s} do not add up to the {counts[g]} rows of class {g}")
        return {g: [max(c - 1, 0) for c in _running(s)[:-1]] for g, s in plan.items()}

    _, stats = order_statistics(keyed.select(F.col("_g").alias("g"), F.col("_k").alias("v")), cut_ranks)

    bucket = F.lit(None).cast("int")
    tied = F.lit(False)
    tie_start: dict[tuple[int, float], int] = {}
    for g, s in plan.items():
        ends = _running(s)
        place = F.lit(len(s) - 1)
        for i in reversed(range(len(s) - 1)):
            if ends[i] == 0:
                continue
            cut = stats[g][i]
            place = F.when(F.col("_k") <= F.lit(cut.value), F.lit(i)).otherwise(place)
            if cut.below + cut.equal > ends[i]:  # the cut falls between equal prefixes
                tie_start[(g, cut.value)] = cut.below
                tied = tied | ((F.col("_g") == g) & (F.col("_k") == F.lit(cut.value)))
        bucket = F.when(F.col("_g") == g, place).otherwise(bucket)

    if not tie_start:
        return keyed.withColumn(name, bucket).drop("_d", "_k", "_g")
    clear = keyed.where(~tied).withColumn(name, bucket)
    ranked = _rank_ties(keyed.where(tied), df.columns)
    position = F.lit(None).cast("long")
    for (g, v), start in tie_start.items():
        position = F.when(
            (F.col("_g") == g) & (F.col("_k") == F.lit(v)), F.col("_r") + F.lit(start)
        ).otherwise(position)
    placed = F.lit(None).cast("int")
    for g, s in plan.items():
        ends = _running(s)
        here = F.lit(len(s) - 1)
        for i in reversed(range(len(s) - 1)):
            here = F.when(position <= ends[i], F.lit(i)).otherwise(here)
        placed = F.when(F.col("_g") == g, here).otherwise(placed)
    ranked = ranked.withColumn(name, placed).drop("_r")
    return clear.unionByName(ranked).drop("_d", "_k", "_g")


def _rank_ties(rows: DataFrame, columns: list[str]) -> DataFrame:
    """1-based rank `_r` within (class, prefix). Salting by content spreads a key with many rows."""
    rows = rows.withColumn("_s", F.pmod(F.xxhash64(*[col(c) for c in columns]), F.lit(TIE_SALTS)))
    part = Window.partitionBy("_g", "_k")
    starts = (
        rows.groupBy("_g", "_k", "_s").agg(F.count("*").alias("_n"))
        .withColumn("_o", F.sum("_n").over(part.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_g", "_k", "_s", F.coalesce("_o", F.lit(0)).alias("_o"))
    )
    inner = Window.partitionBy("_g", "_k", "_s").orderBy("_d", *[col(c) for c in columns])
    return (
        rows.withColumn("_n", F.row_number().over(inner))
        .join(F.broadcast(starts), ["_g", "_k", "_s"])  # at most cuts x TIE_SALTS rows
        .withColumn("_r", F.col("_n") + F.col("_o"))
        .drop("_s", "_n", "_o")
    )


def _running(sizes: Sequence[int]) -> list[int]:
    out, total = [], 0
    for s in sizes:
        total += s
        out.append(total)
    return out


# ---- stratified split ------------------------------------------------------------------------

def split_quotas(counts: Mapping[int, int], test_size: float) -> dict[int, int]:
    """Test rows per class: ceil(test_size * n) in all, shared by largest remainder."""
    n = sum(counts.values())
    total = math.ceil(test_size * n)
    shares = {g: total * c / n for g, c in counts.items()}
    quotas = {g: math.floor(s) for g, s in shares.items()}
    by_remainder = sorted(shares, key=lambda g: (quotas[g] - shares[g], g))
    for g in by_remainder[: total - sum(quotas.values())]:
        quotas[g] += 1
    return quotas


def stratified_split(
    df: DataFrame, test_size: float = d.TEST_SIZE, key: str = d.ID, label: str = d.LABEL, seed: int = d.SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with equal class shares."""
    parts = split_flag(df, test_size, key, label, seed)
    return parts.where("NOT is_test").drop("is_test"), parts.where("is_test").drop("is_test")


def split_flag(
    df: DataFrame, test_size: float = d.TEST_SIZE, key: str = d.ID, label: str = d.LABEL, seed: int = d.SEED
) -> DataFrame:
    if label not in df.columns:
        raise ValueError(f"'{label}' column required for a stratified split")

    def sizes(counts: dict[int, int]) -> Sizes:
        small = {g: c for g, c in counts.items() if c < 2}
        if small:
            raise ValueError(f"a stratified split needs at least 2 rows per class, got {small}")
        quotas = split_quotas(counts, test_size)
        return {g: [quotas[g], c - quotas[g]] for g, c in counts.items()}

    out = assign_buckets(df, sizes, key, label, seed, "_b")
    return out.withColumn("is_test", F.col("_b") == 0).drop("_b")


def split_report(parts: DataFrame, label: str = d.LABEL) -> DataFrame:
    """Rows and default rate of each side of `split_flag`."""

    def side(test: bool, name: str) -> list:
        mask = F.col("is_test") if test else ~F.col("is_test")
        rate = F.round(F.avg(F.when(mask, col(label))) * 100, 4)
        return [F.count_if(mask).alias(f"{name}_rows"), rate.alias(f"{name}_default_rate_pct")]

    return parts.agg(*side(False, "train"), *side(True, "test"))


def stratified_folds(
    df: DataFrame, k: int = d.CV_FOLDS, key: str = d.ID, label: str = d.LABEL, seed: int = d.SEED,
    name: str = "fold",
) -> DataFrame:
    """Add a fold number 0..k-1; class counts differ by at most one row between folds."""

    def sizes(counts: dict[int, int]) -> Sizes:
        return {g: [c // k + (i < c % k) for i in range(k)] for g, c in counts.items()}

    return assign_buckets(df, sizes, key, label, seed, name)


def sample_rows(df: DataFrame, n: int, key: str = d.ID, seed: int = d.SEED) -> DataFrame:
    """Exactly min(n, rows) rows, the first in digest order: one scan that keeps n rows in each task, so n is small."""
    return df.withColumn("_d", X.order_digest(col(key), seed)).orderBy("_d", col(key)).limit(n).drop("_d")
