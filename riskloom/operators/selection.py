"""Exact order statistics without sorting or gathering a column.

Spark's exact `percentile` keeps every distinct value of a group in one task. Here each pass is an
ordinary aggregation whose state is bounded: a quantile sketch brackets the wanted ranks, and narrower
sketches follow until few values are left inside. The last pass counts rows per value inside the brackets
and per gap between them, and running sums over those few rows give the ranks. Copies of one value are
only ever counted, so a value that fills a third of the table costs nothing extra.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import number_array, numeric_long

GRID = 400
ACCURACY = 2_000
LIMIT = 1_000_000
WHOLE = 10_000
_INF = float("inf")


@dataclass(frozen=True)
class OrderStat:
    value: float
    following: float | None
    below: int
    equal: int


@dataclass
class _Target:
    rank: int
    lo: float = -_INF
    hi: float = _INF
    inside: int = 0

    def narrow(self, grid: Sequence[float], before: int, inside: int, slack: int) -> None:
        share = min(max((self.rank - before) / max(inside, 1), 0.0), 1.0)
        pad = slack + math.ceil(2 * GRID / max(inside, 1))  # never less than two rows each way
        a, b = math.floor(share * GRID) - pad, math.ceil(share * GRID) + pad
        self.lo = self.lo if a <= 0 else grid[a]
        self.hi = self.hi if b >= GRID else grid[b]
        self.inside = math.ceil(inside * (min(b, GRID) - max(a, 0)) / GRID)


FRACTIONS = number_array(i / GRID for i in range(GRID + 1))


def _grid(name: str) -> Column:
    return F.expr(f"percentile_approx({name}, {FRACTIONS}, {ACCURACY})")


def _per_group(values: Mapping[int, float]) -> Column:
    """Literal lookup g -> value; g is a small dense integer."""
    return F.expr(f"element_at({number_array(values.get(g, 0.0) for g in range(max(values) + 1))}, g + 1)")


def order_statistics(
    long: DataFrame,
    ranks: Callable[[dict[int, int]], Mapping[int, Sequence[int]]],
    limit: int = LIMIT,
    slack: int = 2,
) -> tuple[dict[int, int], dict[int, list[OrderStat]]]:
    """Values at 0-based ranks per group of `long(g int, v double)`.

    `ranks` receives the non-null count of every group and names the ranks wanted in each.
    """
    cells = long.where("v IS NOT NULL")
    limit = max(limit, 64)  # below this a bracket of grid cells no longer shrinks
    whole = min(WHOLE, limit)
    first = cells.groupBy("g").agg(F.count("v").alias("n"), _grid("v").alias("grid")).collect()
    counts = {r.g: r.n for r in first}
    wanted = {g: list(rs) for g, rs in ranks(dict(counts)).items() if len(rs)}
    targets: dict[int, list[_Target]] = {}
    for r in first:
        if r.g not in wanted:
            continue
        targets[r.g] = [_Target(k, inside=r.n) for k in wanted[r.g]]
        if r.n > whole:
            for t in targets[r.g]:
                t.narrow(r.grid, 0, r.n, slack)
    if not targets:
        return counts, {}
    width = max(len(ts) for ts in targets.values())
    cells = cells.where(F.col("g").isin(sorted(targets)))

    def edges(i: int) -> tuple[Column, Column]:
        pick = {g: ts[min(i, len(ts) - 1)] for g, ts in targets.items()}
        return (
            _per_group({g: t.lo for g, t in pick.items()}),
            _per_group({g: t.hi for g, t in pick.items()}),
        )

    while max(t.inside for ts in targets.values() for t in ts) > limit:
        inner, aggs = {}, []
        for i in range(width):
            lo, hi = edges(i)
            inner[f"w{i}"] = F.when((F.col("v") > lo) & (F.col("v") < hi), F.col("v"))
            aggs += [
                F.count_if(F.col("v") <= lo).alias(f"before{i}"),
                F.count(f"w{i}").alias(f"inside{i}"),
                _grid(f"w{i}").alias(f"grid{i}"),
            ]
        for r in cells.withColumns(inner).groupBy("g").agg(*aggs).collect():
            for i, t in enumerate(targets[r.g]):
                if r[f"inside{i}"] > limit:
                    t.narrow(r[f"grid{i}"], r[f"before{i}"], r[f"inside{i}"], slack)
                else:
                    t.inside = r[f"inside{i}"]

    v, kept, below = F.col("v"), F.lit(False), F.lit(-_INF)
    for i in range(width):
        lo, hi = edges(i)
        kept = kept | ((v >= lo) & (v <= hi))
        below = F.greatest(below, F.when(v > hi, hi))
    ladder = cells.groupBy("g", F.when(kept, v).otherwise(below).alias("v"), (~kept).alias("gap")).agg(
        F.count("*").alias("n")
    )
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("v", "gap"))  # values inside brackets only
    asked = ", ".join(
        "array(" + ", ".join(f"{k}L" for t in targets.get(g, []) for k in (t.rank, t.rank + 1)) + ")"
        for g in range(max(targets) + 1)
    )
    rows = ladder.withColumn("upto", upto).where(
        f"exists(element_at(array({asked}), g + 1), k -> k < upto AND k >= upto - n)"
    ).collect()

    def at(g: int, rank: int):
        return next((r for r in rows if r.g == g and r.upto - r.n <= rank < r.upto and not r.gap), None)

    out: dict[int, list[OrderStat]] = {}
    for g, ts in targets.items():
        out[g] = []
        for t in ts:
            here, after = at(g, t.rank), at(g, t.rank + 1)
            if here is None or (after is None and t.rank + 1 < counts[g]):
                if slack > GRID // 8:
                    raise RuntimeError("order statistics did not converge")
                return order_statistics(long, ranks, limit, slack * 4)  # a sketch missed: widen and go again
            out[g].append(OrderStat(here.v, after.v if after else None, here.upto - here.n, here.n))
    return counts, out


def exact_quantiles_long(
    long: DataFrame, probabilities: Sequence[float], limit: int = LIMIT
) -> dict[int, list[float]]:
    return quantiles_and_counts(long, probabilities, limit)[0]


def quantiles_and_counts(
    long: DataFrame, probabilities: Sequence[float], limit: int = LIMIT
) -> tuple[dict[int, list[float]], dict[int, int]]:
    """Linearly interpolated quantiles and the non-null count per group; groups without values are absent."""

    def ranks(counts: dict[int, int]) -> dict[int, list[int]]:
        return {g: [math.floor(p * (n - 1)) for p in probabilities] for g, n in counts.items() if n}

    counts, stats = order_statistics(long, ranks, limit)
    out = {}
    for g, found in stats.items():
        row = []
        for p, s in zip(probabilities, found):
            position = p * (counts[g] - 1)
            share = position - math.floor(position)
            row.append(s.value if share == 0 else s.value + (s.following - s.value) * share)
        out[g] = row
    return out, counts


def exact_quantiles(
    df: DataFrame, names: Sequence[str], probabilities: Sequence[float], limit: int = LIMIT
) -> dict[str, list[float]]:
    """Quantiles of several columns together; columns without values are absent."""
    if not names:
        return {}
    found = exact_quantiles_long(numeric_long(df, names), probabilities, limit)
    return {names[g]: row for g, row in found.items()}
