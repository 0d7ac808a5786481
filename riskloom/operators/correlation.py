"""Correlations with the label and between features."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import domain as d
from riskloom.functions.columns import col, name_of, number_array, numeric_columns, numeric_long
from riskloom.functions.expressions import correlation, number
from riskloom.operators.selection import exact_quantiles

MISSING_SKIP = 0.99
FLAT = 1e-10


def target_correlation(df: DataFrame, top_n: int = 20, label: str = d.LABEL) -> DataFrame | None:
    """Point-biserial correlation of every numeric feature with the label, missing cells set to the
    column median of the labelled rows; strongest `top_n`, with a two-sided p-value."""
    if label not in df.columns:
        return None
    names = numeric_columns(df, exclude=(*d.META_COLUMNS, label))
    if not names:
        return None
    medians = exact_quantiles(df.where(col(label).isNotNull()), names, [0.5])
    fill = F.expr(f"element_at({number_array(medians.get(c, [0.0])[0] for c in names)}, g + 1)")
    y = F.col("y")
    filled = F.when(y.isNotNull(), F.coalesce("v", fill))
    rows = (
        numeric_long(df, names, keep=[number(col(label)).alias("y")])
        .groupBy("g")
        .agg(
            correlation(filled, y).alias("r"), F.count(y).alias("n"),
            F.avg(F.col("v").isNull().cast("int")).alias("missing"),
        )
        .where((F.col("missing") < MISSING_SKIP) & F.col("r").isNotNull() & ~F.isnan("r"))
        .collect()  # one row per column
    )
    out = []
    for row in rows:
        p = correlation_p_value(row.r, row.n)
        r = round(row.r, 4)
        out.append((names[row.g], r, abs(r), round(p, 6), p < 0.05))
    out.sort(key=lambda x: (-x[2], x[0]))
    schema = "feature string, correlation double, abs_correlation double, p_value double, significant boolean"
    return df.sparkSession.createDataFrame(out[:top_n], schema)


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson correlation: t test with n - 2 degrees of freedom."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return _regularised_beta(1 - r * r, (n - 2) / 2, 0.5)


def _log_beta(a: float, b: float) -> float:
    """log B(a, b). Of a large and a small argument, log-gamma would lose the digits of the difference; the
    asymptotic series of lgamma(large + small) - lgamma(large) keeps them."""
    a, b = max(a, b), min(a, b)
    if a < 100:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    stirling = 1 / (12 * (a + b)) - 1 / (12 * a) - 1 / (360 * (a + b) ** 3) + 1 / (360 * a ** 3)
    rise = (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + stirling
    return math.lgamma(b) - rise


def _regularised_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b) by its continued fraction, evaluated on the side where it converges quickly."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _regularised_beta(1 - x, b, a)
    front = math.exp(
        -_log_beta(a, b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny, c, dd, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        dd = 1 / (1 + step * dd or tiny)
        c = 1 + step / c or tiny
        f *= c * dd
        if abs(1 - c * dd) < 1e-15:
            break
    return front * (f - 1)


def label_correlations(df: DataFrame, names: Sequence[str], label: str = d.LABEL) -> list:
    """Pairwise-complete correlation with the label and the mean, one row per column."""
    long = numeric_long(df, names, keep=[number(col(label)).alias("y")])
    return long.groupBy("g").agg(correlation(F.col("v"), F.col("y")).alias("r"), F.avg("v").alias("mean")).collect()


def correlation_matrix(df: DataFrame, top_n: int = d.CORRELATION_TOP_N, label: str = d.LABEL) -> DataFrame:
    """Lower triangle of the pairwise-complete correlations among the label and the `top_n - 1` numeric
    features most correlated with it. Unknown correlations are NULL."""
    names = numeric_columns(df, exclude=(d.ID,))
    rows = {names[r.g]: r for r in label_correlations(df, names, label)}
    known = [
        (-abs(r.r), i, c) for i, c in enumerate(names)
        if c != label and (r := rows.get(c)) and r.r is not None and not math.isnan(r.r)
    ]
    chosen = [label] + [c for _, _, c in sorted(known)[: top_n - 1]]
    centre = np.array([rows[c].mean for c in chosen])
    return pairwise_correlation(df, chosen, centre)


def pairwise_correlation(df: DataFrame, names: Sequence[str], centre: np.ndarray) -> DataFrame:
    """All correlations of `names` in one pass.

    Each task folds its rows into k x k product sums with matrix products (k*k/2 `corr` expressions
    would not fit generated code), and Spark adds the sums up. Centring near the mean keeps them exact.
    """
    k = len(names)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            seen = ~np.isnan(x)
            x = np.where(seen, x - centre, 0.0)
            seen = seen.astype(float)
            n += seen.T @ seen
            sx += x.T @ seen
            sxx += (x * x).T @ seen
            sxy += x.T @ x
        i, j = np.tril_indices(k)
        yield pd.DataFrame({
            "i": i, "j": j, "n": n[i, j], "sx": sx[i, j], "sy": sx[j, i],
            "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j],
        })

    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    total = (
        df.select(*[number(col(c)).alias(f"c{i}") for i, c in enumerate(names)])
        .mapInPandas(sums, schema)
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    # a feature constant on the shared rows leaves only rounding noise here
    varies = (vx > FLAT * F.col("sxx")) & (vy > FLAT * F.col("syy"))
    r = F.when((F.col("n") > 1) & varies, cov / (F.sqrt(vx) * F.sqrt(vy)))
    return total.select(
        name_of(names, "i").alias("feature_x"), name_of(names, "j").alias("feature_y"),
        F.round(r, 4).alias("correlation"),
    )


def importance_table(features: DataFrame, top_n: int | None = None) -> DataFrame:
    """Rank, share and running share of (feature, importance); one row per feature."""
    order = Window.orderBy(F.desc("importance"), "feature")
    total = F.sum("importance").over(Window.partitionBy())
    running = F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, 0))
    safe = F.when(total == 0, 1.0).otherwise(total)
    base = features if top_n is None else features.orderBy(F.desc("importance"), "feature").limit(top_n)
    return base.select(
        F.row_number().over(order).alias("rank"), "feature", F.round("importance", 6).alias("importance"),
        F.round(F.col("importance") / safe * 100, 2).alias("share_pct"),
        F.round(running / safe * 100, 2).alias("cumulative_pct"),
    )
