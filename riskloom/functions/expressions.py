"""Column expressions: everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import domain as d


def number(c: Column) -> Column:
    """Cast to double with NaN turned into NULL, so that one notion of 'missing' remains."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den; NULL when the denominator is NULL, zero, NaN or infinite."""
    den = number(den)
    finite = F.abs(den) < F.lit(float("inf"))
    return F.when(finite & (den != 0), num.cast("double") / den)


def years(days: Column, round_to: int | None = None) -> Column:
    value = F.abs(days.cast("double")) / F.lit(d.DAYS_PER_YEAR)
    return value if round_to is None else F.round(value, round_to)


def age_years(days_birth: Column, round_to: int | None = None) -> Column:
    return years(days_birth, round_to)


def tenure_years(days_employed: Column, round_to: int | None = None) -> Column:
    """Employment length; the 'not employed' sentinel becomes NULL."""
    return years(F.nullif(days_employed.cast("double"), F.lit(float(d.EMPLOYED_SENTINEL))), round_to)


def _bands(value: Column, bands: list[tuple]) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(bands):
        inside = value >= lo if hi is None else (value >= lo) & (value < hi)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def age_bin(age: Column) -> Column:
    """Five-year left-closed bins written like '[20, 25)'; outside the edges -> NULL."""
    edges = d.AGE_EDGES
    return _bands(age, [(a, b, f"[{a}, {b})") for a, b in zip(edges, edges[1:])])


def tenure_band(tenure: Column) -> Column:
    return _bands(tenure, d.TENURE_BANDS)


def label_name(label: Column) -> Column:
    return F.when(label == 0, "Non-Default").when(label == 1, "Default")


def class_share(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def correlation(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson aggregate; NULL without variance (`corr` raises there in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


# ---- scoring ---------------------------------------------------------------------------------

def _checked(p: Column) -> Column:
    bad = F.raise_error(F.format_string("probability must be in [0.0, 1.0], got %.6f", p))
    return F.when((p >= 0) & (p <= 1), p).when(p.isNull(), F.lit(None)).otherwise(bad.cast("double"))


def risk_score(p: Column) -> Column:
    return (_checked(p) * 1000).cast("int")


def risk_band(p: Column) -> Column:
    p = _checked(p)
    out = F.lit(d.RISK_BANDS[-1][1])
    for upper, name in reversed(d.RISK_BANDS[:-1]):
        out = F.when(p < upper, F.lit(name)).otherwise(out)
    return F.when(p.isNotNull(), out)


# ---- deterministic pseudo-random order -------------------------------------------------------

KEY_RANGE = float(1 << 52)


def order_digest(key: Column, seed: int) -> Column:
    """Seeded shuffle key: sorting by it is a reproducible random order in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def order_number(digest: Column) -> Column:
    """The first 52 bits of the digest as a double (exact), in the same order as the digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double")


# ---- explanations ----------------------------------------------------------------------------

def impact_direction(value: Column) -> Column:
    return (
        F.when(value > 1e-6, "Increases Risk").when(value < -1e-6, "Decreases Risk").otherwise("Neutral")
    )


def impact_strength(value: Column, row_max: Column) -> Column:
    top = F.when(row_max == 0, 1.0).otherwise(row_max)
    ratio = F.abs(value) / top
    return F.when(ratio >= 0.5, "Strong").when(ratio >= 0.2, "Moderate").otherwise("Weak")
