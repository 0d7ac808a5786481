"""Business insights: all of them come out of one aggregation over the application table.

An insight names the columns it needs, the aggregates it reads and the text it writes. The runner
merges the aggregates of all insights whose columns exist into a single `agg`.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import domain as d
from riskloom.functions import expressions as X
from riskloom.functions.columns import col, is_missing
from riskloom.operators.selection import exact_quantiles_long
from riskloom.sources.tables import settle

log = logging.getLogger(__name__)
TEXT = ["category", "title", "finding", "recommendation", "severity"]


@dataclass(frozen=True)
class Text:
    category: str
    title: str
    finding: Column
    recommendation: str
    severity: Column | str = "info"

    def __post_init__(self) -> None:
        if isinstance(self.severity, str) and self.severity not in d.SEVERITIES:
            raise ValueError(f"severity must be one of {d.SEVERITIES}, got {self.severity!r}")

    def columns(self) -> list[Column]:
        level = F.lit(self.severity) if isinstance(self.severity, str) else self.severity
        return [
            F.lit(self.category).alias("category"), F.lit(self.title).alias("title"),
            self.finding.alias("finding"), F.lit(self.recommendation).alias("recommendation"),
            level.alias("severity"),
        ]


@dataclass(frozen=True)
class Insight:
    """aggregates -> derived metrics (by name) -> text. Derived names may be used by the text."""

    aggregates: dict[str, Column]
    metrics: dict[str, Column]
    text: Text


def _pct(mask: Column, y: Column) -> Column:
    return F.avg(F.when(mask, y)) * 100


def _fmt(pattern: str, *args: Column | str) -> Column:
    return F.format_string(pattern, *args)


def class_imbalance(df: DataFrame) -> Insight | None:
    if d.LABEL not in df.columns:
        return None
    y = col(d.LABEL)
    ratio = F.col("n_non_default") / F.greatest("n_default", F.lit(1))
    return Insight(
        {"n_default": F.count_if(y == 1), "n_non_default": F.count_if(y == 0), "default_rate": F.avg(y) * 100},
        {"default_rate": F.col("default_rate"), "imbalance_ratio": ratio},
        Text(
            "Target Variable", "Class Imbalance Detected",
            _fmt(
                "Of all applicants %.2f%% default: %,d repaid and %,d did not, which is %.1f to 1.",
                "default_rate", "n_non_default", "n_default", "imbalance_ratio",
            ),
            "Weight the positive class by the imbalance ratio when training, and judge models by ROC-AUC, "
            "PR-AUC and the KS statistic instead of accuracy.",
            F.when(F.col("imbalance_ratio") > d.IMBALANCE_CRITICAL, "critical")
            .when(F.col("imbalance_ratio") > d.IMBALANCE_WARNING, "warning").otherwise("info"),
        ),
    )


def income_patterns(df: DataFrame) -> Insight | None:
    if not {"AMT_INCOME_TOTAL", d.LABEL} <= set(df.columns):
        return None
    income, y = X.number(col("AMT_INCOME_TOTAL")), col(d.LABEL)
    # group 2 is everyone, groups 0 and 1 are the classes; one selection serves all three
    member = F.array(F.lit(2), F.when(y.isin(0, 1), y.cast("int")))
    long = df.select(F.explode(member).alias("g"), income.alias("v")).where("g IS NOT NULL")
    found = exact_quantiles_long(long, [0.5, 0.99])
    if 0 not in found or 1 not in found:
        return None
    m0, m1, p99 = found[0][0], found[1][0], found[2][1]
    gap = (m0 - m1) / max(m0, 1) * 100
    share = F.col("outlier_count") * 100.0 / F.col("total")
    return Insight(
        {"outlier_count": F.count_if(income > p99), "total": F.count("*")},
        {
            "median_income_default": F.lit(m1), "median_income_non_default": F.lit(m0),
            "income_gap_pct": F.lit(gap), "outlier_count": F.col("outlier_count"),
        },
        Text(
            "Financial", "Income Disparity Between Default Groups",
            _fmt(
                "Half of those who repay earn at least $%,.0f, half of those who default at least $%,.0f, a gap "
                "of %.1f%%.  Incomes of %,d applicants (%.1f%%) lie beyond the 99th percentile of $%,.0f.",
                F.lit(m0), F.lit(m1), F.lit(gap), F.col("outlier_count"), share, F.lit(p99),
            ),
            "Use credit-to-income and annuity-to-income ratios as features, and cap income at its 99th "
            "percentile before modelling.",
        ),
    )


def credit_patterns(df: DataFrame) -> Insight | None:
    if not {"AMT_CREDIT", d.LABEL} <= set(df.columns):
        return None
    credit, y = col("AMT_CREDIT"), col(d.LABEL)
    high = F.lit(0).cast("long")
    metrics = {
        "mean_credit_default": F.col("mean_credit_default"),
        "mean_credit_non_default": F.col("mean_credit_non_default"),
    }
    if "AMT_INCOME_TOTAL" in df.columns:
        high = F.count_if(X.safe_ratio(credit, col("AMT_INCOME_TOTAL")) > d.HIGH_CREDIT_INCOME)
        metrics["high_credit_income_ratio_count"] = F.col("high_ratio_count")
    more = F.col("mean_credit_default") > F.col("mean_credit_non_default")
    return Insight(
        {
            "mean_credit_default": F.avg(F.when(y == 1, credit)),
            "mean_credit_non_default": F.avg(F.when(y == 0, credit)),
            "high_ratio_count": high,
        },
        metrics,
        Text(
            "Financial", "Credit Amount Risk Profile",
            _fmt(
                "Loans that default have a %s mean than the others ($%,.0f against $%,.0f).  In %,d applications "
                "the credit is more than three annual incomes.",
                F.when(more, "larger").otherwise("smaller"), F.col("mean_credit_default"),
                F.col("mean_credit_non_default"), F.col("high_ratio_count"),
            ),
            "Use the credit-to-income ratio as a feature and flag applicants whose credit exceeds three "
            "times their income.",
            F.when(more, "warning").otherwise("info"),
        ),
    )


def age_patterns(df: DataFrame) -> Insight | None:
    if not {"DAYS_BIRTH", d.LABEL} <= set(df.columns):
        return None
    age, y = X.age_years(col("DAYS_BIRTH")), col(d.LABEL)
    bins = list(zip(d.AGE_EDGES, d.AGE_EDGES[1:]))
    by_bin = {f"bin_{a}": F.avg(F.when((age >= a) & (age < b), y)) for a, b in bins}
    # lowest bin among those with the highest rate
    ranked = F.array_sort(F.filter(
        F.array(*[
            F.struct((-F.col(f"bin_{a}")).alias("r"), F.lit(i).alias("i"), F.lit(f"[{a}, {b})").alias("name"))
            for i, (a, b) in enumerate(bins)
        ]),
        lambda s: s["r"].isNotNull(),
    ))
    return Insight(
        {
            "young_default_rate": _pct(age < d.YOUNG_AGE, y), "senior_default_rate": _pct(age > d.SENIOR_AGE, y),
            "overall_default_rate": F.avg(y) * 100, **by_bin,
        },
        {
            **{k: F.col(k) for k in ("young_default_rate", "senior_default_rate", "overall_default_rate")},
            "peak_age_bin": F.coalesce(F.get(ranked, 0)["name"], F.lit("N/A")),
        },
        Text(
            "Demographic", "Age-Based Default Risk",
            _fmt(
                "Of applicants below 30, %.1f%% default, compared with %.1f%% of all and %.1f%% of those above 55.  "
                "The rate peaks at ages %s.",
                "young_default_rate", "overall_default_rate", "senior_default_rate", "peak_age_bin",
            ),
            "Derive the age in years as a feature and consider risk tiers by age group.",
            F.when(F.col("young_default_rate") > F.col("overall_default_rate") * d.YOUNG_RISK_FACTOR, "warning")
            .otherwise("info"),
        ),
    )


def employment_patterns(df: DataFrame) -> Insight | None:
    if not {"DAYS_EMPLOYED", d.LABEL} <= set(df.columns):
        return None
    days, y = col("DAYS_EMPLOYED"), col(d.LABEL)
    return Insight(
        {
            "anomaly_count": F.count_if(days == d.EMPLOYED_SENTINEL), "total": F.count("*"),
            "short_tenure_def_rate": _pct(X.tenure_years(days) < d.SHORT_TENURE, y),
            "overall_default_rate": F.avg(y) * 100,
        },
        {
            "anomaly_count": F.col("anomaly_count"),
            "anomaly_pct": F.col("anomaly_count") * 100.0 / F.col("total"),
            "short_tenure_def_rate": F.col("short_tenure_def_rate"),
            "overall_default_rate": F.col("overall_default_rate"),
        },
        Text(
            "Financial", "Employment Duration — Anomaly & Risk Analysis",
            _fmt(
                f"In %,d rows (%.1f%%) DAYS_EMPLOYED is {d.EMPLOYED_SENTINEL}, which stands for no employment.  "
                "Among those employed for less than a year %.1f%% default, among all %.1f%%.",
                "anomaly_count", "anomaly_pct", "short_tenure_def_rate", "overall_default_rate",
            ),
            "Turn the sentinel into a missing value with its own flag, then derive the employment length "
            "in years.",
            "warning",
        ),
    )


def external_scores(df: DataFrame) -> Insight | None:
    names = [c for c in d.EXTERNAL_SCORES if c in df.columns and d.LABEL in df.columns]
    if not names:
        return None
    y = col(d.LABEL)
    aggregates, metrics, parts = {}, {}, []
    for c in names:
        aggregates[f"corr_{c}"] = X.correlation(X.number(col(c)), y.cast("double"))
        aggregates[f"null_{c}"] = F.avg(is_missing(df, c).cast("int"))
        metrics[f"corr_{c}"] = F.round(F.col(f"corr_{c}"), 4)
        metrics[f"null_pct_{c}"] = F.round(F.col(f"null_{c}") * 100, 2)
        parts.append(_fmt(f"{c}: %.4f (%.1f%% missing)", f"corr_{c}", f"null_pct_{c}"))
    ranked = F.array_sort(F.array(*[
        F.struct(F.coalesce(F.col(f"corr_{c}"), F.lit(2.0)).alias("r"), F.lit(i).alias("i"), F.lit(c).alias("name"))
        for i, c in enumerate(names)
    ]))
    metrics["strongest_negative"] = ranked[0]["name"]
    return Insight(
        aggregates, metrics,
        Text(
            "Credit History", "External Credit Scores — Top Predictors",
            F.concat(
                F.lit("Correlation of each external score with the outcome: "), F.concat_ws(", ", *parts),
                F.lit(".  The lowest is that of "), F.col("strongest_negative"),
                F.lit(", so a high value there goes with repayment."),
            ),
            "External scores usually predict best; add their mean so that applicants who lack one keep the "
            "signal.",
        ),
    )


def missing_severity(df: DataFrame) -> Insight:
    names = df.columns
    share = {c: F.avg(is_missing(df, c).cast("int")) * 100 for c in names}
    table = F.array(*[
        F.struct((-F.col(f"miss_{i}")).alias("r"), F.lit(i).alias("i"), F.lit(c).alias("name"))
        for i, c in enumerate(names)
    ])
    high = F.filter(table, lambda s: -s["r"] > d.HIGH_MISSING_PCT)
    moderate = F.filter(
        table, lambda s: (-s["r"] > d.MODERATE_MISSING_PCT) & (-s["r"] <= d.HIGH_MISSING_PCT)
    )
    worst = F.transform(
        F.slice(F.array_sort(high), 1, 5), lambda s: F.concat(F.lit("`"), s["name"], _fmt("` (%.1f%%)", -s["r"]))
    )
    return Insight(
        {f"miss_{i}": share[c] for i, c in enumerate(names)},
        {
            "high_missing_count": F.size(high), "moderate_missing_count": F.size(moderate),
            "worst_columns": F.when(F.size(high) > 0, F.array_join(worst, ", ")).otherwise("none"),
        },
        Text(
            "Data Quality", "Missing Value Severity Assessment",
            _fmt(
                "More than half of the values are missing in %d features, a tenth to a half in %d.  Emptiest: %s.",
                "high_missing_count", "moderate_missing_count", "worst_columns",
            ),
            "Drop features that are more than 80% missing, fill the others by median or mode, and add "
            "missing-value flags where more than 10% is missing.",
            F.when(F.col("high_missing_count") > 0, "warning").otherwise("info"),
        ),
    )


def document_flags(df: DataFrame) -> Insight | None:
    names = [c for c in df.columns if c.startswith("FLAG_DOCUMENT_")]
    if d.LABEL not in df.columns or not names:
        return None
    y = col(d.LABEL)
    aggregates = {"overall_default_rate": F.avg(y) * 100}
    metrics = {"overall_default_rate": F.col("overall_default_rate")}
    entries = []
    for c in names:
        aggregates[f"n_{c}"] = F.count_if(col(c) == 1)
        aggregates[f"raw_{c}"] = _pct(col(c) == 1, y)
        rate = F.when(F.col(f"n_{c}") >= d.DOCUMENT_MIN_ROWS, F.round(F.col(f"raw_{c}"), 2))
        metrics[f"rate_{c}"] = rate
        entries.append(F.struct(F.lit(c).alias("name"), F.col(f"rate_{c}").alias("rate")))
    risky = F.filter(
        F.array(*entries), lambda s: s["rate"] > F.col("overall_default_rate") * d.DOCUMENT_RISK_FACTOR
    )
    listed = F.array_join(
        F.transform(F.slice(risky, 1, 5), lambda s: F.concat(s["name"], _fmt(" (%.1f%%)", s["rate"]))), ", "
    )
    return Insight(
        aggregates, metrics,
        Text(
            "Behavioural", "Document Submission Flags — Risk Signal",
            F.concat(
                _fmt(f"The data has {len(names)} document flags; %.2f%% of all applicants default.  ", "overall_default_rate"),
                F.when(F.size(risky) > 0, F.concat(F.lit("Flags whose holders default over 1.2 times as often: "), listed))
                .otherwise("No flag stands out."),
            ),
            "Consider the number of submitted documents as one combined feature.",
        ),
    )


ANALYSES: dict[str, Callable[[DataFrame], Insight | None]] = {
    "class_imbalance": class_imbalance,
    "income_patterns": income_patterns,
    "credit_patterns": credit_patterns,
    "age_patterns": age_patterns,
    "employment_patterns": employment_patterns,
    "external_scores": external_scores,
    "missing_values": missing_severity,
    "document_flags": document_flags,
}
ORDER = [*list(ANALYSES)[:7], "bureau", "document_flags"]


def insight(df: DataFrame, name: str) -> DataFrame | None:
    """Metrics and text of one insight in one row; None when its columns are absent."""
    found = ANALYSES[name](df)
    if found is None:
        return None
    raw = df.agg(*[e.alias(a) for a, e in found.aggregates.items()])
    metric = raw.withColumns(found.metrics)
    return metric.select(*found.metrics, *found.text.columns())


def bureau_overview(bureau: DataFrame | None) -> DataFrame | None:
    """Size, coverage and overdue records of the bureau table, with its five commonest credit types."""
    if bureau is None:
        return None
    overdue = F.lit(0).cast("long")
    if "CREDIT_DAY_OVERDUE" in bureau.columns:
        overdue = F.count_if(col("CREDIT_DAY_OVERDUE") > 0)
    # counting per client first keeps the distinct count an ordinary two-step aggregation
    per_client = bureau.groupBy(col(d.ID)).agg(F.count("*").alias("n"), overdue.alias("o"))
    totals = per_client.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_bureau_records"),
        F.count(col(d.ID)).alias("unique_clients"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("overdue_record_count"),
    )
    top = F.lit("")
    if "CREDIT_TYPE" in bureau.columns:
        common = (
            bureau.where(col("CREDIT_TYPE").isNotNull()).groupBy("CREDIT_TYPE").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "CREDIT_TYPE").limit(5)
        )
        listed = common.agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("CREDIT_TYPE").alias("t")))),
            lambda s: F.concat(F.lit("'"), s["t"], F.lit("': "), (-s["k"]).cast("string")),
        ), ", ").alias("types"))
        totals = totals.crossJoin(F.broadcast(listed))  # one row
        top = F.when(F.col("types") != "", F.concat(F.lit("Commonest credit types: {"), F.col("types"), F.lit("}."))).otherwise("")
    average = F.round(F.col("total_bureau_records") / F.greatest("unique_clients", F.lit(1)), 1)
    text = Text(
        "Credit History", "Bureau Credit History — Overview",
        F.concat(
            _fmt(
                "%,d bureau records belong to %,d applicants, %.1f to each on average.  %,d of them are overdue.  ",
                "total_bureau_records", "unique_clients", "avg_entries_per_client", "overdue_record_count",
            ),
            top,
        ),
        "Aggregate the bureau records per client (active and closed loans, overdue days, credit sums) and join "
        "them to the applications before training.",
    )
    metrics = ["total_bureau_records", "unique_clients", "avg_entries_per_client", "overdue_record_count"]
    return totals.withColumn("avg_entries_per_client", average).select(*metrics, *text.columns())


def all_insights(
    df: DataFrame, bureau: DataFrame | None = None, names: Sequence[str] = tuple(ORDER)
) -> DataFrame:
    """Every insight that applies, in order. One that cannot be built is logged and left out."""
    aggregates: dict[str, Column] = {}
    rows = []
    for position, name in enumerate(names):
        if name == "bureau":
            continue
        try:
            found = ANALYSES[name](df)
            if found is None:
                continue
            df.agg(*[e.alias(a) for a, e in found.aggregates.items()]).schema  # surfaces analysis errors here
        except Exception:  # noqa: BLE001 - one broken insight must not stop the others
            log.exception("insight %s failed", name)
            continue
        rows.append((position, name, found))
        aggregates |= {f"{name}__{a}": e for a, e in found.aggregates.items()}
    parts = []
    if rows:
        # one row of aggregates; each insight in turn sees its own under their plain names
        table = df.agg(*[e.alias(a) for a, e in aggregates.items()])
        for position, name, found in rows:
            table = (
                table.withColumns({a: F.col(f"{name}__{a}") for a in found.aggregates})
                .withColumns(found.metrics)
                .withColumn(f"_row{position}", F.struct(F.lit(position).alias("position"), *found.text.columns()))
                .drop(*found.aggregates, *found.metrics)
            )
        parts.append(table.select(F.inline(F.array(*[F.col(f"_row{p}") for p, _, _ in rows]))))
    overview = bureau_overview(bureau)
    if overview is not None and "bureau" in names:
        parts.append(overview.select(F.lit(names.index("bureau")).alias("position"), *TEXT))
    if not parts:
        return df.sparkSession.createDataFrame([], "position int, " + ", ".join(f"{c} string" for c in TEXT))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def isolated_insights(
    df: DataFrame, bureau: DataFrame | None = None, names: Sequence[str] = tuple(ORDER)
) -> DataFrame:
    """`all_insights`, evaluated now. If a value makes the shared pass fail, every insight gets a pass of its own, and the
    ones that fail are logged and left out."""
    try:
        return settle(all_insights(df, bureau, names), "insights")
    except Exception:  # noqa: BLE001 - one broken insight must not stop the others
        log.exception("the shared pass failed; trying the insights one by one")
    out = df.sparkSession.createDataFrame([], "position int, " + ", ".join(f"{c} string" for c in TEXT))
    for position, name in enumerate(names):
        try:
            one = settle(all_insights(df, bureau, [name]), "insight")
        except Exception:  # noqa: BLE001
            log.exception("insight %s failed", name)
            continue
        out = out.unionByName(one.withColumn("position", F.lit(position)))
    return out


def severity_counts(insights: DataFrame) -> DataFrame:
    return insights.groupBy("severity").agg(F.count("*").alias("insight_count"))
