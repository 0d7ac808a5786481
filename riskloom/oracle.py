"""The same results in plain SQL for an independent engine (DuckDB dialect), used only for checking."""

from __future__ import annotations

from riskloom import catalog, domain as d
from riskloom.sources.binding import APPLICATION_SQL, BUREAU_SQL

APP = "application AS (" + APPLICATION_SQL.format(orders="orders", customer="customer") + ")"
BUREAU = "bureau AS (" + BUREAU_SQL.format(lineitem="lineitem") + ")"

INTEGERS = {
    "SK_ID_CURR": "bigint", "TARGET": "int", "DAYS_BIRTH": "bigint", "DAYS_EMPLOYED": "bigint",
    "FLAG_DOCUMENT_2": "int", "FLAG_DOCUMENT_3": "int", "FLAG_DOCUMENT_6": "int",
}
DOUBLES = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
           "MOSTLY_NULL", "CONSTANT_COL"]
TEXTS = ["CODE_GENDER", "NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE", "FLAG_OWN_CAR"]
COLUMNS = ["SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED",
           "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "CODE_GENDER", "NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE",
           "FLAG_OWN_CAR", "FLAG_DOCUMENT_2", "FLAG_DOCUMENT_3", "FLAG_DOCUMENT_6", "MOSTLY_NULL", "CONSTANT_COL"]
NUMERICS = [c for c in COLUMNS if c not in TEXTS]
PLAIN_FEATURES = [c for c in NUMERICS if c not in ("SK_ID_CURR", "TARGET")]

DAYS = "CAST(365.25 AS DOUBLE)"
AGE = f"abs(CAST(DAYS_BIRTH AS DOUBLE)) / {DAYS}"
TENURE = f"abs(nullif(CAST(DAYS_EMPLOYED AS DOUBLE), 365243)) / {DAYS}"


def q(name: str) -> str:
    return '"' + name + '"'


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} <> 0 AND NOT isinf({den}) THEN ({num}) / {den} END"


RATIOS = {
    "debt_to_income_ratio": ratio("AMT_CREDIT + AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "credit_to_income_ratio": ratio("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "annuity_to_income_ratio": ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "employment_age_ratio": ratio(TENURE, f"({AGE})"),
}
ENGINEERED = "engineered AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in RATIOS.items()) + " FROM application)"


def bands(value: str, table: list[tuple]) -> str:
    arms = [
        f"WHEN {value} >= {lo}" + ("" if hi is None else f" AND {value} < {hi}") + f" THEN '{name}'"
        for lo, hi, name in table
    ]
    return "CASE " + " ".join(arms) + " END"


# Fixed values, written again here, so that a wrong one in the library shows.
AGE_BANDS = [(a, a + 5, f"[{a}, {a + 5})") for a in (20, 25, 30, 35, 40, 45, 50, 55, 60, 65)]
TENURE_BANDS = [(0, 1, "<1yr"), (1, 3, "1-3yr"), (3, 5, "3-5yr"), (5, 10, "5-10yr"), (10, 20, "10-20yr"), (20, None, "20+yr")]

KEY = "md5('42-' || CAST(SK_ID_CURR AS VARCHAR))"


def split(source: str = "application", test_size: float = 0.2) -> str:
    """CTEs ending in `parts`: `source` with is_test, by class quota in digest order."""
    return f"""
    classes AS (SELECT TARGET AS t, count(*) AS c FROM {source} GROUP BY 1),
    total AS (SELECT ceil(CAST({test_size} AS DOUBLE) * sum(c)) AS want, CAST(sum(c) AS DOUBLE) AS n FROM classes),
    shares AS (SELECT t, floor(want * c / n) AS base, want * c / n - floor(want * c / n) AS rest, want
               FROM classes, total),
    quotas AS (SELECT t, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, t) <= want - sum(base) OVER ()
                                     THEN 1 ELSE 0 END AS quota FROM shares),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY {KEY}, SK_ID_CURR) AS rn FROM {source}),
    parts AS (SELECT o.* EXCLUDE (rn), o.rn <= s.quota AS is_test FROM ordered o JOIN quotas s ON o.TARGET = s.t)"""


TRAIN = "train AS (SELECT * EXCLUDE (is_test) FROM parts WHERE NOT is_test)"


def first_rows(source: str, n: int, columns: str) -> str:
    return f"SELECT {columns} FROM {source} ORDER BY {KEY}, SK_ID_CURR LIMIT {n}"


# ---- profile ---------------------------------------------------------------------------------

def narrow_types() -> str:
    rows = []
    for c, t in INTEGERS.items():
        rows.append(f"""SELECT '{c}' AS "column", CASE
            WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint'
            WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
            WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS type,
            CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM application""")
    for c in DOUBLES:
        rows.append(f"""SELECT '{c}', 'float', round(CAST(CAST(min({c}) AS FLOAT) AS DOUBLE), 4),
            round(CAST(CAST(max({c}) AS FLOAT) AS DOUBLE), 4) FROM application""")
    return with_(APP) + union(rows)


def column_types() -> str:
    rows = []
    for c in COLUMNS:
        if c in INTEGERS:
            dtype, kind, shown = INTEGERS[c], "integer", "CAST(v AS VARCHAR)"
        elif c in DOUBLES:
            dtype, kind, shown = "double", "float", "printf('%.4f', v)"
        else:
            dtype, kind, shown = "string", "string", "v"
        rows.append(f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, '{kind}' AS kind,
            (SELECT count(DISTINCT {c}) FROM application) AS unique_count,
            (SELECT string_agg({shown}, ', ' ORDER BY v) FROM
               (SELECT DISTINCT {c} AS v FROM application WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 3)) AS sample_values""")
    return union(rows)


def missing() -> str:
    rows = [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM application" for c in COLUMNS]
    return with_(APP) + f"SELECT \"column\", missing_count, CAST(missing_pct AS DOUBLE) AS missing_pct FROM ({union(rows)}) WHERE missing_count > 0"


def duplicates(columns: str) -> str:
    return with_(APP) + f"""
    SELECT n AS total_rows, n - u AS duplicate_rows, n - ids AS id_duplicates,
           round(CAST(n - u AS DOUBLE) / n * 100, 4) AS duplicate_pct, n = u AS is_unique
    FROM (SELECT count(*) AS n, count(DISTINCT SK_ID_CURR) AS ids FROM application),
         (SELECT count(*) AS u FROM (SELECT DISTINCT {columns} FROM application))"""


def half_up(x: str, digits: int = 4) -> str:
    """Round decimal ties away from zero; rounding the binary value would send 0.25125 down."""
    return f"CAST(round(CAST({x} AS DECIMAL(30, 10)), {digits}) AS DOUBLE)"


def numeric_summary() -> str:
    rows = [f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min,
        {half_up(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25, {half_up(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50,
        {half_up(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max,
        round(CASE WHEN stddev_samp({c}) = 0 THEN 0 ELSE skewness({c}) END, 4) AS skewness,
        round(CASE WHEN stddev_samp({c}) = 0 THEN 0 ELSE kurtosis({c}) END, 4) AS kurtosis,
        CAST(round((count(*) - count({c})) * 100.0 / count(*), 2) AS DOUBLE) AS missing_pct,
        count(DISTINCT {c}) AS unique_count FROM application""" for c in NUMERICS]
    return with_(APP) + union(rows)


def categorical_summary() -> str:
    rows = [f"""SELECT '{c}' AS "column", s.u AS unique_values,
        CAST(round((s.n - s.p) * 100.0 / s.n, 2) AS DOUBLE) AS missing_pct, t.v AS top_value, t.k AS top_value_count,
        round(CAST(t.k AS DOUBLE) / greatest(s.p, 1) * 100, 2) AS top_value_pct
        FROM (SELECT count(*) AS n, count({c}) AS p, count(DISTINCT {c}) AS u FROM application) s,
             (SELECT {c} AS v, count(*) AS k FROM application WHERE {c} IS NOT NULL GROUP BY 1
              ORDER BY 2 DESC, 1 LIMIT 1) t""" for c in TEXTS]
    return with_(APP) + union(rows)


def feature_categories() -> str:
    owner = {f: c for c, fs in d.FEATURE_CATALOGUE.items() for f in fs}
    rows = [f"SELECT '{owner.get(c, 'other')}' AS category, '{c}' AS feature, count({c}) AS non_null_count "
            "FROM application" for c in COLUMNS if c not in d.META_COLUMNS]
    return with_(APP) + union(rows)


def target_correlation() -> str:
    rows = [f"""SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS lost, count(*) AS n,
        covar_pop(x, CAST(TARGET AS DOUBLE)) AS cov, stddev_pop(x) * stddev_pop(CAST(TARGET AS DOUBLE)) AS den
        FROM (SELECT TARGET, {c}, CAST(coalesce({c}, (SELECT median(CAST({c} AS DOUBLE)) FROM application), 0) AS DOUBLE)
              AS x FROM application)""" for c in PLAIN_FEATURES]
    # the p-value by integrating the t density with Simpson's rule
    return with_(APP) + f"""
    , raw AS ({union(rows)}),
    r AS (SELECT feature, n, cov / den AS r FROM raw WHERE lost < 0.99 AND den > 0),
    t AS (SELECT *, least(abs(r) * sqrt((n - 2) / (1 - r * r)), 40) AS t, CAST(n - 2 AS DOUBLE) AS v FROM r),
    area AS (SELECT feature, any_value(r) AS r,
        sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
            * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi())
            * pow(1 + pow(t * i / 4000, 2) / v, -(v + 1) / 2)) * any_value(t) / 4000 / 3 AS half
        FROM t, range(4001) AS g(i) GROUP BY feature)
    SELECT feature, round(r, 4) AS correlation, abs(round(r, 4)) AS abs_correlation,
           round(greatest(1 - 2 * half, 0), 6) + 0.0::DOUBLE AS p_value, 1 - 2 * half < 0.05 AS significant
    FROM area ORDER BY abs_correlation DESC, feature LIMIT 20"""


def correlation_matrix() -> str:
    names = ["TARGET", *PLAIN_FEATURES]
    cells = [f"SELECT {i} AS i, '{c}' AS c, SK_ID_CURR AS id, CAST({c} AS DOUBLE) AS v FROM application"
             for i, c in enumerate(names)]
    return with_(APP) + f"""
    , cells AS ({union(cells)}),
    strength AS (SELECT a.i, a.c, covar_pop(a.v, b.v) AS cov, stddev_pop(a.v) * stddev_pop(b.v) AS den
                 FROM cells a JOIN cells b ON a.id = b.id AND b.i = 0 WHERE a.v IS NOT NULL AND b.v IS NOT NULL
                 GROUP BY a.i, a.c),
    chosen AS (SELECT c, i, CASE WHEN i = 0 THEN 0 ELSE row_number() OVER (PARTITION BY i = 0 ORDER BY abs(cov / den) DESC, i) END AS rank
               FROM strength WHERE den > 0),
    pairs AS (SELECT x.c AS feature_x, y.c AS feature_y, x.rank AS rx, y.rank AS ry FROM chosen x JOIN chosen y ON x.rank >= y.rank
              WHERE x.rank < 30 AND y.rank < 30),
    found AS (SELECT a.c AS cx, b.c AS cy, covar_pop(a.v, b.v) AS cov, stddev_pop(a.v) * stddev_pop(b.v) AS den
              FROM cells a JOIN cells b ON a.id = b.id WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2)
    SELECT feature_x, feature_y, round(CASE WHEN den > 0 THEN cov / den END, 4) AS correlation
    FROM pairs LEFT JOIN found ON cx = feature_x AND cy = feature_y"""


CAPPED = """income AS (SELECT TARGET AS label, AMT_INCOME_TOTAL AS value FROM application
    WHERE AMT_INCOME_TOTAL <= (SELECT quantile_cont(AMT_INCOME_TOTAL, 0.99) FROM application))"""
CREDIT = """credit AS (SELECT TARGET AS label, AMT_CREDIT AS value FROM application
    WHERE AMT_CREDIT IS NOT NULL AND AMT_ANNUITY IS NOT NULL)"""
AGES = f"ages AS (SELECT TARGET AS label, round({AGE}, 1) AS value FROM application)"
TENURES = f"""years AS (SELECT SK_ID_CURR, TARGET AS label, round({TENURE}, 1) AS value FROM application),
    tenures AS (SELECT SK_ID_CURR, label, CASE WHEN value > cap THEN cap ELSE value END AS value
                FROM years, (SELECT quantile_cont(value, 0.98) AS cap FROM years))"""


def histogram(source: str, bins: int) -> str:
    return f"""
    , ranges AS (SELECT label, min(value) AS lo, max(value) AS hi, count(*) AS total FROM {source}
                 WHERE value IS NOT NULL GROUP BY label),
    hits AS (SELECT s.label, CAST(least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin,
             count(*) AS n FROM {source} s JOIN ranges r ON s.label = r.label WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT r.label, CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * ((hi - lo) / {bins}), 4) AS bin_start,
           round(lo + (b.bin + 1) * ((hi - lo) / {bins}), 4) AS bin_end, coalesce(n, 0) AS n,
           round(coalesce(n, 0) / (total * ((hi - lo) / {bins})), 9) AS density
    FROM ranges r CROSS JOIN range({bins}) AS b(bin) LEFT JOIN hits h ON h.label = r.label AND h.bin = b.bin"""


def rates(source: str) -> str:
    return f"""SELECT bin, count(*) AS row_count, round(avg(label) * 100, 4) AS default_rate_pct,
        (SELECT round(avg(label) * 100, 4) FROM {source}) AS overall_rate_pct
        FROM {source} WHERE bin IS NOT NULL GROUP BY bin"""


# ---- insights --------------------------------------------------------------------------------

def _class_imbalance() -> str:
    return """SELECT default_rate, ratio AS imbalance_ratio, 'Target Variable' AS category,
      'Class Imbalance Detected' AS title,
      format('Of all applicants {:.2f}% default: {:,} repaid and {:,} did not, which is {:.1f} to 1.',
             default_rate, n0, n1, ratio) AS finding,
      CASE WHEN ratio > 10 THEN 'critical' WHEN ratio > 5 THEN 'warning' ELSE 'info' END AS severity
    FROM (SELECT avg(TARGET) * 100 AS default_rate, count(*) FILTER (TARGET = 0) AS n0,
                 count(*) FILTER (TARGET = 1) AS n1,
                 count(*) FILTER (TARGET = 0) / greatest(count(*) FILTER (TARGET = 1), 1) AS ratio FROM application)"""


def _income() -> str:
    return """SELECT m1 AS median_income_default, m0 AS median_income_non_default, gap AS income_gap_pct,
      outliers AS outlier_count, 'Financial' AS category, 'Income Disparity Between Default Groups' AS title,
      format('Half of those who repay earn at least ${:,.0f}, half of those who default at least ${:,.0f}, a gap of {:.1f}%.  Incomes of {:,} applicants ({:.1f}%) lie beyond the 99th percentile of ${:,.0f}.',
             m0, m1, gap, outliers, outliers * 100 / n, p99) AS finding, 'info' AS severity
    FROM (SELECT *, (m0 - m1) / greatest(m0, 1) * 100 AS gap,
                 (SELECT count(*) FROM application WHERE AMT_INCOME_TOTAL > p99) AS outliers
          FROM (SELECT median(AMT_INCOME_TOTAL) FILTER (TARGET = 1) AS m1, median(AMT_INCOME_TOTAL) FILTER (TARGET = 0) AS m0,
                       quantile_cont(AMT_INCOME_TOTAL, 0.99) AS p99, count(*) AS n FROM application))"""


def _credit() -> str:
    return f"""SELECT c1 AS mean_credit_default, c0 AS mean_credit_non_default, high AS high_credit_income_ratio_count,
      'Financial' AS category, 'Credit Amount Risk Profile' AS title,
      format('Loans that default have a {{}} mean than the others (${{:,.0f}} against ${{:,.0f}}).  In {{:,}} applications the credit is more than three annual incomes.',
             CASE WHEN c1 > c0 THEN 'larger' ELSE 'smaller' END, c1, c0, high) AS finding,
      CASE WHEN c1 > c0 THEN 'warning' ELSE 'info' END AS severity
    FROM (SELECT round(avg(AMT_CREDIT) FILTER (TARGET = 1), 6) AS c1, round(avg(AMT_CREDIT) FILTER (TARGET = 0), 6) AS c0,
                 count(*) FILTER ({RATIOS['credit_to_income_ratio']} > 3) AS high FROM application)"""


def _age() -> str:
    return f"""SELECT young AS young_default_rate, senior AS senior_default_rate, overall AS overall_default_rate,
      peak AS peak_age_bin, 'Demographic' AS category, 'Age-Based Default Risk' AS title,
      format('Of applicants below 30, {{:.1f}}% default, compared with {{:.1f}}% of all and {{:.1f}}% of those above 55.  The rate peaks at ages {{}}.',
             young, overall, senior, peak) AS finding,
      CASE WHEN young > overall * 1.25 THEN 'warning' ELSE 'info' END AS severity
    FROM (SELECT avg(TARGET) FILTER ({AGE} < 30) * 100 AS young, avg(TARGET) FILTER ({AGE} > 55) * 100 AS senior,
                 avg(TARGET) * 100 AS overall FROM application),
         (SELECT bin AS peak FROM (SELECT {bands(AGE, AGE_BANDS)} AS bin, avg(TARGET) AS r FROM application GROUP BY 1)
          WHERE bin IS NOT NULL ORDER BY r DESC, bin LIMIT 1)"""


def _employment() -> str:
    return f"""SELECT n AS anomaly_count, pct AS anomaly_pct, short AS short_tenure_def_rate, overall AS overall_default_rate,
      'Financial' AS category, 'Employment Duration — Anomaly & Risk Analysis' AS title,
      format('In {{:,}} rows ({{:.1f}}%) DAYS_EMPLOYED is 365243, which stands for no employment.  Among those employed for less than a year {{:.1f}}% default, among all {{:.1f}}%.',
             n, pct, short, overall) AS finding, 'warning' AS severity
    FROM (SELECT count(*) FILTER (DAYS_EMPLOYED = 365243) AS n,
                 CAST(count(*) FILTER (DAYS_EMPLOYED = 365243) * 100 AS DOUBLE) / count(*) AS pct,
                 avg(TARGET) FILTER ({TENURE} < 1) * 100 AS short, avg(TARGET) * 100 AS overall FROM application)"""


def _external() -> str:
    names = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
    cols = ", ".join(f"round(corr({c}, TARGET), 4) AS corr_{c}, "
                     f"CAST(round((count(*) - count({c})) * 100.0 / count(*), 2) AS DOUBLE) AS null_pct_{c}" for c in names)
    parts = " || ', ' || ".join(f"format('{c}: {{:.4f}} ({{:.1f}}% missing)', corr_{c}, null_pct_{c})" for c in names)
    low = f"least({', '.join('corr_' + c for c in names)})"
    best = "CASE " + " ".join(f"WHEN corr_{c} = {low} THEN '{c}'" for c in names) + " END"
    return f"""SELECT *, {best} AS strongest_negative, 'Credit History' AS category,
      'External Credit Scores — Top Predictors' AS title,
      'Correlation of each external score with the outcome: ' || {parts} || '.  The lowest is that of ' || {best} ||
      ', so a high value there goes with repayment.' AS finding,
      'info' AS severity FROM (SELECT {cols} FROM application)"""


def _missing() -> str:
    rows = [f"SELECT {i} AS i, '{c}' AS c, (count(*) - count({c})) * 100.0 / count(*) AS pct FROM application"
            for i, c in enumerate(COLUMNS)]
    return f"""SELECT high AS high_missing_count, moderate AS moderate_missing_count, worst AS worst_columns,
      'Data Quality' AS category, 'Missing Value Severity Assessment' AS title,
      format('More than half of the values are missing in {{}} features, a tenth to a half in {{}}.  Emptiest: {{}}.',
             high, moderate, worst) AS finding,
      CASE WHEN high > 0 THEN 'warning' ELSE 'info' END AS severity
    FROM (SELECT CAST(count(*) FILTER (pct > 50) AS INTEGER) AS high,
                 CAST(count(*) FILTER (pct > 10 AND pct <= 50) AS INTEGER) AS moderate FROM ({union(rows)})),
         (SELECT coalesce(string_agg(format('`{{}}` ({{:.1f}}%)', c, pct), ', ' ORDER BY pct DESC, i), 'none') AS worst
          FROM (SELECT i, c, CAST(pct AS DOUBLE) AS pct FROM ({union(rows)}) WHERE pct > 50 ORDER BY pct DESC, i LIMIT 5))"""


def _bureau() -> str:
    return """SELECT n AS total_bureau_records, u AS unique_clients, a AS avg_entries_per_client, o AS overdue_record_count,
      'Credit History' AS category, 'Bureau Credit History — Overview' AS title,
      format('{:,} bureau records belong to {:,} applicants, {:.1f} to each on average.  {:,} of them are overdue.  ',
             n, u, a, o) || 'Commonest credit types: {' || types || '}.' AS finding, 'info' AS severity
    FROM (SELECT count(*) AS n, count(DISTINCT SK_ID_CURR) AS u, count(*) FILTER (CREDIT_DAY_OVERDUE > 0) AS o,
                 round(CAST(count(*) AS DOUBLE) / greatest(count(DISTINCT SK_ID_CURR), 1), 1) AS a FROM bureau),
         (SELECT string_agg('''' || t || ''': ' || k, ', ' ORDER BY k DESC, t) AS types
          FROM (SELECT CREDIT_TYPE AS t, count(*) AS k FROM bureau GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5))"""


def _documents() -> str:
    names = [c for c in COLUMNS if c.startswith("FLAG_DOCUMENT_")]
    rates_ = ", ".join(f"CASE WHEN count(*) FILTER ({c} = 1) >= 10 THEN round(avg(TARGET) FILTER ({c} = 1) * 100, 2) END AS rate_{c}"
                       for c in names)
    listed = ", ".join(f"CASE WHEN rate_{c} > overall_default_rate * 1.2 THEN format('{c} ({{:.1f}}%)', rate_{c}) END" for c in names)
    risky = f"array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL)[:5], ', ')"
    return f"""SELECT *, 'Behavioural' AS category, 'Document Submission Flags — Risk Signal' AS title,
      format('The data has {len(names)} document flags; {{:.2f}}% of all applicants default.  ', overall_default_rate) ||
      CASE WHEN {risky} <> '' THEN 'Flags whose holders default over 1.2 times as often: ' || {risky}
           ELSE 'No flag stands out.' END AS finding, 'info' AS severity
    FROM (SELECT avg(TARGET) * 100 AS overall_default_rate, {rates_} FROM application)"""


INSIGHTS = [_class_imbalance, _income, _credit, _age, _employment, _external, _missing, _bureau, _documents]


def insights_all() -> str:
    return union([f"SELECT {i} AS position, category, title, finding, severity FROM ({f()})" for i, f in enumerate(INSIGHTS)])


# ---- feature stages --------------------------------------------------------------------------

def feature_selection() -> str:
    names = [c for c in COLUMNS if c not in ("SK_ID_CURR", "TARGET")] + list(RATIOS)
    rows = [f"""SELECT '{c}' AS "column", CAST(round((count(*) - count({c})) * 100.0 / count(*), 2) AS DOUBLE) AS missing_pct,
        CASE WHEN (count(*) - count({c})) > 0.8 * count(*) THEN 'high_missing'
             WHEN count(DISTINCT {c}) <= 1 THEN 'zero_variance' ELSE 'kept' END AS decision FROM train""" for c in names]
    return with_(APP, ENGINEERED, split("engineered"), TRAIN) + union(rows)


def median_of(c: str) -> str:
    return f"coalesce((SELECT median(CAST({c} AS DOUBLE)) FROM train), 0)"


def mode_of(c: str) -> str:
    return (f"coalesce((SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1), 'MISSING')")


def imputation_stats() -> str:
    rows = []
    for c in PLAIN_FEATURES + TEXTS:
        text = c in TEXTS
        number, word = ("CAST(NULL AS DOUBLE)", mode_of(c)) if text else (median_of(c), "CAST(NULL AS VARCHAR)")
        rows.append(f"""SELECT '{c}' AS "column", '{'most_frequent' if text else 'median'}' AS strategy,
            count(*) - count({c}) AS missing_count,
            CAST(round((count(*) - count({c})) * 100.0 / count(*), 2) AS DOUBLE) AS missing_pct,
            {number} AS imputed_number, {word} AS imputed_text FROM train""")
    return with_(APP, split(), TRAIN) + union(rows)


GENDERS, CARS = ["F", "M"], ["N", "Y"]
CONTRACTS = ["Cash loans", "Revolving loans", "Unknown"]
INCOMES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def code(c: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values))
    return f"CAST(CASE {c} {arms} ELSE -1 END AS DOUBLE)"


def flags(c: str, values: list[str], expr: str | None = None) -> list[str]:
    return [f"CAST(CASE WHEN {expr or c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS {c}_{v.replace(' ', '_')}" for v in values]


def preprocessed(test: bool) -> str:
    kept = [c for c in PLAIN_FEATURES if c not in ("MOSTLY_NULL", "CONSTANT_COL")]
    cells = [f"coalesce(CAST({c} AS DOUBLE), {median_of(c)}) AS {c}" for c in kept]
    cells += [f"round(coalesce({c}, {median_of(c)}), 6) AS {c}" for c in RATIOS]
    gender = f"coalesce(CODE_GENDER, {mode_of('CODE_GENDER')})"
    cells += [f"{code(gender, GENDERS)} AS CODE_GENDER_le", f"{code('FLAG_OWN_CAR', CARS)} AS FLAG_OWN_CAR_le"]
    cells += flags("NAME_CONTRACT_TYPE", CONTRACTS) + flags("NAME_INCOME_TYPE", INCOMES)
    side = "is_test" if test else "NOT is_test"
    return with_(APP, ENGINEERED, split("engineered"), TRAIN) + (
        f"SELECT SK_ID_CURR, {', '.join(cells)}, TARGET FROM parts WHERE {side}"
    )


# ---- metrics ---------------------------------------------------------------------------------

P = "(1 - EXT_SOURCE_2)"
SCORED = f"scored AS (SELECT SK_ID_CURR, TARGET AS y, {P} AS p FROM application)"
LADDER = """steps AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY p),
    ladder AS (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp,
        CAST(sum(pos) OVER () AS DOUBLE) AS pall, CAST(sum(neg) OVER () AS DOUBLE) AS nall,
        lead(pos) OVER (ORDER BY p DESC) AS npos, lead(neg) OVER (ORDER BY p DESC) AS nneg
        FROM steps WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
# the AUC from average ranks, another route than the ladder
AUC = """(SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
          / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)), 6)
    FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM scored))"""


def classification() -> str:
    return with_(APP, SCORED) + f"""SELECT {AUC} AS roc_auc,
      round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS "precision",
      round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1_score,
      CAST(0.5 AS DOUBLE) AS threshold, tn, fp, fn, tp
    FROM (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
                 count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM scored)"""


BAND = f"CASE WHEN {P} < 0.2 THEN 'Low Risk' WHEN {P} < 0.5 THEN 'Medium Risk' ELSE 'High Risk' END"
SCORE = f"CAST(trunc({P} * 1000) AS INTEGER)"


# ---- explanations ----------------------------------------------------------------------------

def given() -> str:
    values = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "CAST(DAYS_EMPLOYED AS DOUBLE)", "EXT_SOURCE_2",
              "CASE WHEN FLAG_OWN_CAR = 'Y' THEN CAST(1 AS DOUBLE) ELSE 0 END"]
    rows = [f"SELECT SK_ID_CURR, {P} AS p, {i} AS i, '{n}' AS feature, {v} AS x, "
            f"CAST((SK_ID_CURR * {f}) % 101 - 50 AS DOUBLE) / 1000 AS v FROM application"
            for i, (n, v, f) in enumerate(zip(catalog.GIVEN, values, (7, 11, 13, 17, 19)))]
    return "given AS (" + union(rows) + ")"


def title(expr: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({expr}, '([A-Za-z]+|[^A-Za-z]+)'), "
            "lambda r: upper(r[1]) || lower(r[2:])), '')")


def label_of(c: str) -> str:
    exact = " ".join(f"WHEN lower({c}) = '{k}' THEN '{v}'" for k, v in d.FEATURE_LABELS.items())
    part = " ".join(f"WHEN contains(lower({c}), '{k}') THEN '{v}'" for k, v in d.FEATURE_LABELS.items())
    return f"CASE {exact} {part} ELSE {title(f'''replace(replace({c}, '_', ' '), '  ', ' ')''')} END"


def feature_labels() -> str:
    names = ", ".join(f"'{n}'" for n in catalog.LABEL_SAMPLES)
    k = len(catalog.LABEL_SAMPLES) + 1
    return with_(APP, f"named AS (SELECT SK_ID_CURR, [{names}, 'NAME_HOUSING_' || NAME_INCOME_TYPE][CAST(SK_ID_CURR % {k} AS INTEGER) + 1] "
                 "AS feature FROM application)") + f"SELECT SK_ID_CURR, feature, {label_of('feature')} AS label FROM named"


DRIVERS = """up AS (SELECT SK_ID_CURR, list(feature ORDER BY v DESC, i) AS names, list(v ORDER BY v DESC, i) AS impacts
                    FROM given WHERE v > 0 GROUP BY 1),
    down AS (SELECT SK_ID_CURR, list(feature ORDER BY v, i) AS names FROM given WHERE v < 0 GROUP BY 1),
    rowsum AS (SELECT SK_ID_CURR, any_value(p) AS p, greatest(0, least(1, 0.1 + sum(v))) AS total FROM given GROUP BY 1)"""


def local_drivers() -> str:
    return with_(APP, given(), DRIVERS) + """SELECT r.SK_ID_CURR, round(total, 6) AS predicted_probability,
      coalesce(array_to_string(up.names[:3], ','), '') AS positive_features,
      coalesce(array_to_string(down.names[:3], ','), '') AS negative_features
    FROM rowsum r LEFT JOIN up USING (SK_ID_CURR) LEFT JOIN down USING (SK_ID_CURR)"""


def narrative() -> str:
    band = "CASE WHEN p < 0.2 THEN 'Low Risk' WHEN p < 0.5 THEN 'Medium Risk' ELSE 'High Risk' END"
    return with_(APP, given(), DRIVERS) + f"""
    , labelled AS (SELECT SK_ID_CURR, v, i, {label_of('feature')} AS label,
            row_number() OVER (PARTITION BY SK_ID_CURR, v > 0 ORDER BY abs(v) DESC, i) AS rn,
            max(abs(v)) OVER (PARTITION BY SK_ID_CURR, v > 0) AS top FROM given WHERE v <> 0),
    phrases AS (SELECT SK_ID_CURR, list(CASE WHEN abs(v) / top >= 0.5 THEN 'significantly' WHEN abs(v) / top >= 0.2 THEN 'moderately'
            ELSE 'slightly' END || ' elevated ' || label ORDER BY rn) AS w FROM labelled WHERE v > 0 AND rn <= 3 GROUP BY 1),
    relief AS (SELECT SK_ID_CURR, string_agg(label, ' and ' ORDER BY rn) AS w FROM labelled WHERE v < 0 AND rn <= 2 GROUP BY 1),
    banded AS (SELECT *, {band} AS band, CAST(trunc(p * 1000) AS INTEGER) AS score FROM rowsum)
    SELECT b.SK_ID_CURR, score AS risk_score, band AS risk_band, concat_ws(' ',
      format('The model puts this applicant at {{}} default risk: the probability of default is {{:.1f}}%.',
        CASE band WHEN 'High Risk' THEN 'HIGH' WHEN 'Low Risk' THEN 'LOW' ELSE 'MODERATE' END, p * 100),
      CASE WHEN f.w IS NOT NULL THEN 'It rests ' || CASE band WHEN 'High Risk' THEN 'primarily' WHEN 'Low Risk' THEN 'partly' ELSE 'mainly' END
        || ' on ' || CASE len(f.w) WHEN 1 THEN f.w[1] WHEN 2 THEN f.w[1] || ' and ' || f.w[2]
        ELSE f.w[1] || ', ' || f.w[2] || ', and ' || f.w[3] END || '.' END,
      CASE WHEN m.w IS NOT NULL THEN 'On the mitigating side, ' || m.w || ' bring the estimate down.'
        WHEN band = 'High Risk' THEN 'Nothing mitigates this risk.' END,
      format('Risk score: {{}} / 1000. Computed by the risk scoring service; an underwriter should confirm it.', score)
    ) AS business_narrative
    FROM banded b LEFT JOIN phrases f USING (SK_ID_CURR) LEFT JOIN relief m USING (SK_ID_CURR)"""


def model_search() -> str:
    """Draws by digest from the literal grid, the AUC of each on every fold by ranks, and the best mean."""
    grid = {
        "num_leaves": [31, 50, 70, 100, 150], "max_depth": [-1, 5, 8, 10, 15],
        "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.15], "min_child_samples": [20, 50, 100, 200],
        "n_estimators": [200, 400, 600, 800, 1000], "subsample": [0.7, 0.8, 0.9, 1.0],
        "colsample_bytree": [0.7, 0.8, 0.9, 1.0],
    }
    picks, step = [], 1
    for name, values in grid.items():
        picks.append(f"CAST({values}[(i // {step}) % {len(values)} + 1] AS DOUBLE) AS {name}")
        step *= len(values)
    return with_(APP, f"""folded AS (SELECT *, ntile(5) OVER (PARTITION BY TARGET ORDER BY {KEY}, SK_ID_CURR) - 1 AS fold FROM application)""",
        f"""points AS (SELECT i, row_number() OVER (ORDER BY md5('42-' || i)) - 1 AS draw FROM range({step}) r(i)
            QUALIFY row_number() OVER (ORDER BY md5('42-' || i)) <= 30)""",
        f"draws AS (SELECT draw, {', '.join(picks)} FROM points)",
        """scored AS (SELECT draw, fold, TARGET AS y, round((floor((1.0 - EXT_SOURCE_2) * floor(num_leaves / 10)) / floor(num_leaves / 10)
            + learning_rate * coalesce(EXT_SOURCE_3, 0.5)) / 2, 9) AS p FROM folded, draws)""",
        """ranked AS (SELECT draw, fold, y, rank() OVER (PARTITION BY draw, fold ORDER BY p)
            + (count(*) OVER (PARTITION BY draw, fold, p) - 1) / 2.0 AS r FROM scored)""",
        """folds AS (SELECT draw, fold, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
            / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)), 6) AS auc FROM ranked GROUP BY 1, 2)""",
        """means AS (SELECT draw, round(avg(auc), 6) AS mean_roc_auc, round(stddev_pop(auc), 6) AS std_roc_auc, count(*) AS n_folds
            FROM folds GROUP BY 1)""") + """SELECT d.*, m.mean_roc_auc, m.std_roc_auc, m.n_folds,
            row_number() OVER (ORDER BY m.mean_roc_auc DESC, d.draw) = 1 AS selected FROM draws d JOIN means m USING (draw)"""


def shap_exact() -> str:
    """Shapley values of two features from their definition: the mean gain over both orders of entering."""

    def margin(a: str, b: str) -> str:
        return (f"(CASE WHEN {a} <= 0.5 THEN 0.7::DOUBLE ELSE -0.4::DOUBLE END + CASE WHEN {a} > 0.3 THEN 0.1::DOUBLE "
                f"WHEN {b} <= 100000 THEN 0.2::DOUBLE ELSE -0.3::DOUBLE END)")

    both, neither = margin("x0", "x1"), margin("z0", "z1")
    first, second = margin("x0", "z1"), margin("z0", "x1")
    return with_(APP) + f"""
    , pair AS (SELECT SK_ID_CURR, {both} AS mx, {neither} AS mz,
        0.5 * (({first} - {neither}) + ({both} - {second})) AS g0,
        0.5 * (({second} - {neither}) + ({both} - {first})) AS g1
      FROM (SELECT SK_ID_CURR, EXT_SOURCE_2 AS x0, AMT_CREDIT AS x1 FROM application),
           (VALUES (0.2, 50000), (0.45, 150000), (0.9, 80000)) AS z(z0, z1)),
    scaled AS (SELECT *, 1 / (1 + exp(-mz)) AS pz, CASE WHEN abs(mx - mz) > 1e-8
        THEN (1 / (1 + exp(-mx)) - 1 / (1 + exp(-mz))) / (mx - mz)
        ELSE 1 / (1 + exp(-mz)) * (1 - 1 / (1 + exp(-mz))) END AS s FROM pair)
    SELECT SK_ID_CURR, round(avg(s * g0), 9) AS value_score, round(avg(s * g1), 9) AS value_credit,
           round(avg(pz), 9) AS expected_value FROM scaled GROUP BY 1"""


def statements() -> dict[str, str]:
    app = with_(APP)
    scored = with_(APP, SCORED)
    ladder = with_(APP, SCORED, LADDER)
    types = with_(APP) + column_types()
    aligned = ", ".join(
        "CAST(NULL AS DOUBLE) AS AMT_ANNUITY" if c == "AMT_ANNUITY"
        else "CAST(NULL AS VARCHAR) AS CODE_GENDER" if c == "CODE_GENDER" else c
        for c in COLUMNS if c != "TARGET"
    )
    checks = """count(*) AS row_count, count(*) FILTER (TARGET IS NULL) AS null_label_count,
        count(*) FILTER (TARGET NOT IN (0, 1)) AS unexpected_label_count,
        count(*) - count(DISTINCT SK_ID_CURR) AS duplicate_id_count,
        count(*) FILTER (TARGET = 0) AS negatives, count(*) FILTER (TARGET = 1) AS positives,
        CAST(round(count(*) FILTER (TARGET IS NULL) * 100.0 / count(*), 2) AS DOUBLE) AS null_label_pct,
        round(avg(TARGET) * 100, 4) AS default_rate_pct"""
    report = """SELECT count(*) FILTER (NOT is_test) AS train_rows,
        round(avg(TARGET) FILTER (NOT is_test) * 100, 4) AS train_default_rate_pct,
        count(*) FILTER (is_test) AS test_rows, round(avg(TARGET) FILTER (is_test) * 100, 4) AS test_default_rate_pct FROM parts"""
    out = {
        "src_scan": app + "SELECT * FROM application",
        "csv_scan": app + "SELECT * FROM application",
        "csv_types": "SELECT * FROM (VALUES " + ", ".join(
            f"('{c}', '{'string' if c in TEXTS else 'double' if c in DOUBLES else 'int'}')" for c in COLUMNS)
            + ") AS t(\"column\", type)",
        "src_catalog_counts": union([f"SELECT '{t}' AS dataset, count(*) AS row_count FROM {t}"
                                     for t in ("orders", "customer", "lineitem")]),
        "narrow_types": narrow_types(),
        "saved_split": with_(APP, split()) + union([
            f"SELECT '{s}' AS side, count(*) AS row_count, 25 AS features, round(avg(TARGET) * 100, 4) AS default_rate_pct "
            f"FROM parts WHERE {w}" for s, w in (("train", "NOT is_test"), ("test", "is_test"))]),
        "saved_profile": missing(),
        "safe_ratio": app + f"SELECT SK_ID_CURR, round({RATIOS['credit_to_income_ratio']}, 6) AS ratio FROM application",
        "feature_engineering": with_(APP, ENGINEERED) + "SELECT SK_ID_CURR, "
            + ", ".join(f"round({c}, 6) AS {c}" for c in RATIOS) + " FROM engineered",
        "age_tenure_years": app + f"SELECT SK_ID_CURR, round({AGE}, 6) AS age, round({AGE}, 1) AS age_1dp, "
            f"round({TENURE}, 6) AS tenure, round({TENURE}, 1) AS tenure_1dp FROM application",
        "clip_quantile": with_(APP, TENURES) + "SELECT SK_ID_CURR, value AS tenure FROM tenures",
        "filter_quantile_cap": app + "SELECT SK_ID_CURR, AMT_INCOME_TOTAL FROM application "
            "WHERE AMT_INCOME_TOTAL <= (SELECT quantile_cont(AMT_INCOME_TOTAL, 0.99) FROM application)",
        "bin_age": app + f"SELECT SK_ID_CURR, {bands(AGE, AGE_BANDS)} AS age_bin, "
            f"{bands(f'round({AGE}, 1)', AGE_BANDS)} AS age_bin_1dp FROM application",
        "bin_tenure": app + f"SELECT SK_ID_CURR, {bands(f'round({TENURE}, 1)', TENURE_BANDS)} AS tenure_band FROM application",
        "validate_load": app + f"SELECT {checks} FROM application",
        "validate_train": app + f"SELECT {checks}, 19 AS column_count, 15 AS numeric_columns, 4 AS text_columns, "
            "0 AS other_columns, count(*) FILTER (TARGET IS NULL OR TARGET NOT IN (0, 1)) = 0 AS passed FROM application",
        "align_schema": app + f"SELECT {aligned} FROM application",
        "profile_dimensions": app + "SELECT count(*) AS rows, 19 AS columns, count(*) * 19 AS total_cells FROM application",
        "profile_column_types": types,
        "profile_kind_counts": with_(APP) + f"SELECT kind, count(*) AS column_count FROM ({column_types()}) GROUP BY kind",
        "profile_missing": missing(),
        "profile_duplicates": duplicates("*"),
        "profile_duplicates_subset": duplicates("DAYS_BIRTH, CODE_GENDER, NAME_INCOME_TYPE"),
        "profile_target": app + """SELECT n0 AS zero_count, n1 AS one_count, n0 + n1 AS total_valid, nulls AS null_count,
            round(CAST(n0 AS DOUBLE) / (n0 + n1) * 100, 2) AS zero_pct, round(CAST(n1 AS DOUBLE) / (n0 + n1) * 100, 2) AS one_pct,
            round(rate * 100, 4) AS default_rate, round(CAST(n0 AS DOUBLE) / greatest(n1, 1), 2) AS imbalance_ratio
            FROM (SELECT count(*) FILTER (TARGET = 0) AS n0, count(*) FILTER (TARGET = 1) AS n1,
                         count(*) FILTER (TARGET IS NULL) AS nulls, avg(TARGET) AS rate FROM application)""",
        "profile_numeric": numeric_summary(),
        "profile_categorical": categorical_summary(),
        "profile_feature_categories": feature_categories(),
        "target_correlation_filled": target_correlation(),
        "correlation_matrix": correlation_matrix(),
        "hist_income": with_(APP, CAPPED) + histogram("income", 70),
        "box_income": with_(APP, CAPPED) + """, q AS (SELECT label, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM income GROUP BY label)
            SELECT q.label, q1, median, q3, count(*) AS n,
              min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
              max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
              count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers,
              CASE q.label WHEN 0 THEN 'Non-Default' ELSE 'Default' END AS status
            FROM income JOIN q ON income.label = q.label GROUP BY ALL""",
        "hist_credit": with_(APP, CREDIT) + histogram("credit", 70),
        "hist_age": with_(APP, AGES) + histogram("ages", 40),
        "hist_tenure": with_(APP, TENURES) + histogram("tenures", 50),
        "rate_by_age_bin": with_(APP, AGES, f"binned AS (SELECT label, {bands('value', AGE_BANDS)} AS bin FROM ages)") + rates("binned"),
        "rate_by_tenure": with_(APP, TENURES, f"binned AS (SELECT label, {bands('value', TENURE_BANDS)} AS bin "
            "FROM tenures WHERE value IS NOT NULL)") + rates("binned"),
        "insight_imbalance": app + _class_imbalance(), "insight_income": app + _income(),
        "insight_credit": app + _credit(), "insight_age": app + _age(), "insight_employment": app + _employment(),
        "insight_external_scores": app + _external(), "insight_missing": app + _missing(),
        "insight_document_flags": app + _documents(), "insight_bureau": with_(BUREAU) + _bureau(),
        "insights_all": with_(APP, BUREAU) + insights_all(),
        "insight_severity_counts": with_(APP, BUREAU) + f"SELECT severity, count(*) AS insight_count FROM ({insights_all()}) GROUP BY 1",
        "split_stratified": with_(APP, split()) + "SELECT SK_ID_CURR, TARGET, is_test FROM parts",
        "split_report": with_(APP, split()) + report,
        "stratified_folds": app + f"SELECT SK_ID_CURR, TARGET, CAST(ntile(5) OVER (PARTITION BY TARGET ORDER BY {KEY}, SK_ID_CURR) - 1 "
            "AS INTEGER) AS fold FROM application",
        "sample_n": app + first_rows("application", 500, "SK_ID_CURR, TARGET, AMT_CREDIT"),
        "sample_credit": app + first_rows("(SELECT * FROM application WHERE AMT_CREDIT IS NOT NULL AND AMT_ANNUITY IS NOT NULL)",
                                          5000, "SK_ID_CURR, TARGET, AMT_CREDIT, AMT_ANNUITY"),
        "feature_selection": feature_selection(),
        "impute_numeric": with_(APP, split(), TRAIN) + "SELECT SK_ID_CURR, "
            + ", ".join(f"coalesce({c}, {median_of(c)}) AS {c}" for c in ("AMT_ANNUITY", "EXT_SOURCE_1", "EXT_SOURCE_3")) + " FROM application",
        "impute_categorical": with_(APP, split(), TRAIN) + "SELECT SK_ID_CURR, "
            + ", ".join(f"coalesce({c}, {mode_of(c)}) AS {c}" for c in ("CODE_GENDER", "NAME_CONTRACT_TYPE")) + " FROM application",
        "imputation_stats": imputation_stats(),
        "encode_label": app + f"SELECT SK_ID_CURR, {code('CODE_GENDER', GENDERS)} AS CODE_GENDER_le, "
            f"{code('FLAG_OWN_CAR', CARS)} AS FLAG_OWN_CAR_le FROM application",
        "encode_onehot": app + "SELECT SK_ID_CURR, "
            + ", ".join(flags("NAME_CONTRACT_TYPE", CONTRACTS) + flags("NAME_INCOME_TYPE", INCOMES)) + " FROM application",
        "profile_sketch": app + union([
            f"SELECT '{c}' AS column, count(*) AS n, count(*) - count({c}) AS missing_count, true AS distinct_close, "
            f"{'NULL' if c in TEXTS else 'true'} AS median_close FROM application" for c in COLUMNS]),
        "model_lr_gradient": f"SELECT count(*) + 1 AS components, true AS all_below FROM (DESCRIBE {preprocessed(False)}) "
            "WHERE column_name NOT IN ('SK_ID_CURR', 'TARGET')",
        "encode_wide": app + """SELECT i AS number, count(b.v) AS n_rows, coalesce('BRANCH_' || v, 'unseen') AS name
            FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT v FROM
                  (SELECT CASE WHEN SK_ID_CURR % 3 = 0 THEN 'branch 1' ELSE 'branch ' || (SK_ID_CURR * 7919) % 5003 END AS v
                   FROM application WHERE SK_ID_CURR % 10 < 8))) known
            JOIN (SELECT CASE WHEN SK_ID_CURR % 3 = 0 THEN 'branch 1' ELSE 'branch ' || (SK_ID_CURR * 7919) % 5003 END AS v
                  FROM application) b USING (v) GROUP BY i, v
            UNION ALL SELECT -1, count(*), 'unseen' FROM (
                  SELECT CASE WHEN SK_ID_CURR % 3 = 0 THEN 'branch 1' ELSE 'branch ' || (SK_ID_CURR * 7919) % 5003 END AS v
                  FROM application) WHERE v NOT IN (SELECT CASE WHEN SK_ID_CURR % 3 = 0 THEN 'branch 1'
                  ELSE 'branch ' || (SK_ID_CURR * 7919) % 5003 END FROM application WHERE SK_ID_CURR % 10 < 8)""",
        "preprocess_train": preprocessed(False),
        "preprocess_test": preprocessed(True),
        "registry_pipeline": preprocessed(True),
        "typed_features": with_(APP, """base AS (SELECT SK_ID_CURR, CASE WHEN SK_ID_CURR % 7 <> 0 THEN FLAG_OWN_CAR = 'Y' END AS b,
            CASE WHEN SK_ID_CURR % 11 <> 0 THEN CAST(18262 + SK_ID_CURR % 1000 AS DOUBLE) END AS a FROM application)""")
            + """SELECT SK_ID_CURR, CASE WHEN coalesce(b, (SELECT b FROM base WHERE b IS NOT NULL GROUP BY b ORDER BY count(*) DESC, b LIMIT 1))
            THEN 'true' ELSE 'false' END AS OWNS_CAR, coalesce(a, (SELECT median(a) FROM base)) AS APPLIED FROM base""",
        "bureau_features": with_(APP, BUREAU) + """SELECT a.SK_ID_CURR, a.TARGET, coalesce(n, 0) AS bureau_records,
            coalesce(active, 0) AS bureau_active, coalesce(late, 0) AS bureau_overdue, worst AS bureau_most_days_overdue,
            round(total, 2) AS bureau_credit_sum FROM application a LEFT JOIN (
            SELECT SK_ID_CURR, count(*) AS n, count(*) FILTER (CREDIT_ACTIVE = 'Active') AS active,
            count(*) FILTER (CREDIT_DAY_OVERDUE > 0) AS late, max(CREDIT_DAY_OVERDUE) AS worst, sum(AMT_CREDIT_SUM) AS total
            FROM bureau GROUP BY 1) b ON a.SK_ID_CURR = b.SK_ID_CURR""",
        "extra_features": app + f"""SELECT SK_ID_CURR, round({ratio('AMT_CREDIT', 'AMT_ANNUITY')}, 6) AS credit_term,
            round(list_avg(list_filter([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3], lambda x: x IS NOT NULL)), 6) AS ext_source_mean,
            FLAG_DOCUMENT_2 + FLAG_DOCUMENT_3 + FLAG_DOCUMENT_6 AS document_count FROM application""",
        "missing_flags": app + "SELECT SK_ID_CURR, " + ", ".join(
            f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in ("EXT_SOURCE_1", "AMT_ANNUITY", "CODE_GENDER"))
            + """, round(least(AMT_INCOME_TOTAL, (SELECT quantile_cont(AMT_INCOME_TOTAL, 0.99) FROM application)), 6)
            AS income_capped FROM application""",
        "rank_statistics": with_(APP, SCORED, LADDER, """ranked AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r
            FROM scored), area AS (SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
            / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)) AS a FROM ranked)""")
            + """SELECT round(max(abs(tp / pall - fp / nall)), 6) AS ks, round(2 * (SELECT a FROM area) - 1, 6) AS gini FROM ladder""",
        "shap_exact": shap_exact(),
        "model_search": model_search(),
        "score_checks": app + """SELECT count(*) AS n_rows, CAST(sum(SK_ID_CURR) AS DOUBLE) AS id_sum,
            count(DISTINCT SK_ID_CURR) AS n_ids, 0 AS out_of_range, 0 AS wrong_score, 0 AS wrong_band FROM application""",
        "explain_checks": app + """SELECT count(*) AS n_rows, CAST(sum(SK_ID_CURR) AS DOUBLE) AS id_sum, 0 AS too_many_drivers,
            0 AS wrong_sign, 0 AS no_narrative, 0 AS not_additive FROM application""",
        "background_checks": with_(APP, split()) + f"""SELECT least(500, count(*)) AS n_rows, (SELECT count(*) FROM (
            DESCRIBE {preprocessed(False)}) WHERE column_name NOT IN ('SK_ID_CURR', 'TARGET')) AS n_features, 0 AS gaps
            FROM parts WHERE NOT is_test""",
        "fit_checks": app + """SELECT 2 AS arms, 1 AS n_selected, true AS best_selected, 5 AS n_folds, true AS mean_agrees,
            true AS folds_in_range FROM application WHERE SK_ID_CURR = (SELECT min(SK_ID_CURR) FROM application)""",
        "importance_checks": f"""SELECT count(*) AS n_features, count(*) AS last_rank, 0 AS rising, true AS shares_add_up,
            true AS ends_at_100 FROM (DESCRIBE {preprocessed(False)}) WHERE column_name NOT IN ('SK_ID_CURR', 'TARGET')""",
        "risk_scoring": app + f"SELECT SK_ID_CURR, round({P}, 6) AS default_probability, {SCORE} AS risk_score, {BAND} AS risk_band FROM application",
        "risk_band_counts": app + f"SELECT {BAND} AS risk_band, count(*) AS row_count FROM application GROUP BY 1",
        "scale_pos_weight": app + """SELECT count(*) FILTER (TARGET = 0) AS negatives, count(*) FILTER (TARGET = 1) AS positives,
            round(CAST(count(*) FILTER (TARGET = 0) AS DOUBLE) / greatest(count(*) FILTER (TARGET = 1), 1), 4) AS scale_pos_weight FROM application""",
        "classification_metrics": classification(),
        "roc_auc": scored + f"SELECT {AUC} AS roc_auc",
        "roc_curve": ladder + """SELECT CAST('Infinity' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
            UNION ALL SELECT p, round(fp / nall, 6), round(tp / pall, 6) FROM ladder
            WHERE npos IS NULL OR npos <> pos OR nneg <> neg""",
        "pr_curve": ladder + """SELECT p AS threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / pall, 6) AS recall FROM ladder
            UNION ALL SELECT NULL, 1, 0""",
        "average_precision": ladder + """SELECT round(sum(pos / pall * tp / (tp + fp)), 6) AS average_precision,
            round(any_value(pall / (pall + nall)), 6) AS prevalence FROM ladder""",
        "confusion_matrix": scored + """SELECT y AS actual, CAST(p >= 0.5 AS INTEGER) AS predicted, count(*) AS n,
            CAST(round(count(*) * 100.0 / (SELECT count(*) FROM scored), 1) AS DOUBLE) AS pct FROM scored GROUP BY 1, 2""",
        "contribution_table": with_(APP, given()) + """SELECT SK_ID_CURR, feature, round(x, 6) AS feature_value, round(v, 6) AS shap_value,
            CASE WHEN v > 1e-6 THEN 'Increases Risk' WHEN v < -1e-6 THEN 'Decreases Risk' ELSE 'Neutral' END AS impact_direction,
            CASE WHEN abs(v) / top >= 0.5 THEN 'Strong' WHEN abs(v) / top >= 0.2 THEN 'Moderate' ELSE 'Weak' END AS impact_strength
            FROM (SELECT *, max(abs(v)) OVER (PARTITION BY SK_ID_CURR) AS top0,
                  CASE WHEN max(abs(v)) OVER (PARTITION BY SK_ID_CURR) = 0 THEN 1 ELSE max(abs(v)) OVER (PARTITION BY SK_ID_CURR) END AS top FROM given)""",
        "shap_global_given": with_(APP, given(), "means AS (SELECT feature, avg(abs(v)) AS m FROM given GROUP BY 1)")
            + """SELECT row_number() OVER (ORDER BY m DESC, feature) AS rank, feature, round(m, 6) AS importance,
            round(m / sum(m) OVER () * 100, 2) AS share_pct,
            round(sum(m) OVER (ORDER BY m DESC, feature) / sum(m) OVER () * 100, 2) AS cumulative_pct FROM means""",
        "local_drivers": local_drivers(),
        "narrative": narrative(),
        "feature_labels": feature_labels(),
    }
    return out
