"""Column profiles: each is one or two aggregations whatever the number of columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import domain as d
from riskloom.functions.columns import (
    col, is_missing, kind, name_of, number_array, numeric_columns, numeric_long, text_columns, text_long,
)
from riskloom.functions.expressions import class_share
from riskloom.operators.selection import exact_quantiles_long

CHUNK = 200
BROADCAST_HASHES = 1_000_000


def per_column(df: DataFrame, names: Sequence[str], row: Callable[[str], list[Column]]) -> DataFrame:
    """One output row per column from wide aggregates.

    Chunks read disjoint columns, so on columnar files they cost one scan together.
    """
    parts = []
    for i in range(0, len(names), CHUNK):
        rows = F.array(*[F.struct(F.lit(c).alias("column"), *row(c)) for c in names[i : i + CHUNK]])
        parts.append(df.agg(rows.alias("r")).select(F.inline("r")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_facts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, n, missing, same): rows, missing values, and whether at most one value occurs.

    Numbers go through the long form in their own type, where minimum and maximum are generated code; text
    has no fixed width, so it is aggregated without grouping (grouping would sort it).
    """
    parts = []
    for family, cast in _families(df.select(*[col(c) for c in names])):
        if cast == "string":
            parts.append(per_column(df, family, lambda c: [
                F.count("*").alias("n"), F.count_if(is_missing(df, c)).alias("missing"),
                (F.min(col(c).cast("string")) == F.max(col(c).cast("string"))).alias("same"),
            ]))
            continue
        cells = F.array(*[F.when(~is_missing(df, c), col(c).cast(cast)) for c in family])
        parts.append(
            df.select(F.posexplode(cells).alias("g", "v")).groupBy("g")
            .agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"),
                 (F.min("v") == F.max("v")).alias("same"))
            .select(name_of(family).alias("column"), "n", "missing", "same")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("same", F.coalesce("same", F.lit(True)))


def dimensions(df: DataFrame) -> DataFrame:
    k = len(df.columns)
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(k).alias("columns"), (F.col("rows") * k).alias("total_cells")
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Columns that have missing values, worst first."""
    table = per_column(
        df, df.columns,
        lambda c: [F.count_if(is_missing(df, c)).alias("missing_count"), F.count("*").alias("n")],
    )
    return (
        table.where("missing_count > 0")
        .select("column", "missing_count", class_share(F.col("missing_count"), F.col("n"), 2).alias("missing_pct"))
        .orderBy(F.desc("missing_pct"), "column")
    )


def _families(df: DataFrame) -> list[tuple[list[str], str]]:
    """Columns grouped by the type in which their values can be compared without loss."""
    groups: dict[str, list[str]] = {}
    for f in df.schema:
        if isinstance(f.dataType, T.IntegralType):
            groups.setdefault("bigint", []).append(f.name)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            groups.setdefault("double", []).append(f.name)
        elif isinstance(f.dataType, T.DecimalType):  # as text, 10 would come before 2
            groups.setdefault(f.dataType.simpleString(), []).append(f.name)
        else:
            groups.setdefault("string", []).append(f.name)
    return [(names, t) for t, names in groups.items()]


def _value_counts(df: DataFrame, names: Sequence[str], cast: str) -> DataFrame:
    """(g, v, n): how often each column holds each value; combined before the shuffle."""
    cells = F.array(*[F.when(~is_missing(df, c), col(c).cast(cast)) for c in names])
    return df.select(F.posexplode(cells).alias("g", "v")).groupBy("g", "v").agg(F.count("*").alias("n"))


def column_types(df: DataFrame, samples: int = 3, exact: bool = True) -> DataFrame:
    """Type, kind, distinct count and the smallest values of every column."""
    parts = []
    for names, cast in _families(df):
        dtypes = [df.schema[c].dataType.simpleString() for c in names]
        kinds = [kind(df.schema[c].dataType) for c in names]
        shown = F.format_string("%.4f", "v") if cast == "double" else F.col("v").cast("string")
        values = _value_counts(df, names, cast).where("v IS NOT NULL")
        # the row_number limit is pushed below the shuffle: each task passes on `samples` rows per column
        order = Window.partitionBy("g").orderBy("v")
        smallest = (
            values.withColumn("i", F.row_number().over(order)).where(F.col("i") <= samples)
            .groupBy("g")
            .agg(F.array_join(F.transform(
                F.sort_array(F.collect_list(F.struct("i", shown.alias("s")))), lambda x: x["s"]
            ), ", ").alias("sample_values"))
        )
        if exact:
            distinct = values.groupBy("g").agg(F.count("*").alias("unique_count"))
        else:
            cells = F.array(*[F.when(~is_missing(df, c), col(c).cast(cast)) for c in names])
            distinct = df.select(F.posexplode(cells).alias("g", "v")).groupBy("g").agg(
                F.approx_count_distinct("v").alias("unique_count")
            )
        base = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("g"))
        parts.append(
            base.join(F.broadcast(distinct), "g", "left").join(F.broadcast(smallest), "g", "left")
            .select(
                name_of(names).alias("column"), name_of(dtypes).alias("dtype"), name_of(kinds).alias("kind"),
                F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
                F.coalesce("sample_values", F.lit("")).alias("sample_values"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kind_counts(types: DataFrame) -> DataFrame:
    return types.groupBy("kind").agg(F.count("*").alias("column_count"))


def duplicates(df: DataFrame, subset: Sequence[str] | None = None, key: str = d.ID) -> DataFrame:
    """Rows beyond the first copy, over all columns or `subset`.

    Rows with a unique 64-bit digest cannot have a copy, so only digests seen more than once lead to
    comparing whole rows. Clean data moves eight bytes per row, never the rows.
    """
    names = list(subset or df.columns)
    digests = df.select(F.xxhash64(*[col(c) for c in names]).alias("_h"))
    repeated = digests.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    copies = F.lit(0).cast("long")
    total = df.agg(F.count("*").alias("total_rows"))
    found = repeated.limit(BROADCAST_HASHES + 1).count()
    if found:
        rows = df.select(*[col(c) for c in names]).withColumn("_h", F.xxhash64(*[col(c) for c in names]))
        # small sets of suspects are broadcast; larger ones go through a shuffled semi join (AQE splits skew)
        side = F.broadcast(repeated) if found <= BROADCAST_HASHES else repeated
        groups = rows.join(side, "_h", "left_semi").groupBy(*[col(c) for c in names]).agg(F.count("*").alias("_n"))
        extra = groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
        total = total.crossJoin(F.broadcast(extra))  # one row each
    else:
        total = total.withColumn("duplicate_rows", copies)
    if key in df.columns:
        ids = df.groupBy(col(key)).agg(F.count("*").alias("_n")).agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("id_duplicates")
        )
        total = total.crossJoin(F.broadcast(ids))
    return total.withColumns({
        "duplicate_pct": class_share(F.col("duplicate_rows"), F.col("total_rows"), 4),
        "is_unique": F.col("duplicate_rows") == 0,
    })


def target_distribution(df: DataFrame, label: str = d.LABEL) -> DataFrame | None:
    if label not in df.columns:
        return None
    y = col(label)
    counts = df.agg(
        F.count_if(y == 0).alias("zero_count"), F.count_if(y == 1).alias("one_count"),
        F.count(y).alias("total_valid"), F.count_if(y.isNull()).alias("null_count"),
        F.avg(y).alias("_mean"),
    )
    ratio = F.col("zero_count") / F.greatest("one_count", F.lit(1))
    return counts.select(
        "zero_count", "one_count", "total_valid", "null_count",
        class_share(F.col("zero_count"), F.col("total_valid"), 2).alias("zero_pct"),
        class_share(F.col("one_count"), F.col("total_valid"), 2).alias("one_pct"),
        F.round(F.col("_mean") * 100, 4).alias("default_rate"),
        F.round(ratio, 2).alias("imbalance_ratio"),
    )


def numeric_summary(df: DataFrame, exact: bool = True) -> DataFrame | None:
    """describe() plus bias-corrected skewness and kurtosis, missing share and distinct count."""
    names = numeric_columns(df)
    if not names:
        return None
    cells = numeric_long(df, names)
    v, n = F.col("v"), F.col("count").cast("double")
    moments = cells.groupBy("g").agg(
        F.count("v").alias("count"), F.count("*").alias("_rows"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.skewness("v").alias("_g1"), F.kurtosis("v").alias("_g2"),
        *([] if exact else [
            F.approx_count_distinct("v").alias("unique_count"),
            F.percentile_approx("v", [0.25, 0.5, 0.75], 10_000).alias("_q"),
        ]),
    )
    if exact:
        quartiles = exact_quantiles_long(cells, [0.25, 0.5, 0.75])
        found = (number_array(quartiles[g]) if g in quartiles else "cast(null as array<double>)" for g in range(len(names)))
        literal = ", ".join(found)
        distinct = (
            cells.where(v.isNotNull()).groupBy("g", "v").agg(F.lit(1).alias("_one"))
            .groupBy("g").agg(F.count("*").alias("unique_count"))
        )
        # one row per column on either side
        moments = moments.join(F.broadcast(distinct), "g", "left").withColumn(
            "_q", F.expr(f"element_at(array({literal}), g + 1)")
        )
    flat = F.col("std") == 0
    skew = F.when(n < 3, None).when(flat, 0.0).otherwise(F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n < 4, None).when(flat, 0.0).otherwise(
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)
    )
    rounded = {
        "mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), "p25": F.col("_q")[0],
        "p50": F.col("_q")[1], "p75": F.col("_q")[2], "max": F.col("max"), "skewness": skew, "kurtosis": kurt,
    }
    return moments.select(
        name_of(names).alias("column"), "count",
        *[F.round(e, 4).alias(a) for a, e in rounded.items()],
        class_share(F.col("_rows") - F.col("count"), F.col("_rows"), 2).alias("missing_pct"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
    )


def categorical_summary(df: DataFrame) -> DataFrame | None:
    """Distinct values, missing share and the most frequent value (ties: the smallest)."""
    names = text_columns(df)
    if not names:
        return None
    counts = text_long(df, names).groupBy("g", "v").agg(F.count("*").alias("n"))
    present = F.col("v").isNotNull()
    return (
        counts.groupBy("g")
        .agg(
            F.count("v").alias("unique_values"),
            F.sum("n").alias("_rows"),
            F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("_seen"),
            F.min_by(F.struct("v", "n"), F.when(present, F.struct(-F.col("n"), F.col("v")))).alias("_top"),
        )
        .select(
            name_of(names).alias("column"), "unique_values",
            class_share(F.col("_rows") - F.col("_seen"), F.col("_rows"), 2).alias("missing_pct"),
            F.col("_top.v").alias("top_value"),
            F.coalesce("_top.n", F.lit(0)).alias("top_value_count"),
            F.coalesce(class_share(F.col("_top.n"), F.greatest("_seen", F.lit(1)), 2), F.lit(0.0))
            .alias("top_value_pct"),
        )
    )


def feature_categories(df: DataFrame) -> DataFrame:
    """Domain category of every feature, with how many values it holds."""
    owner = {f: c for c, features in d.FEATURE_CATALOGUE.items() for f in features}
    names = [c for c in df.columns if c not in d.META_COLUMNS]
    table = per_column(df, names, lambda c: [
        F.lit(owner.get(c, "other")).alias("category"),
        F.count_if(~is_missing(df, c)).alias("non_null_count"),
    ])
    return table.select("category", F.col("column").alias("feature"), "non_null_count")
