"""The feature pipeline as Spark ML stages: fitting is one aggregation, transforming one projection."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import domain as d
from riskloom.functions import expressions as X
from riskloom.functions.columns import col, numeric_columns, numeric_long, text_columns, text_long
from riskloom.operators import dictionary
from riskloom.operators.profile import column_facts
from riskloom.operators.quality import SchemaValidationError
from riskloom.operators.selection import quantiles_and_counts

#: A text column with more values becomes one sparse vector column instead of a column for each value.
MAX_CATEGORIES = 1000


class _Stateful(Params, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps what a stage has learnt as JSON in a param, so that Spark saves and loads it with the stage."""

    state = Param(Params._dummy(), "state", "learnt state as JSON", TypeConverters.toString)

    def __init__(self, state: dict | None = None):
        super().__init__()
        self._set(state=json.dumps(state or {}))

    @property
    def learnt(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


def _features(df: DataFrame, key: str, label: str) -> list[str]:
    return [c for c in df.columns if c not in (key, label)]


# ---- engineered ratios -----------------------------------------------------------------------

# The engineered ratios and the columns each needs.
RATIO_SOURCES = {
    "debt_to_income_ratio": ("AMT_CREDIT", "AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "credit_to_income_ratio": ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "annuity_to_income_ratio": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "employment_age_ratio": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
}


def _ratio(name: str) -> Column:
    income = F.col("AMT_INCOME_TOTAL")
    if name == "debt_to_income_ratio":
        return X.safe_ratio(X.number(F.col("AMT_CREDIT")) + X.number(F.col("AMT_ANNUITY")), income)
    if name == "credit_to_income_ratio":
        return X.safe_ratio(X.number(F.col("AMT_CREDIT")), income)
    if name == "annuity_to_income_ratio":
        return X.safe_ratio(X.number(F.col("AMT_ANNUITY")), income)
    return X.safe_ratio(X.tenure_years(F.col("DAYS_EMPLOYED")), X.age_years(F.col("DAYS_BIRTH")))


class RatioFeatures(Estimator):
    """Adds the ratios whose source columns exist when fitted."""

    def _fit(self, dataset: DataFrame) -> RatioFeaturesModel:
        have = set(dataset.columns)
        lacking = {n: sorted(set(src) - have) for n, src in RATIO_SOURCES.items()}
        return RatioFeaturesModel({
            "created": [n for n, m in lacking.items() if not m],
            "skipped": {n: f"missing columns: {m}" for n, m in lacking.items() if m},
        })


class RatioFeaturesModel(Model, _Stateful):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({n: _ratio(n) for n in self.learnt["created"]})


# ---- types -----------------------------------------------------------------------------------

class PlainTypes(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Features as numbers or text: a boolean becomes 'true' or 'false', a date its day number since 1970, a time its
    seconds since then. Nulls stay. A type that is neither (array, map, struct, binary) is refused by name."""

    def __init__(self, key: str = d.ID, label: str = d.LABEL):
        super().__init__()
        self._key, self._label = key, label

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made, bad = {}, []
        for f in dataset.schema:
            if f.name in (self._key, self._label) or isinstance(f.dataType, (T.NumericType, T.StringType)):
                continue
            if isinstance(f.dataType, (T.BooleanType, T.NullType)):
                made[f.name] = col(f.name).cast("string")
            elif isinstance(f.dataType, T.DateType):
                made[f.name] = F.unix_date(col(f.name)).cast("double")
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                made[f.name] = F.unix_micros(col(f.name).cast("timestamp")) / 1e6
            else:
                bad.append(f"{f.name} {f.dataType.simpleString()}")
        if bad:
            raise SchemaValidationError(f"neither numbers nor text: {bad}")
        return dataset.withColumns(made) if made else dataset


# ---- column selection ------------------------------------------------------------------------

class ColumnSelector(Estimator):
    """Drops columns that are mostly missing or never vary. Id and label are left alone."""

    missingLimit = Param(Params._dummy(), "missingLimit", "largest allowed share of missing", TypeConverters.toFloat)

    def __init__(self, missing_limit: float = d.MISSING_LIMIT, key: str = d.ID, label: str = d.LABEL):
        super().__init__()
        self._set(missingLimit=missing_limit)
        self._key, self._label = key, label

    def _fit(self, dataset: DataFrame) -> ColumnSelectorModel:
        limit = self.getOrDefault(self.missingLimit)
        names = _features(dataset, self._key, self._label)
        facts = {r.column: r for r in column_facts(dataset, names).collect()} if names else {}
        missing = {c: facts[c].missing / facts[c].n if c in facts and facts[c].n else 1.0 for c in names}
        constant = {c for c in names if c not in facts or facts[c].same}
        high = [c for c in names if missing[c] > limit]
        flat = [c for c in names if c in constant and c not in high]
        dropped = {*high, *flat}
        return ColumnSelectorModel({
            "selected": [c for c in names if c not in dropped],
            "protected": [self._key, self._label],
            "report": {
                "missing_limit": limit,
                "dropped_high_missing": [{"column": c, "missing_pct": round(missing[c] * 100, 2)} for c in high],
                "dropped_zero_variance": flat,
                "input_feature_count": len(names),
                "output_feature_count": len(names) - len(dropped),
                "total_dropped": len(dropped),
            },
        })


class ColumnSelectorModel(Model, _Stateful):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = self.learnt
        absent = sorted(set(state["selected"]) - set(dataset.columns))
        if absent:
            raise SchemaValidationError(f"missing expected columns: {absent}")
        carried = [c for c in state["protected"] if c in dataset.columns]
        return dataset.select(*[col(c) for c in carried + state["selected"]])


def selection_report(df: DataFrame, limit: float = d.MISSING_LIMIT, key: str = d.ID, label: str = d.LABEL) -> DataFrame:
    """What the selector decides about each column, as a table."""
    table = column_facts(df, _features(df, key, label))
    share = F.try_divide(F.col("missing").cast("double"), F.col("n").cast("double"))
    return table.select(
        "column", F.round(share * 100, 2).alias("missing_pct"),
        F.when(share > limit, "high_missing").when(F.col("same"), "zero_variance").otherwise("kept")
        .alias("decision"),
    )


# ---- imputation ------------------------------------------------------------------------------

class MissingFiller(Estimator):
    """Median for numbers (0 when there is none), commonest value for text ('MISSING' when there is none)."""

    def __init__(self, key: str = d.ID, label: str = d.LABEL):
        super().__init__()
        self._key, self._label = key, label

    def _fit(self, dataset: DataFrame) -> MissingFillerModel:
        numbers = numeric_columns(dataset, exclude=(self._key, self._label))
        texts = text_columns(dataset, exclude=(self._key, self._label))
        found, seen = ({}, {}) if not numbers else quantiles_and_counts(numeric_long(dataset, numbers), [0.5])
        fills: dict[str, float | str] = {c: found[g][0] if g in found else 0.0 for g, c in enumerate(numbers)}
        top, present, total = commonest_values(dataset, texts)
        fills |= dict(zip(texts, top))
        if not texts:
            total = dataset.count()
        lost = {c: total - seen.get(g, 0) for g, c in enumerate(numbers)}
        lost |= {c: total - k for c, k in zip(texts, present)}
        columns = {
            c: {
                "strategy": "median" if c in numbers else "most_frequent",
                "missing_count": lost[c],
                "missing_pct": round(lost[c] / total * 100, 2) if total else 0.0,
                "imputed_value": fills[c],
            }
            for c in fills
        }
        return MissingFillerModel({"fills": fills, "columns": columns, "total_imputed": sum(lost.values())})


class MissingFillerModel(Model, _Stateful):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        def filled(c: str, value: float | str) -> Column:
            return F.coalesce(col(c) if isinstance(value, str) else X.number(col(c)), F.lit(value))

        fills = self.learnt["fills"]
        return dataset.withColumns({c: filled(c, v) for c, v in fills.items() if c in dataset.columns})

    def stats(self, spark) -> DataFrame:
        rows = [
            (c, s["strategy"], s["missing_count"], s["missing_pct"],
             None if isinstance(s["imputed_value"], str) else float(s["imputed_value"]),
             s["imputed_value"] if isinstance(s["imputed_value"], str) else None)
            for c, s in self.learnt["columns"].items()
        ]
        return spark.createDataFrame(
            rows, "column string, strategy string, missing_count long, missing_pct double, "
            "imputed_number double, imputed_text string",
        )


def commonest_values(
    df: DataFrame, names: Sequence[str], fallback: str = "MISSING"
) -> tuple[list[str], list[int], int]:
    """Most frequent value (ties to the smallest) and non-null count per text column, and the row count.

    Values are counted first, so a frequent one is combined before the shuffle.
    """
    if not names:
        return [], [], 0
    counts = text_long(df, names).groupBy("g", "v").agg(F.count("*").alias("n"))
    present = F.col("v").isNotNull()
    found = counts.groupBy("g").agg(
        F.min_by("v", F.when(present, F.struct(-F.col("n"), F.col("v")))).alias("top"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("seen"), F.sum("n").alias("total"),
    ).collect()
    rows = {r.g: r for r in found}
    top = [rows[i].top if i in rows and rows[i].top is not None else fallback for i in range(len(names))]
    seen = [rows[i].seen if i in rows else 0 for i in range(len(names))]
    return top, seen, found[0].total if found else 0


# ---- encoding --------------------------------------------------------------------------------

class CategoryEncoder(Estimator):
    """Codes for text columns with at most two values, one 0/1 column per value for the others.

    Numbers pass as doubles. Output names hold only letters, digits and underscores. A column with more than
    `max_categories` values becomes one sparse vector column, `<column>_values`; its values are never gathered, but numbered
    in order in a dictionary (riskloom.operators.dictionary) that is saved with the model.
    """

    def __init__(
        self, max_binary: int = d.BINARY_MAX_UNIQUE, max_categories: int = MAX_CATEGORIES,
        key: str = d.ID, label: str = d.LABEL,
    ):
        super().__init__()
        self._max_binary, self._max_categories = max_binary, max_categories
        self._key, self._label = key, label

    def _fit(self, dataset: DataFrame) -> CategoryEncoderModel:
        texts = text_columns(dataset, exclude=(self._key, self._label))
        numbers = [c for c in _features(dataset, self._key, self._label) if c not in texts]
        sizes = dictionary.sizes(dataset, texts)
        wide = [c for c in texts if sizes[c] > self._max_categories]
        values = self._categories(dataset, [c for c in texts if c not in wide])
        coded = [c for c in values if len(values[c]) <= self._max_binary]
        spread = [c for c in values if c not in coded]
        raw = [*numbers, *[f"{c}_le" for c in coded], *[f"{c}_{v}" for c in spread for v in values[c]],
               *[f"{c}_values" for c in wide]]
        return CategoryEncoderModel({
            "key": self._key, "label": self._label, "numbers": numbers, "values": values,
            "coded": coded, "spread": spread, "wide": {c: sizes[c] for c in wide}, "names": sanitise(raw),
            "dictionary": dictionary.build(dataset, wide) if wide else None,
        })

    def _categories(self, dataset: DataFrame, texts: list[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {c: [] for c in texts}
        if texts:
            for r in text_long(dataset, texts).where("v IS NOT NULL").distinct().collect():  # max_categories for each
                out[texts[r.g]].append(r.v)
        for vs in out.values():
            vs.sort()
        return out


class _EncoderWriter(DefaultParamsWriter):
    """Saves the dictionary of wide columns beside the other params."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        given = self.instance.learnt.get("dictionary")
        if given:
            spark = SparkSession.active()
            spark.read.parquet(given).write.mode("overwrite").parquet(f"{path}/dictionary")


class _EncoderReader(DefaultParamsReader):
    def load(self, path: str) -> CategoryEncoderModel:
        model = super().load(path)
        if model.learnt.get("dictionary"):
            model._set(state=json.dumps({**model.learnt, "dictionary": f"{path}/dictionary"}))
        return model


class CategoryEncoderModel(Model, _Stateful):
    def write(self) -> _EncoderWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> _EncoderReader:
        return _EncoderReader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.learnt
        cells = [X.number(col(c)) for c in s["numbers"]]
        for c in s["coded"]:
            code = F.lit(float(d.UNKNOWN_CODE))
            for i, v in enumerate(s["values"][c]):
                code = F.when(col(c) == v, F.lit(float(i))).otherwise(code)
            cells.append(code)
        for c in s["spread"]:
            cells += [F.coalesce((col(c) == v).cast("double"), F.lit(0.0)) for v in s["values"][c]]
        wide = list(s.get("wide", {}))
        if wide:
            table = dataset.sparkSession.read.parquet(s["dictionary"])
            dataset = dictionary.vectors(dataset, table, s["wide"], [f"_v{i}" for i in range(len(wide))])
            cells += [F.col(f"_v{i}") for i in range(len(wide))]
        keep = [col(c) for c in (s["key"],) if c in dataset.columns]
        tail = [col(c) for c in (s["label"],) if c in dataset.columns]
        return dataset.select(*keep, *[e.alias(n) for e, n in zip(cells, s["names"])], *tail)

    @property
    def feature_names(self) -> list[str]:
        return self.learnt["names"]


def sanitise(names: Sequence[str]) -> list[str]:
    """Letters, digits and single underscores only; clashes get _1, _2, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        safe = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", name).strip("_"))
        n = seen.get(safe)
        seen[safe] = 0 if n is None else n + 1
        out.append(safe if n is None else f"{safe}_{n + 1}")
    return out


def preprocessing(missing_limit: float = d.MISSING_LIMIT, max_categories: int = MAX_CATEGORIES) -> Pipeline:
    """Plain types, ratios, selection, filling, encoding. Fit it on training rows only."""
    return Pipeline(stages=[
        PlainTypes(), RatioFeatures(), ColumnSelector(missing_limit), MissingFiller(),
        CategoryEncoder(max_categories=max_categories),
    ])


def feature_names(fitted: Transformer) -> list[str]:
    return next(s for s in fitted.stages if isinstance(s, CategoryEncoderModel)).feature_names


def preprocessing_metadata(fitted: Transformer) -> dict:
    """Everything the fitted stages learnt, ready to be saved beside them."""
    ratios, selector, filler, encoder = (s.learnt for s in fitted.stages[1:5])
    return {
        "created_features": ratios["created"],
        "skipped_features": ratios["skipped"],
        "feature_selection_report": selector["report"],
        "imputation_stats": {"columns": filler["columns"], "total_values_imputed": filler["total_imputed"]},
        "encoding": {
            "label_encoded_columns": encoder["coded"], "one_hot_encoded_columns": encoder["spread"],
            "sparse_encoded_columns": encoder["wide"],
            "unknown_label_value": d.UNKNOWN_CODE, "output_feature_count": len(encoder["names"]),
        },
        "feature_names": encoder["names"],
    }


def raw_schema(df: DataFrame, key: str = d.ID, label: str = d.LABEL) -> dict[str, str]:
    """Feature name -> Spark type, the schema that scoring input is aligned to."""
    return {f.name: f.dataType.simpleString() for f in df.schema if f.name not in (key, label)}
