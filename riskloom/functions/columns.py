"""Schema helpers: which columns are numeric or text, and the long form of several columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FractionalType,)):
        return "float"
    return "string"


def is_missing(df: DataFrame, name: str) -> Column:
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return col(name).isNull() | F.isnan(col(name)) if floating else col(name).isNull()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_array(values: Sequence[str]) -> str:
    """SQL array of string literals. Long literal lists are written as one SQL text: building them from
    Column objects costs a gateway round trip per element."""
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def number_array(values: Iterable[float]) -> str:
    """SQL array of double literals."""

    def one(v: float) -> str:
        return f"double('{v}')" if v in (float("inf"), float("-inf")) else f"{float(v)!r}D"

    return "array(" + ", ".join(one(v) for v in values) + ")"


def numeric_long(df: DataFrame, names: Sequence[str], keep: Sequence[Column | str] = ()) -> DataFrame:
    """One row per cell: (g = position in `names`, v = double, NULL for NaN). The plan stays small however
    wide the table."""

    def cell(c: str) -> str:
        value = f"cast({quoted(c)} as double)"
        floating = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
        return f"nanvl({value}, cast(null as double))" if floating else value

    cells = ", ".join(cell(c) for c in names)
    return df.select(*keep, F.expr(f"posexplode(array({cells}))").alias("g", "v"))


def text_long(df: DataFrame, names: Sequence[str]) -> DataFrame:
    cells = ", ".join(quoted(c) for c in names)
    return df.select(F.expr(f"posexplode(array({cells}))").alias("g", "v"))


def name_of(names: Sequence[str], g: str = "g") -> Column:
    return F.expr(f"element_at({text_array(names)}, {g} + 1)")
