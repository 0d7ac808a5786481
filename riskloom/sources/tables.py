"""Reading and writing tables. Every path may be any Hadoop-visible location."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import col, numeric_columns


class SourceError(RuntimeError):
    """A source exists but cannot be read."""


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    required: bool = True,
) -> DataFrame | None:
    """Read CSV (header, inferred types unless `schema` is given) or Parquet.

    A missing path raises FileNotFoundError when `required`, else gives None. Inference reads a CSV
    twice, so pass a schema for big inputs.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    try:
        if fmt == "csv":
            df = reader.options(header=True, inferSchema=schema is None, mode="FAILFAST").csv(path)
        else:
            df = reader.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            if required:
                raise FileNotFoundError(f"required dataset not found: {path}") from e
            return None
        raise SourceError(f"cannot read {path}: {e}") from e
    if not df.columns:
        raise SourceError(f"cannot read {path}: no columns")
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark treats NaN as a value; every operator here expects NULL for 'missing'."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(col(c), F.lit(None)) for c in floats}) if floats else df


@dataclass(frozen=True)
class Dataset:
    name: str
    file: str
    required: bool = False


# The dataset files of the domain.
DATASETS = (
    Dataset("application_train", "application_train.csv", required=True),
    Dataset("bureau", "bureau.csv"),
    Dataset("previous_application", "previous_application.csv"),
)


def load_datasets(
    spark: SparkSession,
    root: str,
    datasets: tuple[Dataset, ...] = DATASETS,
    fmt: str = "csv",
    schemas: Mapping[str, T.StructType] | None = None,
) -> dict[str, DataFrame]:
    """Load every dataset that exists, register each as a temp view, return them by name."""
    out = {}
    for d in datasets:
        df = read_table(spark, f"{root}/{d.file}", fmt, (schemas or {}).get(d.name), d.required)
        if df is not None:
            df.createOrReplaceTempView(d.name)
            out[d.name] = df
    return out


# Integer types from narrow to wide with the largest value each can hold.
_INTEGERS = [(T.ByteType(), 2**7 - 1), (T.ShortType(), 2**15 - 1), (T.IntegerType(), 2**31 - 1),
             (T.LongType(), 2**63 - 1)]
_FLOAT_MAX = 3.4028234663852886e38


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast each numeric column to the smallest type that holds its range (floats to 32 bits).

    One aggregation finds all ranges, one projection casts. Columns without values stay as they are.
    """
    fields = [f for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.DoubleType, T.FloatType))]
    if not fields:
        return df
    ranges = df.agg(*[F.struct(F.min(col(f.name)), F.max(col(f.name))).alias(f.name) for f in fields]).first()
    casts = {}
    for f in fields:
        low, high = ranges[f.name]
        if low is None:
            continue
        if isinstance(f.dataType, T.IntegralType):
            casts[f.name] = next(t for t, top in _INTEGERS if -top - 1 <= low and high <= top)
        elif -_FLOAT_MAX <= low and high <= _FLOAT_MAX:
            casts[f.name] = T.FloatType()
    return df.select(*[col(c).cast(casts[c]).alias(c) if c in casts else col(c) for c in df.columns])


def type_summary(df: DataFrame) -> DataFrame:
    """One row per numeric column: name and narrowed type with its range, for reports."""
    names = numeric_columns(df)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.min(col(c)).cast("double").alias("min"), F.max(col(c)).cast("double").alias("max"),
        )
        for c in names
    ])
    return df.agg(rows.alias("r")).select(F.inline("r"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
    return path


def write_train_test(train: DataFrame, test: DataFrame, root: str, fmt: str = "parquet") -> dict[str, str]:
    return {
        "train": write_table(train, f"{root}/train", fmt),
        "test": write_table(test, f"{root}/test", fmt),
    }


def read_train_test(
    spark: SparkSession, root: str, label: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train, test and warnings. The label must be in train; differing widths are only a warning."""
    train = read_table(spark, f"{root}/train", fmt)
    test = read_table(spark, f"{root}/test", fmt)
    if label not in train.columns:
        raise ValueError(f"'{label}' column not found in the training table")
    a, b = (len([c for c in df.columns if c != label]) for df in (train, test))
    return train, test, [] if a == b else [f"test has {b} features, train has {a}"]


# ---- places for intermediate data ------------------------------------------------------------

#: Paths of intermediate tables that this process has named and not removed yet.
_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that the cluster names in spark.checkpoint.dir.

    Only a local session, whose driver and executors are one process, may do without that setting: it gets one temporary
    folder, removed when Python ends. No setting of the session is changed. What lies at the path is removed at the end
    of `scratch`, or when Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_folder()
    if not _made:
        atexit.register(_remove_made)
    _made.append(f"{root}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end. What is to last must have been written elsewhere by then,
    or been taken from the frames that read them."""
    first = len(_made)
    try:
        yield
    finally:
        for path in _made[first:]:
            remove(spark, path)


def _remove_made() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_made) if spark else []:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before Python does
            return


@cache
def _local_folder() -> str:
    root = tempfile.mkdtemp(prefix="riskloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write and read back: cuts lineage and survives the loss of any executor."""
    path = write_table(df, work_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
