"""Dictionaries of the values of text columns, for columns with any number of values.

A dictionary is a table (column, value, number, n): the values of a column numbered from 0 in their order, and how many
rows have each. Rows take their numbers by a join whose kind Spark chooses by what it measures. Values that many rows
share are looked up in a broadcast part of at most HOT_VALUES rows, so no task gets all rows of one value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import col, text_long
from riskloom.sources.tables import settle, work_path, write_table

HOT_VALUES = 10_000


def sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Number of distinct values of each column; nulls do not count."""
    if not columns:
        return {}
    pairs = text_long(df, columns).where("v IS NOT NULL").distinct()
    found = {r.g: r.n for r in pairs.groupBy("g").agg(F.count("*").alias("n")).collect()}
    return {c: found.get(g, 0) for g, c in enumerate(columns)}


def numbered(df: DataFrame, group: str, order: str, name: str = "number") -> DataFrame:
    """Add the place from 0 within `group`, in order of `order`, whose values differ within a group.

    The rows are sorted by ranges; a task numbers its own range, after the rows of the ranges before.
    """
    parts = settle(df.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(group, "_part").agg(F.count("*").alias("_n")).select(
        group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_part").orderBy(order)
    return parts.join(starts, [group, "_part"]).withColumn(
        name, F.col("_start") + F.row_number().over(inside) - 1).drop("_part", "_start")


def build(df: DataFrame, columns: Sequence[str]) -> str:
    """Write the dictionary of `columns` to the shared folder; its path."""
    counted = text_long(df, columns).where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(c) for c in columns])
    table = numbered(counted, "g", "v").select(
        F.element_at(names, F.col("g") + 1).alias("column"), F.col("v").alias("value"), "number", "n")
    return write_table(table, work_path(df.sparkSession, "dictionary"))


def attach(rows: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """Add `name`: the number of the value of `column`; null for an unknown or missing one."""
    own = table.where(F.col("column") == column)
    total = own.agg(F.sum("n").alias("n")).first().n or 0
    limit = total // HOT_VALUES + 1
    hot = own.where(F.col("n") > limit).select(F.col("value").alias("_hot"), F.col("number").alias("_hot_index"))
    rest = own.where(F.col("n") <= limit).select(F.col("value").alias("_rest"), F.col("number").alias("_rest_index"))
    known = rows.join(F.broadcast(hot), col(column).cast("string") == F.col("_hot"), "left")  # at most HOT_VALUES rows
    # rows that are done, or have no value, are dealt evenly under keys that no value has
    apart = F.concat(F.lit("\x00 "), F.pmod(F.xxhash64(*[col(c) for c in rows.columns]), F.lit(4096)).cast("string"))
    asked = F.when(F.col("_hot_index").isNull() & col(column).isNotNull(), col(column).cast("string")).otherwise(apart)
    return known.withColumn("_asked", asked).join(rest, F.col("_asked") == F.col("_rest"), "left").withColumn(
        name, F.coalesce("_hot_index", F.when(F.col("_hot_index").isNull() & col(column).isNotNull(), F.col("_rest_index")))
    ).drop("_hot", "_hot_index", "_asked", "_rest", "_rest_index")


def vectors(rows: DataFrame, table: DataFrame, wide: Mapping[str, int], names: Sequence[str]) -> DataFrame:
    """Add a sparse vector for each column of `wide` (column -> number of values): 1 at the value's number, all 0 for an
    unknown or missing value."""
    places = [f"_place{i}" for i in range(len(names))]
    for (column, size), place in zip(wide.items(), places):
        rows = attach(rows, table, column, place).withColumn(
            place, F.coalesce(F.col(place), F.lit(size)).cast("double"))
    encoder = OneHotEncoder(inputCols=places, outputCols=list(names), handleInvalid="keep", dropLast=True)
    # the encoder learns nothing but the sizes, which are known
    known = rows.sparkSession.createDataFrame([tuple(float(n - 1) for n in wide.values())], places)
    return encoder.fit(known).transform(rows).drop(*places)


def value_names(table: DataFrame, column: str) -> DataFrame:
    """(number, name) of the values of a column, for reading a model's importances."""
    return table.where(F.col("column") == column).select("number", F.concat_ws("_", "column", "value").alias("name"))
