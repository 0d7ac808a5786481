import pytest
from pyspark.sql import functions as F

from riskloom.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(20_000).select(
        (F.col("id") % 4).alias("day"), F.when(F.col("id") % 10 > 0, (F.col("id") * 7919 % 1000).cast("double")).alias("x"),
        F.concat(F.lit("t"), F.col("id") % 300).alias("t"), F.lit(None).cast("string").alias("none"),
        (F.col("id") % 2 == 0).alias("flag"))


def test_only_new_partitions_are_read(spark, rows, tmp_path):
    root = str(tmp_path / "s")
    assert sketches.refresh(rows.where("day < 3"), "day", root) == []
    # partitions that are kept must not be read again: a value that fails would stop the refresh
    trap = rows.withColumn("x", F.when(F.col("day") < 3, F.raise_error(F.lit("read again")).cast("double")).otherwise(F.col("x")))
    assert sorted(sketches.refresh(trap, "day", root)) == ["p0", "p1", "p2"]
    got = {r.column: r for r in sketches.merged(spark, root).collect()}
    assert {c: r.n for c, r in got.items()} == dict.fromkeys(("x", "t", "none", "flag"), 20_000)
    assert got["x"].missing_count == 2000 and got["none"].missing_count == 20_000 and got["x"].missing_pct == 10.0
    assert got["t"].unique_count == pytest.approx(300, rel=0.05) and got["flag"].unique_count == 2
    assert got["none"].unique_count == 0 and got["none"].p50 is None and got["t"].p50 is None
    assert got["x"].p25 == pytest.approx(250, abs=20) and got["x"].p75 == pytest.approx(750, abs=20)
    close = {r.column: r for r in sketches.accuracy(rows, sketches.merged(spark, root), ["x", "t", "none", "flag"]).collect()}
    assert all(r.distinct_close for r in close.values()) and close["x"].median_close and close["t"].median_close is None


def test_null_partitions_and_no_rows(spark, rows, tmp_path):
    odd = rows.limit(50).withColumn("day", F.when(F.col("day") > 1, F.col("day")))
    root = str(tmp_path / "s")
    sketches.refresh(odd, "day", root)
    assert sorted(sketches.refresh(odd, "day", root)) == ["n", "p2", "p3"]
    assert sketches.merged(spark, root).where("column = 'x'").first().n == 50
    assert sketches.kept_partitions(spark, str(tmp_path / "nothing")) == []
