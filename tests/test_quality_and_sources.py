import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.quality import SchemaValidationError, align_to_schema, label_checks, validate
from riskloom.plans.eda import write_json
from riskloom.sources import tables
from riskloom.sources.registry import ModelRegistry

APP = "SK_ID_CURR,TARGET,AMT,NAME\n1,0,10.5,a\n2,1,,b\n3,0,3.0,\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "application_train.csv").write_text(APP)
    (tmp_path / "bureau.csv").write_text("SK_ID_CURR,CREDIT_TYPE\n1,x\n")
    return str(tmp_path)


def test_csv_types_and_nulls(spark, folder):
    df = tables.read_table(spark, f"{folder}/application_train.csv")
    assert [f.dataType for f in df.schema] == [T.IntegerType(), T.IntegerType(), T.DoubleType(), T.StringType()]
    assert df.where("AMT is null").count() == 1 and df.where("NAME is null").count() == 1


def test_missing_files(spark, folder):
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, f"{folder}/absent.csv")
    assert tables.read_table(spark, f"{folder}/absent.csv", required=False) is None


def test_unreadable_file(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        tables.read_table(spark, f"{tmp_path}/x.parquet", "parquet").collect()
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(tables.SourceError):
        tables.read_table(spark, f"{tmp_path}/empty.csv")


def test_load_all_skips_optional(spark, folder):
    got = tables.load_datasets(spark, folder)
    assert set(got) == {"application_train", "bureau"}
    assert spark.table("bureau").count() == 1


def test_given_schema_avoids_inference(spark, folder):
    df = tables.read_table(spark, f"{folder}/bureau.csv", schema="SK_ID_CURR long, CREDIT_TYPE string")
    assert df.schema["SK_ID_CURR"].dataType == T.LongType()


def test_nan_becomes_null(spark):
    df = tables.nan_to_null(spark.createDataFrame([(float("nan"), 1)], "a double, b int"))
    assert df.first().a is None


def test_narrowing(spark):
    df = spark.createDataFrame(
        [(1, 300, 70000, 3_000_000_000, 1.5, 1e300, None, "x"), (-5, 2, 3, 4, 2.5, 0.0, None, "y")],
        "a long, b long, c long, d long, e double, f double, g double, h string",
    )
    out = tables.narrow_types(df)
    assert [f.dataType.simpleString() for f in out.schema] == [
        "tinyint", "smallint", "int", "bigint", "float", "double", "double", "string",
    ]
    assert out.first().c == 70000


def test_split_round_trip_and_warnings(spark, tmp_path):
    train = spark.createDataFrame([(1, 0, 2.0, 1.0)], "SK_ID_CURR int, TARGET int, a double, b double")
    test = train.drop("b")
    for fmt in ("parquet", "csv"):
        tables.write_train_test(train, test, f"{tmp_path}/{fmt}", fmt)
        a, b, warnings = tables.read_train_test(spark, f"{tmp_path}/{fmt}", "TARGET", fmt)
        assert a.first() == train.first() and "2 features, train has 3" in warnings[0]
    tables.write_train_test(train.drop("TARGET"), test, f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="TARGET"):
        tables.read_train_test(spark, f"{tmp_path}/bad", "TARGET")
    with pytest.raises(FileNotFoundError):
        tables.read_train_test(spark, f"{tmp_path}/none", "TARGET")


def test_json_keeps_nulls(spark, tmp_path):
    path = write_json(spark.createDataFrame([(1, None)], "a int, b double"), f"{tmp_path}/j")
    assert spark.read.text(path).first().value == '{"a":1,"b":null}'


def test_registry_documents(spark, tmp_path):
    r = ModelRegistry(spark, str(tmp_path))
    r.save_json("m", {"a": float("nan"), "b": [1, {"c": 2}]})
    got = r.load_json("m")
    assert got["a"] is None and got["b"] == [1, {"c": 2}] and "saved_at" in got
    for load in (r.load_model, r.load_pipeline, lambda: r.load_json("none")):
        with pytest.raises(FileNotFoundError):
            load()


def people(spark, labels, ids=None):
    ids = ids or range(len(labels))
    return spark.createDataFrame(list(zip(ids, labels)), "SK_ID_CURR int, TARGET int")


def test_null_labels_warn_on_load_and_fail_in_training(spark):
    df = people(spark, [0, 1, None, 0])
    assert any("NULL" in w for w in validate(df)["warnings"])
    with pytest.raises(SchemaValidationError, match="NULL"):
        validate(df, "train")


def test_bad_labels_and_columns(spark):
    with pytest.raises(SchemaValidationError, match="other than"):
        validate(people(spark, [0, 2]))
    with pytest.raises(SchemaValidationError, match="missing required"):
        validate(people(spark, [0, 1]).drop("TARGET"))
    with pytest.raises(SchemaValidationError, match="numeric"):
        validate(people(spark, [0, 1]).withColumn("TARGET", F.col("TARGET").cast("string")), "train")


def test_duplicate_ids_are_counted(spark):
    facts = label_checks(people(spark, [0, 1, 0, 0], [1, 1, 1, 2])).first()
    assert facts.duplicate_id_count == 2 and facts.positives == 1 and facts.default_rate_pct == 25.0
    assert validate(people(spark, [0, 1, 0], [1, 1, 2]))["warnings"]


def test_alignment(spark):
    df = spark.createDataFrame([(1, 0, "x", 5)], "SK_ID_CURR int, TARGET int, b string, extra int")
    out = align_to_schema(df, {"a": "double", "b": "string"})
    assert out.columns == ["SK_ID_CURR", "a", "b"] and out.first() == (1, None, "x")
    assert out.schema["a"].dataType == T.DoubleType()
    with pytest.raises(SchemaValidationError):
        align_to_schema(df, {})


class _Session:
    """Just the two settings `work_path` reads."""

    def __init__(self, setting):
        self.setting, self.folder, self.conf, self.sparkContext = setting, None, self, self

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.setting

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_work_goes_to_the_folder_the_cluster_names():
    shared = _Session("hdfs://shared/checkpoints")
    assert tables.work_path(shared, "x").startswith("hdfs://shared/checkpoints/x-") and shared.folder is None
    unset = _Session(None)
    unset.master = "local[8]"
    first, second = tables.work_path(unset, "x"), tables.work_path(unset, "x")
    assert first != second and unset.folder is None and first.rpartition("/")[0] == second.rpartition("/")[0]
    unset.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.work_path(unset, "x")
