from conftest import telco
from pyspark.sql import functions as F

from churnspark.operators.validate import duplicate_count, leak_correlations, validate


def status(report):
    return {c[0]: c[1] for c in report.checks}


def test_clean_table(spark):
    report = validate(telco(spark, 120), "t.csv")
    assert report.status == "valid" and report.is_valid
    assert status(report)["Target Column"] == "pass" and len(report.checks) >= 6
    assert report.table(spark).count() == len(report.checks)


def test_small_and_duplicate(spark):
    df = telco(spark, 50).withColumn("customerID", F.concat(F.lit("C"), F.regexp_extract("customerID", "([0-9])$", 1)))
    report = validate(df)
    assert report.is_valid and report.status == "warning"
    assert any("duplicate" in w for w in report.warnings)
    assert status(report)["Sample Size"] == "warning"
    tiny = validate(telco(spark, 10))
    assert not tiny.is_valid and any("Insufficient" in e for e in tiny.errors)


def test_empty(spark):
    report = validate(telco(spark, 5).where("1 = 0"))
    assert report.status == "error" and status(report) == {"File Content": "fail"}


def test_one_class_and_no_target(spark):
    one = validate(telco(spark, 60).withColumn("Churn", F.lit("No")))
    assert status(one)["Target Variance"] == "fail"
    none = validate(telco(spark, 60).drop("Churn"))
    assert status(none)["Target Column"] == "fail"
    assert validate(telco(spark, 60).drop("Churn"), training=False).is_valid


def test_missing_cardinality_leak_balance(spark):
    df = telco(spark, 400).withColumns({
        "gap": F.when(F.col("tenure") > 50, F.col("tenure").cast("double")),
        "free_text": F.concat(F.lit("t"), F.col("customerID")),
        "mirror": F.when(F.col("Churn") == "Yes", 10.0).otherwise(0.0),
        "Churn": F.when(F.col("customerID") == "ID1", "wat").otherwise(F.col("Churn")),
    })
    got = status(validate(df))
    assert got["Missing Values"] == "warning"
    assert got["Categorical Cardinality"] == "warning"
    assert got["Target Correlation"] == "warning"
    assert got["Target Labels"] == "warning"
    rare = telco(spark, 200).withColumn("Churn", F.when(F.col("customerID").isin("ID1", "ID2"), "Yes").otherwise("No"))
    assert status(validate(rare))["Class Balance"] == "warning"


def test_null_ids_count_as_one_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "id string")
    assert duplicate_count(df, "id").first()["duplicates"] == 2


def test_leak_needs_complete_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (0, 0.0, None), (1, 1.0, 1.0), (0, 0.0, 0.0)], "_y int, a double, b double")
    got = {r["column"]: r["is_leak"] for r in leak_correlations(df, ["a", "b"]).collect()}
    assert got == {"a": True, "b": False}
