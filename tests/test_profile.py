import pytest
from conftest import telco
from pyspark.sql import functions as F

from churnspark.operators import profile as P
from churnspark.operators.clean import align, clean
from churnspark.operators.diagnose import spend_column, tenure_column


def test_roles(spark):
    prof = P.profile(telco(spark, 50), "t.csv")
    assert (prof.target, prof.id_column) == ("Churn", "customerID")
    assert prof.numeric == ["tenure", "MonthlyCharges"]
    assert prof.categorical == ["Contract", "PaymentMethod", "InternetService"]
    assert prof.rows == 50 and prof.filename == "t.csv"
    assert P.TableProfile.from_json(prof.to_json()) == prof


def test_leakage_before_constant(spark):
    df = telco(spark, 50).withColumn("cancellation_date", F.lit("2024-01-01")).withColumn("churn_reason", F.lit("Price"))
    prof = P.profile(df)
    assert prof.leakage_columns == ["cancellation_date", "churn_reason"]
    assert not set(prof.leakage_columns) & set(prof.all_features)


@pytest.mark.parametrize("name", ["Customer Churn", "Attrition_Flag", "Churn Value", "Did_Churn", "Exited"])
def test_target_names(spark, name):
    assert P.profile(telco(spark, 30).withColumnRenamed("Churn", name)).target == name


def test_target_by_part_skips_post_event_names():
    assert P.target_by_name(["churn_month", "user_cancelled_flag"]) == "user_cancelled_flag"
    assert P.target_by_name(["a", "b"]) is None


def test_target_by_values(spark):
    df = telco(spark, 50).drop("Churn").withColumn(
        "AccountOutcome", F.when(F.col("tenure") > 30, " stayed").otherwise("Churned")
    ).withColumn("Partner", F.when(F.col("tenure") > 30, "Yes").otherwise("No"))
    assert P.profile(df).target == "AccountOutcome"
    assert P.profile(df, scoring_only=True).target == ""


def test_id_by_uniqueness(spark):
    df = telco(spark, 40).withColumnRenamed("customerID", "contract_num")
    assert P.profile(df).id_column == "contract_num"
    few = telco(spark, 9).withColumnRenamed("customerID", "contract_num")
    assert P.profile(few).id_column is None


def test_constant_date_flag_and_numeric_text(spark):
    df = spark.createDataFrame(
        [("x", "2024-01-01", "True", " $5 ", float("nan"), 9.0, True), ("x", "2024-01-02", "false", "6", 1.0, 8.0, False),
         ("x", "2024-01-03", None, "7", 1.0, 7.0, True), ("x", "2024-01-04", "TRUE", "oops", 1.0, 6.0, False),
         (None, "2024-01-05", "true", "1,000", 1.0, 5.0, True)],
        "only string, created_at string, flag string, amount string, same double, lifetime_value double, vip boolean",
    )
    prof = P.profile(df, scoring_only=True)
    assert prof.constant_columns == ["only", "same"]
    assert prof.date_columns == ["created_at"]
    assert prof.numeric == ["flag", "amount", "lifetime_value", "vip"] and prof.flag_columns == ["flag", "vip"]
    row = clean(df, prof).orderBy("created_at").select("flag", "amount", "vip").collect()
    assert [tuple(r) for r in row] == [(1.0, 5.0, 1.0), (0.0, 6.0, 0.0), (None, 7.0, 1.0), (1.0, None, 0.0), (1.0, 1000.0, 1.0)]


def test_target_kind(spark):
    df = telco(spark, 30).withColumn("Churn", F.when(F.col("Churn") == "Yes", "2").otherwise("0"))
    prof = P.profile(df)
    assert prof.target_kind == "numeric"
    assert clean(df, prof).where("_y = 1").count() == df.where("Churn = '2'").count()


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1, "a", "Yes"), (2, "b", "No")], ["a.b", " my col ", "Churn"])
    prof = P.profile(df)
    assert prof.numeric == ["a.b"] and prof.categorical == ["my col"]
    assert clean(df, prof).columns == ["a.b", "my col", "Churn", "_y"]
    assert P.missing_counts(df.toDF("a.b", "my col", "Churn")).count() == 0


def test_align_adds_missing(spark):
    prof = P.TableProfile(numeric=["x", "gone"], categorical=["k", "lost"])
    df = spark.createDataFrame([(" 1 ", " none "), ("2", "")], "x string, k string")
    assert [tuple(r) for r in align(df, prof).collect()] == [(1.0, None, None, None), (2.0, None, None, None)]


def test_resolvers():
    assert spend_column(["a", "Total_Spend", "MonthlyCharges"]) == "Total_Spend"
    assert tenure_column(["x", "Tenure_years"]) == "Tenure_years"
    assert spend_column(["a"]) is None


def test_category_fields_cap_before_the_shuffle(spark):
    df = spark.range(500).select(F.format_string("v%04d", "id").alias("k"))
    out = P.category_fields(df, ["k"], limit=50)
    assert [r["value"] for r in out.orderBy("position").collect()] == [f"v{i:04d}" for i in range(50)]
    assert P.category_fields(df, ["k"]).count() == 500  # all of them unless a limit is asked for
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_empty_numeric_field(spark):
    df = spark.createDataFrame([(None,)], "x double")
    row = P.numeric_fields(df, ["x"]).first()
    assert (row["min"], row["max"], row["mean"], row["default"]) == (0.0, 100.0, 0.0, 0.0)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, None, 7.0), (4.0, 9.0, 7.0)], "a double, b double, k double")
    got = {(r["a"], r["b"]): r["r"] for r in P.correlations(df, ["a", "b", "k"]).collect()}
    assert got[("a", "k")] is None and got[("a", "a")] == pytest.approx(1.0)
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(0.998625428903524)  # three complete rows
