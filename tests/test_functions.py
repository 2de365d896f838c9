import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark.functions import rules
from churnspark.functions.label import outcome
from churnspark.functions.text import clean_category, clean_number, money_or_zero, norm_name


def column(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_norm_name():
    assert norm_name(" Customer-ID 7") == "customerid7"


def test_clean_number(spark):
    raw = [" $1,234.50 ", "12", "-3.5e2", ".5", "5.", "", " ", "n/k", "1d", "NaN", "inf", "0x1p3", "1 2", "\t7\n", None, " 8 ", "+4"]
    want = [1234.5, 12.0, -350.0, 0.5, 5.0, None, None, None, None, None, None, None, None, 7.0, None, 8.0, 4.0]
    assert column(spark, raw, clean_number) == want


def test_clean_number_typed(spark):
    assert column(spark, [1.5, float("nan"), None], lambda c: clean_number(c, T.DoubleType()), "double") == [1.5, None, None]
    assert column(spark, [True, False, None], lambda c: clean_number(c, T.BooleanType()), "boolean") == [1.0, 0.0, None]


def test_clean_category(spark):
    raw = [" a ", "none", "None", "null", "nan", "NULL", "", None]
    assert column(spark, raw, clean_category) == ["a", None, "None", None, None, "NULL", "", None]
    assert column(spark, [" ", "x"], lambda c: clean_category(c, blank_is_missing=True)) == [None, "x"]


def test_money(spark):
    raw = ["₹1,200.50", "Rs. 75", "Rs 80", "INR 9", "$5", "free", None, ""]
    assert column(spark, raw, money_or_zero) == [1200.5, 75.0, 80.0, 9.0, 5.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("values,kind,dtype,labels,unread", [
    (["Yes", "no", "YES", "No", "Churn", "Stay"], "text", "string", [1, 0, 1, 0, 1, 0], 0),
    ([1, 0, 1, 0, 0], "numeric", "int", [1, 0, 1, 0, 0], 0),
    ([3.0, 0.0, -1.0, float("nan"), None], "numeric", "double", [1, 0, 0, 0, 0], 2),
    ([True, None, False], "boolean", "boolean", [1, 0, 0], 1),
    (["did churn ", "Attrited Customer", "maybe", None, "1.0", "T"], "text", "string", [1, 1, 0, 0, 1, 1], 2),
])
def test_outcome(spark, values, kind, dtype, labels, unread):
    assert column(spark, values, lambda c: outcome(c, kind)[0], dtype) == labels
    assert sum(column(spark, values, lambda c: outcome(c, kind)[1], dtype)) == unread


def test_bands_and_outreach(spark):
    scores = [0.75, 0.6, 0.5999, 0.45, 0.35, 0.2]
    assert column(spark, scores, rules.risk_band, "double") == ["High", "High", "Medium", "Medium", "Medium", "Low"]
    assert column(spark, scores, lambda s: rules.outreach(rules.risk_band(s), s), "double") == [
        rules.IMMEDIATE, rules.SOON, rules.REVIEW, rules.REVIEW, rules.REVIEW, rules.ROUTINE]
    assert column(spark, [0.5, 0.4999], rules.predicted_status, "double") == [rules.LIKELY_CHURN, rules.LIKELY_STAY]


def test_thresholds():
    assert rules.check_thresholds(0.705, 0.301) == (0.7 if round(0.705, 2) == 0.7 else 0.71, 0.3)
    for high, med in ((0.3, 0.6), (0.5, 0.5), (1.2, 0.3), (0.5, 0.0)):
        with pytest.raises(ValueError):
            rules.check_thresholds(high, med)


@pytest.mark.parametrize("text,driver,action", [
    ("contract:month-to-month", "", rules.ACTION_CONTRACT),
    ("contract:two year", "Contract: Two year", rules.ACTION_CONTRACT),
    ("paymentmethod:electronic check", "", rules.ACTION_PAYMENT),
    ("x:1", "Bank transfer", rules.ACTION_PAYMENT),
    ("mode:upi", "", rules.ACTION_PAYMENT),
    ("x:1", "tenure: 3", rules.ACTION_TENURE),
    ("internetservice:fiber optic", "MonthlyCharges: 90", rules.ACTION_FIBER),
    ("internetservice:fiber optic", "", rules.ACTION_DEFAULT),
    ("techsupport:no", "", rules.ACTION_SUPPORT),
    ("techsupport: no", "", rules.ACTION_SUPPORT),
    ("onlinesecurity:no", "", rules.ACTION_SECURITY),
    ("note:no online security", "", rules.ACTION_SECURITY),
    ("a:b", "", rules.ACTION_DEFAULT),
])
def test_actions(spark, text, driver, action):
    df = spark.createDataFrame([(text, driver)], "t string, d string")
    assert df.select(rules.next_best_action(F.col("t"), F.col("d"))).first()[0] == action


def test_rules_accept_a_stream(spark, tmp_path):
    """The decision rules are stateless projections, so a streaming book can be scored as well."""
    from churnspark.operators.score import decide

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("A", 50.0, 0.9), ("B", 20.0, 0.1)], "id string, MonthlyCharges double, p double")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    decided = decide(stream, F.col("p"), ["id", "MonthlyCharges"], "MonthlyCharges")
    query = (
        decided.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination(60)
    got = {r["id"]: (r["risk_band"], r["annual_revenue_at_risk"]) for r in spark.read.parquet(out).collect()}
    assert got == {"A": ("High", 600.0), "B": ("Low", 0.0)}
