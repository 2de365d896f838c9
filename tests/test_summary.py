import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnspark.operators.summary import numeric_summary, rounds_for, text_summary

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def check(spark, values, accuracy=10_000, rounds=1):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    row = numeric_summary(df, ["x"], PROBS, accuracy=accuracy, rounds=rounds).first()
    assert row["count"] == len(values)
    np.testing.assert_allclose(row["quantiles"], np.quantile(np.array(values, float), PROBS), rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(row["mean"], np.mean(values), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(row["std_pop"], np.std(values), rtol=1e-9, atol=1e-7)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-20, 20), min_size=1, max_size=40))
def test_small_with_ties(spark, values):
    check(spark, values)


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_brackets_are_exact(spark, accuracy):
    """A coarse sketch leaves wide brackets; the result stays exact."""
    rng = np.random.default_rng(3)
    check(spark, np.round(rng.normal(size=20_000), 3), accuracy)
    check(spark, np.concatenate([np.zeros(7_000), rng.normal(size=13_000)]), accuracy)  # one value holds a third


@pytest.mark.parametrize("rounds", [2, 3])
def test_further_rounds_are_exact(spark, rounds):
    rng = np.random.default_rng(4)
    check(spark, np.round(rng.normal(size=30_000), 4), 1_000, rounds)
    check(spark, np.concatenate([np.full(10_000, 0.25), rng.random(20_000)]), 1_000, rounds)
    check(spark, [1.0, 2.0, 4.0], rounds=rounds)


def test_rounds_grow_with_the_table():
    # 4/10,000 of the rows are left after the first round, 1/150 of that after each further one:
    # 4e11 -> 2.7e9 -> 1.8e7 -> 1.2e5 values for 1e15 rows
    assert [rounds_for(n) for n in (10**4, 10**9, 10**11, 10**13, 10**15)] == [1, 1, 2, 3, 4]


def test_by_label_and_nulls(spark):
    df = spark.createDataFrame([(0, 1.0), (0, None), (0, 3.0), (1, float("nan")), (1, 5.0)], "_y int, x double")
    rows = {r["_y"]: r for r in numeric_summary(df, ["x"], [0.5], label="_y").collect()}
    assert (rows[0]["count"], rows[0]["quantiles"]) == (2, [2.0])
    assert (rows[1]["count"], rows[1]["quantiles"]) == (1, [5.0])


def test_median_is_the_mean_of_the_middle(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 10.0)], "x double")
    assert numeric_summary(df, ["x"], [0.5]).first()["quantiles"] == [3.0]


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "k string")
    row = text_summary(df, ["k"]).first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (4, 2, "a", 2)


def test_sketch_work_is_bounded(spark, monkeypatch):
    """No per-group list of values: neither percentile() nor collect of the column in any plan that runs."""
    from churnspark.operators import summary

    plans, write = [], summary.stage

    def noted(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, name)

    monkeypatch.setattr(summary, "stage", noted)
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    plans.append(numeric_summary(df, ["x"], [0.5])._jdf.queryExecution().toString())
    assert not any("percentile(" in p or "collect_set(" in p for p in plans)
    assert any("percentile_approx" in p for p in plans)


def test_two_scans_for_any_number_of_columns(spark, monkeypatch):
    """One sketch aggregate and one counting pass read the columns as they stand: no unpivot, no join of the rows."""
    from churnspark.operators import summary

    plans, write = [], summary.stage

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(summary, "stage", noted)
    names = [f"n.{k}" for k in range(40)]
    df = spark.range(2_000).select(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(997)).cast("double").alias(n) for k, n in enumerate(names)])
    rows = {r["column"]: r for r in numeric_summary(df, names, PROBS).collect()}
    right = df.toPandas().quantile(PROBS)
    for n in names:
        np.testing.assert_allclose(rows[n]["quantiles"], right[n].to_numpy(), rtol=1e-12)
        assert rows[n]["rows"] == rows[n]["count"] == 2_000
    over_data = [p for p in plans if "Range (" in p]
    assert len(over_data) == len(plans) == 2 and not any("Expand" in p for p in plans)


def test_text_labels_and_empty_columns(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None), ("b", 2.0, None), ("b", 4.0, None), (None, 9.0, None)], "group string, x double, gone double"
    )
    rows = {(r["group"], r["column"]): r["quantiles"] for r in numeric_summary(df, ["x", "gone"], [0.5], label="group").collect()}
    assert rows == {("a", "x"): [1.0], ("b", "x"): [3.0]}
    assert numeric_summary(df.where("false"), ["x"], [0.5]).count() == 0
