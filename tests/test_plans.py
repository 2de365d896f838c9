"""Plan shapes that have to hold at any data size."""

import re

import pytest
from pyspark.sql import functions as F

from churnspark.operators import diagnose, evaluate
from churnspark.operators.profile import numeric_fields
from churnspark.plans import learning
from churnspark.plans.registry import ALL
from churnspark.sources import books

RELATIONAL = sorted(n for n, (_, sql) in ALL.items() if sql and n not in ("csv_roundtrip", "parquet_roundtrip"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cross_join_and_no_python(spark, sf, name):
    plan = plan_of(ALL[name][0](spark, sf))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan, name


def test_segments_scan_once(spark, sf):
    """All segment columns and the portfolio rate come from one scan and one shuffle."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(
        (F.col("o_custkey") % 2).cast("int").alias("_y"), "o_orderpriority", "o_orderstatus"
    )
    rows = rows.withColumn("spend", F.lit(1.5))
    groupings = {c: F.col(c) for c in ("o_orderpriority", "o_orderstatus")}
    for df in (
        diagnose.segment_lift(rows, list(groupings)),
        diagnose.worst_cohort(diagnose.cohorts(rows, groupings, spend="spend")),
    ):
        final = final_plan(df).split("== Initial Plan ==")[0]
        assert len(re.findall("FileScan parquet", final)) == 1 and "ReusedExchange" in final


def test_columns_are_pruned(spark, sf):
    plan = plan_of(diagnose.churn_mix(books.labelled(spark, sf, [])))
    assert "lineitem" not in plan and "o_totalprice" not in plan and "c_acctbal" not in plan
    plan = plan_of(numeric_fields(books.accounts(spark, sf, ["tenure"]), ["tenure"]))
    assert "lineitem" not in plan and "ReadSchema: struct<o_orderkey" not in plan


def test_filters_are_pushed(spark, sf):
    plan = plan_of(ALL["activity_filter"][0](spark, sf))
    scan = spark.read.schema(books.SCHEMAS["orders"]).parquet(f"{sf}/orders.parquet").where("o_totalprice > 5")
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,5.0)]" in plan_of(scan)
    assert "Filter" in plan


def test_top_k_is_not_a_global_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan_of(ALL["top_at_risk"][0](spark, sf))
    assert "TakeOrderedAndProject" in plan_of(ALL["book_filter"][0](spark, sf))


def test_split_does_not_move_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 2).cast("int").alias("_y"))
    plan = plan_of(learning.split.mark_holdout(rows, "o_orderkey"))
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_evaluation_scans_once(spark, sf, monkeypatch):
    """Confusion counts and ranking metrics of all candidates share one scan of the scored rows."""
    written, write = [], evaluate.stage

    def noted(df, name):
        written.append(df)
        return write(df, name)

    monkeypatch.setattr(evaluate, "stage", noted)
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(
        (F.col("o_custkey") % 2).cast("int").alias("_y"), (F.col("o_totalprice") / 500000.0).alias("score"),
        (F.col("o_totalprice") > 250000).cast("int").alias("pred"), F.col("o_orderstatus").alias("candidate"),
    )
    frames = [evaluate.evaluate(rows, "score", "pred", by=["candidate"]), *written]
    plans = [final_plan(df).split("== Initial Plan ==")[0] for df in frames]
    assert sum(len(re.findall(r"FileScan parquet.*orders\.parquet", p)) for p in plans) == 1
