"""Customer books built from the star tables (see FIXTURES.md part B)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL, outcome

ACCOUNT_COLUMNS = [
    "account_id", "tenure", "MonthlyCharges", "line_items", "total_units",
    "Contract", "PaymentMethod", "TechSupport", "Region", "Churn",
]
NUMERIC = ["tenure", "MonthlyCharges", "line_items", "total_units"]
CATEGORICAL = ["Contract", "PaymentMethod", "TechSupport", "Region"]


# Declared, so that building a plan does not start a job to read file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer with its region; how the small tables are joined is left to the optimizer's size check."""
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "r_name")
    return table(spark, sf_dir, "customer").join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )


def accounts(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ACCOUNT_COLUMNS) -> DataFrame:
    """Main book, one row per order. The line-item side is joined only when asked for."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"
    )
    last_day = orders.agg(F.max("o_orderdate")).scalar()
    age = F.datediff(last_day, "o_orderdate")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    limit = (
        F.when(urgent & (age < 730), "b333").when(urgent, "7333")
        .when(age < 730, "4ccd").otherwise("1999")
    )
    key = F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("-y")))
    support = (
        F.when(F.col("n_nationkey") % 3 == 0, "No")
        .when(F.col("n_nationkey") % 3 == 1, "Yes").otherwise("No add-on")
    )
    book = orders.join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("account_id"),
        F.floor(age / F.lit(30.0)).cast("int").alias("tenure"),
        F.col("o_totalprice").alias("MonthlyCharges"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("Contract"),
        F.col("c_mktsegment").alias("PaymentMethod"),
        support.alias("TechSupport"),
        F.col("r_name").alias("Region"),
        F.when(F.substring(key, 1, 4) < limit, "Yes").otherwise("No").alias("Churn"),
    )
    if {"line_items", "total_units"} & set(columns):
        items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("account_id")).agg(
            F.count(F.lit(1)).alias("line_items"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("total_units"),
        )
        book = book.join(items, "account_id", "left").withColumn(
            "line_items", F.coalesce("line_items", F.lit(0))
        )
    return book.select(*columns)


def labelled(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of the main book plus the 0/1 label."""
    wanted = [c for c in columns if c != "Churn"]
    label, _ = outcome(F.col("Churn"), "text")
    return accounts(spark, sf_dir, [*wanted, "Churn"]).select(*wanted, label.alias(LABEL))


def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with history; churned = no order in the last 365 days."""
    orders = table(spark, sf_dir, "orders")
    snap = orders.agg(F.expr("max(o_orderdate) - INTERVAL 365 DAY")).scalar()
    past = F.col("o_orderdate") <= F.col("snap")
    history = (
        orders.select("o_custkey", "o_orderdate", "o_totalprice", snap.alias("snap"))
        .groupBy("o_custkey", "snap")
        .agg(
            F.count_if(past).alias("n_orders"),
            F.min(F.when(past, F.col("o_orderdate"))).alias("first_order"),
            F.sum(F.when(past, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("total_spend"),
            F.count_if(~past).alias("recent"),
        )
        .where("n_orders > 0")
    )
    return history.join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("customer_id"), "n_orders", "total_spend", "c_acctbal",
        F.floor(F.datediff("snap", "first_order") / F.lit(30.0)).cast("int").alias("tenure"),
        F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"),
        F.when(F.col("recent") == 0, 1).otherwise(0).alias("churned"),
    )


def accounts_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main book with planted dirt, for cleaning, profiling and validation."""
    book = accounts(spark, sf_dir, ["account_id", "MonthlyCharges", "Contract", "Churn"])
    key = F.col("account_id")
    return book.select(
        F.when((key > 0) & (key % 97 == 0), key - 1).otherwise(key).alias("account_id"),
        F.when(key % 11 == 0, F.lit(None))
        .when(key % 13 == 0, " ")
        .when(key % 17 == 0, "n/k")
        .otherwise(F.concat(F.lit(" $"), F.col("MonthlyCharges").cast("decimal(18,2)").cast("string"), F.lit(" ")))
        .alias("MonthlyCharges"),
        F.when(key % 7 == 0, F.concat(F.lit(" "), F.col("Contract"), F.lit(" ")))
        .when(key % 19 == 0, "none").otherwise(F.col("Contract")).alias("Contract"),
        F.when(key % 23 == 0, "unknown").when(key % 5 == 0, F.upper("Churn"))
        .otherwise(F.concat(F.col("Churn"), F.lit(" "))).alias("Churn"),
        F.lit("X").alias("const_col"),
        F.lit("2001-01-01").alias("churn_date"),
    )


def documents_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a second natural label: low quality counts as the positive class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias(LABEL))
    return docs.join(labels, "doc_id")


def with_pseudo_score(df: DataFrame) -> DataFrame:
    """Deterministic score in [0, 1] with many ties, for rules and evaluation without a model."""
    return df.withColumn("score", F.lit(1.0) - F.least(F.col("tenure"), F.lit(80)) / F.lit(80.0))
