"""Activity log: an append-only table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, category string, level string, title string, detail string, account_id string"


def append(
    spark: SparkSession, path: str, title: str, detail: str, level: str = "info",
    category: str = "INTERVENTION", account_id: str = "USER",
) -> None:
    row = (datetime.now(timezone.utc), category, level, title, detail, account_id)
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def feed(log: DataFrame, categories: Sequence[str] = ("ALL",), n: int | None = None) -> DataFrame:
    """Newest first, equal times by the other columns; 'ALL' or an empty choice shows every category."""
    rows = log if "ALL" in categories or not categories else log.where(F.col("category").isin(list(categories)))
    ordered = rows.orderBy(F.desc("ts"), *[F.col(c) for c in ("category", "level", "title", "detail", "account_id")])
    return ordered if n is None else ordered.limit(n)


def summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("level") == level).alias(level) for level in ("critical", "warning", "success")],
    )
