"""Report tables: the presentable form of the operators' figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.functions.text import named
from churnspark.operators.diagnose import (
    kpis, order_segments, segment_lift, spend_column, tenure_column,
)
from churnspark.operators.playbook import pillars
from churnspark.operators.profile import TableProfile
from churnspark.sources.files import write_csv, write_parquet

TOP_ACCOUNTS = 250
# Severity limits on the lift, columns of the account list.
SEVERITY = [("high", 0.10), ("medium", 0.02)]
ACCOUNT_COLUMNS = [
    "churn_probability", "risk_band", "predicted_status", "retention_priority",
    "monthly_revenue_at_risk", "annual_revenue_at_risk", "recommended_action",
]


def _percent(col: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f%%", col * 100)


def executive_summary(figures: DataFrame) -> DataFrame:
    """(position, indicator, value, definition) from one row of KPIs."""
    c = F.col

    def when_positive(col: Column, text: Column) -> Column:
        return F.when(col > 0, text).otherwise("N/A")

    def rupees(col: Column) -> Column:
        return when_positive(col, F.concat(F.lit("₹"), F.format_number(col, 2)))

    # The eight indicators with their definitions.
    rows = [
        ("Total Active Portfolio Accounts", F.format_number("customers", 0), "Total customer base in active extract"),
        ("Identified Churned Customers", F.format_number("churners", 0), "Historical churn count in baseline"),
        ("Retained Active Customers", F.format_number("retained", 0), "Loyal customer cohort"),
        ("Portfolio Churn Rate", _percent(c("churn_rate"), 2), "Baseline attrition rate"),
        ("Monthly Revenue at Risk", rupees(c("monthly_revenue_at_risk")), "Direct recurring monthly spend at risk (INR)"),
        ("Annualized Revenue at Risk", rupees(c("annual_revenue_at_risk")), "Projected 12-month revenue exposure (INR)"),
        ("Average Account Tenure", when_positive(c("avg_tenure"), F.format_string("%.1f months", "avg_tenure")), "Mean customer lifetime duration"),
        ("Average Monthly Spend", when_positive(c("avg_monthly"), F.format_string("₹%.2f", "avg_monthly")), "Mean customer monthly recurring spend (INR)"),
    ]
    structs = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("indicator"), value.alias("value"), F.lit(text).alias("definition"))
        for i, (name, value, text) in enumerate(rows)
    ]
    return figures.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def rounded_kpis(figures: DataFrame) -> DataFrame:
    """KPIs with the usual places: rate 4, money 2, tenure 1."""
    places = {
        "churn_rate": 4, "monthly_revenue_at_risk": 2, "annual_revenue_at_risk": 2, "avg_tenure": 1, "avg_monthly": 2,
    }
    return figures.withColumns({name: F.round(name, n) for name, n in places.items()})


def dataset_profile(spark: SparkSession, prof: TableProfile) -> DataFrame:
    features = f"{len(prof.all_features)} features ({len(prof.numeric)} numeric, {len(prof.categorical)} categorical)"
    leaks = f"{len(prof.leakage_columns)} columns" if prof.leakage_columns else "None detected (Clean)"
    # Labels and defaults of the profile table.
    return spark.createDataFrame(
        [
            ("Source File", prof.filename or "Active Extract"),
            ("Total Records", f"{prof.rows:,} rows"),
            ("Predictor Features", features),
            ("Target Column", prof.target),
            ("Identifier Column", prof.id_column or "Row Index"),
            ("Data Leakage Columns Excluded", leaks),
        ],
        "item string, value string",
    )


def governance(metrics: DataFrame, champion: str) -> DataFrame:
    """Formatted model comparison with the champion flagged."""
    four = [F.format_string("%.4f", m).alias(m) for m in ("roc_auc", "pr_auc")]
    rest = [F.format_string("%.4f", m).alias(m) for m in ("precision", "recall", "f1")]
    return metrics.orderBy("position").select(
        F.initcap(F.replace("candidate", F.lit("_"), F.lit(" "))).alias("algorithm"),
        F.col("training_status").alias("status"), *four, _percent(F.col("accuracy"), 2).alias("accuracy"), *rest,
        F.format_string("%.4f ± %.4f", "cv_pr_auc_mean", "cv_pr_auc_std").alias("cv_pr_auc"),
        F.when(F.col("candidate") == champion, "Champion").otherwise("Candidate").alias("role"),
    )


def segment_matrix(segments: DataFrame) -> DataFrame:
    """Segment lift with a severity mark."""
    level = F.lit(None).cast("string")
    for name, limit in reversed(SEVERITY):
        level = F.when(F.col("lift") > F.lit(limit), name).otherwise(level)
    return segments.withColumn("severity", level)


def segment_matrix_text(segments: DataFrame) -> DataFrame:
    return segment_matrix(segments).withColumns({
        "churn_rate": _percent(F.col("churn_rate"), 2), "lift": F.format_string("%+.2f%%", F.col("lift") * 100)
    })


def playbook_table(pillar_rows: DataFrame) -> DataFrame:
    return pillar_rows.select(
        "priority", "pillar_name", "target_segment", "observed_metric", "annual_revenue_at_risk",
        F.concat_ws(" | ", "recommended_actions").alias("recommended_actions"),
    )


def top_accounts(scored: DataFrame, id_column: str | None, features: Sequence[str], n: int = TOP_ACCOUNTS) -> DataFrame:
    """The n accounts most at risk: a bounded top-k per task, merged once; no global sort."""
    wanted = [id_column or "customerID", *ACCOUNT_COLUMNS]
    shown = [c for c in scored.columns if c in wanted]
    shown += [c for c in list(features)[:6] if c in scored.columns and c not in shown]
    ties = [named(id_column)] if id_column in scored.columns else [named(c).cast("string") for c in shown]
    order = [F.desc("churn_probability"), *ties]
    return scored.orderBy(*order).limit(n).select(*[named(c) for c in shown])


def tables(
    cleaned: DataFrame, prof: TableProfile, metrics: DataFrame | None = None, champion: str = "",
    scored: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every report table that can be made from what is there."""
    spark = cleaned.sparkSession
    figures = kpis(cleaned, spend_column(prof.numeric), tenure_column(prof.numeric))
    out = {
        "executive_summary": executive_summary(figures),
        "dataset_profile": dataset_profile(spark, prof),
        "segment_risk_matrix": segment_matrix_text(
            order_segments(segment_lift(cleaned, prof.categorical, LABEL), prof.categorical, "rate")
        ),
        "retention_playbook": playbook_table(pillars(cleaned, prof)),
    }
    if metrics is not None:
        out["model_governance"] = governance(metrics, champion)
    if scored is not None:
        out["scored_accounts"] = top_accounts(scored, prof.id_column, prof.all_features)
    return out


def export(report: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder per table; as many files as the table's size asks for."""
    for name, df in report.items():
        (write_csv if fmt == "csv" else write_parquet)(df, f"{folder}/{name}")
