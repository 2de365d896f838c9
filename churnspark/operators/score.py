"""Scoring: probabilities, bands, priorities, revenue at risk, actions. Map-only plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark.functions import rules
from churnspark.functions.label import LABEL
from churnspark.functions.text import money_or_zero, named
from churnspark.operators import explain, features
from churnspark.operators.diagnose import spend_column
from churnspark.operators.profile import TableProfile
from churnspark.operators.train import probability
from churnspark.sources.files import read_table, require_rows, strip_names

SCORE_COLUMNS = [
    "churn_score", "churn_probability", "churn_risk_pct", "risk_band", "predicted_status",
    "retention_priority", "monthly_revenue_at_risk", "annual_revenue_at_risk", "recommended_action",
]


def record(df: DataFrame, columns: Sequence[str]) -> Column:
    """The searchable text of a row; only text columns need their values rendered."""
    letters = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return rules.record_text([(c, named(c) if c in letters else None) for c in columns])


def decide(
    df: DataFrame, score: Column, inputs: Sequence[str], spend: str | None,
    high: float = rules.HIGH, med: float = rules.MEDIUM, driver: Column | None = None,
) -> DataFrame:
    """Append the decision columns to a frame that has a score. Bands use the unrounded score."""
    base = df.withColumn("churn_score", score).withColumn("x_record", record(df, inputs))
    s = F.col("churn_score")
    banded = base.withColumns({
        "churn_probability": F.round(s, 4),
        "churn_risk_pct": F.round(s * 100, 1),
    })
    banded = _banded(banded, spend, high, med)
    return banded.withColumn("recommended_action", rules.next_best_action(F.col("x_record"), driver)).drop("x_record")


def _banded(df: DataFrame, spend: str | None, high: float, med: float) -> DataFrame:
    monthly = money_or_zero(named(spend), df.schema[spend].dataType) if spend else F.lit(0.0)
    s, band = F.col("churn_score"), F.col("risk_band")
    return (
        df.withColumn("risk_band", rules.risk_band(s, high, med))
        .withColumns({
            "predicted_status": rules.predicted_status(s),
            "retention_priority": rules.outreach(band, s),
            "monthly_revenue_at_risk": rules.revenue_at_risk(band, monthly),
        })
        .withColumn("annual_revenue_at_risk", F.round(F.col("monthly_revenue_at_risk") * 12.0, 2))
    )


def reband(scored: DataFrame, spend: str | None, high: float, med: float) -> DataFrame:
    """New thresholds on an already scored book: a projection of the stored score, no model run."""
    high, med = rules.check_thresholds(high, med)
    order = scored.columns
    return _banded(scored, spend, high, med).select(*[named(c) for c in order])


def check_coverage(columns: Sequence[str], prof: TableProfile) -> None:
    """Reject a batch that lacks more than half of the model's features."""
    missing = [c for c in prof.all_features if c not in columns]
    if len(missing) > len(prof.all_features) * 0.5:
        raise ValueError("Batch file is missing feature columns the model needs: " + ", ".join(missing[:6]))


def score(
    df: DataFrame, model: PipelineModel, prof: TableProfile, high: float = rules.HIGH, med: float = rules.MEDIUM,
) -> DataFrame:
    """Score every row; no label needed. Input columns plus SCORE_COLUMNS."""
    base = df.drop(LABEL)
    predicted = probability(model.transform(features.with_inputs(base, prof)))
    decided = decide(
        predicted.select(*[named(c) for c in base.columns], "x_score"), F.col("x_score"), base.columns,
        spend_column(prof.numeric) if spend_column(prof.numeric) in base.columns else None, high, med,
    )
    return decided.drop("x_score")


def score_explained(
    df: DataFrame, model: PipelineModel, prof: TableProfile, high: float = rules.HIGH, med: float = rules.MEDIUM,
) -> DataFrame:
    """Score with per-row attributions; the action takes the top driver into account."""
    base = df.drop(LABEL)
    predicted = probability(model.transform(features.with_inputs(base, prof)))
    explained = explain.local(predicted, model, prof, F.col("x_score"))
    extra = ["x_score", "top_risk_elevators", "top_retention_anchors", "risk_summary", "top_driver"]
    decided = decide(
        explained.select(*[named(c) for c in base.columns], *extra), F.col("x_score"), base.columns,
        spend_column(prof.numeric) if spend_column(prof.numeric) in base.columns else None, high, med, F.col("top_driver"),
    )
    return decided.drop("x_score").withColumn(
        "thresholds_used", F.struct(F.lit(high).alias("high"), F.lit(med).alias("medium"))
    )


def score_batch(
    spark: SparkSession, path: str, model: PipelineModel, prof: TableProfile,
    high: float = rules.HIGH, med: float = rules.MEDIUM,
) -> DataFrame:
    """Read a batch file, check that it can be scored, score it."""
    batch = require_rows(strip_names(read_table(spark, path)), "batch file")
    check_coverage(batch.columns, prof)
    return score(batch, model, prof, high, med)


def with_verdict(scored: DataFrame) -> DataFrame:
    """The older output pair next to the scored columns."""
    will, text = rules.churn_verdict(F.col("churn_score"))
    return scored.withColumns({"will_churn": will, "prediction": text})
