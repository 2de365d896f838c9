"""Portfolio diagnostics: KPIs, segment lift, tenure buckets, class profiles.

All ratios are unrounded; rounding and number formats belong to `report`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.functions.rules import BANDS
from churnspark.functions.text import named

# Tenure buckets (label, inclusive upper bound); the first starts above -0.1.
TENURE_BUCKETS = [
    ("0–6m", 6), ("7–12m", 12), ("13–24m", 24),
    ("25–36m", 36), ("37–48m", 48), ("49m+", 10_000),
]
TENURE_FLOOR = -0.1

MONEY = "decimal(20,4)"


def spend_column(numeric: Sequence[str]) -> str | None:
    """First numeric column whose name speaks of months, charges or spend."""
    return next((c for c in numeric if any(k in c.lower() for k in ("month", "charge", "spend"))), None)


def tenure_column(numeric: Sequence[str]) -> str | None:
    return next((c for c in numeric if "tenure" in c.lower()), None)


def money(col: Column) -> Column:
    """Exact decimal, so a sum does not depend on the order of the rows."""
    return col.cast(MONEY)


def kpis(df: DataFrame, spend: str | None, tenure: str | None, label: str = LABEL) -> DataFrame:
    """One row of portfolio figures, one pass."""
    y = named(label)
    none = F.lit(None).cast("double")
    at_risk = F.coalesce(F.sum(F.when(y == 1, money(named(spend)))), F.lit(0).cast(MONEY)) if spend else F.lit(0).cast(MONEY)
    return df.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(y == 1).alias("churners"),
        F.count_if(y == 0).alias("retained"),
        F.avg(y).alias("churn_rate"),
        at_risk.cast("double").alias("monthly_revenue_at_risk"),
        (at_risk * 12).cast("double").alias("annual_revenue_at_risk"),
        (F.avg(named(tenure)) if tenure else none).alias("avg_tenure"),
        (F.avg(named(spend)) if spend else none).alias("avg_monthly"),
        F.lit(spend).cast("string").alias("monthly_column"),
        F.lit(tenure).cast("string").alias("tenure_column"),
    )


def churn_mix(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Retained and churned counts, both rows always present."""
    y = named(label)
    both = df.agg(F.count_if(y == 0).alias("stay"), F.count_if(y == 1).alias("leave"))
    return both.select(F.explode(F.array(
        F.struct(F.lit("Active (Retained)").alias("label"), F.col("stay").alias("value")),
        F.struct(F.lit("Churned").alias("label"), F.col("leave").alias("value")),
    )).alias("r")).select("r.*")


def cohorts(df: DataFrame, groupings: Mapping[str, Column], label: str = LABEL, spend: str | None = None) -> DataFrame:
    """(column, segment, customers, churners, [revenue,] churn_rate, lift) for every grouping at once.

    The groupings are turned into rows, so one shuffle of partial counts serves them all.
    Portfolio totals are the sums over one grouping's own groups, null group included;
    that second aggregate reuses the same shuffle instead of scanning again.
    """
    names = list(groupings)
    values = F.array(*[
        F.struct(F.lit(i).alias("grouping"), groupings[name].cast("string").alias("segment")) for i, name in enumerate(names)
    ])
    # explode instead of unpivot: the two uses of `groups` below must stay identical plans
    long = df.select(
        named(label).alias("y"), *([money(named(spend)).alias("spend")] if spend else []), F.inline(values)
    )
    churned = F.col("y") == 1
    measures = {"customers": F.count(F.lit(1)), "churners": F.count_if(churned)}
    if spend:
        measures["revenue"] = F.coalesce(F.sum(F.when(churned, F.col("spend"))), F.lit(0).cast(MONEY))
    groups = long.groupBy("grouping", "segment").agg(*[m.alias(name) for name, m in measures.items()])
    totals = groups.groupBy("grouping").agg(*[F.sum(name).alias(f"all_{name}") for name in measures])
    rate = F.col("churners") / F.col("customers")
    column = F.get(F.array(*[F.lit(n) for n in names]), F.col("grouping"))
    # Drops the null group. Naming every total here (the added tests never hold) keeps the
    # filter above the join, so both uses of `groups` stay identical and share one shuffle.
    shown = F.col("segment").isNotNull() | (F.col("all_customers") < 0) | (F.col("all_churners") < 0)
    if spend:
        shown = shown | F.isnan(F.col("all_revenue").cast("double"))
    return (
        groups.join(F.broadcast(totals), "grouping")  # one total per requested grouping
        .where(shown)
        .select(
            column.alias("column"), "segment", *measures, rate.alias("churn_rate"),
            (rate - F.col("all_churners") / F.col("all_customers")).alias("lift"),
        )
    )


def segment_lift(
    df: DataFrame, columns: Sequence[str], label: str = LABEL,
    min_customers: int = 15, min_lift: float = 0.05, max_columns: int | None = None,
) -> DataFrame:
    """Churn rate and lift over the portfolio for every value of the categorical columns (the first max_columns, if given)."""
    table = cohorts(df, {c: named(c) for c in list(columns)[:max_columns]}, label)
    high = (F.col("lift") > F.lit(min_lift)) & (F.col("customers") >= min_customers)
    return table.withColumn("is_high_risk", high)


def high_risk_segments(segments: DataFrame) -> DataFrame:
    return segments.where("is_high_risk")


def order_segments(segments: DataFrame, columns: Sequence[str], mode: str = "lift", max_columns: int | None = None) -> DataFrame:
    """Segments column by column, each column's rows ordered by lift, rate or population."""
    key = {"lift": "lift", "rate": "churn_rate", "population": "customers"}[mode]
    shown = list(columns)[:max_columns]
    place = F.array_position(F.array(*[F.lit(c) for c in shown]), F.col("column"))
    return segments.where(F.col("column").isin(shown)).orderBy(place, F.desc(key), F.asc("segment"))


def churn_rate_by(df: DataFrame, column: str, label: str = LABEL) -> DataFrame:
    """Mean label per value of one column, highest first."""
    return (
        df.where(named(column).isNotNull()).groupBy(named(column).cast("string").alias("segment"))
        .agg(F.avg(named(label)).alias("churn_rate"), F.count(F.lit(1)).alias("customers"))
        .orderBy(F.desc("churn_rate"), F.asc("segment"))
    )


def worst_cohort(groups: DataFrame) -> DataFrame:
    """Per column the segment with the highest churn rate (then more customers, then smaller value)."""
    figures = [c for c in groups.columns if c not in ("column", "segment")]
    best = F.min(F.struct(
        (-F.col("churn_rate")).alias("by_rate"), (-F.col("customers")).alias("by_size"), "segment", *figures
    ))
    return groups.groupBy("column").agg(best.alias("b")).select("column", "b.segment", *[f"b.{c}" for c in figures])


def _dimension(df: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """A constant one-column table, for groups that must appear even when empty."""
    return df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(labels)], f"pos int, {name} string")


def tenure_buckets(df: DataFrame, tenure: str, label: str = LABEL) -> DataFrame:
    """Customers and churn rate per tenure bucket; empty buckets stay with a null rate."""
    months = F.coalesce(F.nanvl(named(tenure).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.select(months.alias("months"), named(label).alias("y"))
    pos = F.when(F.col("months") <= TENURE_FLOOR, F.lit(None).cast("int"))
    for i, (_, upper) in enumerate(TENURE_BUCKETS):
        pos = pos.when(F.col("months") <= upper, i)
    counted = rows.groupBy(pos.alias("pos")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("y").alias("churn_rate")
    )
    dimension = _dimension(df, "bucket", [b for b, _ in TENURE_BUCKETS])
    return (
        dimension.join(counted, "pos", "left").orderBy("pos")
        .select("bucket", F.coalesce("customers", F.lit(0)).alias("customers"), "churn_rate")
    )


def class_profile(df: DataFrame, columns: Sequence[str], label: str = LABEL, max_columns: int | None = None) -> DataFrame:
    """Mean of each numeric column among retained and among churned rows, one pass."""
    shown = list(columns)[:max_columns]
    y = named(label)
    means = df.agg(*[
        F.avg(F.when((y == k) & ~F.isnan(named(c).cast("double")), named(c))).cast("double").alias(f"m{i}_{k}")
        for i, c in enumerate(shown) for k in (0, 1)
    ])
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}_0").alias("retained_mean"), F.col(f"m{i}_1").alias("churned_mean"))
        for i, c in enumerate(shown)
    ]
    return means.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def risk_band_distribution(scored: DataFrame, band: str = "risk_band") -> DataFrame:
    """Count and share per band; a band without accounts stays with zero."""
    counts = scored.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(named(band) == b).alias(b) for b in BANDS])
    rows = F.array(*[F.struct(F.lit(b).alias("risk_band"), F.col(b).alias("accounts")) for b in BANDS])
    return counts.select("total", F.explode(rows).alias("r")).select(
        "r.risk_band", "r.accounts", (F.col("r.accounts") / F.nullif("total", F.lit(0))).alias("share")
    )


def book_page(scored: DataFrame, id_column: str, band: str | None = None, n: int = 100) -> DataFrame:
    """First n accounts of one band (None: all bands), most at risk first."""
    rows = scored if band is None else scored.where(F.col("risk_band") == band)
    return rows.orderBy(F.desc("churn_probability"), named(id_column)).limit(n)
