"""Retention playbook: one pillar per risk cohort found in the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.functions.text import named
from churnspark.operators.diagnose import MONEY, cohorts, spend_column, tenure_column, worst_cohort
from churnspark.operators.profile import TableProfile

EARLY_MONTHS = 6
# Name parts that pick the column of a pillar.
CONTRACT_PARTS = ["contract"]
PAYMENT_PARTS = ["payment", "billing"]
SUPPORT_PARTS = ["tech", "support", "security", "backup", "protection"]

# The pillars. {column} and {segment} are filled in per table.
PILLARS = {
    "contract": {
        "priority": "Immediate (0–30 Days)",
        "badge_color": "danger",
        "pillar_name": "Contract Stabilization & Term Migration",
        "target_segment": "{column}: {segment}",
        "metric_noun": "churn rate",
        "metric_tail": "pts vs portfolio baseline",
        "accounts_noun": "accounts",
        "no_revenue": "Calculated per account",
        "strategic_rationale": "Accounts on {segment} exhibit the highest volatility in the portfolio. Converting even 15% of this cohort to annual agreements delivers compounding retention gains.",
        "recommended_actions": [
            "Launch a 12-month contract migration incentive: offer a ₹500/month billing discount + price lock guarantee.",
            "Trigger automated retention save workflows 45 days prior to customer renewal dates.",
            "Route inbound cancellation requests from this segment to a specialized Tier-2 Save Desk.",
        ],
    },
    "early": {
        "priority": "Short-Term (30–60 Days)",
        "badge_color": "warning",
        "pillar_name": "New Account 90-Day Success Program",
        "target_segment": "Accounts with tenure ≤ 6 months",
        "metric_noun": "early churn rate",
        "metric_tail": "pts vs portfolio",
        "accounts_noun": "onboarding accounts",
        "no_revenue": "Calculated per account",
        "strategic_rationale": "Attrition peaks in the first 6 months. Proactive onboarding reduces early buyer remorse and accelerates time-to-value.",
        "recommended_actions": [
            "Implement a 30/60/90 day milestone check-in sequence via WhatsApp/SMS and account manager outreach.",
            "Provide free onboarding consultation and guided feature walkthroughs for new signups.",
            "Track early usage signals to flag disengaged accounts before the first quarterly billing cycle.",
        ],
    },
    "payment": {
        "priority": "Medium-Term (60–90 Days)",
        "badge_color": "info",
        "pillar_name": "Frictionless Billing & Auto-Pay Promotion",
        "target_segment": "{column}: {segment}",
        "metric_noun": "churn rate",
        "metric_tail": "pts vs portfolio baseline",
        "accounts_noun": "accounts",
        "fixed_revenue": "High operational friction cost",
        "strategic_rationale": "Manual and non-automated payment methods like {segment} experience higher involuntary and convenience-based attrition.",
        "recommended_actions": [
            "Offer a one-time ₹250 cashback / bill discount for enrolling in UPI AutoPay or NACH bank mandate.",
            "Implement automated WhatsApp, SMS, and email reminders 5 days prior to invoice due dates.",
            "Simplify digital payment options (UPI, Net Banking, QR code) to eliminate transaction friction.",
        ],
    },
    "support": {
        "priority": "Ongoing Program",
        "badge_color": "success",
        "pillar_name": "Value-Add Protection & Support Bundling",
        "target_segment": "Accounts without {column}",
        "metric_noun": "churn rate",
        "metric_tail": "pts vs portfolio baseline",
        "accounts_noun": "unprotected accounts",
        "fixed_revenue": "Moderate stickiness deficit",
        "strategic_rationale": "Subscribers lacking {column} have lower switching barriers and significantly higher churn propensity.",
        "recommended_actions": [
            "Create bundled tiers offering 6 months of complimentary {column} on contract renewals.",
            "Highlight protection value in monthly customer account newsletters and app notifications.",
            "Incentivize customer service reps to recommend support add-ons during routine support interactions.",
        ],
    },
}

# The operating rhythm.
CADENCE = [
    ("Weekly", "Score & Triage High-Risk Accounts",
     "Upload latest customer extract, score the book, and assign all accounts with Churn Probability ≥ 60% to retention reps."),
    ("Bi-Weekly", "Campaign Performance Review",
     "Track save rates across contract conversion offers and auto-pay enrollment campaigns."),
    ("Monthly", "Executive Portfolio Health Check",
     "Review portfolio churn rate trends, realized revenue savings, and recalibrate risk thresholds."),
    ("Quarterly", "Model Retraining & Governance",
     "Retrain models with the newest quarter of historical outcomes to adapt to changing customer behavioral patterns."),
]


def early_tenure(tenure: Column, months: int = EARLY_MONTHS) -> Column:
    return tenure <= months


def says_no(col: Column) -> Column:
    """Any value that contains 'no', in any case."""
    return F.lower(col.cast("string")).contains("no")


def first_with(columns: list[str], parts: list[str]) -> str | None:
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def pillar_columns(prof: TableProfile, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Which column feeds which pillar; an override replaces the first match by name."""
    found = {
        "contract": first_with(prof.categorical, CONTRACT_PARTS), "early": tenure_column(prof.numeric),
        "payment": first_with(prof.categorical, PAYMENT_PARTS), "support": first_with(prof.categorical, SUPPORT_PARTS),
    }
    found |= overrides or {}
    return {kind: found[kind] for kind in PILLARS if found.get(kind)}


def pillar_cohorts(df: DataFrame, columns: dict[str, str], spend: str | None, label: str = LABEL) -> DataFrame:
    """(column = pillar kind, segment, customers, churners, revenue, churn_rate, lift).

    All four cohorts come from one scan and one shuffle of partial counts: contract and
    payment by value, the other two by a yes/no condition.
    """
    groupings = {}
    for kind, name in columns.items():
        if kind == "early":
            groupings[kind] = F.when(early_tenure(named(name)), F.lit("early"))
        elif kind == "support":
            groupings[kind] = F.when(says_no(named(name)), F.lit("no"))
        else:
            groupings[kind] = named(name)
    found = worst_cohort(cohorts(df, groupings, label, spend))
    return found if spend else found.withColumn("revenue", F.lit(0).cast(MONEY))


def _filled(text: str, column: Column) -> Column:
    return F.replace(F.replace(F.lit(text), F.lit("{column}"), column), F.lit("{segment}"), F.col("segment"))


def pillars(df: DataFrame, prof: TableProfile, label: str = LABEL, overrides: dict[str, str] | None = None) -> DataFrame:
    """One row per pillar, figures and texts, in playbook order."""
    columns = pillar_columns(prof, overrides)
    cohort = pillar_cohorts(df, columns, spend_column(prof.numeric), label)
    kinds = list(columns)

    def per_kind(make) -> Column:
        out = F.when(F.col("column") == kinds[0], make(kinds[0]))
        for kind in kinds[1:]:
            out = out.when(F.col("column") == kind, make(kind))
        return out

    source = per_kind(lambda k: F.lit(columns[k]))
    annual = (F.col("revenue") * 12).cast("double")

    def text(field: str) -> Column:
        return per_kind(lambda k: _filled(PILLARS[k][field], F.lit(columns[k])))

    def revenue(kind: str) -> Column:
        if "fixed_revenue" in PILLARS[kind]:
            return F.lit(PILLARS[kind]["fixed_revenue"])
        amount = F.concat(F.lit("₹"), F.format_number(annual, 2))
        return F.when(annual > 0, amount).otherwise(PILLARS[kind]["no_revenue"])

    metric = F.concat(
        F.format_string("%.1f%%", F.col("churn_rate") * 100), F.lit(" "),
        per_kind(lambda k: F.lit(PILLARS[k]["metric_noun"])), F.lit(" ("),
        F.format_string("%+.1f%%", F.col("lift") * 100), F.lit(" "),
        per_kind(lambda k: F.lit(PILLARS[k]["metric_tail"])), F.lit(")"),
    )
    actions = per_kind(lambda k: F.array(*[_filled(a, F.lit(columns[k])) for a in PILLARS[k]["recommended_actions"]]))
    return cohort.orderBy(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("column"))).select(
        F.col("column").alias("pillar"), source.alias("source_column"), "segment", "customers", "churners",
        "churn_rate", "lift", annual.alias("annual_revenue"),
        text("priority").alias("priority"), text("badge_color").alias("badge_color"),
        text("pillar_name").alias("pillar_name"), text("target_segment").alias("target_segment"),
        metric.alias("observed_metric"),
        F.concat(F.format_number("customers", 0), F.lit(" "), per_kind(lambda k: F.lit(PILLARS[k]["accounts_noun"]))).alias("affected_accounts"),
        per_kind(revenue).alias("annual_revenue_at_risk"),
        text("strategic_rationale").alias("strategic_rationale"), actions.alias("recommended_actions"),
    )


def playbook_summary(df: DataFrame, pillar_rows: DataFrame, label: str = LABEL) -> DataFrame:
    """total_customers, portfolio_churn_rate (4 places), pillars_count."""
    count = pillar_rows.agg(F.count(F.lit(1))).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("total_customers"), F.round(F.avg(named(label)), 4).alias("portfolio_churn_rate")
    ).withColumn("pillars_count", count)


def cadence(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CADENCE, "frequency string, title string, action string")
