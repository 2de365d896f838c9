"""Decision rules: bands, outreach priority, revenue at risk, next best action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, MEDIUM = 0.60, 0.35
IMMEDIATE_FROM = 0.75

# Bands, statuses and outreach targets.
BANDS = ["High", "Medium", "Low"]
LIKELY_CHURN, LIKELY_STAY = "Likely to Churn", "Likely to Stay"
IMMEDIATE = "Immediate Outreach (within 24–48 hours)"
SOON = "High Priority (within 3–5 days)"
REVIEW = "Retention Review (within 14 days)"
ROUTINE = "Routine Account Monitoring"

# Actions offered to an account, one per rule below.
ACTION_CONTRACT = "Offer 12-month contract migration incentive (₹500/mo billing discount + price lock guarantee)."
ACTION_PAYMENT = "Promote UPI AutoPay / NACH e-mandate registration with a one-time ₹250 bill cashback."
ACTION_TENURE = "Enroll in 90-day Customer Onboarding Success Program with scheduled account health checks."
ACTION_FIBER = "Initiate VIP service quality check and offer complimentary high-speed broadband booster."
ACTION_SUPPORT = "Bundle complimentary Technical Support & Device Protection for 6 months."
ACTION_SECURITY = "Provide complimentary Cyber Security & Cloud Backup suite to enhance stickiness."
ACTION_DEFAULT = "Schedule dedicated account manager check-in to review usage and customer satisfaction."


def check_thresholds(high: float, med: float) -> tuple[float, float]:
    """Both rounded to two places, which is how they are stored; then 0 < med < high <= 1 must hold."""
    high, med = round(high, 2), round(med, 2)
    if not 0.0 < med < high <= 1.0:
        raise ValueError("thresholds must satisfy 0 < medium < high <= 1 on two places")
    return high, med


def risk_band(score: Column, high: float = HIGH, med: float = MEDIUM) -> Column:
    return F.when(score >= F.lit(high), "High").when(score >= F.lit(med), "Medium").otherwise("Low")


def predicted_status(score: Column) -> Column:
    return F.when(score >= F.lit(0.5), LIKELY_CHURN).otherwise(LIKELY_STAY)


def outreach(band: Column, score: Column, immediate_from: float = IMMEDIATE_FROM) -> Column:
    return (
        F.when((band == "High") & (score >= F.lit(immediate_from)), IMMEDIATE)
        .when(band == "High", SOON)
        .when(band == "Medium", REVIEW)
        .otherwise(ROUTINE)
    )


def revenue_at_risk(band: Column, monthly: Column) -> Column:
    """Monthly spend of accounts in the two upper bands, else zero."""
    return F.when(band.isin("High", "Medium"), F.round(monthly, 2)).otherwise(F.lit(0.0))


def record_text(columns: Sequence[tuple[str, Column | None]]) -> Column:
    """'name:value name:value …' in lower case.

    Pass None instead of a column whose values hold no letters (numbers, dates):
    only its name can match a rule, so its value need not be rendered.
    """
    parts = [
        F.lit(f"{name}:") if col is None else F.concat(F.lit(f"{name}:"), F.coalesce(col, F.lit("")))
        for name, col in columns
    ]
    return F.lower(F.concat_ws(" ", *parts))


def next_best_action(record: Column, driver: Column | None = None) -> Column:
    """First matching rule over the record text and the name of the top driver."""
    drv = F.lower(F.coalesce(driver, F.lit(""))) if driver is not None else F.lit("")

    def has(*words: str) -> Column:
        found = record.contains(words[0])
        for word in words[1:]:
            found = found | record.contains(word)
        return found

    return (
        F.when(drv.contains("contract") | has("month-to-month"), ACTION_CONTRACT)
        .when(has("electronic check", "upi") | drv.contains("payment") | drv.contains("bank"), ACTION_PAYMENT)
        .when(drv.contains("tenure"), ACTION_TENURE)
        .when(has("fiber") & (drv.contains("charge") | drv.contains("monthly")), ACTION_FIBER)
        .when(has("no tech support", "techsupport: no", "techsupport:no"), ACTION_SUPPORT)
        .when(has("no online security", "onlinesecurity: no", "onlinesecurity:no"), ACTION_SECURITY)
        .otherwise(ACTION_DEFAULT)
    )


def churn_verdict(score: Column) -> tuple[Column, Column]:
    """The older output pair: will_churn flag and its sentence, on the one-decimal percentage."""
    will = F.round(score * 100, 1) / 100 >= F.lit(0.5)
    text = F.when(will, "Customer is likely to CHURN").otherwise("Customer is likely to STAY (Retained)")
    return will, text
