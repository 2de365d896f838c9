"""Decision rules, attributions and evaluation on a deterministic pseudo-score."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnspark.functions import rules
from churnspark.functions.label import LABEL
from churnspark.operators import diagnose, evaluate, explain, report, score
from churnspark.plans.books_sql import F1, sql, stacked
from churnspark.sources import books

INPUTS = ["account_id", "tenure", "MonthlyCharges", "Contract", "PaymentMethod", "TechSupport"]


def _scored_rows(spark, sf, columns, driver=None):
    rows = books.with_pseudo_score(books.accounts(spark, sf, columns))
    return score.decide(rows, F.col("score"), columns, "MonthlyCharges" if "MonthlyCharges" in columns else None, driver=driver).drop("score")


# The rules once more in SQL.
BAND = "CASE WHEN {s} >= {hi} THEN 'High' WHEN {s} >= {med} THEN 'Medium' ELSE 'Low' END"


def decided(hi: float = 0.6, med: float = 0.35) -> str:
    band = BAND.format(s="score", hi=f"{hi}::double", med=f"{med}::double")
    return f"""banded AS (SELECT *, {band} AS risk_band FROM book),
decided AS (SELECT *, score AS churn_score, round(score, 4) AS churn_probability, round(score * 100, 1) AS churn_risk_pct,
  CASE WHEN score >= 0.5 THEN '{rules.LIKELY_CHURN}' ELSE '{rules.LIKELY_STAY}' END AS predicted_status,
  CASE WHEN risk_band = 'High' AND score >= 0.75 THEN '{rules.IMMEDIATE}' WHEN risk_band = 'High' THEN '{rules.SOON}'
       WHEN risk_band = 'Medium' THEN '{rules.REVIEW}' ELSE '{rules.ROUTINE}' END AS retention_priority,
  CASE WHEN risk_band IN ('High', 'Medium') THEN round(MonthlyCharges, 2) ELSE 0 END AS monthly_revenue_at_risk,
  round(CASE WHEN risk_band IN ('High', 'Medium') THEN round(MonthlyCharges, 2) ELSE 0 END * 12.0::double, 2) AS annual_revenue_at_risk
FROM banded)"""


def risk_bands(spark, sf):
    return _scored_rows(spark, sf, ["account_id", "tenure"]).select(
        "account_id", "churn_score", "churn_probability", "churn_risk_pct", "risk_band", "predicted_status"
    )


def risk_band_distribution(spark, sf):
    return diagnose.risk_band_distribution(_scored_rows(spark, sf, ["account_id", "tenure"]))


DISTRIBUTION = """SELECT b AS risk_band, count(risk_band) AS accounts, count(risk_band) / any_value(n) AS share
FROM (VALUES ('High'), ('Medium'), ('Low')) AS v(b) LEFT JOIN decided ON risk_band = b CROSS JOIN (SELECT count(*) AS n FROM book) GROUP BY 1"""


def priority_sla(spark, sf):
    return _scored_rows(spark, sf, ["account_id", "tenure"]).select("account_id", "risk_band", "retention_priority")


def revenue_at_risk(spark, sf):
    return _scored_rows(spark, sf, ["account_id", "tenure", "MonthlyCharges"]).select(
        "account_id", "risk_band", "monthly_revenue_at_risk", "annual_revenue_at_risk"
    )


def _driver():
    return (
        F.when(F.col("Contract") == "1-URGENT", "Contract: 1-URGENT")
        .when(F.col("PaymentMethod") == "BUILDING", "PaymentMethod: BUILDING")
        .when(F.col("tenure") <= 12, "tenure: early").otherwise("")
    )


def next_best_action(spark, sf):
    """The rule chain with a driver derived from the row."""
    return _scored_rows(spark, sf, INPUTS, _driver()).select("account_id", "recommended_action")


def next_best_action_text(spark, sf):
    """The text rules without a driver, over part descriptions with planted phrases."""
    rows = books.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    texts = rows.withColumn("note", F.concat_ws(
        " ", F.when(F.col("p_partkey") % 7 == 0, "Month-to-Month"), F.when(F.col("p_partkey") % 5 == 0, "Electronic check"),
        F.when(F.col("p_partkey") % 3 == 0, "no tech support"), F.when(F.col("p_partkey") % 2 == 0, "No online security"),
    ))
    record = score.record(texts, ["p_partkey", "p_name", "p_brand", "p_type", "note"])
    return texts.select("p_partkey", rules.next_best_action(record).alias("recommended_action"))


ACTION_PARTS = f"""SELECT p_partkey, CASE
  WHEN contains(t, 'month-to-month') THEN '{rules.ACTION_CONTRACT}'
  WHEN contains(t, 'electronic check') OR contains(t, 'upi') THEN '{rules.ACTION_PAYMENT}'
  WHEN contains(t, 'no tech support') OR contains(t, 'techsupport: no') OR contains(t, 'techsupport:no') THEN '{rules.ACTION_SUPPORT}'
  WHEN contains(t, 'no online security') THEN '{rules.ACTION_SECURITY}' ELSE '{rules.ACTION_DEFAULT}' END AS recommended_action
FROM (SELECT p_partkey, lower('p_partkey:' || p_partkey || ' p_name:' || p_name || ' p_brand:' || p_brand || ' p_type:' || p_type || ' note:'
  || concat_ws(' ', CASE WHEN p_partkey % 7 = 0 THEN 'Month-to-Month' END, CASE WHEN p_partkey % 5 = 0 THEN 'Electronic check' END,
     CASE WHEN p_partkey % 3 = 0 THEN 'no tech support' END, CASE WHEN p_partkey % 2 = 0 THEN 'No online security' END)) AS t FROM part)"""

ACTION_BOOK = f"""SELECT account_id, CASE
  WHEN contains(drv, 'contract') OR contains(t, 'month-to-month') THEN '{rules.ACTION_CONTRACT}'
  WHEN contains(t, 'electronic check') OR contains(drv, 'payment') OR contains(t, 'upi') OR contains(drv, 'bank') THEN '{rules.ACTION_PAYMENT}'
  WHEN contains(drv, 'tenure') THEN '{rules.ACTION_TENURE}'
  WHEN contains(t, 'techsupport:no') THEN '{rules.ACTION_SUPPORT}' ELSE '{rules.ACTION_DEFAULT}' END AS recommended_action
FROM (SELECT account_id, lower('contract:' || coalesce(Contract, '') || ' paymentmethod:' || PaymentMethod || ' techsupport:' || TechSupport) AS t,
  lower(CASE WHEN Contract = '1-URGENT' THEN 'Contract: 1-URGENT' WHEN PaymentMethod = 'BUILDING' THEN 'PaymentMethod: BUILDING'
    WHEN tenure <= 12 THEN 'tenure: early' ELSE '' END) AS drv FROM book)"""


def reband(spark, sf):
    """Scored with the default thresholds, then re-banded at 0.8 / 0.5 from the stored score."""
    rows = _scored_rows(spark, sf, ["account_id", "tenure", "MonthlyCharges"])
    return score.reband(rows, "MonthlyCharges", 0.8, 0.5).select(
        "account_id", "risk_band", "retention_priority", "monthly_revenue_at_risk"
    )


def book_filter(spark, sf):
    rows = _scored_rows(spark, sf, ["account_id", "tenure"])
    return diagnose.book_page(rows, "account_id", "High").select("account_id", "churn_probability", "risk_band")


def top_at_risk(spark, sf):
    rows = _scored_rows(spark, sf, INPUTS)
    return report.top_accounts(rows, "account_id", ["tenure", "MonthlyCharges", "Contract"]).drop("recommended_action")


TOP = """SELECT account_id, churn_probability, risk_band, predicted_status, retention_priority, monthly_revenue_at_risk,
  annual_revenue_at_risk, tenure, MonthlyCharges, Contract FROM decided
QUALIFY row_number() OVER (ORDER BY decided.churn_probability DESC, account_id) <= 250"""


def churn_verdict(spark, sf):
    rows = score.with_verdict(_scored_rows(spark, sf, ["account_id", "tenure"]))
    return rows.select("account_id", "will_churn", "prediction")


# --- attributions --------------------------------------------------------------------------------


def attribution_rules(spark, sf):
    """Attribution lists over the whole book from declared effects per feature."""
    rows = books.with_pseudo_score(books.accounts(spark, sf, ["account_id", "tenure", "MonthlyCharges", "Contract", "PaymentMethod", "TechSupport"]))
    effects = {
        "tenure": (F.lit(36) - F.col("tenure")) / F.lit(128.0),
        "MonthlyCharges": (F.floor("MonthlyCharges") - 150000) / F.lit(1048576.0),
        "Contract": F.when(F.col("Contract") == "1-URGENT", 0.625).when(F.col("Contract") == "5-LOW", -0.25).otherwise(0.0),
        "PaymentMethod": F.when(F.col("PaymentMethod") == "BUILDING", 0.125).otherwise(0.0078125),
        "TechSupport": F.when(F.col("TechSupport") == "No", 0.0625).when(F.col("TechSupport") == "Yes", -0.5).otherwise(0.0),
    }
    types = {f.name: f.dataType for f in rows.schema}
    parts = [
        (name, effect, explain.value_text(F.col(name), types[name]), F.coalesce(F.col(name).cast("string"), F.lit("")))
        for name, effect in effects.items()
    ]
    out = explain.attribute(rows, parts, F.col("score"))

    def joined(column: str, field: str):
        return F.concat_ws(" | ", F.transform(column, lambda s: s[field].cast("string")))

    return out.select(
        "account_id", joined("top_risk_elevators", "label").alias("elevators"),
        joined("top_risk_elevators", "impact_pct").alias("elevator_pct"),
        joined("top_retention_anchors", "label").alias("anchors"),
        joined("top_retention_anchors", "impact_pct").alias("anchor_pct"),
        "risk_summary", "top_driver",
    )


ATTRIBUTION = f"""effects AS (
  SELECT account_id, score, 0 AS pos, 'tenure' AS feature, format('{{:,.2f}}', tenure::double) AS shown, tenure::varchar AS plain, (36 - tenure) / 128.0::double AS effect FROM book
  UNION ALL SELECT account_id, score, 1, 'MonthlyCharges', format('{{:,.2f}}', MonthlyCharges), MonthlyCharges::varchar, (floor(MonthlyCharges) - 150000) / 1048576.0::double FROM book
  UNION ALL SELECT account_id, score, 2, 'Contract', coalesce(Contract, ''), coalesce(Contract, ''), CASE Contract WHEN '1-URGENT' THEN 0.625::double WHEN '5-LOW' THEN -0.25::double ELSE 0::double END FROM book
  UNION ALL SELECT account_id, score, 3, 'PaymentMethod', PaymentMethod, PaymentMethod, CASE PaymentMethod WHEN 'BUILDING' THEN 0.125::double ELSE 0.0078125::double END FROM book
  UNION ALL SELECT account_id, score, 4, 'TechSupport', TechSupport, TechSupport, CASE TechSupport WHEN 'No' THEN 0.0625::double WHEN 'Yes' THEN -0.5::double ELSE 0::double END FROM book),
marked AS (SELECT *, least(45, greatest(5, cast(floor(abs(effect) * 100) AS int))) AS pct,
  row_number() OVER (PARTITION BY account_id, effect > 0.01 ORDER BY round(effect, 4) DESC, pos) AS up,
  row_number() OVER (PARTITION BY account_id, effect < -0.01 ORDER BY round(effect, 4), pos) AS down FROM effects),
lists AS (SELECT account_id, any_value(score) AS score,
  string_agg(feature || ': ' || shown, ' | ' ORDER BY up) FILTER (effect > 0.01 AND up <= 4) AS ups,
  string_agg(pct::varchar, ' | ' ORDER BY up) FILTER (effect > 0.01 AND up <= 4) AS up_pct,
  string_agg(feature || ': ' || shown, ' | ' ORDER BY down) FILTER (effect < -0.01 AND down <= 3) AS downs,
  string_agg(pct::varchar, ' | ' ORDER BY down) FILTER (effect < -0.01 AND down <= 3) AS down_pct,
  string_agg(feature || ': ' || shown, ', ' ORDER BY up) FILTER (effect > 0.01 AND up <= 3) AS three,
  min(feature || ': ' || shown) FILTER (effect > 0.01 AND up = 1) AS best,
  string_agg(feature || ': ' || plain, ' | ' ORDER BY pos) FILTER (pos < 3) AS fallback,
  string_agg(feature || ': ' || plain, ', ' ORDER BY pos) FILTER (pos < 3) AS fallback_three,
  min(feature || ': ' || plain) FILTER (pos = 0) AS fallback_best
  FROM marked GROUP BY 1),
chosen AS (SELECT account_id, score, ups IS NULL AND downs IS NULL AS none,
  CASE WHEN ups IS NULL AND downs IS NULL THEN fallback ELSE coalesce(ups, '') END AS elevators,
  CASE WHEN ups IS NULL AND downs IS NULL THEN '15 | 15 | 15' ELSE coalesce(up_pct, '') END AS elevator_pct,
  coalesce(downs, '') AS anchors, coalesce(down_pct, '') AS anchor_pct,
  CASE WHEN ups IS NULL AND downs IS NULL THEN fallback_three ELSE three END AS three,
  CASE WHEN ups IS NULL AND downs IS NULL THEN fallback_best ELSE best END AS best FROM lists)
SELECT account_id, elevators, elevator_pct, anchors, anchor_pct,
  CASE WHEN elevators = '' THEN '{explain.NO_FACTOR}' WHEN score >= 0.6 THEN '{explain.HIGH_TEXT}' || three || '.'
       WHEN score >= 0.35 THEN '{explain.MODERATE_TEXT}' || three || '.' ELSE '{explain.LOW_TEXT}' END AS risk_summary,
  coalesce(best, '{explain.NO_DRIVER}') AS top_driver FROM chosen"""


def importance_rollup(spark, sf):
    """Slot importances (here: absolute segment lifts) summed to their column and ranked."""
    cats = books.CATEGORICAL
    segments = diagnose.segment_lift(books.labelled(spark, sf, cats), cats)
    slots = segments.select(F.col("column").alias("feature"), F.abs("lift").alias("importance"))
    return explain.importance_rollup(slots, cats, [])


def _rollup_sql() -> str:
    cats = books.CATEGORICAL
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains(lower(feature), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{text}'" for words, text in explain.DRIVER_TEXTS
    )
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(cats))
    return sql(f"""SELECT cast(row_number() OVER (ORDER BY s DESC, CASE feature {order} END) AS int) AS rank, feature, 'Categorical' AS feature_type,
  round(s, 4) AS importance_score, round(s * 100, 1) AS importance_pct,
  CASE {arms} ELSE 'Key predictor ''' || feature || ''' contributing to portfolio churn differentiation.' END AS description
FROM (SELECT feature, sum(imp) / (SELECT sum(imp) FROM slots) AS s FROM slots GROUP BY 1)""", F1,
        f"long AS ({stacked(cats, 'book', '_y')})",
        """slots AS (SELECT "column" AS feature, abs(sum(_y) / count(*) - (SELECT sum(_y) / count(*) FROM book)) AS imp
           FROM long WHERE value IS NOT NULL GROUP BY "column", value)""")


# --- evaluation ------------------------------------------------------------------------------------


def _judged(spark, sf):
    rows = books.with_pseudo_score(books.labelled(spark, sf, ["tenure"]))
    return rows.withColumn("pred", F.when(F.col("score") >= 0.5, 1).otherwise(0))


COUNTS = """c AS (SELECT count(*) FILTER (_y = 0 AND score < 0.5) AS tn, count(*) FILTER (_y = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (_y = 1 AND score < 0.5) AS fn, count(*) FILTER (_y = 1 AND score >= 0.5) AS tp FROM book)"""
ORDERED = """g AS (SELECT score AS s, count(*) FILTER (_y = 1) AS pos, count(*) FILTER (_y = 0) AS neg FROM book GROUP BY 1),
run AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g
  WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""
AUC = "sum(neg * (2 * cp - pos))::double / (2.0::double * any_value(p) * any_value(n))"
AP = "sum(pos * (cp / (cp + cn))) / any_value(p)"


def confusion_matrix(spark, sf):
    return evaluate.confusion(_judged(spark, sf), "pred")


def binary_metrics(spark, sf):
    return evaluate.threshold_metrics(evaluate.confusion(_judged(spark, sf), "pred")).select("accuracy", "precision", "recall", "f1")


def classification_report(spark, sf):
    out = evaluate.classification_report(evaluate.confusion(_judged(spark, sf), "pred"))
    return out.withColumns({m: F.round(m, 9) for m in ("precision", "recall", "f1")})


REPORT = """r AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
  tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS s1, (tp + tn) / (tp + tn + fp + fn) AS acc FROM c)
SELECT "class", round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
  SELECT '0' AS "class", p0 AS "precision", r0 AS recall, f0 AS f1, s0 AS support FROM r
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM r UNION ALL SELECT 'accuracy', acc, acc, acc, s0 + s1 FROM r
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM r
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM r)"""


def roc_auc(spark, sf):
    return evaluate.roc_auc(_judged(spark, sf), "score")


def roc_auc_tied(spark, sf):
    """One score holds nearly all rows and few scores fit a bucket."""
    judged = books.with_pseudo_score(books.labelled(spark, sf, ["account_id", "tenure", "MonthlyCharges"]))
    tied = judged.withColumn("score", F.when(F.col("account_id") % 50 == 0, F.col("MonthlyCharges")).otherwise(F.lit(0.5)))
    return evaluate.ranking_metrics(tied, "score", per_task=20).select("roc_auc", F.round("pr_auc", 9).alias("pr_auc"))


TIED = """g AS (SELECT CASE WHEN account_id % 50 = 0 THEN MonthlyCharges ELSE 0.5::double END AS s,
  count(*) FILTER (_y = 1) AS pos, count(*) FILTER (_y = 0) AS neg FROM book GROUP BY 1),
run AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g
  WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


def class_report_by_region(spark, sf):
    """One report for each of several confusion rows, as training keeps them by candidate."""
    rows = books.with_pseudo_score(books.labelled(spark, sf, ["tenure", "Region"]))
    judged = rows.withColumn("pred", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    out = evaluate.classification_report(evaluate.confusion(judged, "pred", by=["Region"]), by=["Region"])
    return out.where(F.col("class").isin("0", "1")).withColumns({m: F.round(m, 9) for m in ("precision", "recall", "f1")})


REGION_REPORT = """SELECT Region, k AS "class",
  round(coalesce(hit / nullif(hit + wrong, 0), 0), 9) AS "precision", round(coalesce(hit / nullif(hit + lost, 0), 0), 9) AS recall,
  round(coalesce(2 * hit / nullif(2 * hit + wrong + lost, 0), 0), 9) AS f1, hit + lost AS support
FROM (SELECT Region, k, count(*) FILTER (_y = k::int AND (score >= 0.5)::int = k::int) AS hit,
    count(*) FILTER (_y <> k::int AND (score >= 0.5)::int = k::int) AS wrong, count(*) FILTER (_y = k::int AND (score >= 0.5)::int <> k::int) AS lost
  FROM book CROSS JOIN (VALUES ('0'), ('1')) AS v(k) GROUP BY ALL)"""


def average_precision(spark, sf):
    return evaluate.average_precision(_judged(spark, sf), "score").select(F.round("pr_auc", 9).alias("pr_auc"))


def roc_points(spark, sf):
    return evaluate.roc_points(_judged(spark, sf), "score")


def ranking_by_region(spark, sf):
    """Ranking metrics of the natural score MonthlyCharges (many distinct values) per region."""
    rows = books.labelled(spark, sf, ["MonthlyCharges", "Region"])
    out = evaluate.ranking_metrics(rows, "MonthlyCharges", by=["Region"])
    return out.withColumns({m: F.round(m, 9) for m in ("roc_auc", "pr_auc")})


BY_REGION = """g AS (SELECT Region, MonthlyCharges AS s, count(*) FILTER (_y = 1) AS pos, count(*) FILTER (_y = 0) AS neg FROM book GROUP BY 1, 2),
run AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY Region) AS p, sum(neg) OVER (PARTITION BY Region) AS n FROM g
  WINDOW w AS (PARTITION BY Region ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""

D = decided()
QUERIES = {
    "risk_bands": (risk_bands, sql(
        "SELECT account_id, churn_score, churn_probability, churn_risk_pct, risk_band, predicted_status FROM decided", F1, D)),
    "risk_band_distribution": (risk_band_distribution, sql(DISTRIBUTION, F1, D)),
    "priority_sla": (priority_sla, sql("SELECT account_id, risk_band, retention_priority FROM decided", F1, D)),
    "revenue_at_risk": (revenue_at_risk, sql(
        "SELECT account_id, risk_band, monthly_revenue_at_risk, annual_revenue_at_risk FROM decided", F1, D)),
    "next_best_action": (next_best_action, sql(ACTION_BOOK)),
    "next_best_action_text": (next_best_action_text, ACTION_PARTS),
    "reband": (reband, sql(
        "SELECT account_id, risk_band, retention_priority, monthly_revenue_at_risk FROM decided", F1, decided(0.8, 0.5))),
    "book_filter": (book_filter, sql(
        "SELECT account_id, churn_probability, risk_band FROM decided WHERE risk_band = 'High' "
        "QUALIFY row_number() OVER (ORDER BY decided.churn_probability DESC, account_id) <= 100", F1, D)),
    "top_at_risk": (top_at_risk, sql(TOP, F1, D)),
    "churn_verdict": (churn_verdict, sql(
        "SELECT account_id, round(score * 100, 1) / 100 >= 0.5 AS will_churn, CASE WHEN round(score * 100, 1) / 100 >= 0.5 "
        "THEN 'Customer is likely to CHURN' ELSE 'Customer is likely to STAY (Retained)' END AS prediction FROM book")),
    "attribution_rules": (attribution_rules, sql("SELECT * FROM (WITH " + ATTRIBUTION + ")")),
    "importance_rollup": (importance_rollup, _rollup_sql()),
    "confusion_matrix": (confusion_matrix, sql(
        "SELECT *, tn / greatest(1, tn + fp) AS tn_rate, fp / greatest(1, tn + fp) AS fp_rate, "
        "fn / greatest(1, fn + tp) AS fn_rate, tp / greatest(1, fn + tp) AS tp_rate FROM c", F1, COUNTS)),
    "binary_metrics": (binary_metrics, sql(
        'SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, '
        "2 * tp / (2 * tp + fp + fn) AS f1 FROM c", F1, COUNTS)),
    "classification_report": (classification_report, sql("SELECT * FROM (WITH " + REPORT + ")", F1, COUNTS)),
    "roc_auc_tied": (roc_auc_tied, sql(f"SELECT {AUC} AS roc_auc, round({AP}, 9) AS pr_auc FROM run", F1, TIED)),
    "class_report_by_region": (class_report_by_region, sql(REGION_REPORT)),
    "roc_auc": (roc_auc, sql(f"SELECT {AUC} AS roc_auc FROM run", F1, ORDERED)),
    "average_precision": (average_precision, sql(f"SELECT round({AP}, 9) AS pr_auc FROM run", F1, ORDERED)),
    "roc_points": (roc_points, sql("SELECT s AS threshold, cn / n AS fpr, cp / p AS tpr FROM run", F1, ORDERED)),
    "ranking_by_region": (ranking_by_region, sql(
        f"SELECT Region, round({AUC}, 9) AS roc_auc, round({AP}, 9) AS pr_auc FROM run GROUP BY 1", F1, BY_REGION)),
}
