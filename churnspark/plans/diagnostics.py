"""Portfolio diagnostics, buckets, cohorts, playbook and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.operators import activity, diagnose, playbook, report
from churnspark.operators.profile import TableProfile
from churnspark.plans.books_sql import F1, F2, F4, sql, stacked
from churnspark.sources import books

CATS, NUMS = books.CATEGORICAL, books.NUMERIC
PILLAR_SOURCES = {
    "contract": "Contract", "early": "tenure", "payment": "PaymentMethod", "support": "TechSupport",
}
BOOK_PROFILE = TableProfile(
    target="Churn", id_column="account_id", numeric=list(NUMS), categorical=list(CATS), columns=list(books.ACCOUNT_COLUMNS),
)


def portfolio_kpis(spark, sf):
    return diagnose.kpis(books.labelled(spark, sf, ["tenure", "MonthlyCharges"]), "MonthlyCharges", "tenure").withColumns(
        {"avg_tenure": F.round("avg_tenure", 6), "avg_monthly": F.round("avg_monthly", 6)}
    )


KPIS = """SELECT count(*) AS customers, cast(sum(_y) AS bigint) AS churners, cast(sum(1 - _y) AS bigint) AS retained,
  sum(_y) / count(*) AS churn_rate,
  cast(coalesce(sum(CASE WHEN _y = 1 THEN cast(MonthlyCharges AS decimal(20,4)) END), 0) AS double) AS monthly_revenue_at_risk,
  cast(coalesce(sum(CASE WHEN _y = 1 THEN cast(MonthlyCharges AS decimal(20,4)) END), 0) * 12 AS double) AS annual_revenue_at_risk,
  round(avg(tenure), 6) AS avg_tenure, round(avg(MonthlyCharges), 6) AS avg_monthly,
  'MonthlyCharges' AS monthly_column, 'tenure' AS tenure_column
FROM book"""


def executive_summary(spark, sf):
    """The formatted KPI table."""
    figures = diagnose.kpis(books.labelled(spark, sf, ["tenure", "MonthlyCharges"]), "MonthlyCharges", "tenure")
    return report.executive_summary(figures).drop("definition")


EXECUTIVE = """SELECT * FROM (
  SELECT 1 AS position, 'Total Active Portfolio Accounts' AS indicator, format('{:,}', customers) AS value FROM k
  UNION ALL SELECT 2, 'Identified Churned Customers', format('{:,}', churners) FROM k
  UNION ALL SELECT 3, 'Retained Active Customers', format('{:,}', retained) FROM k
  UNION ALL SELECT 4, 'Portfolio Churn Rate', printf('%.2f%%', churn_rate * 100) FROM k
  UNION ALL SELECT 5, 'Monthly Revenue at Risk', '₹' || format('{:,.2f}', monthly_revenue_at_risk) FROM k
  UNION ALL SELECT 6, 'Annualized Revenue at Risk', '₹' || format('{:,.2f}', annual_revenue_at_risk) FROM k
  UNION ALL SELECT 7, 'Average Account Tenure', printf('%.1f months', avg_tenure) FROM k
  UNION ALL SELECT 8, 'Average Monthly Spend', printf('₹%.2f', avg_monthly) FROM k)"""


def churn_mix(spark, sf):
    return diagnose.churn_mix(books.labelled(spark, sf, []))


def _segments(spark, sf):
    return diagnose.segment_lift(books.labelled(spark, sf, CATS), CATS)


SEGMENTS = f"""long AS ({stacked(CATS, 'book', '_y')}),
total AS (SELECT sum(_y) / count(*) AS rate FROM book),
segments AS (SELECT "column", value AS segment, count(*) AS customers, cast(sum(_y) AS bigint) AS churners,
    sum(_y) / count(*) AS churn_rate, sum(_y) / count(*) - any_value(rate) AS lift
  FROM long CROSS JOIN total WHERE value IS NOT NULL GROUP BY ALL),
flagged AS (SELECT *, lift > 0.05::double AND customers >= 15 AS is_high_risk FROM segments)"""


def _seg_sql(body: str) -> str:
    return sql(body, F1, SEGMENTS)


def _placed(ordered):
    """With the place of each row in its column, so that the order is compared too."""
    here = Window.partitionBy("column").orderBy(F.monotonically_increasing_id())
    return ordered.withColumn("place", F.row_number().over(here))


def high_risk_segments(spark, sf):
    return diagnose.high_risk_segments(_segments(spark, sf))


def segment_by_population(spark, sf):
    return _placed(diagnose.order_segments(_segments(spark, sf), CATS, "population"))


def segment_by_lift(spark, sf):
    return _placed(diagnose.order_segments(_segments(spark, sf), CATS, "lift"))


WIDE_TEXTS = [f"c{i}" for i in range(14)]
WIDE_NUMBERS = [f"n{i}" for i in range(10)]


def segment_lift_wide(spark, sf):
    """Fourteen categorical columns: none is left out."""
    rows = books.labelled(spark, sf, ["account_id"])
    wide = rows.withColumns({c: (F.col("account_id") * (i + 3) % (i + 2)).cast("string") for i, c in enumerate(WIDE_TEXTS)})
    return diagnose.segment_lift(wide, WIDE_TEXTS)


def class_profile_wide(spark, sf):
    """Ten numeric columns: none is left out."""
    rows = books.labelled(spark, sf, ["account_id"])
    wide = rows.withColumns({c: (F.col("account_id") % (i + 7)).cast("double") for i, c in enumerate(WIDE_NUMBERS)})
    return diagnose.class_profile(wide, WIDE_NUMBERS)


WIDE_SEGMENTS = "long AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", cast(account_id * {i + 3} % {i + 2} AS varchar) AS value, _y FROM book""" for i, c in enumerate(WIDE_TEXTS)
) + "), " + SEGMENTS.split("),\n", 1)[1]


def segment_risk_matrix(spark, sf):
    return report.segment_matrix(_segments(spark, sf))


def churn_rate_by_column(spark, sf):
    return diagnose.churn_rate_by(books.labelled(spark, sf, ["Contract"]), "Contract")


def segment_lift_documents(spark, sf):
    return diagnose.segment_lift(books.documents_labelled(spark, sf), ["lang", "source"])


DOC_SEGMENTS = f"""WITH {F4},
long AS ({stacked(['lang', 'source'], 'book', '_y')}), total AS (SELECT sum(_y) / count(*) AS rate FROM book)
SELECT "column", value AS segment, count(*) AS customers, cast(sum(_y) AS bigint) AS churners,
  sum(_y) / count(*) AS churn_rate, sum(_y) / count(*) - any_value(rate) AS lift,
  sum(_y) / count(*) - any_value(rate) > 0.05::double AND count(*) >= 15 AS is_high_risk
FROM long CROSS JOIN total WHERE value IS NOT NULL GROUP BY ALL"""


def tenure_buckets(spark, sf):
    return diagnose.tenure_buckets(books.labelled(spark, sf, ["tenure"]), "tenure")


def tenure_buckets_recency(spark, sf):
    return diagnose.tenure_buckets(books.recency(spark, sf), "tenure", "churned")


def _bucket_sql(label: str) -> str:
    names = ", ".join(f"({i}, '{b}')" for i, (b, _) in enumerate(diagnose.TENURE_BUCKETS))
    return f"""SELECT bucket, coalesce(customers, 0) AS customers, churn_rate FROM (VALUES {names}) AS d(pos, bucket)
LEFT JOIN (SELECT CASE WHEN coalesce(tenure, 0) <= -0.1 THEN NULL WHEN coalesce(tenure, 0) <= 6 THEN 0
    WHEN tenure <= 12 THEN 1 WHEN tenure <= 24 THEN 2 WHEN tenure <= 36 THEN 3 WHEN tenure <= 48 THEN 4
    WHEN tenure <= 10000 THEN 5 END AS pos, count(*) AS customers, sum({label}) / count(*) AS churn_rate
  FROM book GROUP BY 1) USING (pos)"""


def class_numeric_profile(spark, sf):
    means = diagnose.class_profile(books.labelled(spark, sf, NUMS), NUMS)
    return means.select("column", *[F.round(c, 6).alias(c) for c in ("retained_mean", "churned_mean")])


CLASS_PROFILE = """SELECT "column", round(avg(value) FILTER (_y = 0), 6) AS retained_mean,
  round(avg(value) FILTER (_y = 1), 6) AS churned_mean FROM long GROUP BY 1"""


def worst_cohort(spark, sf):
    rows = books.labelled(spark, sf, ["MonthlyCharges", "Contract", "PaymentMethod"])
    groups = diagnose.cohorts(rows, {c: F.col(c) for c in ("Contract", "PaymentMethod")}, spend="MonthlyCharges")
    return diagnose.worst_cohort(groups).withColumn("revenue", F.col("revenue").cast("double"))


COHORTS = """total AS (SELECT sum(_y) / count(*) AS rate FROM book),
groups AS (SELECT "column", value AS segment, count(*) AS customers, cast(sum(_y) AS bigint) AS churners,
    coalesce(sum(CASE WHEN _y = 1 THEN cast(MonthlyCharges AS decimal(20,4)) END), 0) AS revenue,
    sum(_y) / count(*) AS churn_rate, sum(_y) / count(*) - any_value(rate) AS lift
  FROM long CROSS JOIN total WHERE value IS NOT NULL GROUP BY 1, 2),
worst AS (SELECT * FROM groups
  QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY churn_rate DESC, customers DESC, segment) = 1)"""


def _cohort_sql(body: str, long: str) -> str:
    return sql(body, F1, f"long AS ({long})", COHORTS)


TWO = stacked(["Contract", "PaymentMethod"], "book", "_y, MonthlyCharges")


def cohort_revenue(spark, sf):
    """Annual revenue lost in every contract cohort."""
    rows = books.labelled(spark, sf, ["MonthlyCharges", "Contract"])
    groups = diagnose.cohorts(rows, {"Contract": F.col("Contract")}, spend="MonthlyCharges")
    return groups.select("segment", "churners", (F.col("revenue") * 12).cast("double").alias("annual_revenue"))


def early_tenure_cohort(spark, sf):
    rows = books.labelled(spark, sf, ["tenure", "MonthlyCharges"])
    return diagnose.kpis(rows.where(playbook.early_tenure(F.col("tenure"))), "MonthlyCharges", None).select(
        "customers", "churners", "churn_rate", "annual_revenue_at_risk"
    )


def no_addon_cohort(spark, sf):
    rows = books.labelled(spark, sf, ["MonthlyCharges", "TechSupport"])
    return diagnose.kpis(rows.where(playbook.says_no(F.col("TechSupport"))), "MonthlyCharges", None).select(
        "customers", "churners", "churn_rate", "annual_revenue_at_risk"
    )


def _filtered(where: str) -> str:
    return sql(f"""SELECT count(*) AS customers, cast(sum(_y) AS bigint) AS churners, sum(_y) / count(*) AS churn_rate,
  cast(sum(CASE WHEN _y = 1 THEN cast(MonthlyCharges AS decimal(20,4)) END) * 12 AS double) AS annual_revenue_at_risk
FROM book WHERE {where}""")


def label_filter(spark, sf):
    """Churned rows of the book."""
    rows = books.labelled(spark, sf, ["account_id", "tenure", "Contract"])
    return rows.where(F.col(LABEL) == 1).select("account_id", "tenure", "Contract")


def playbook_pillars(spark, sf):
    rows = books.labelled(spark, sf, ["tenure", "MonthlyCharges", "Contract", "PaymentMethod", "TechSupport"])
    return playbook.pillars(rows, BOOK_PROFILE).select(
        "pillar", "source_column", "segment", "customers", "churners", "churn_rate", "lift", "annual_revenue",
        "priority", "pillar_name", "target_segment", "observed_metric", "affected_accounts", "annual_revenue_at_risk",
    )


def _pillar_sql() -> str:
    long = (
        "SELECT 'contract' AS \"column\", Contract AS value, _y, MonthlyCharges FROM book "
        "UNION ALL SELECT 'payment', PaymentMethod, _y, MonthlyCharges FROM book "
        "UNION ALL SELECT 'early', CASE WHEN tenure <= 6 THEN 'early' END, _y, MonthlyCharges FROM book "
        "UNION ALL SELECT 'support', CASE WHEN contains(lower(TechSupport), 'no') THEN 'no' END, _y, MonthlyCharges FROM book"
    )
    arms = {"source_column": [], "priority": [], "pillar_name": [], "target_segment": [], "noun": [], "tail": [], "accounts": [], "money": []}
    for kind, column in PILLAR_SOURCES.items():
        p = playbook.PILLARS[kind]
        target = p["target_segment"].replace("{column}", column)
        arms["source_column"].append((kind, f"'{column}'"))
        arms["priority"].append((kind, f"'{p['priority']}'"))
        arms["pillar_name"].append((kind, f"'{p['pillar_name']}'"))
        arms["target_segment"].append((kind, f"replace('{target}', '{{segment}}', segment)"))
        arms["noun"].append((kind, f"'{p['metric_noun']}'"))
        arms["tail"].append((kind, f"'{p['metric_tail']}'"))
        arms["accounts"].append((kind, f"'{p['accounts_noun']}'"))
        money = f"'{p['fixed_revenue']}'" if "fixed_revenue" in p else "'₹' || format('{:,.2f}', cast(revenue * 12 AS double))"
        arms["money"].append((kind, money))
    case = {
        name: "CASE " + " ".join(f"WHEN \"column\" = '{k}' THEN {v}" for k, v in pairs) + " END" for name, pairs in arms.items()
    }
    return _cohort_sql(f"""SELECT "column" AS pillar, {case['source_column']} AS source_column, segment, customers, churners,
  churn_rate, lift, cast(revenue * 12 AS double) AS annual_revenue, {case['priority']} AS priority,
  {case['pillar_name']} AS pillar_name, {case['target_segment']} AS target_segment,
  printf('%.1f%%', churn_rate * 100) || ' ' || {case['noun']} || ' (' || printf('%+.1f%%', lift * 100) || ' ' || {case['tail']} || ')' AS observed_metric,
  format('{{:,}}', customers) || ' ' || {case['accounts']} AS affected_accounts, {case['money']} AS annual_revenue_at_risk
FROM worst""", long)


def playbook_table(spark, sf):
    """The report form: actions joined, and the text columns only."""
    rows = books.labelled(spark, sf, ["tenure", "MonthlyCharges", "Contract", "PaymentMethod", "TechSupport"])
    return report.playbook_table(playbook.pillars(rows, BOOK_PROFILE)).select("priority", "recommended_actions")


def _playbook_table_sql() -> str:
    rows = " UNION ALL ".join(
        "SELECT '{}' AS priority, '{}' AS recommended_actions WHERE EXISTS (SELECT 1 FROM book WHERE {})".format(
            p["priority"], " | ".join(p["recommended_actions"]).replace("{column}", PILLAR_SOURCES[kind]),
            {"contract": "Contract IS NOT NULL", "early": "tenure <= 6", "payment": "PaymentMethod IS NOT NULL",
             "support": "contains(lower(TechSupport), 'no')"}[kind],
        )
        for kind, p in playbook.PILLARS.items()
    )
    return sql(rows)


def playbook_summary(spark, sf):
    rows = books.labelled(spark, sf, ["tenure", "MonthlyCharges", "Contract", "PaymentMethod", "TechSupport"])
    return playbook.playbook_summary(rows, playbook.pillars(rows, BOOK_PROFILE))


# events as an activity log: the type gives category and level
LEVELS = {"error": "critical", "click": "warning", "purchase": "success"}


def event_log(spark, sf, types=None):
    """The log of all events, or of some types; the filter is on the stored column, so the scan can skip."""
    kind = F.col("event_type")
    level = F.lit("info")
    for name, mark in LEVELS.items():
        level = F.when(kind == name, mark).otherwise(level)
    events = books.table(spark, sf, "events")
    events = events if types is None else events.where(kind.isin(types))
    return events.select(
        "ts", F.upper(kind).alias("category"), level.alias("level"), kind.alias("title"),
        F.col("props").alias("detail"), F.col("user_id").cast("string").alias("account_id"),
    )


EVENT_LOG = """log AS (SELECT ts, upper(event_type) AS category,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'warning' WHEN 'purchase' THEN 'success' ELSE 'info' END AS level,
  event_type AS title, props AS detail, cast(user_id AS varchar) AS account_id FROM events)"""


def activity_summary(spark, sf):
    return activity.summary(event_log(spark, sf))


def activity_filter(spark, sf):
    return activity.feed(event_log(spark, sf, ["error", "signup"]), ["ERROR", "SIGNUP"])


QUERIES = {
    "portfolio_kpis": (portfolio_kpis, sql(KPIS)),
    "executive_summary": (executive_summary, sql(EXECUTIVE, F1, f"k AS ({KPIS})")),
    "churn_mix": (churn_mix, sql(
        "SELECT 'Active (Retained)' AS label, cast(sum(1 - _y) AS bigint) AS value FROM book "
        "UNION ALL SELECT 'Churned', cast(sum(_y) AS bigint) FROM book")),
    "segment_lift": (_segments, _seg_sql("SELECT * FROM flagged")),
    "high_risk_segments": (high_risk_segments, _seg_sql("SELECT * FROM flagged WHERE is_high_risk")),
    "segment_by_population": (segment_by_population, _seg_sql(
        'SELECT *, cast(row_number() OVER (PARTITION BY "column" ORDER BY customers DESC, segment) AS int) AS place FROM flagged')),
    "segment_by_lift": (segment_by_lift, _seg_sql(
        'SELECT *, cast(row_number() OVER (PARTITION BY "column" ORDER BY lift DESC, segment) AS int) AS place FROM flagged')),
    "segment_lift_wide": (segment_lift_wide, sql("SELECT * FROM flagged", F1, WIDE_SEGMENTS)),
    "class_profile_wide": (class_profile_wide, sql(" UNION ALL ".join(
        f"""SELECT '{c}' AS "column", avg(account_id % {i + 7}) FILTER (_y = 0) AS retained_mean,
            avg(account_id % {i + 7}) FILTER (_y = 1) AS churned_mean FROM book""" for i, c in enumerate(WIDE_NUMBERS)))),
    "segment_risk_matrix": (segment_risk_matrix, _seg_sql(
        "SELECT *, CASE WHEN lift > 0.10::double THEN 'high' WHEN lift > 0.02::double THEN 'medium' END AS severity FROM flagged")),
    "churn_rate_by_column": (churn_rate_by_column, sql(
        "SELECT Contract AS segment, sum(_y) / count(*) AS churn_rate, count(*) AS customers FROM book "
        "WHERE Contract IS NOT NULL GROUP BY 1")),
    "segment_lift_documents": (segment_lift_documents, DOC_SEGMENTS),
    "tenure_buckets": (tenure_buckets, sql(_bucket_sql("_y"))),
    "tenure_buckets_recency": (tenure_buckets_recency, sql(_bucket_sql("churned"), F2)),
    "class_numeric_profile": (class_numeric_profile, sql(
        CLASS_PROFILE, F1, f"long AS ({stacked(NUMS, 'book', '_y', 'double')})")),
    "worst_cohort": (worst_cohort, _cohort_sql("SELECT * REPLACE (cast(revenue AS double) AS revenue) FROM worst", TWO)),
    "cohort_revenue": (cohort_revenue, sql(
        "SELECT Contract AS segment, cast(sum(_y) AS bigint) AS churners, "
        "cast(coalesce(sum(CASE WHEN _y = 1 THEN cast(MonthlyCharges AS decimal(20,4)) END), 0) * 12 AS double) AS annual_revenue "
        "FROM book WHERE Contract IS NOT NULL GROUP BY 1")),
    "early_tenure_cohort": (early_tenure_cohort, _filtered("tenure <= 6")),
    "no_addon_cohort": (no_addon_cohort, _filtered("contains(lower(TechSupport), 'no')")),
    "label_filter": (label_filter, sql("SELECT account_id, tenure, Contract FROM book WHERE _y = 1")),
    "playbook_pillars": (playbook_pillars, _pillar_sql()),
    "playbook_table": (playbook_table, _playbook_table_sql()),
    "playbook_summary": (playbook_summary, sql(
        "SELECT count(*) AS total_customers, round(sum(_y) / count(*), 4) AS portfolio_churn_rate, "
        "cast(any_value(EXISTS (SELECT 1 FROM book WHERE Contract IS NOT NULL))::int + any_value(EXISTS (SELECT 1 FROM book WHERE tenure <= 6))::int "
        "+ any_value(EXISTS (SELECT 1 FROM book WHERE PaymentMethod IS NOT NULL))::int "
        "+ any_value(EXISTS (SELECT 1 FROM book WHERE contains(lower(TechSupport), 'no')))::int AS bigint) AS pillars_count FROM book")),
    "activity_summary": (activity_summary, f"""WITH {EVENT_LOG} SELECT count(*) AS total,
  count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'warning') AS warning,
  count(*) FILTER (level = 'success') AS success FROM log"""),
    "activity_filter": (activity_filter, f"WITH {EVENT_LOG} SELECT * FROM log WHERE category IN ('ERROR', 'SIGNUP')"),
}
