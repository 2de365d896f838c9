"""Field profiles, cleaning, role inference and validation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from churnspark.functions.label import LABEL, outcome
from churnspark.functions.text import clean_category, clean_number, money_or_zero, named
from churnspark.operators import profile as prof_ops
from churnspark.operators import validate as val_ops
from churnspark.operators.clean import align, clean, features_and_label
from churnspark.plans.books_sql import BLANKS, F1, F3, label, number, sql, stacked
from churnspark.plans.diagnostics import BOOK_PROFILE
from churnspark.session import shared_folder
from churnspark.sources import books, files

CATS, NUMS = books.CATEGORICAL, books.NUMERIC
DIRTY = ["account_id", "MonthlyCharges", "Contract", "Churn", "const_col", "churn_date"]
DIRTY_PROFILE = prof_ops.TableProfile(
    target="Churn", id_column="account_id", numeric=["MonthlyCharges"], categorical=["Contract"],
    leakage_columns=["churn_date"], constant_columns=["const_col"], columns=DIRTY,
)


def _rounded(df, columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- profiles ---------------------------------------------------------------------------------


def five_number_by_class(spark, sf):
    out = prof_ops.five_numbers(books.labelled(spark, sf, ["tenure", "MonthlyCharges"]), ["tenure", "MonthlyCharges"], LABEL)
    return _rounded(out, ["min", "q25", "q50", "q75", "max"])


def _five(group: str) -> str:
    return f"""SELECT {group}, "column", round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
  round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max
FROM long GROUP BY ALL"""


def correlation_pairs(spark, sf):
    return _rounded(prof_ops.correlations(books.labelled(spark, sf, NUMS), [*NUMS, LABEL]), ["r"])


def _corr_sql() -> str:
    cols = [*NUMS, LABEL]
    return sql(" UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr(cast({a} AS double), cast({b} AS double)), 6) AS r FROM book" for a in cols for b in cols
    ))


def describe_columns(spark, sf):
    df = books.accounts(spark, sf)
    out = prof_ops.describe(df, NUMS, [*CATS, "Churn"])
    return _rounded(out, ["mean", "std", "min", "q25", "q50", "q75", "max"])


def _describe_sql() -> str:
    numeric = f"""SELECT "column", count(value) AS count, NULL::bigint AS "unique", NULL::varchar AS top, NULL::bigint AS freq,
  round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM nums GROUP BY 1"""
    texts = """SELECT "column", cast(sum(n) AS bigint), count(*), min_by(value, (-n, value)), max(n),
  NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM freq GROUP BY 1"""
    return sql(
        f"{numeric} UNION ALL {texts}", F1, f"nums AS ({stacked(NUMS, 'book', cast='double')})",
        f"""freq AS (SELECT "column", value, count(*) AS n FROM ({stacked([*CATS, 'Churn'], 'book')}) WHERE value IS NOT NULL GROUP BY 1, 2)""",
    )


def value_counts(spark, sf):
    return prof_ops.value_counts(books.accounts(spark, sf, ["Churn"]), "Churn")


def missing_by_column(spark, sf):
    return prof_ops.missing_counts(books.accounts(spark, sf))


def missing_by_column_dirty(spark, sf):
    return prof_ops.missing_counts(books.accounts_dirty(spark, sf))


def _missing_sql(columns, source, book) -> str:
    return sql(
        f'SELECT "column", count(*) AS missing FROM ({stacked(columns, source)}) WHERE value IS NULL GROUP BY 1', book
    )


def field_profile_numeric(spark, sf):
    return prof_ops.numeric_fields(books.accounts(spark, sf, NUMS), NUMS)


FIELDS = """SELECT "column" AS name, round(coalesce(min(value), 0), 2) AS min, round(coalesce(max(value), 100), 2) AS max,
  round(coalesce(avg(value), 0), 2) AS mean, round(coalesce(avg(value), 0), 2) AS "default" FROM long GROUP BY 1"""


def field_profile_categorical(spark, sf):
    return prof_ops.category_fields(books.accounts(spark, sf, CATS), CATS)


def field_profile_capped(spark, sf):
    """The first 50 options, as asked for."""
    return prof_ops.category_fields(books.table(spark, sf, "supplier"), ["s_name"], limit=50)


def field_profile_long(spark, sf):
    """A column with more than 50 distinct values, all of them."""
    return prof_ops.category_fields(books.table(spark, sf, "supplier"), ["s_name"])


def preview(spark, sf):
    return prof_ops.preview(books.accounts(spark, sf, ["account_id", *NUMS[:1], *CATS, "Churn"]), "account_id")


# --- cleaning ---------------------------------------------------------------------------------


def clean_numbers(spark, sf):
    df = books.accounts_dirty(spark, sf)
    return df.select("account_id", F.col("MonthlyCharges").alias("raw"), clean_number(F.col("MonthlyCharges")).alias("cleaned"))


def clean_categories(spark, sf):
    df = books.accounts_dirty(spark, sf)
    return df.select("account_id", F.col("Contract").alias("raw"), clean_category(F.col("Contract")).alias("cleaned"))


def normalize_target(spark, sf):
    y, unread = outcome(F.col("Churn"), "text")
    return books.accounts_dirty(spark, sf).select("account_id", F.col("Churn").alias("raw"), y.alias("label"), unread.alias("unrecognised"))


def normalize_target_flags(spark, sf):
    """An outcome told in words true and false, padded and in mixed case, as a CSV file has it."""
    rows = books.labelled(spark, sf, ["account_id"])
    told = rows.select("account_id", F.when(F.col("_y") == 1, F.lit(" True ")).otherwise(F.lit("FALSE")).alias("Churn"))
    y, unread = outcome(F.col("Churn"), prof_ops.profile(told).target_kind)
    return told.select("account_id", F.col("Churn").alias("raw"), y.alias("label"), unread.alias("unrecognised"))


def clean_extract(spark, sf):
    """The whole cleaned extract as the workspace stores it."""
    return clean(books.accounts_dirty(spark, sf), DIRTY_PROFILE)


CLEAN_CONTRACT = f"CASE WHEN trim(Contract, {BLANKS}) NOT IN ('nan', 'none', 'null') THEN trim(Contract, {BLANKS}) END"


def align_features(spark, sf):
    """Features the table lacks appear as nulls, the others cleaned, in model order."""
    return align(books.accounts_dirty(spark, sf), BOOK_PROFILE)


def feature_projection(spark, sf):
    """Features that are present, plus the label."""
    return features_and_label(clean(books.accounts(spark, sf, ["tenure", "MonthlyCharges", "Contract", "Region", "Churn"]), BOOK_PROFILE), BOOK_PROFILE)


def rich_currency(spark, sf):
    """Currency marks of several kinds added to the dirty amounts, then parsed."""
    key = F.col("account_id")
    mark = (
        F.when(key % 5 == 0, "₹").when(key % 5 == 1, "Rs. ").when(key % 5 == 2, "Rs").when(key % 5 == 3, "INR ").otherwise("")
    )
    df = books.accounts_dirty(spark, sf).withColumn("raw", F.concat(mark, F.col("MonthlyCharges")))
    return df.select("account_id", "raw", money_or_zero(F.col("raw")).alias("amount"))


CURRENCY = f"""SELECT account_id, raw, coalesce({number("replace(replace(replace(replace(raw, '₹', ''), 'Rs.', ''), 'Rs', ''), 'INR', '')")}, 0) AS amount
FROM (SELECT account_id, CASE account_id % 5 WHEN 0 THEN '₹' WHEN 1 THEN 'Rs. ' WHEN 2 THEN 'Rs' WHEN 3 THEN 'INR ' ELSE '' END || MonthlyCharges AS raw FROM dirty)"""


def csv_roundtrip(spark, sf):
    """Write the dirty book as CSV, read it back as text with the missing tokens set to null."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(books.accounts_dirty(spark, sf), path)
    return files.read_csv(spark, path)


CSV_BACK = "SELECT * REPLACE (cast(account_id AS varchar) AS account_id) FROM dirty"


def parquet_roundtrip(spark, sf):
    path = f"{shared_folder(spark)}/parquet-{uuid.uuid4().hex}"
    files.write_parquet(books.accounts(spark, sf), path)
    return files.read_parquet(spark, path)


MALFORMED = ["account_id", "Contract", "Region"]


def csv_malformed(spark, sf):
    """The book as CSV lines, some cut, some with a field too many, some with an open quote: rows and what is wrong with them."""
    rows = books.accounts(spark, sf).select(*MALFORMED).na.fill("", MALFORMED[1:])
    whole = F.concat_ws(",", *MALFORMED)
    line = (
        F.when(F.expr("account_id % 7 = 1"), F.concat(whole, F.lit(",one more")))
        .when(F.expr("account_id % 7 = 2"), F.concat_ws(",", "account_id", "Contract"))
        .when(F.expr("account_id % 7 = 3"), F.concat(F.col("account_id"), F.lit(',"'), F.concat_ws(",", "Contract", "Region")))
        .when(F.expr("account_id % 7 = 4"), F.concat(F.col("account_id"), F.lit(',"a ""b"", c",'), "Region"))
        .otherwise(whole)
    )
    path = f"{shared_folder(spark)}/csv-lines-{uuid.uuid4().hex}"
    rows.select(line.alias("line")).write.text(path)
    found, mark = files.read_csv_checked(spark, path, MALFORMED)
    sound = F.coalesce(F.col(mark), F.lit("short")) == "short"
    return found.select("account_id", *[F.when(sound, F.col(c)).alias(c) for c in MALFORMED[1:]], F.col(mark).alias("malformed"))


CSV_MALFORMED = """SELECT cast(account_id AS varchar) AS account_id,
    CASE WHEN account_id % 7 IN (1, 3) THEN NULL WHEN account_id % 7 = 4 THEN 'a "b", c' ELSE Contract END AS Contract,
    CASE WHEN account_id % 7 IN (1, 2, 3) THEN NULL ELSE Region END AS Region,
    CASE account_id % 7 WHEN 1 THEN 'long' WHEN 2 THEN 'short' WHEN 3 THEN 'quote' END AS malformed FROM f1"""


# --- inference and validation --------------------------------------------------------------------


def numeric_parse_ratio(spark, sf):
    df = books.accounts_dirty(spark, sf)
    types = {f.name: f.dataType for f in df.schema}
    wide = df.agg(*[prof_ops.parse_ratio(named(c), types[c]).cast("double").alias(c) for c in DIRTY])
    return wide.unpivot([], DIRTY, "column", "ratio")


def _ratio_sql() -> str:
    return sql(
        f'SELECT "column", count({number("value")}) / count(value) AS ratio FROM long GROUP BY 1', F3,
        f"long AS ({stacked(DIRTY, 'dirty')})",
    )


def distinct_profile(spark, sf):
    return prof_ops.exact_distinct(books.accounts_dirty(spark, sf), DIRTY)


DISTINCT = """SELECT "column", count(DISTINCT value) AS n_distinct, count(*) AS n_rows, count(*) - count(value) AS n_missing
FROM long GROUP BY 1"""


def column_roles(spark, sf):
    """The inferred role of every column of the dirty book."""
    return spark.createDataFrame(prof_ops.profile(books.accounts_dirty(spark, sf)).roles(), "column string, role string")


ROLES = f"""SELECT "column", CASE WHEN "column" = 'Churn' THEN 'target' WHEN "column" = 'account_id' THEN 'identifier'
  WHEN contains(replace("column", '_', ''), 'churndate') THEN 'leakage'
  WHEN count(DISTINCT value) <= 1 THEN 'constant'
  WHEN count({number("value")}) / count(value) >= 0.8 THEN 'numeric' ELSE 'categorical' END AS role
FROM long GROUP BY 1"""


def duplicate_ids(spark, sf):
    return val_ops.duplicate_count(books.accounts_dirty(spark, sf), "account_id")


def validation_metrics(spark, sf):
    """The one-row aggregate behind the checks."""
    row = val_ops.metrics(books.accounts_dirty(spark, sf), DIRTY_PROFILE)
    return _rounded(row, ["s0", "r0"])


VALIDATION = f"""SELECT count(*) AS rows, count(*) - count(MonthlyCharges) AS missing0, count(*) - count(Contract) AS missing1,
  cast(sum(y) AS bigint) AS churned, cast(sum(1 - y) AS bigint) AS retained,
  cast(sum(CASE WHEN lower(trim(Churn)) IN ('yes', 'no') THEN 0 ELSE 1 END) AS bigint) AS unread,
  count(x) AS n0, round(stddev_samp(x), 6) AS s0, round(corr(x, cast(y AS double)), 6) AS r0
FROM (SELECT *, {label("Churn")} AS y, {number("MonthlyCharges")} AS x FROM dirty)"""


def validation_checks(spark, sf):
    """Check, status and figure of the whole suite on the dirty book."""
    report = val_ops.validate(books.accounts_dirty(spark, sf))
    return report.table(spark).select("check", "status", F.round("metric", 6).alias("metric"))


CHECK_FIGURES = f"""d AS (SELECT *, {label("Churn")} AS y, {number("MonthlyCharges")} AS x FROM dirty),
m AS (SELECT count(*) AS n, sum(y) / count(*) AS rate, count(DISTINCT account_id) AS ids,
   sum(CASE WHEN lower(trim(Churn)) IN ('yes', 'no') THEN 0 ELSE 1 END) AS unread,
   (count(*) - count(MonthlyCharges)) AS miss0, (count(*) - count(Contract)) AS miss1,
   count(DISTINCT Contract) AS card, count(x) = count(*) AND abs(corr(x, y)) > 0.98 AS leak FROM d)"""

CHECKS = """SELECT 'Target Column' AS "check", 'pass' AS status, round(rate, 6) AS metric FROM m
UNION ALL SELECT 'Class Balance', CASE WHEN rate BETWEEN 0.05 AND 0.95 THEN 'pass' ELSE 'warning' END, round(rate, 6) FROM m
UNION ALL SELECT 'Target Labels', CASE WHEN unread > 0 THEN 'warning' ELSE 'pass' END, unread FROM m
UNION ALL SELECT 'Sample Size', CASE WHEN n < 40 THEN 'fail' WHEN n < 100 THEN 'warning' ELSE 'pass' END, n FROM m
UNION ALL SELECT 'ID Uniqueness', CASE WHEN n > ids THEN 'warning' ELSE 'pass' END, n - ids FROM m
UNION ALL SELECT 'Feature Count', 'pass', 2 FROM m
UNION ALL SELECT 'Missing Values', CASE WHEN greatest(miss0, miss1) > 0.4 * n THEN 'warning' ELSE 'pass' END,
  CASE WHEN greatest(miss0, miss1) > 0.4 * n THEN (miss0 > 0.4 * n)::int + (miss1 > 0.4 * n)::int ELSE miss0 + miss1 END FROM m
UNION ALL SELECT 'Categorical Cardinality', CASE WHEN card > 60 AND card > 0.3 * n THEN 'warning' ELSE 'pass' END, (card > 60 AND card > 0.3 * n)::int FROM m
UNION ALL SELECT 'Constant Columns', 'warning', 1 FROM m
UNION ALL SELECT 'Data Leakage Prevention', 'warning', 1 FROM m
UNION ALL SELECT 'Target Correlation', CASE WHEN leak THEN 'warning' ELSE 'pass' END, leak::int FROM m"""


def leak_correlation(spark, sf):
    """The book with a planted copy of the label among its numeric columns."""
    df = books.labelled(spark, sf, NUMS).withColumn("mirror", F.col(LABEL) * 3.0 + 1.0)
    return _rounded(val_ops.leak_correlations(df, [*NUMS, "mirror"]), ["std", "corr"])


LEAK = """SELECT "column", count(value) = count(*) AS complete, round(stddev_samp(value), 6) AS std,
  round(corr(value, cast(_y AS double)), 6) AS corr,
  count(value) = count(*) AND stddev_samp(value) > 0 AND abs(corr(value, cast(_y AS double))) > 0.98 AS is_leak FROM long GROUP BY 1"""

QUERIES = {
    "five_number_by_class": (five_number_by_class, sql(
        _five("_y"), F1, f"long AS ({stacked(['tenure', 'MonthlyCharges'], 'book', '_y', 'double')})")),
    "correlation_pairs": (correlation_pairs, _corr_sql()),
    "describe_columns": (describe_columns, _describe_sql()),
    "value_counts": (value_counts, sql("SELECT Churn AS value, count(*) AS count FROM book GROUP BY 1")),
    "missing_by_column": (missing_by_column, _missing_sql(books.ACCOUNT_COLUMNS, "book", F1)),
    "missing_by_column_dirty": (missing_by_column_dirty, _missing_sql(DIRTY, "dirty", F3)),
    "field_profile_numeric": (field_profile_numeric, sql(FIELDS, F1, f"long AS ({stacked(NUMS, 'book', cast='double')})")),
    "field_profile_categorical": (field_profile_categorical, sql(
        """SELECT "column", cast(row_number() OVER (PARTITION BY "column" ORDER BY value) AS int) AS position, value,
           row_number() OVER (PARTITION BY "column" ORDER BY value) = 1 AS is_default
           FROM (SELECT DISTINCT "column", value FROM long WHERE value IS NOT NULL)""",
        F1, f"long AS ({stacked(CATS, 'book')})")),
    "field_profile_capped": (field_profile_capped,
        """SELECT 's_name' AS "column", cast(row_number() OVER (ORDER BY s_name) AS int) AS position, s_name AS value,
           row_number() OVER (ORDER BY s_name) = 1 AS is_default FROM (SELECT DISTINCT s_name FROM supplier)
           QUALIFY row_number() OVER (ORDER BY s_name) <= 50"""),
    "field_profile_long": (field_profile_long,
        """SELECT 's_name' AS "column", cast(row_number() OVER (ORDER BY s_name) AS int) AS position, s_name AS value,
           row_number() OVER (ORDER BY s_name) = 1 AS is_default FROM (SELECT DISTINCT s_name FROM supplier)"""),
    "normalize_target_flags": (normalize_target_flags, sql(
        "SELECT account_id, CASE _y WHEN 1 THEN ' True ' ELSE 'FALSE' END AS raw, _y AS label, false AS unrecognised FROM book")),
    "preview": (preview, sql(
        "SELECT " + ", ".join(f"coalesce(cast({c} AS varchar), '') AS {c}" for c in ["account_id", "tenure", *CATS, "Churn"])
        + " FROM book QUALIFY row_number() OVER (ORDER BY book.account_id) <= 15")),
    "clean_numbers": (clean_numbers, sql(
        f"SELECT account_id, MonthlyCharges AS raw, {number('MonthlyCharges')} AS cleaned FROM dirty", F3)),
    "clean_categories": (clean_categories, sql(f"SELECT account_id, Contract AS raw, {CLEAN_CONTRACT} AS cleaned FROM dirty", F3)),
    "normalize_target": (normalize_target, sql(
        f"SELECT account_id, Churn AS raw, {label('Churn')} AS label, lower(trim(Churn)) NOT IN ('yes', 'no') AS unrecognised FROM dirty", F3)),
    "clean_extract": (clean_extract, sql(
        f"SELECT account_id, {number('MonthlyCharges')} AS MonthlyCharges, {CLEAN_CONTRACT} AS Contract, Churn, const_col, churn_date, "
        f"{label('Churn')} AS _y FROM dirty", F3)),
    "align_features": (align_features, sql(
        f"SELECT NULL::double AS tenure, {number('MonthlyCharges')} AS MonthlyCharges, NULL::double AS line_items, NULL::double AS total_units, "
        f"{CLEAN_CONTRACT} AS Contract, NULL::varchar AS PaymentMethod, NULL::varchar AS TechSupport, NULL::varchar AS Region FROM dirty", F3)),
    "feature_projection": (feature_projection, sql(
        "SELECT cast(tenure AS double) AS tenure, MonthlyCharges, Contract, Region, _y FROM book")),
    "rich_currency": (rich_currency, sql(CURRENCY, F3)),
    "csv_roundtrip": (csv_roundtrip, sql(CSV_BACK, F3)),
    "csv_malformed": (csv_malformed, sql(CSV_MALFORMED)),
    "parquet_roundtrip": (parquet_roundtrip, sql("SELECT * FROM f1")),
    "numeric_parse_ratio": (numeric_parse_ratio, _ratio_sql()),
    "distinct_profile": (distinct_profile, sql(DISTINCT, F3, f"long AS ({stacked(DIRTY, 'dirty')})")),
    "column_roles": (column_roles, sql(ROLES, F3, f"long AS ({stacked(DIRTY, 'dirty')})")),
    "duplicate_ids": (duplicate_ids, sql(
        "SELECT count(*) AS rows, count(DISTINCT account_id) AS distinct_ids, count(*) - count(DISTINCT account_id) AS duplicates FROM dirty", F3)),
    "validation_metrics": (validation_metrics, sql(VALIDATION, F3)),
    "validation_checks": (validation_checks, sql(CHECKS, F3, CHECK_FIGURES)),
    "leak_correlation": (leak_correlation, sql(
        LEAK, F1, f"long AS ({stacked(NUMS, 'book', '_y', 'double')} UNION ALL SELECT 'mirror', _y * 3.0::double + 1.0::double, _y FROM book)")),
}
