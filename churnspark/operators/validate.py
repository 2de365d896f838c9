"""Data-quality checks over a raw extract."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL, outcome
from churnspark.functions.stats import correlation
from churnspark.functions.text import is_missing, named
from churnspark.operators.clean import number_column
from churnspark.operators.profile import TableProfile, exact_distinct, profile

# Limits of the checks.
MIN_TRAIN_ROWS = 40
SMALL_ROWS = 100
BALANCE = (0.05, 0.95)
MAX_MISSING = 0.40
CARDINALITY = (60, 0.30)
LEAK_CORRELATION = 0.98

CHECK_SCHEMA = "check string, status string, metric double, message string"


@dataclass
class ValidationReport:
    status: str
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    checks: list[tuple[str, str, float | None, str]] = field(default_factory=list)
    profile: TableProfile | None = None

    @property
    def is_valid(self) -> bool:
        return not self.errors

    def to_dict(self) -> dict:
        out = asdict(self)
        out["is_valid"] = self.is_valid
        out["rows"] = self.profile.rows if self.profile else 0
        out["columns"] = self.profile.columns if self.profile else []
        return out

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.checks, CHECK_SCHEMA)


def duplicate_count(df: DataFrame, id_column: str) -> DataFrame:
    """One row: rows, distinct_ids (null counts as one value), duplicates.

    A repeated id collapses to one partial count per task before the shuffle.
    """
    ids = df.groupBy(named(id_column)).agg(F.count(F.lit(1)).alias("n"))
    totals = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_ids"))
    return totals.withColumn("duplicates", F.col("rows") - F.col("distinct_ids"))


def leak_correlations(cleaned: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    """(column, complete, std, corr, is_leak) per numeric column, one pass."""
    wide = cleaned.agg(
        F.count(F.lit(1)).alias("rows"),
        *[agg.alias(f"{tag}{i}") for i, c in enumerate(columns) for tag, agg in (
            ("n", F.count(named(c))), ("s", F.stddev_samp(named(c))),
            ("r", correlation(named(c), named(label))),
        )],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"), (F.col(f"n{i}") == F.col("rows")).alias("complete"),
            F.col(f"s{i}").alias("std"), F.col(f"r{i}").alias("corr"),
        )
        for i, c in enumerate(columns)
    ]
    leak = F.col("complete") & (F.col("std") > 0) & (F.abs("corr") > F.lit(LEAK_CORRELATION))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn(
        "is_leak", F.coalesce(leak, F.lit(False))
    )


def metrics(df: DataFrame, prof: TableProfile, training: bool = True) -> DataFrame:
    """One row with everything the checks need, one pass over the extract.

    rows, missing<i> per feature; when training also churned, retained, unread (outcome
    texts not recognised) and n<i>, s<i>, r<i> (count, std, correlation) per numeric column.
    """
    # parsed once in a projection, then used by several aggregates
    parts = [is_missing(named(c), df.schema[c].dataType).alias(f"m{i}") for i, c in enumerate(prof.all_features)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(F.col(f"m{i}")).alias(f"missing{i}") for i in range(len(prof.all_features))]
    if training and prof.target:
        y, unread = outcome(named(prof.target), prof.target_kind)
        parts += [y.alias("y"), unread.alias("u")]
        parts += [number_column(df, prof, c).alias(f"x{i}") for i, c in enumerate(prof.numeric)]
        aggs += [F.count_if(F.col("y") == k).alias(tag) for k, tag in ((1, "churned"), (0, "retained"))]
        aggs.append(F.count_if("u").alias("unread"))
        for i in range(len(prof.numeric)):
            aggs += [
                F.count(f"x{i}").alias(f"n{i}"), F.stddev_samp(f"x{i}").alias(f"s{i}"),
                correlation(F.col(f"x{i}"), F.col("y")).alias(f"r{i}"),
            ]
    return df.select(*parts).agg(*aggs)


def _wide_columns(df: DataFrame, prof: TableProfile) -> dict[str, int]:
    """Exact distinct counts of the categorical columns over both limits; the sketch only picks candidates."""
    count, share = CARDINALITY
    maybe = [c for c in prof.categorical if prof.distinct.get(c, 0) > count / 2]
    if not maybe:
        return {}
    exact = {r["column"]: r["n_distinct"] for r in exact_distinct(df, maybe).collect()}
    return {c: exact[c] for c in maybe if exact[c] > count and exact[c] > share * prof.rows}


def facts(df: DataFrame, prof: TableProfile, training: bool) -> dict:
    """Every figure the checks speak of, from the one-row aggregate and the profile."""
    m = metrics(df, prof, training).first()
    rows, columns = m["rows"], prof.columns
    missing = {c: m[f"missing{i}"] for i, c in enumerate(prof.all_features)}
    heavy = {c: n / rows for c, n in missing.items() if n > MAX_MISSING * rows}
    wide = _wide_columns(df, prof)
    labelled = bool(training and prof.target)
    mirrors = {
        c: abs(m[f"r{i}"]) for i, c in enumerate(prof.numeric)
        if m[f"n{i}"] == rows and (m[f"s{i}"] or 0) > 0 and abs(m[f"r{i}"] or 0) > LEAK_CORRELATION
    } if labelled else {}
    churned, retained = (m["churned"], m["retained"]) if labelled else (0, 0)
    return {
        "rows": rows, "training": training, "labelled": labelled, "target": prof.target, "id": prof.id_column,
        "columns": ", ".join(columns[:10]) + (f", … {len(columns) - 10} more" if len(columns) > 10 else ""),
        "churned": churned, "retained": retained, "rate": churned / rows, "classes": (churned > 0) + (retained > 0),
        "unread": m["unread"] if labelled else 0,
        "copies": duplicate_count(df, prof.id_column).first()["duplicates"] if prof.id_column else 0,
        "features": len(prof.all_features), "numeric": len(prof.numeric), "categorical": len(prof.categorical),
        "gaps": sum(missing.values()), "n_heavy": len(heavy), "heavy": ", ".join(f"{c} ({s:.0%})" for c, s in heavy.items()),
        "n_wide": len(wide), "wide": ", ".join(f"{c} ({n} distinct)" for c, n in wide.items()),
        "n_constant": len(prof.constant_columns), "constant": ", ".join(prof.constant_columns[:3]),
        "n_leaks": len(prof.leakage_columns), "leaks": ", ".join(prof.leakage_columns),
        "n_mirrors": len(mirrors), "mirrors": ", ".join(f"{c} ({r:.2f})" for c, r in mirrors.items()),
    }


@dataclass(frozen=True)
class Finding:
    """One outcome of a check: the SQL condition on the facts that leads to it, its status, figure and texts.

    The texts are templates over the facts; `notice` goes to the errors of a failure or to the warnings.
    """

    check: str
    when: str
    status: str
    figure: str | None
    message: str
    notice: str = ""


# Names of the checks and what they tell. Of the findings of one check the first that holds counts.
FINDINGS = [
    Finding("File Structure", "malformed > 0", "warning", "malformed", "{malformed:,} malformed lines",
            "{malformed:,} lines have too few or too many fields or an open quote; lines with too many fields or an open quote are left out."),
    Finding("Sample Size", f"training AND rows < {MIN_TRAIN_ROWS}", "fail", "rows", "{rows} rows, {least} are needed",
            "Insufficient data: {rows} rows, training needs {least}."),
    Finding("Sample Size", f"rows < {SMALL_ROWS}", "warning", "rows", "{rows} rows, a small sample", "Small sample of {rows} rows."),
    Finding("Sample Size", "true", "pass", "rows", "{rows:,} rows"),
    Finding("Feature Count", "features = 0", "fail", "features", "No feature left", "No column can serve as a feature."),
    Finding("Feature Count", "true", "pass", "features", "{features} features: {numeric} numeric, {categorical} categorical"),
    Finding("ID Uniqueness", "id IS NULL", "pass", None, "No identifier column; rows stand for themselves"),
    Finding("ID Uniqueness", "copies > 0", "warning", "copies", "{copies:,} repeated values in '{id}'",
            "{copies:,} duplicate identifiers in '{id}'; remove the copies."),
    Finding("ID Uniqueness", "true", "pass", "copies", "'{id}' is unique"),
    Finding("Missing Values", "n_heavy > 0", "warning", "n_heavy", "{n_heavy} column(s) mostly empty",
            "More than {gap_limit:.0%} missing in {heavy}; gaps will be filled."),
    Finding("Missing Values", "true", "pass", "gaps", "{gaps:,} missing entries in all features"),
    Finding("Categorical Cardinality", "n_wide > 0", "warning", "n_wide", "{n_wide} column(s) with very many values",
            "High cardinality: {wide}."),
    Finding("Categorical Cardinality", "true", "pass", "n_wide", "No categorical column is too wide"),
    Finding("Constant Columns", "n_constant > 0", "warning", "n_constant", "{n_constant} column(s) left out",
            "{n_constant} constant column(s), such as {constant}."),
    Finding("Data Leakage Prevention", "n_leaks > 0", "warning", "n_leaks", "{n_leaks} column(s) left out",
            "Known only after the outcome, by name: {leaks}."),
    Finding("Data Leakage Prevention", "true", "pass", "n_leaks", "No name points to the time after the outcome"),
    Finding("Target Column", "training AND NOT labelled", "fail", None, "No outcome column among: {columns}",
            "No churn target column detected among: {columns}."),
    Finding("Target Variance", "labelled AND classes = 1", "fail", "classes", "Only one class",
            "'{target}' has only 1 class; churned and retained rows are both needed."),
    Finding("Target Column", "labelled AND classes = 2", "pass", "rate",
            "'{target}': {rate:.1%} churned ({churned:,} of {rows:,})"),
    Finding("Class Balance", f"labelled AND classes = 2 AND rate NOT BETWEEN {BALANCE[0]} AND {BALANCE[1]}", "warning", "rate",
            "Far from even: {rate:.1%} churned", "Severe class imbalance: {rate:.1%} churned."),
    Finding("Class Balance", "labelled AND classes = 2", "pass", "rate", "Enough of both classes ({rate:.1%} churned)"),
    Finding("Target Labels", "labelled AND unread > 0", "warning", "unread", "{unread:,} outcomes not recognised",
            "{unread:,} outcome values were not recognised and count as retained."),
    Finding("Target Labels", "labelled", "pass", "unread", "All outcomes recognised"),
    Finding("Target Correlation", "labelled AND n_mirrors > 0", "warning", "n_mirrors", "{n_mirrors} column(s) mirror the outcome",
            "Correlation with the outcome above {leak_limit}: {mirrors}."),
    Finding("Target Correlation", "labelled", "pass", "n_mirrors", "No numeric column mirrors the outcome"),
]


def validate(df: DataFrame, filename: str = "", training: bool = True, prof: TableProfile | None = None, malformed: int = 0) -> ValidationReport:
    """Hold the facts of an extract against FINDINGS; a failure makes it unusable, a warning does not.

    `malformed` lines of the file are reported if there are any.
    """
    df = df.toDF(*[c.strip() for c in df.columns])
    if not df.columns or df.isEmpty():
        return ValidationReport("error", ["The file has no data rows."], [], [("File Content", "fail", 0.0, "No rows")])
    prof = prof or profile(df, filename, scoring_only=not training)
    known = facts(df, prof, training) | {"malformed": malformed}
    table = df.sparkSession.createDataFrame([tuple(known.values())], ", ".join(f"{k} {_SQL_TYPES[k]}" for k in known))
    holds = table.select(*[F.expr(f.when).alias(f"f{k}") for k, f in enumerate(FINDINGS)]).first()
    first: dict[str, Finding] = {}
    for k, f in enumerate(FINDINGS):
        if holds[f"f{k}"]:
            first.setdefault(f.check, f)
    texts = known | {"least": MIN_TRAIN_ROWS, "gap_limit": MAX_MISSING, "leak_limit": LEAK_CORRELATION}
    checks = [
        (f.check, f.status, None if f.figure is None else float(known[f.figure]), f.message.format(**texts)) for f in first.values()
    ]
    notices = {status: [f.notice.format(**texts) for f in first.values() if f.status == status] for status in ("fail", "warning")}
    status = "error" if notices["fail"] else "warning" if notices["warning"] else "valid"
    return ValidationReport(status, notices["fail"], notices["warning"], checks, prof)


_TEXTS = ("target", "id", "columns", "heavy", "wide", "constant", "leaks", "mirrors")
_SQL_TYPES = dict.fromkeys(_TEXTS, "string") | {"training": "boolean", "labelled": "boolean", "rate": "double"} | dict.fromkeys(
    ("rows", "churned", "retained", "classes", "unread", "copies", "features", "numeric", "categorical", "gaps",
     "n_heavy", "n_wide", "n_constant", "n_leaks", "n_mirrors", "malformed"), "bigint")
