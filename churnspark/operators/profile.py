"""Column roles and field profiles."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark.functions.text import clean_number, is_missing, named, norm_name, strip
from churnspark.operators.moments import pair_moments
from churnspark.operators.summary import frequencies, long_text, numeric_summary, text_summary

# Column names read as the outcome (compared after norm_name).
TARGET_NAMES = [
    "churn", "exited", "attrition", "left", "is_churn", "churned", "cancelled",
    "canceled", "target", "status", "churn_label", "churn_flag",
    "attrition_flag", "customer_status", "churn_status", "churn_value",
    "churn_indicator", "is_attrited", "has_churned", "did_churn", "is_churned",
    "lost_customer", "churn_risk", "retention_status", "retention_flag",
    "attrited", "churned_customer", "customer_churn", "churn_binary",
    "churn_yn", "churn_yes_no", "cancellation_status", "attrition_status",
    "churn_category", "churn_class", "churn_state", "churn_event",
]
# Parts of a name that suggest the outcome, and parts that rule it out.
TARGET_PARTS = ["churn", "attrit", "exited", "canceld", "cancell"]
NOT_TARGET_PARTS = ["date", "reason", "time", "day", "month", "year", "timestamp", "code", "notes", "comment"]
# Cell values that suggest an outcome column, and names that rule it out.
TARGET_YES = [
    "yes", "y", "true", "1", "1.0", "churn", "churned", "attrited",
    "attrited customer", "exited", "cancelled", "canceled", "left", "lost",
    "closed", "terminated", "t",
]
TARGET_NO = [
    "no", "n", "false", "0", "0.0", "stay", "stayed", "active", "retained",
    "existing customer", "current", "joined", "renewed", "open", "f",
]
ATTRIBUTE_PARTS = [
    "gender", "sex", "partner", "depend", "phone", "bill", "senior", "tech",
    "stream", "backup", "protect", "device", "paper",
]
# Column names read as the identifier, and parts a unique column must show.
ID_NAMES = [
    "customerid", "customer_id", "userid", "user_id", "id", "accountid",
    "account_id", "client_id", "clientid", "subscriber_id", "subscriberid",
    "sub_id", "cust_id", "member_id", "memberid",
]
ID_PARTS = ["id", "code", "num", "key", "account"]
# Parts of names that give away post-outcome information.
LEAKAGE_NAMES = [
    "churn_date", "cancellation_date", "cancel_date", "exit_date",
    "churn_reason", "cancellation_reason", "cancel_reason", "exit_reason",
    "refund_after_cancel", "termination_code", "status_after_churn",
    "account_closed", "closed_date", "closure_date", "deactivation_date",
    "disconnection_date", "cancellation", "churned_date",
]
# Parts of names read as dates.
DATE_PARTS = ["date", "time", "timestamp", "created", "signup", "joined"]

NUMERIC_FROM = 0.80


@dataclass
class TableProfile:
    """What each column is. Driver-side metadata, kept as JSON next to the data."""

    target: str = ""
    target_kind: str = "text"
    id_column: str | None = None
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    date_columns: list[str] = field(default_factory=list)
    leakage_columns: list[str] = field(default_factory=list)
    constant_columns: list[str] = field(default_factory=list)
    flag_columns: list[str] = field(default_factory=list)
    distinct: dict[str, int] = field(default_factory=dict)
    filename: str = ""
    rows: int = 0
    columns: list[str] = field(default_factory=list)

    @property
    def all_features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def roles(self) -> list[tuple[str, str]]:
        groups = {
            "numeric": self.numeric, "categorical": self.categorical, "date": self.date_columns,
            "leakage": self.leakage_columns, "constant": self.constant_columns,
            "target": [self.target], "identifier": [self.id_column],
        }
        role = {name: kind for kind, names in groups.items() for name in names}
        return [(name, role[name]) for name in self.columns]

    def to_json(self) -> str:
        return json.dumps({**asdict(self), "all_features": self.all_features})

    @classmethod
    def from_json(cls, text: str) -> TableProfile:
        values = json.loads(text)
        values.pop("all_features", None)
        return cls(**values)


def target_by_name(columns: Sequence[str]) -> str | None:
    known = {norm_name(n) for n in TARGET_NAMES}
    by_alias = next((c for c in columns if norm_name(c) in known), None)
    if by_alias is not None:
        return by_alias
    return next(
        (
            c for c in columns
            if not any(p in norm_name(c) for p in NOT_TARGET_PARTS) and any(p in norm_name(c) for p in TARGET_PARTS)
        ),
        None,
    )


def target_by_values(columns: Sequence[str], values: dict[str, set[str]]) -> str | None:
    """First column with 1–3 texts that read like an outcome and a name that does not rule it out."""
    for name in columns:
        seen = values.get(name, set())
        if not 1 <= len(seen) <= 3 or any(p in norm_name(name) for p in ATTRIBUTE_PARTS):
            continue
        if seen & set(TARGET_YES) and (seen & set(TARGET_NO) or len(seen) == 1):
            return name
    return None


def id_by_name(columns: Sequence[str]) -> str | None:
    known = {norm_name(n) for n in ID_NAMES}
    return next((c for c in columns if norm_name(c) in known), None)


def is_leakage_name(name: str) -> bool:
    return any(norm_name(k) in norm_name(name) for k in LEAKAGE_NAMES)


def is_date_name(name: str) -> bool:
    return any(k in norm_name(name) for k in DATE_PARTS)


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct, n_rows, n_missing), nulls not counted as a value.

    Two-step: equal values collapse before the shuffle, so a value holding a third
    of the rows arrives as a few partial counts.
    """
    counted = long_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column").agg(
        F.count("value").alias("n_distinct"),
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
    )


def _word(col: Column) -> Column:
    return F.lower(strip(col.cast("string")))


def parse_ratio(col: Column, dtype: T.DataType) -> Column:
    """Share of the non-null values that read as numbers (1 for numeric types)."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.when(F.count(col) > 0, 1.0)
    ok = F.count_if(clean_number(col, dtype).isNotNull())
    return ok / F.nullif(F.count(col), F.lit(0))


def profile(df: DataFrame, filename: str = "", scoring_only: bool = False) -> TableProfile:
    """Infer column roles.

    One aggregate without a wide shuffle answers almost everything: a column is
    constant when its minimum equals its maximum, distinct counts are sketches. Exact
    sets or counts are fetched only where a decision hangs on them (an unnamed
    outcome column, an unnamed identifier).
    """
    df = df.toDF(*[c.strip() for c in df.columns])
    types = {f.name: f.dataType for f in df.schema}
    columns = list(df.columns)
    target = None if scoring_only else target_by_name(columns)
    by_value = target is None and not scoring_only
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        col, dtype = named(name), types[name]
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            col = F.when(~F.isnan(col), col)
        aggs += [
            F.count(col).alias(f"n{i}"),
            F.approx_count_distinct(col).alias(f"d{i}"),
            F.min(col).eqNullSafe(F.max(col)).alias(f"same{i}"),
            parse_ratio(col, dtype).alias(f"p{i}"),
        ]
        if isinstance(dtype, T.StringType):
            aggs.append((F.count_if(_word(col).isin("true", "false")) == F.count(col)).alias(f"flag{i}"))
        if by_value:
            aggs.append(F.approx_count_distinct(_word(col)).alias(f"w{i}"))
    row = df.agg(*aggs).first()
    rows = row["rows"]
    at = {name: i for i, name in enumerate(columns)}

    if by_value:
        # The sketch only picks candidates, at twice the size that can matter; the sets themselves decide.
        few = [c for c in columns if row[f"n{at[c]}"] > 0 and row[f"w{at[c]}"] <= 12]
        if few:
            sets = df.agg(*[F.collect_set(_word(named(c))).alias(f"s{at[c]}") for c in few]).first()
            target = target_by_values(columns, {c: set(sets[f"s{at[c]}"]) for c in few})

    id_column = id_by_name(columns)
    if id_column is None and rows > 10:
        maybe = [
            c for c in columns
            if c != target and any(p in c.lower() for p in ID_PARTS)
            and row[f"n{at[c]}"] == rows and row[f"d{at[c]}"] >= 0.5 * rows
        ]
        if maybe:
            unique = {
                r["column"] for r in exact_distinct(df, maybe).where("n_distinct = n_rows").collect()
            }
            id_column = next((c for c in maybe if c in unique), None)

    out = TableProfile(
        target=target or "", id_column=id_column, filename=filename, rows=rows, columns=columns,
        distinct={c: int(row[f"d{at[c]}"]) for c in columns},
    )
    for name in columns:
        i, dtype = at[name], types[name]
        flags = isinstance(dtype, T.BooleanType) or (
            isinstance(dtype, T.StringType) and row[f"n{i}"] > 0 and row[f"flag{i}"]
        )
        ratio = row[f"p{i}"] or 0.0
        if name == target:
            numeric = isinstance(dtype, T.NumericType) or ratio == 1.0
            # words true and false are in the lists of outcome texts; only a real boolean is cast
            out.target_kind = "boolean" if isinstance(dtype, T.BooleanType) else "numeric" if numeric else "text"
            continue
        if name == id_column:
            continue
        numeric = isinstance(dtype, T.NumericType) or ratio >= NUMERIC_FROM
        if is_leakage_name(name):
            out.leakage_columns.append(name)
        elif row[f"same{i}"]:
            out.constant_columns.append(name)
        elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) or (
            is_date_name(name) and not numeric
        ):
            out.date_columns.append(name)
        elif flags:
            out.numeric.append(name)
            out.flag_columns.append(name)
        elif numeric:
            out.numeric.append(name)
        else:
            out.categorical.append(name)
    return out


# --- field profiles -------------------------------------------------------------------------


def numeric_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, mean (2 places) and default per numeric column; 0/100/0 when empty."""
    wide = [
        agg(F.when(~F.isnan(named(c).cast("double")), named(c).cast("double"))).alias(f"{tag}{i}")
        for i, c in enumerate(columns) for tag, agg in (("lo", F.min), ("hi", F.max), ("mid", F.avg))
    ]
    rows = [
        F.struct(
            F.lit(c).alias("name"),
            F.round(F.coalesce(F.col(f"lo{i}"), F.lit(0.0)), 2).alias("min"),
            F.round(F.coalesce(F.col(f"hi{i}"), F.lit(100.0)), 2).alias("max"),
            F.round(F.coalesce(F.col(f"mid{i}"), F.lit(0.0)), 2).alias("mean"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*wide).select(F.explode(F.array(*rows)).alias("r")).select("r.*", F.col("r.mean").alias("default"))


def category_fields(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """The options of each categorical column in value order, with the default marked.

    With `limit` only the first so many; the rank filter is then applied inside each partition
    before the shuffle. The options of a column are what a form lists, one row per distinct value.
    """
    values = long_text(df, columns).where(F.col("value").isNotNull()).distinct()
    values = values.where(~F.lower("value").isin("nan", "none", "null"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    ranked = values.select("column", "value", rank.alias("position"))
    if limit is not None:
        ranked = ranked.where(F.col("position") <= limit)
    return ranked.select("column", "position", "value", (F.col("position") == 1).alias("is_default"))


def describe(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], rounds: int | None = None) -> DataFrame:
    """count, unique/top/freq for text columns, mean/std/min/quartiles/max for numeric ones.

    rounds: see numeric_summary.
    """
    figures = numeric_summary(df, numeric, rounds=rounds).select(
        "column", "count",
        F.lit(None).cast("bigint").alias("unique"), F.lit(None).cast("string").alias("top"),
        F.lit(None).cast("bigint").alias("freq"), "mean", "std", "min",
        *[F.get("quantiles", F.lit(i)).alias(q) for i, q in enumerate(("q25", "q50", "q75"))], "max",
    )
    none = [F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    texts = text_summary(df, categorical).select("column", "count", "unique", "top", "freq", *none)
    return figures.unionByName(texts)


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing) for columns with at least one null."""
    shown = list(columns or df.columns)
    counts = df.agg(*[F.count_if(is_missing(named(c), df.schema[c].dataType)).alias(f"m{i}") for i, c in enumerate(shown)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(shown)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("missing > 0")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(named(column).isNotNull()).groupBy(named(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair over its complete rows, null when a side does not vary; one pass, see pair_moments."""
    spread = F.sqrt("xx") * F.sqrt("yy")
    names = F.array(*[F.lit(c) for c in columns])
    found = pair_moments(df, columns).select("i", "j", F.try_divide("xy", spread).alias("r"))
    both = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    once = F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)
    return found.select("r", F.explode(once).alias("x")).select(
        F.get(names, F.col("x.a")).alias("a"), F.get(names, F.col("x.b")).alias("b"), "r"
    )


def five_numbers(df: DataFrame, columns: Sequence[str], label: str, rounds: int | None = None) -> DataFrame:
    """min, quartiles and max of each numeric column per class."""
    return numeric_summary(df, columns, label=label, rounds=rounds).select(
        label, "column", "min", *[F.get("quantiles", F.lit(i)).alias(q) for i, q in enumerate(("q25", "q50", "q75"))], "max"
    )


def preview(df: DataFrame, order_by: str, rows: int = 15, columns: int = 14, label: str = "_y") -> DataFrame:
    """First rows and columns as text, nulls blank; ordered so the result is repeatable."""
    shown = [c for c in df.columns if c != label][:columns]
    top = df.orderBy(named(order_by), *[named(c).cast("string") for c in shown if c != order_by]).limit(rows)
    return top.select(*[F.coalesce(named(c).cast("string"), F.lit("")).alias(c) for c in shown])
