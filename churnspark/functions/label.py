"""Turning an outcome column into the 0/1 label `_y`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnspark.functions.text import clean_number, strip

LABEL = "_y"

# Outcome texts read as churned.
CHURNED_TEXTS = [
    "yes", "y", "true", "1", "1.0", "churn", "churned", "left", "exited",
    "cancelled", "canceled", "positive", "attrition", "attrited",
    "attrited customer", "lost", "closed", "terminated", "non-renewed",
    "did churn", "t",
]

# Outcome texts read as retained.
RETAINED_TEXTS = [
    "no", "n", "false", "0", "0.0", "stay", "stayed", "active", "retained",
    "negative", "current", "joined", "existing customer", "existing",
    "renewed", "open", "f",
]


def outcome(col: Column, kind: str) -> tuple[Column, Column]:
    """(label 0/1, is-unrecognised flag) for kind 'boolean', 'numeric' or 'text'.

    The flag marks nulls of a boolean or 0/1 column and texts in neither list;
    a numeric column with other values counts as churned when positive.
    """
    if kind == "boolean":
        return F.coalesce(col.cast("int"), F.lit(0)), col.isNull()
    if kind == "numeric":
        number = clean_number(col.cast("string"))
        return F.when(number > 0, 1).otherwise(0), number.isNull()
    word = F.lower(strip(F.coalesce(col.cast("string"), F.lit(""))))
    known = word.isin(CHURNED_TEXTS + RETAINED_TEXTS)
    return F.when(word.isin(CHURNED_TEXTS), 1).otherwise(0), ~known
