"""Cleaning projections driven by a TableProfile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark.functions.label import LABEL, outcome
from churnspark.functions.text import clean_category, clean_flag, clean_number, named
from churnspark.operators.profile import TableProfile


def number_column(df: DataFrame, prof: TableProfile, name: str) -> Column:
    """The cleaned expression of one numeric feature."""
    dtype = df.schema[name].dataType
    if name in prof.flag_columns and isinstance(dtype, T.StringType):
        return clean_flag(named(name))
    return clean_number(named(name), dtype)


def clean(df: DataFrame, prof: TableProfile) -> DataFrame:
    """Numbers to double, categories trimmed, `_y` added when the outcome column is present."""
    df = df.toDF(*[c.strip() for c in df.columns])
    out = []
    for name in df.columns:
        if name in prof.numeric:
            out.append(number_column(df, prof, name).alias(name))
        elif name in prof.categorical:
            out.append(clean_category(named(name)).alias(name))
        else:
            out.append(named(name))
    if prof.target and prof.target in df.columns:
        out.append(outcome(named(prof.target), prof.target_kind)[0].alias(LABEL))
    return df.select(*out)


def align(df: DataFrame, prof: TableProfile) -> DataFrame:
    """The trained feature list from any table: cleaned, missing columns as null."""
    return df.select(*feature_columns(df, prof))


def feature_columns(df: DataFrame, prof: TableProfile) -> list[Column]:
    """One cleaned expression per feature, numeric first, aliased to the feature's name."""
    present = set(df.columns)
    numbers = [
        (number_column(df, prof, c) if c in present else F.lit(None).cast("double")).alias(c) for c in prof.numeric
    ]
    texts = [
        (clean_category(named(c), blank_is_missing=True) if c in present else F.lit(None).cast("string")).alias(c)
        for c in prof.categorical
    ]
    return numbers + texts


def features_and_label(df: DataFrame, prof: TableProfile) -> DataFrame:
    """Features that are present plus the label (the raw outcome when `_y` is not there yet)."""
    shown = [named(c) for c in prof.all_features if c in df.columns]
    return df.select(*shown, named(LABEL if LABEL in df.columns else prof.target).alias(LABEL))
