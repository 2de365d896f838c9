"""Cleaning of numbers, categories and currency strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters removed at both ends of a text value.
BLANKS = " \t\n\r\x0b\x0c\u00a0"

# Texts that mean "missing" in a cleaned column (exact case).
MISSING_TOKENS = ["nan", "none", "null"]

# Currency marks dropped by the tolerant money parser, in this order.
CURRENCY_MARKS = ["₹", "Rs.", "Rs", "INR", "$", ","]

# What counts as a number once separators are gone. Spark's own cast is more
# generous ('1d', 'NaN'), so the pattern decides first.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def named(name: str) -> Column:
    """Column reference that survives dots and blanks in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def norm_name(name: str) -> str:
    """Lower-case, letters and digits only."""
    return re.sub(r"[^a-z0-9]", "", str(name).lower())


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def parse_number(text: Column) -> Column:
    """Text to double; anything that does not match NUMBER becomes null.

    The match is null where there is none, so the cast only ever sees numbers: a failed
    cast costs an exception per cell, several times the price of the pattern.
    """
    return F.regexp_substr(text, F.lit(NUMBER)).try_cast("double")


def clean_number(col: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Thousands separators and dollar signs dropped, blanks trimmed, junk to null."""
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        number = col.cast("double")
        return F.when(~F.isnan(number), number)
    return parse_number(strip(F.translate(col.cast("string"), ",$", "")))


def clean_flag(col: Column) -> Column:
    """Text column holding only true/false, read as 1.0/0.0."""
    word = F.lower(strip(col))
    return F.when(word == "true", 1.0).when(word == "false", 0.0)


def clean_category(col: Column, blank_is_missing: bool = False) -> Column:
    """Trimmed text with the missing tokens (and optionally blanks) set to null."""
    text = strip(col.cast("string"))
    tokens = MISSING_TOKENS + ([""] if blank_is_missing else [])
    return F.when(~text.isin(tokens), text)


def money_or_zero(col: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Tolerant currency parser; failure and null give 0.0. Numbers are taken as they are."""
    if isinstance(dtype, T.NumericType):
        return F.coalesce(clean_number(col, dtype), F.lit(0.0))
    text = col.cast("string")
    for mark in CURRENCY_MARKS:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return F.coalesce(parse_number(strip(text)), F.lit(0.0))


def is_missing(col: Column, dtype: T.DataType) -> Column:
    """Null, or NaN in a floating-point column."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()
