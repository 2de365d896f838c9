"""A dictionary of the levels of categorical columns that no single machine has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from churnspark.functions.text import named
from churnspark.operators.summary import frequencies
from churnspark.session import stage


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, index): the levels of each column, numbered from 0 in the order of their texts.

    Levels are counted by a partial aggregate, dealt to partitions by ranges of (column, value) and written once;
    the index of a level is the number of the column's levels in earlier partitions and its rank in its
    own. Nothing is collected and no task sees more than its range; what a window runs over
    is one range, or one row per column and partition. Nulls are no level; an empty table has none.
    """
    counted = frequencies(df, columns)
    ranged = counted.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "levels")  # the ranges are fixed from here on, whatever is recomputed
    sizes = ranged.groupBy("column", "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("column", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part", "column").orderBy("value"))
    numbered = ranged.withColumn("rank", rank).join(before, ["column", "part"])
    return stage(numbered.select("column", "value", "n", (F.col("before") + F.col("rank") - 1).alias("index")), "dictionary")


def attach(df: DataFrame, found: DataFrame, columns: Sequence[str], prefix: str = "i_") -> DataFrame:
    """`df` with the index of each column's level as `prefix` + column: null for null and for a level not in `found`.

    One join a column, whose kind the optimizer picks by the size of the dictionary.
    """
    for column in columns:
        level, index = (_unused(df, name) for name in ("level", "index"))
        mine = found.where(F.col("column") == column).select(F.col("value").alias(level), F.col("index").alias(index))
        joined = df.join(mine, named(column).cast("string") == F.col(level), "left")
        df = joined.select(*[named(c) for c in df.columns], F.col(index).alias(prefix + column))
    return df


def _unused(df: DataFrame, name: str) -> str:
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


def offsets(found: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """First one-hot slot of each column; one row a column comes to the driver."""
    size = {r["column"]: r["n"] for r in found.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, at = {}, 0
    for column in columns:
        first[column], at = at, at + size.get(column, 0)
    return first


def slots(first: dict[str, int], prefix: str = "i_") -> Column:
    """The one-hot row of a frame with attached indexes, as the array of the slots that are 1."""
    return F.array_compact(F.array(*[named(prefix + c) + F.lit(at) for c, at in first.items()]))
