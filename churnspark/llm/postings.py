"""Comparing the members of inverted lists in bounded blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLOCK = 512


def crowded(entries: DataFrame, keys: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """Entries of lists with two or more members, dealt into blocks and paired.

    Returns the entries with `lo` and `hi`, a pair of block numbers of their list, and
    `first`, true where the entry belongs to block `lo`. A list of n members has
    ceil(n / block) blocks and every unordered pair of them is one group, so no group holds
    many more than twice `block` entries however long the list is. Lists are counted by a
    partial aggregate; hot lists are joined back by a plain join, which can be split.
    """
    sizes = (
        entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(*keys, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    return (
        entries.join(sizes, keys)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("mine", "other"))
        .withColumn("hi", F.greatest("mine", "other"))
        .withColumn("first", F.col("mine") == F.col("lo"))
        .drop("blocks", "mine", "other")
    )
