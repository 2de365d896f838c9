"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from churnspark.llm.tables import quoted
from churnspark.session import stage

SHARDS = 24
SEED = 20240
BLOCK_ROWS = 1_000_000


def draw(rng: np.random.Generator, good: int, bad: int, picks: int) -> int:
    """One hypergeometric draw of any size: inversion over the window around the mode.

    Beyond 13 standard deviations the mass is below what a double can hold.
    """
    low, high = max(0, picks - bad), min(good, picks)
    if low == high:
        return low
    total = good + bad
    mean = picks * good / total
    spread = math.sqrt(picks * (good / total) * (bad / total) * max(0.0, (total - picks) / max(1, total - 1)))
    low, high = max(low, math.floor(mean - 13 * spread - 20)), min(high, math.ceil(mean + 13 * spread + 20))
    k = np.arange(low, high, dtype=np.float64)  # ratio of the chances of k + 1 and k
    ratio = (good - k) * (picks - k) / ((k + 1) * (bad - picks + k + 1))
    weight = np.concatenate(([0.0], np.cumsum(np.log(ratio))))
    mass = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, high - low))


def matrix(rows: list[int], capacity: list[int], seed: int = SEED) -> np.ndarray:
    """How many rows of each block go to each shard, drawn as a uniform shuffle would."""
    rng = np.random.default_rng(seed)
    left = list(capacity)
    out = np.zeros((len(rows), len(capacity)), np.int64)
    for b, picks in enumerate(rows):
        rest = sum(left)
        for s, room in enumerate(left):
            rest -= room
            out[b, s] = n = draw(rng, room, rest, picks)
            left[s] -= n
            picks -= n
    return out


def capacities(rows: int, shards: int = SHARDS) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_into_shards(frame: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`frame` with `shard` and `slot` (gapless from 0 in each shard), as one uniform shuffle.

    Rows get a number once, in a written copy, and are dealt into blocks by a hash of it, so
    neither equal rows nor a hot source make a block large. The driver only sees rows per block
    and draws the block-to-shard matrix; a block is permuted and cut into its shards' runs; each
    shard is permuted again in buckets of a random key, whose offsets are running sums of their
    counts. Shard sizes differ by one at most. Pass narrow rows: they are written twice.

    Defined cases: nulls and repeated rows are ordinary rows; an empty table gives an empty result;
    columns of the input called shard or slot are replaced.
    """
    spark = frame.sparkSession
    numbered = stage(
        frame.drop("shard", "slot").withColumn("__row", F.monotonically_increasing_id()), "shard-input"
    )
    rows = numbered.count()
    columns = quoted([c for c in numbered.columns if c != "__row"])
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / block_rows))
    dealt = numbered.withColumn("__block", F.pmod(F.xxhash64("__row", F.lit(seed)), F.lit(blocks)).cast("int"))
    counted = dict(map(tuple, dealt.groupBy("__block").count().collect()))
    order = sorted(counted)
    cuts = np.cumsum(matrix([counted[b] for b in order], capacities(rows, shards), seed), axis=1)
    plan = spark.createDataFrame(
        [(b, c.tolist()) for b, c in zip(order, cuts)], "__block int, __cuts array<long>"
    )
    key = lambda salt: F.xxhash64("__row", F.lit(seed + salt))
    local = W.partitionBy("__block").orderBy(key(1), "__row")
    place = F.row_number().over(local) - 1
    # buckets of a shard: a bucket holds about as many rows as a block
    buckets = max(1, math.ceil(blocks / shards))
    sent = (
        dealt.withColumn("__place", place).join(plan, "__block")
        .withColumn("shard", F.size(F.filter("__cuts", lambda c: c <= F.col("__place"))))
        .withColumn("__bucket", F.pmod(key(2), F.lit(buckets)).cast("int"))
        .select(*columns, "__row", "shard", "__bucket")
    )
    sent = stage(sent, "shard-sent")
    counts = sent.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inner = W.partitionBy("shard", "__bucket").orderBy(key(3), "__row")
    return (
        sent.withColumn("__place", F.row_number().over(inner) - 1)
        .join(offsets, ["shard", "__bucket"])
        .select(*columns, "shard", (F.col("__offset") + F.col("__place")).cast("long").alias("slot"))
    )
