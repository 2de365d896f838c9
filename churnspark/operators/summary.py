"""Exact order statistics and modes without gathering a column in one task.

`percentile` and `mode` keep every distinct value of a group in one task's
memory. Here a bounded sketch brackets each wanted rank first; only the values
inside the narrow bracket are then counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark.functions.text import named
from churnspark.session import stage


def long_numeric(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, value): one row per non-null, non-NaN number."""
    wide = df.select(*[named(b) for b in by], *[named(c).cast("double").alias(c) for c in columns])
    return wide.unpivot([named(b) for b in by], [named(c) for c in columns], "column", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def long_text(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, column, value): every cell as text, nulls kept."""
    wide = df.select(*[named(k) for k in keep], *[named(c).cast("string").alias(c) for c in columns])
    return wide.unpivot([named(k) for k in keep], [named(c) for c in columns], "column", "value")


@dataclass(frozen=True)
class Numbers:
    """The columns of a summary as they stand: the label first, if there is one, then v0, v1, …"""

    frame: DataFrame
    columns: list[str]
    label: str | None


def numbers_of(df: DataFrame, columns: Sequence[str], label: str | None = None) -> Numbers:
    """Doubles, with NaN as null; other columns are left behind."""
    cells = [F.when(~F.isnan(named(c).cast("double")), named(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)]
    return Numbers(df.select(*([named(label).alias("label")] if label else []), *cells), list(columns), label)


def numeric_summary(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    label: str | None = None,
    accuracy: int = 10_000,
    rounds: int | None = None,
) -> DataFrame:
    """Per ([label], column): rows, count, mean, std, std_pop, min, max, quantiles (array, one per prob).

    Quantiles interpolate linearly between neighbours, as `percentile` does; rows counts gaps too.

    Two passes over the columns as they stand, however many there are. Pass 1 sketches the ranks `prob ± 2/accuracy`
    of every column in one aggregate. The second counts the values between the two sketched bounds and lumps
    everything below and above into one entry per task, so about 4/accuracy of the values are shuffled. Every further round is one
    more pass that narrows the brackets about 150 times, for columns so long that
    4/accuracy of them is still too much for one task; without `rounds` their number follows
    from the longest column's count, which the sketch pass returns. Should a sketch miss its
    rank, its bracket is widened and counted again. The driver and the tasks hold the bracket table:
    columns × probs rows, twice that with the 0/1 label, whatever the data size.
    """
    keys = [*([label] if label else []), "column"]
    numbers = numbers_of(df, columns, label)
    margin = 2.0 / accuracy
    wanted = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    n_probs = len(probs)
    figures = [
        F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(v).alias("count"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.percentile_approx(v, wanted, accuracy).alias("bounds"),
        ).alias(f"s{i}")
        for i, (c, v) in enumerate((c, f"v{i}") for i, c in enumerate(numbers.columns))
    ]
    wide = numbers.frame.groupBy(*(["label"] if label else [])).agg(*figures)
    each = F.explode(F.array(*[f"s{i}" for i in range(len(figures))])).alias("s")
    stats = wide.select(*([F.col("label").alias(label)] if label else []), each).select(*map(named, keys[:-1]), "s.*")
    stats = stage(stats.where(F.col("count") > 0), "sketches")  # columns x labels rows, used three times below
    if rounds is None:
        rounds = rounds_for(stats.agg(F.max("count").alias("n")).first()["n"] or 0, accuracy)
    bracket = F.transform(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]),
        lambda s: F.struct(
            s["i"].alias("i"),
            ((F.col("count") - 1) * s["p"]).alias("rank"),
            F.get(F.col("bounds"), s["i"]).alias("low"),
            F.get(F.col("bounds"), s["i"] + n_probs).alias("high"),
        ),
    )
    brackets = stats.select(*map(named, keys), F.explode(bracket).alias("b")).select(*map(named, keys), "b.*")
    values = long_numeric(df, columns, keys[:-1])
    for _ in range(rounds - 1):
        brackets = _narrowed(values, brackets, keys, accuracy)
    picked = stage(_picked(numbers, brackets, keys), "ranks")
    slack = 3
    while not (missed := picked.where("lower IS NULL OR upper IS NULL")).isEmpty():
        # a sketch missed its rank: bracket anew from the whole range, with ever more room
        slack *= 4
        whole = missed.join(stats, keys).select(*map(named, keys), "i", "rank", F.col("min").alias("low"), F.col("max").alias("high"))
        again = _picked(numbers, _narrowed(values, whole, keys, accuracy, slack), keys)
        picked = stage(picked.where("lower IS NOT NULL AND upper IS NOT NULL").unionByName(again), "ranks")
    quantile = F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("rank") - F.floor("rank"))
    quantiles = picked.groupBy(*map(named, keys)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", quantile.alias("q")))), lambda s: s["q"]).alias("quantiles")
    )
    return stats.drop("bounds").join(F.broadcast(quantiles), keys)


def _counter(brackets: Sequence[tuple], labelled: bool):
    """For mapInArrow: values inside each bracket with their counts, and per task one entry for all
    below and one for all above. A bracket is (number, label, place of the column, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[int, int], tuple] = {}

        def lump(bracket: int, side: int, found: np.ndarray) -> None:
            if len(found):
                n, first, last = ends.get((bracket, side), (0, np.inf, -np.inf))
                ends[bracket, side] = (n + len(found), min(first, found.min()), max(last, found.max()))

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(part, kind) for part, kind in zip(zip(*rows), _COUNTED.values())], names=list(_COUNTED)
            )

        for batch in batches:
            cells: dict[tuple, np.ndarray] = {}
            out = []
            for number, label, place, low, high in brackets:
                if (label, place) not in cells:
                    column = batch.column(place + labelled)
                    if labelled:
                        column = column.filter(pc.equal(batch.column(0), pa.scalar(label, batch.column(0).type)))
                    cells[label, place] = column.drop_null().to_numpy(zero_copy_only=False)
                found = cells[label, place]
                below, above = found < low, found > high
                lump(number, -1, found[below])
                lump(number, 1, found[above])
                for value, n in zip(*map(np.ndarray.tolist, np.unique(found[~below & ~above], return_counts=True))):
                    out.append((number, 0, value, n, value, value))
            if out:
                yield sent(out)
        if ends:
            yield sent([(number, side, None, *entry) for (number, side), entry in ends.items()])

    return run


_COUNTED = {
    "number": pa.int32(), "side": pa.int32(), "inside": pa.float64(), "n": pa.int64(), "first": pa.float64(), "last": pa.float64(),
}


def _picked(numbers: Numbers, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, rank, lower, upper): the values at the ranks around each wanted rank, null where the bracket missed."""
    spark = numbers.frame.sparkSession
    found = [r for r in brackets.collect() if not numbers.label or r[0] is not None]
    places = {c: k for k, c in enumerate(numbers.columns)}
    wanted = [
        (number, r[0] if numbers.label else None, places[r["column"]], r["low"], r["high"]) for number, r in enumerate(found)
    ]
    kind = brackets.select(*map(named, keys), "i", "rank").schema
    ranks = spark.createDataFrame([(number, *(r[f] for f in kind.names)) for number, r in enumerate(found)], T.StructType(
        [T.StructField("number", T.IntegerType()), *kind.fields]
    ))
    counted = (
        numbers.frame.mapInArrow(
            _counter(wanted, bool(numbers.label)), "number int, side int, inside double, n bigint, first double, last double"
        )
        .groupBy("number", "side", "inside").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        .join(F.broadcast(ranks), "number")
    )
    in_order = Window.partitionBy("number").orderBy("side", "inside")
    placed = counted.withColumn("upto", F.sum("n").over(in_order)).withColumn("before", F.col("upto") - F.col("n"))

    def at(rank: Column) -> Column:
        """Value at a 0-based rank; lumped rows know only the one next to the bracket."""
        hit = (F.col("before") <= rank) & (rank < F.col("upto"))
        value = (
            F.when((F.col("side") == -1) & (rank == F.col("upto") - 1), F.col("last"))
            .when((F.col("side") == 1) & (rank == F.col("before")), F.col("first"))
            .when(F.col("side") == 0, F.col("inside"))
        )
        return F.max(F.when(hit, value))

    return placed.groupBy(*map(named, keys), "i", "rank").agg(at(F.floor("rank")).alias("lower"), at(F.ceil("rank")).alias("upper"))


def rounds_for(rows: int, accuracy: int = 10_000, per_task: int = 5_000_000) -> int:
    """Bracket rounds after which at most about per_task values per quantile are left to order."""
    rounds, left = 1, 4 * rows / accuracy
    while left > per_task:
        rounds, left = rounds + 1, left / 150
    return rounds


def _narrowed(values: DataFrame, brackets: DataFrame, keys: Sequence[str], accuracy: int, slack: int = 3) -> DataFrame:
    """Brackets cut down to the neighbourhood of the wanted rank, from a sketch of the values inside."""
    grid = 1_000
    shares = ", ".join(f"{i / grid}D" for i in range(grid + 1))
    inside = F.col("value").between(F.col("low"), F.col("high"))
    found = (
        values.join(F.broadcast(brackets), keys)
        .select(*keys, "i", "rank", (F.col("value") < F.col("low")).alias("is_below"), F.when(inside, F.col("value")).alias("v"))
        .groupBy(*keys, "i", "rank")
        .agg(
            F.count_if("is_below").alias("below"), F.count("v").alias("n"),
            F.expr(f"percentile_approx(v, array({shares}), {accuracy})").alias("grid"),
        )
    )
    place = (F.col("rank") - F.col("below")) / F.greatest(F.lit(1), F.col("n")) * grid

    def edge(at: Column) -> Column:
        return F.get("grid", F.least(F.lit(grid), F.greatest(F.lit(0), at)).cast("int"))

    return found.select(
        *keys, "i", "rank", edge(F.floor(place) - slack).alias("low"), edge(F.ceil(place) + slack).alias("high")
    )


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) over non-null values of all columns, in one shuffle."""
    return (
        long_text(df, columns).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def text_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: count, unique, top value and its frequency; ties go to the smallest value."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value")))
    return frequencies(df, columns).groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        best.getField("value").alias("top"),
        (-best.getField("neg")).alias("freq"),
    )
