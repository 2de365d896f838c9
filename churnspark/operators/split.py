"""Stratified holdout, folds and class weights, all from a hash of the identifier.

The data itself is never sorted or shuffled. Cutting a class at a given share needs
one cut key per class: count rows per key prefix, find the prefix that holds the cut,
and look only inside that prefix. Rows are then assigned by comparing their key with
a handful of literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.functions.text import named

SEED = 42
TEST_SHARE = 0.20
FOLDS = 5
_PREFIX = 4  # 65,536 prefixes


def split_key(df: DataFrame, id_column: str | None, salt: str) -> Column:
    """32 hex digits, uniform, the same on every recomputation.

    A row without an id, or with a null one, hashes as a whole.
    """
    whole = F.to_json(F.struct(*[named(c) for c in df.columns]))
    ident = F.coalesce(named(id_column).cast("string"), whole) if id_column else whole
    return F.md5(F.concat(ident, F.lit(f"-{salt}")))


def cut_keys(
    df: DataFrame, key: Column, label: str, shares: Sequence[tuple[int, int]] | dict[int, Sequence[int]],
) -> dict[int, list[str]]:
    """Per class, for every share a/b, the largest key such that the rows up to it are at most round(a·n/b).

    `shares` may also be numbers of rows for each class, as many for one as for the other.

    All rows of one identifier share a key and so stay on one side. The window over
    prefixes sees at most 65,536 rows per class; the window inside a cut prefix sees
    about 1/65,536 of the class's distinct keys.
    """
    rows = df.select(named(label).alias("y"), key.alias("key")).select("y", "key", F.substring("key", 1, _PREFIX).alias("prefix"))
    per_prefix = rows.groupBy("y", "prefix").agg(F.count(F.lit(1)).alias("n"))
    by_prefix = Window.partitionBy("y").orderBy("prefix")
    by_class = shares if isinstance(shares, dict) else {0: shares, 1: shares}
    targets = F.when(F.col("y") == 1, _takes(by_class[1])).otherwise(_takes(by_class[0]))
    cuts = (
        per_prefix.withColumn("upto", F.sum("n").over(by_prefix))
        .withColumn("total", F.sum("n").over(Window.partitionBy("y")))
        .withColumn("t", F.explode(targets))
        .select("y", "prefix", (F.col("upto") - F.col("n")).alias("before"), "upto", "t.*")
        .where((F.col("before") < F.col("take")) & (F.col("take") <= F.col("upto")))
        .select("y", "prefix", "before", "j", "take")
        .collect()  # classes × shares rows
    )
    out = {y: [""] * len(by_class[y]) for y in (0, 1)}
    if not cuts:
        return out
    for c in cuts:
        out[c["y"]][c["j"]] = c["prefix"]
    wanted = df.sparkSession.createDataFrame(
        [(c["y"], c["prefix"], c["before"], c["j"], c["take"]) for c in cuts],
        "y int, prefix string, before long, j int, take long",
    )
    inside = rows.join(F.broadcast(wanted), ["y", "prefix"]).groupBy("y", "j", "key", "before", "take").agg(
        F.count(F.lit(1)).alias("n")
    )
    reached = F.col("before") + F.sum("n").over(Window.partitionBy("y", "j").orderBy("key"))
    best = (
        inside.withColumn("reached", reached).where(F.col("reached") <= F.col("take"))
        .groupBy("y", "j").agg(F.max("key").alias("cut")).collect()
    )
    for b in best:
        out[b["y"]][b["j"]] = b["cut"]
    return out


def _takes(wanted: Sequence[tuple[int, int]] | Sequence[int]) -> Column:
    def rows(what: tuple[int, int] | int) -> Column:
        if isinstance(what, int):
            return F.lit(what).cast("long")
        return F.expr(f"(2 * {what[0]} * total + {what[1]}) div (2 * {what[1]})")

    return F.array(*[F.struct(F.lit(j).alias("j"), rows(what).alias("take")) for j, what in enumerate(wanted)])


def _slot(key: Column, label: str, cuts: dict[int, list[str]]) -> Column:
    """How many of the class's cut keys lie below the key."""
    def below(keys: list[str]) -> Column:
        total = F.lit(0)
        for cut in keys:
            total = total + (key > cut).cast("int")
        return total

    return F.when(named(label) == 1, below(cuts[1])).otherwise(below(cuts[0]))


def mark_holdout(
    df: DataFrame, id_column: str | None, label: str = LABEL, share: tuple[int, int] = (1, 5),
    seed: int = SEED, exact: bool = True,
) -> DataFrame:
    """Add boolean `is_test`.

    exact: each class gives round(share·n) rows where keys are unique, and at most so many
    where copies of an id must stay together (two counting passes). Otherwise the
    key is compared with the share directly: no extra pass, sizes right on average.
    """
    key = split_key(df, id_column, str(seed))
    if exact:
        cuts = cut_keys(df, key, label, [share])
        return df.withColumn("is_test", _slot(key, label, cuts) == 0)
    limit = f"{share[0] * 65536 // share[1]:04x}"
    return df.withColumn("is_test", F.substring(key, 1, 4) < limit)


def holdout(df: DataFrame, id_column: str | None, **kw) -> tuple[DataFrame, DataFrame]:
    marked = mark_holdout(df, id_column, **kw)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def fold_count(class_sizes: Sequence[int], folds: int = FOLDS) -> int:
    return max(2, min(folds, min(class_sizes)))


#: An id is heavy if it holds more than this part of a fold's rows of a class.
HEAVY = 4


def heavy_ids(df: DataFrame, id_column: str, k: int, label: str = LABEL) -> tuple[dict[int, int], dict[str, dict[int, int]]]:
    """Rows of each class, and those of each heavy id by class; at most HEAVY · k ids a class, whatever the data."""
    ident = df.where(named(id_column).isNotNull()).groupBy(named(id_column).cast("string").alias("id"))
    counted = ident.agg(*[F.count_if(named(label) == y).alias(f"n{y}") for y in (0, 1)])
    sizes = df.agg(*[F.count_if(named(label) == y).alias(f"n{y}") for y in (0, 1)]).first()
    limits = [sizes[y] // (HEAVY * k) for y in (0, 1)]
    found = counted.where((F.col("n0") > max(1, limits[0])) | (F.col("n1") > max(1, limits[1]))).collect()
    return {y: sizes[y] for y in (0, 1)}, {r["id"]: {0: r["n0"], 1: r["n1"]} for r in found}


def pack(sizes: dict[int, int], heavy: dict[str, dict[int, int]], k: int) -> tuple[dict[str, int], dict[int, list[int]]]:
    """Fold of every heavy id, and how many of the other rows of each class lie in the folds before 1, 2, … k - 1.

    Largest first, by its share of the classes, each to the fold with the least in it so far; of equal ones the first.
    The other rows of a class fill the folds from below to one level; a fold above it gets none.
    """
    def share(rows: dict[int, int]) -> float:
        return sum(rows[y] / sizes[y] for y in (0, 1) if sizes[y])

    held = [{0: 0, 1: 0} for _ in range(k)]
    folds = {}
    for ident, rows in sorted(heavy.items(), key=lambda item: (-share(item[1]), item[0])):
        folds[ident] = fold = min(range(k), key=lambda f: (share(held[f]), f))
        for y in (0, 1):
            held[fold][y] += rows[y]
    takes = {}
    for y in (0, 1):
        left, filled = sizes[y] - sum(h[y] for h in held), sorted(h[y] for h in held)
        m = next(m for m in range(k, 0, -1) if m == 1 or left + sum(filled[:m]) > m * filled[m - 1])
        level = left + sum(filled[:m])  # times m
        room = [max(0, level - m * h[y]) for h in held]
        takes[y] = [(2 * sum(room[:f]) + m) // (2 * m) for f in range(1, k)]
    return folds, takes


def mark_folds(df: DataFrame, id_column: str | None, k: int, label: str = LABEL, seed: int = SEED) -> DataFrame:
    """Add `fold` 0..k-1; with unique keys the fold sizes of a class differ by at most one row.

    Copies of an id stay together. Ids that hold much of a class are packed over the folds first,
    all their rows into one; the other rows are dealt by their key into the room that is left,
    so that folds without a heavy id stay even and none is left without rows while there are others.
    """
    key = split_key(df, id_column, str(seed))
    sizes, heavy = heavy_ids(df, id_column, k, label) if id_column else ({}, {})
    if not heavy:
        cuts = cut_keys(df, key, label, [(f, k) for f in range(1, k)])
        return df.withColumn("fold", _slot(key, label, cuts))
    folds, takes = pack(sizes, heavy, k)
    text = named(id_column).cast("string")
    is_heavy = F.coalesce(text.isin(list(folds)), F.lit(False))
    cuts = cut_keys(df.where(~is_heavy), key, label, takes)
    chosen = F.lit(0)
    for ident, fold in folds.items():
        chosen = F.when(text == ident, F.lit(fold)).otherwise(chosen)
    return df.withColumn("fold", F.when(is_heavy, chosen).otherwise(_slot(key, label, cuts)))


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, n, weight) with weight = rows / (2 · rows of the class); one pass, no shuffle of rows."""
    y = named(label)
    counts = df.agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
    rows = F.array(*[F.struct(F.lit(k).alias(label), F.col(f"n{k}").alias("n")) for k in (0, 1)])
    return (
        counts.select((F.col("n0") + F.col("n1")).alias("total"), F.explode(rows).alias("r"))
        .select("r.*", (F.col("total") / (2 * F.col("r.n"))).alias("weight"))
    )
