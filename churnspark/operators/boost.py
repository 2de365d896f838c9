"""Boosted trees of several candidates and folds, grown level by level in the same jobs.

All models of a training, candidates times folds, share one table of binned rows. A level of
the current tree of every model is one job: each task adds gradients, hessians and rows of its blocks into histograms by
model, node, column and bin, where of two children only the smaller is counted and the larger is what is left of their parent; the sums of all
tasks, as many as models, nodes and bins allow whatever the number of rows, come to the driver, which
picks the splits. The loops run in the JVM (Kernels.java) on persisted blocks, which remember margins and nodes for the tree and level they
hold for: a job goes one level further, and a lost block is read again and walked down the trees so far. Blocks that do not fit in
memory are brought up to date every few rounds and checkpointed now and then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.operators import kernels
from churnspark.session import iterative_session, shared_folder, written

#: Cuts of a numeric column at most, the rounds after which blocks outside memory are brought up to date, and how many times until they are checkpointed.
CUTS, UPDATED_EVERY, CHECKPOINTED_EVERY = 127, 4, 8
#: Rows times models of a task at least, and once every core has one: below, the start of a task costs more than its rows. Rows of a block.
LEAST_WORK, WORK_A_TASK, BLOCK = 50_000, 20_000_000, 16_384
STORED = "MEMORY_AND_DISK"
#: Sums of so many tasks are added on the driver; those of more meet in a shuffle first.
FEW_TASKS = 32
TEST = -1  # the part of rows that no model learns from


@dataclass(frozen=True)
class Boosting:
    """Size and law of a booster.

    second_order: splits by gradient and hessian sums with `l2` on the leaves and at least `least`
    of hessian on each side. Otherwise splits by the spread of the gradients alone, rows counting as one.
    Leaves are Newton steps in both.
    """

    rounds: int = 120
    depth: int = 4
    rate: float = 0.08
    second_order: bool = False
    l2: float = 0.0
    least: float = 1.0


@dataclass
class Grown:
    """A model's trees as complete binary trees: node i has children 2i + 1 and 2i + 2."""

    law: Boosting
    held: int  # the part kept from this model besides TEST; TEST alone if that
    base: float
    column: list[np.ndarray] = field(default_factory=list)  # per tree and inner node
    value: list[np.ndarray] = field(default_factory=list)  # last bin of the left side, or the level that goes right
    gain: list[np.ndarray] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)


@dataclass(frozen=True)
class Bins:
    """Cuts of the numeric columns, number of levels of the others, and where each column's bins begin."""

    cuts: tuple[np.ndarray, ...]
    levels: tuple[int, ...]

    @property
    def starts(self) -> np.ndarray:
        sizes = [len(c) + 1 for c in self.cuts] + [n + 1 for n in self.levels]
        return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def learn_bins(encoded: DataFrame, n_numeric: int, levels: Sequence[int], cuts: int = CUTS) -> Bins:
    """Quantile cuts of z_n<i> by mergeable sketches, all columns in one pass."""
    shares = [k / (cuts + 1) for k in range(1, cuts + 1)]
    found = []
    if n_numeric:
        row = encoded.agg(*[F.percentile_approx(f"z_n{i}", shares, 10_000).alias(f"q{i}") for i in range(n_numeric)]).first()
        found = [np.unique(np.array(q or [], float)) for q in row]
    return Bins(tuple(found), tuple(levels))


@dataclass
class Block:
    """Up to BLOCK rows, those of a part next to each other: labels, parts, a line of bins for each column and one of margins for each model."""

    y: np.ndarray
    part: np.ndarray
    x: np.ndarray
    margins: np.ndarray

    def packed(self) -> tuple[int, bytes, bytes, bytes, bytes]:
        return len(self.y), *(v.tobytes() for v in (self.y, self.part, self.x, self.margins))

    def record(self) -> pa.RecordBatch:
        n, *packed = self.packed()
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([v], pa.binary()) for v in packed)], names=["n", "y", "part", "bins", "margins"])


BLOCKS = "n int, y binary, part binary, bins binary, margins binary"


def _bin_type(starts: np.ndarray) -> np.dtype:
    return np.min_scalar_type(int(np.diff(starts).max(initial=1)))


def unpacked(rows: Iterator[Sequence], starts: np.ndarray) -> Iterator[Block]:
    kinds = (np.uint8, np.int32, _bin_type(starts), np.float64)
    for n, *packed in rows:
        y, part, x, margins = (np.frombuffer(v, kind) for v, kind in zip(packed, kinds))
        yield Block(y, part, x.reshape(len(starts) - 1, n), margins.reshape(-1, n))


def blocks(batches: Iterator[pa.RecordBatch], starts: np.ndarray) -> Iterator[Block]:
    return unpacked(([column[r].as_py() for column in batch.columns] for batch in batches for r in range(batch.num_rows)), starts)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows, but for the last."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= rows:
            yield pa.Table.from_batches(kept)
            kept = []
    if sum(b.num_rows for b in kept):
        yield pa.Table.from_batches(kept)


def bin_rows(encoded: DataFrame, bins: Bins, part: str = "part", extra: dict[str, Callable[[Block], bytes]] | None = None) -> DataFrame:
    """Blocks of rows: label, part, binned values, no margins yet, and what `extra` functions of the block return."""
    n, k = len(bins.cuts), len(bins.levels)
    kept = [F.col(LABEL).cast("int").alias("y"), F.col(part).cast("int").alias("part")]
    values = [F.col(f"z_n{i}") for i in range(n)] + [F.col(f"i_k{j}") for j in range(k)]
    cuts, kind, extra = bins.cuts, _bin_type(bins.starts), extra or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, BLOCK):
            y, held, *seen = (c.to_numpy() for c in table.columns)
            order = np.argsort(held, kind="stable")
            x = np.empty((n + k, len(y)), kind)
            for c, v in enumerate(seen):
                x[c] = (np.searchsorted(cuts[c], v, side="left") if c < n else v)[order]
            block = Block(y[order].astype(np.uint8), held[order].astype(np.int32), x, np.zeros((0, len(y))))
            record = block.record()
            for name, make in extra.items():
                record = record.append_column(name, pa.array([make(block)], pa.binary()))
            yield record

    return encoded.select(*kept, *values).mapInArrow(run, ", ".join([BLOCKS, *[f"{name} binary" for name in extra]]))


Sums = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def added(a: Sums, b: Sums) -> Sums:
    """Sums by key of two tasks as one."""
    key, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return key, *(np.bincount(at, np.concatenate(pair), len(key)) for pair in zip(a[1:], b[1:]))


def _row_by_row(batches: Iterator[pa.RecordBatch], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Labels, parts and margins of the rows of blocks."""
    for block in blocks(batches, starts):
        ends = pa.array(np.arange(len(block.y) + 1, dtype=np.int32) * len(block.margins))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.y.astype(np.int32)), pa.array(block.part), pa.ListArray.from_arrays(ends, pa.array(block.margins.T.ravel()))],
            names=["y", "part", "margins"],
        )


def smaller_children(histograms: np.ndarray, column: np.ndarray, value: np.ndarray, gain: np.ndarray, starts: np.ndarray, numeric: int) -> np.ndarray:
    """For each node of a level: 0 or 1 for the child with fewer rows, -1 where the node is not split. `histograms`: nodes, bins, sums."""
    out = np.full(len(histograms), -1)
    for node in np.flatnonzero(gain > 0):
        c, v = column[node], value[node]
        n = histograms[node, starts[c]:starts[c + 1], 2]
        right = n[v + 1:].sum() if c < numeric else n[v]
        out[node] = int(2 * right < n.sum())
    return out


def children(histograms: np.ndarray, counted: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Histograms of the next level from those of a level and the `counted` ones of smaller children, in their order.

    The larger child holds what is left; a node without a split sends all to its left child.
    """
    out = np.zeros((2 * len(histograms), *histograms.shape[1:]))
    out[::2] = histograms
    split = np.flatnonzero(smaller >= 0)
    out[2 * split + 1 - smaller[split]] = histograms[split] - counted
    out[2 * split + smaller[split]] = counted
    return out


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, bins: Bins, law: Boosting) -> list[tuple]:
    """Per node (column, value, gain, (g, h) left, (g, h) right, rows), of histograms nodes x bins.

    The first of equal gains in the order of columns and bins wins. A node without a split sends all rows
    left: column 0 and a value no bin exceeds (levels are compared for equality, so a table without numeric columns takes -1).
    """
    starts, numeric, nodes = bins.starts, len(bins.cuts), len(g)
    first = slice(starts[0], starts[1])
    all_g, all_h, all_n = (v[:, first].sum(axis=1, keepdims=True) for v in (g, h, n))
    column, value = np.zeros(nodes, np.int64), np.full(nodes, np.iinfo(np.int32).max if numeric else -1)
    best, left, right = np.zeros(nodes), np.concatenate((all_g, all_h), axis=1), np.zeros((nodes, 2))
    every = np.arange(nodes)
    for c in range(len(starts) - 1):
        s = slice(starts[c], starts[c + 1] - 1)  # not the last bin: the right side would be empty, or the unseen level
        if s.start == s.stop:
            continue
        rg, rh, rn = (v[:, s] for v in (g, h, n))
        if c < numeric:
            rg, rh, rn = (total - np.cumsum(v, axis=1) for total, v in zip((all_g, all_h, all_n), (rg, rh, rn)))
        lg, lh, ln = all_g - rg, all_h - rh, all_n - rn
        weight_l, weight_r, weight = (lh, rh, all_h) if law.second_order else (ln, rn, all_n)
        fine = (ln > 0) & (rn > 0) & (weight_l >= law.least) & (weight_r >= law.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = lg**2 / (weight_l + law.l2) + rg**2 / (weight_r + law.l2) - all_g**2 / (weight + law.l2)
        gain = np.where(fine, gain, -np.inf)
        at = gain.argmax(axis=1)
        better = gain[every, at] > best + 1e-12
        column[better], value[better], best[better] = c, at[better], gain[every, at][better]
        left[better] = np.stack((lg[every, at], lh[every, at]), axis=1)[better]
        right[better] = np.stack((rg[every, at], rh[every, at]), axis=1)[better]
    return list(zip(column.tolist(), value.tolist(), best.tolist(), left.tolist(), right.tolist(), all_n.ravel().tolist()))


def step(g: float, h: float, law: Boosting) -> float:
    """Newton step of a leaf, shrunk by the rate."""
    return -law.rate * g / (h + law.l2) if h + law.l2 > 1e-12 else 0.0


def grow(
    encoded: DataFrame, bins: Bins, models: Sequence[tuple[Boosting, int]], part: str = "part", every: int = UPDATED_EVERY,
) -> tuple[list[Grown], DataFrame]:
    """Grow all models, (law, held part) each, over the rows of `encoded`; and y, part and the margin of every model for all rows.

    `encoded` has the label, `part` (TEST for rows no model learns from), z_n<i> and i_k<j>. A model without both classes in its
    rows stays at its base, the smoothed log odds.
    """
    spark = encoded.sparkSession
    counted = encoded.groupBy(F.col(part).cast("int").alias("part"), F.col(LABEL).cast("int").alias("y")).count().collect()  # two per part
    grown = []
    for law, held in models:
        neg, pos = (sum(r["count"] for r in counted if r["y"] == k and r["part"] not in (TEST, held)) for k in (0, 1))
        share = pos / (neg + pos) if neg and pos else (pos + 1) / (neg + pos + 2)
        grown.append(Grown(law, held, float(np.log(share / (1 - share)))))
        if not (neg and pos):
            grown[-1].law = Boosting(0, law.depth, law.rate, law.second_order, law.l2, law.least)
    rows = sum(r["count"] for r in counted)
    work, context = rows * len(grown), spark.sparkContext
    tasks = max(1, min(work // LEAST_WORK, max(context.defaultParallelism, work // WORK_A_TASK)))
    binned = bin_rows(encoded.coalesce(tasks), bins, part)
    table = iterative_session(spark, tasks, blobs=True).read.schema(binned.schema).parquet(written(binned, "boosting"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    jvm = kernels.load(spark)
    ints, starts, numeric = kernels.ints, bins.starts, len(bins.cuts)
    trees = jvm.trees(numeric, ints([m.held for m in grown]), ints([m.law.depth for m in grown]), ints(starts), kernels.doubles([m.base for m in grown]))
    level_of = getattr(context._jvm.org.apache.spark.api.java.StorageLevels, STORED)
    current = jvm.blocks(kernels.rows_of(table), trees).persist(level_of)
    size, few = int(starts[-1]), current.getNumPartitions() <= FEW_TASKS

    def advanced(tree: int):
        """Blocks that did not fit in memory forget what they learn in a job, so they are written anew now and then."""
        after = jvm.advanced(current, trees, tree).persist(level_of)
        if tree % (every * CHECKPOINTED_EVERY) == 0:
            after.checkpoint()
        after.count()  # before what it is made from is given up
        current.unpersist()
        return after

    for r in range(max(m.law.rounds for m in grown)):
        if r and r % every == 0 and kernels.on_disk(spark, current):
            current = advanced(r)
        going = [k for k, m in enumerate(grown) if r < m.law.rounds]
        for m in (grown[k] for k in going):
            inner = 2**m.law.depth - 1
            for kept, fill, kind in ((m.column, 0, np.int64), (m.value, 0, np.int64), (m.gain, 0, float), (m.rows, 0, float)):
                kept.append(np.full(inner, fill, kind))
            m.leaf.append(np.zeros(inner + 1))
        held: dict[int, np.ndarray] = {}  # histograms of the level, of each model
        for level in range(max(grown[k].law.depth for k in going)):
            nodes = 2**level
            here, above = slice(nodes - 1, 2 * nodes - 1), slice(nodes // 2 - 1, nodes - 1)
            growing = [k for k in going if level < grown[k].law.depth]
            slot, smaller = np.full((len(grown), nodes), -1), {}
            for k in growing:
                m = grown[k]
                trees.grow(k, r, ints(m.column[r]), ints(m.value[r]))
                if level:
                    smaller[k] = smaller_children(held[k], m.column[r][above], m.value[r][above], m.gain[r][above], starts, numeric)
                    split = np.flatnonzero(smaller[k] >= 0)
                    slot[k, 2 * split + smaller[k][split]] = np.arange(len(split))
                else:
                    slot[k, 0] = 0
            slots = (slot >= 0).sum(axis=1)
            counted = np.zeros((slots.sum(), size, 3))
            if slots.any():
                found = jvm.histograms(current, trees, r, level, ints(slot), ints(slots), few)
                if len(found):  # nothing of a table without rows
                    counted = np.frombuffer(found).reshape(counted.shape)
            ends = np.cumsum(slots)
            for k in growing:
                m, mine = grown[k], counted[ends[k] - slots[k]:ends[k]]
                held[k] = children(held[k], mine, smaller[k]) if level else mine
                for i, (column, value, gain, left, right, n) in enumerate(best_splits(*np.ascontiguousarray(held[k].transpose(2, 0, 1)), bins, m.law)):
                    node = nodes - 1 + i
                    m.column[r][node], m.value[r][node], m.gain[r][node], m.rows[r][node] = column, value, gain, n
                    if level == m.law.depth - 1:
                        m.leaf[r][2 * i:2 * i + 2] = step(*left, m.law), step(*right, m.law)
                if level == m.law.depth - 1:
                    trees.grow(k, r, ints(m.column[r]), ints(m.value[r]))
                    trees.finish(k, kernels.doubles(m.leaf[r]))
    finished = kernels.frame(spark, jvm.rows(current, trees, max(m.law.rounds for m in grown)), BLOCKS)
    margins = finished.mapInArrow(lambda batches: _row_by_row(batches, starts), "y int, part int, margins array<double>")
    path = written(margins, "boosting")
    current.unpersist()
    return grown, spark.read.schema(margins.schema).parquet(path)


def to_spark(spark: SparkSession, model: Grown, bins: Bins) -> GBTClassificationModel:
    """The trees as a Spark model over x_features: it scores inside the JVM, is saved and read like any other, and knows its importances.

    Spark's boosted model reads twice its margin as log odds.
    """
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    tree, impurity = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.mllib.tree.impurity
    numeric, slot = len(bins.cuts), np.concatenate(([0], np.cumsum(bins.levels))).astype(int) + len(bins.cuts)
    width = int(slot[-1])
    uid = f"boosted_{uuid.uuid4().hex[:12]}"

    def calculator(rows: float):
        stats = new_array(jvm.double, 3)
        stats[0], stats[1], stats[2] = float(max(rows, 1.0)), 0.0, 0.0
        return impurity.VarianceCalculator(stats, int(rows))

    def leaf(value: float):
        return tree.LeafNode(float(value) / 2, 0.0, calculator(1.0))

    def node(t: int, at: int):
        inner = len(model.column[t])
        if at >= inner:
            return leaf(model.leaf[t][at - inner])
        gain, rows = float(model.gain[t][at]), float(model.rows[t][at])
        if gain <= 0:
            return node(t, 2 * at + 1)  # all rows go left
        c, v = int(model.column[t][at]), int(model.value[t][at])
        split = tree.ContinuousSplit(c, float(bins.cuts[c][v])) if c < numeric else tree.ContinuousSplit(int(slot[c - numeric]) + v, 0.5)
        return tree.InternalNode(0.0, 0.0, gain / max(rows, 1.0), node(t, 2 * at + 1), node(t, 2 * at + 2), split, calculator(rows))

    regression = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    roots = [leaf(model.base)] + [node(t, 0) for t in range(len(model.column))]
    trees, weights = new_array(regression, len(roots)), new_array(jvm.double, len(roots))
    for k, root in enumerate(roots):
        trees[k] = regression(f"{uid}_{k}", root, width)
        weights[k] = 1.0
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid, trees, weights, width, 2))
