"""Random forests of several folds, grown level by level in the same jobs.

All trees of all folds share the table of binned blocks of the boosters. A level of a group of trees is a
job, or a few where its histograms are wide: a task (Kernels.java) takes its rows one level down and counts them by
class in histograms (tree, node, drawn slot, bin); the counts of a tree are added up and its splits picked where
they meet, so the driver sees splits, never histograms or rows. Rows of a tree are drawn anew from the
content of their block each time; the nodes of a group are remembered in the blocks, and found again from the roots where a block was lost.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.operators import kernels
from churnspark.operators.boost import STORED, TEST, Bins, bin_rows
from churnspark.operators.split import SEED
from churnspark.session import iterative_session, shared_folder, written

#: Cuts of a numeric column at most, rows of a task at least and once every core has one, bytes of a task's histograms.
CUTS, LEAST_ROWS, ROWS_A_TASK, HISTOGRAM_BYTES = 31, 10_000, 1_600_000, 64 << 20
REMEMBERED_BYTES = 96 << 20  # nodes of a group of trees that the blocks of a task remember, two bytes a row and tree
NOWHERE = np.iinfo(np.int32).max  # a value that no bin exceeds

#: How often a row is drawn for a tree, by a number below 65,536: Poisson of mean one.
DRAWN = np.searchsorted(65536 * np.exp(-1) * np.cumsum(1 / np.cumprod([1, *range(1, 12)])), np.arange(65536), side="right").astype(np.uint8)


@dataclass(frozen=True)
class Forest:
    """Size and law: bootstrap rows, gini, the root of the number of slots drawn for each node, `least` drawn rows on each side."""

    trees: int = 160
    depth: int = 10
    least: int = 3


@dataclass
class Grown:
    """Trees as complete binary trees: node i has children 2i + 1 and 2i + 2. A node without a split sends all rows left."""

    law: Forest
    held: int
    weights: np.ndarray  # of the classes
    column: np.ndarray  # tree, inner node
    value: np.ndarray
    gain: np.ndarray
    counts: np.ndarray = field(repr=False)  # tree, node, class: drawn rows
    live: np.ndarray = field(repr=False)  # tree, node: rows come here and may be split

    def take(self, tree: int, level: int, found: np.ndarray) -> None:
        """The splits of the live nodes of a level."""
        nodes = np.flatnonzero(self.live[tree, 2**level - 1:2**(level + 1) - 1]) + 2**level - 1
        column, value, gain, *sides = found.reshape(len(nodes), -1).T
        left, total = (np.stack(s, axis=1).astype(np.int64) for s in (sides[:2], sides[2:]))
        self.counts[tree, nodes] = total
        cut = gain > 0
        at = nodes[cut]
        self.column[tree, at], self.value[tree, at], self.gain[tree, at] = column[cut], value[cut], gain[cut]
        for child, rows_there in ((2 * at + 1, left[cut]), (2 * at + 2, (total - left)[cut])):
            self.counts[tree, child] = rows_there
            self.live[tree, child] = (rows_there.min(axis=1) > 0) & (rows_there.sum(axis=1) >= 2 * self.law.least)

    def prune(self, nothing: int) -> None:
        """Two leaves that predict the same become one, as Spark's forests have it, from the bottom up."""
        total = self.counts * self.weights
        predicted = total[:, :, 1] > total[:, :, 0]
        for level in reversed(range(self.law.depth)):
            at = np.arange(2**level - 1, 2**(level + 1) - 1)
            leaf = [self.gain[:, c] <= 0 if level < self.law.depth - 1 else np.ones((self.law.trees, len(at)), bool) for c in (2 * at + 1, 2 * at + 2)]
            same = leaf[0] & leaf[1] & (predicted[:, 2 * at + 1] == predicted[:, 2 * at + 2])
            for kept, gone in ((self.gain, 0), (self.column, 0), (self.value, nothing)):
                kept[:, at] = np.where(same, gone, kept[:, at])

    def shares(self) -> np.ndarray:
        """Weighted share of class 1 by tree and leaf of the last level."""
        total = self.counts * self.weights
        with np.errstate(invalid="ignore", divide="ignore"):
            out = total[:, :1, 1] / total[:, :1].sum(axis=2)
            for level in range(self.law.depth):
                here = slice(2**level - 1, 2**(level + 1) - 1)
                below = total[:, 2**(level + 1) - 1:2**(level + 2) - 1]
                split = np.repeat(self.gain[:, here] > 0, 2, axis=1)
                out = np.where(split, below[:, :, 1] / below.sum(axis=2), np.repeat(out, 2, axis=1))
        return out


def drawn_slots(tree: int, level: int, slots: int) -> np.ndarray:
    """Distinct slots, as many as the root of their number, for each node of a level."""
    k, rng = int(np.ceil(np.sqrt(slots))), np.random.default_rng([SEED, tree, level])
    out = rng.integers(0, slots, (2**level, k))
    while True:
        ordered = np.sort(out, axis=1)
        twice = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
        if not len(twice):
            return ordered
        out[twice] = rng.integers(0, slots, (len(twice), k))


def best_splits(counts: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Gain, position among the drawn slots and last bin of the left side, rows of both classes on the left and in all, per node.

    counts: drawn slot, node, bin, class. The first of equal gains wins; a gain of 0 is no split.
    """
    # an array for each class: sums over an axis of two are slow
    left = [counts[..., y].cumsum(axis=2) for y in (0, 1)]
    total = [v[:1, :, -1:] for v in left]
    right = [t - v for t, v in zip(total, left)]

    def gini(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, b = (v * weight for v, weight in zip(rows, weights))
        both = a + b
        with np.errstate(invalid="ignore", divide="ignore"):
            return both, 1 - (a**2 + b**2) / both**2

    (wl, gl), (wr, gr), (w, g) = gini(left), gini(right), gini(total)
    fine = (left[0] + left[1] >= least) & (right[0] + right[1] >= least)
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = np.where(fine, g - (wl / w) * gl - (wr / w) * gr, 0)
    bins, nodes = counts.shape[2], counts.shape[1]
    flat = gain.transpose(1, 0, 2).reshape(nodes, -1)
    at = flat.argmax(axis=1)
    every = np.arange(nodes)
    sides = np.stack([v[at // bins, every, at % bins] for v in left], axis=1)
    return flat[every, at], at // bins, at % bins, sides, np.stack([v[0, :, 0] for v in total], axis=1)


@dataclass(frozen=True)
class _Level:
    """What a task has to know: the trees (number, model) whose level is split."""

    trees: list[tuple[int, int]]
    live: list[np.ndarray]  # nodes of the level
    level: int
    starts: np.ndarray
    n_numeric: int
    levels: tuple[int, ...]

    @property
    def bins(self) -> int:
        return int(max(2, *np.diff(self.starts)[:self.n_numeric], 2)) if self.n_numeric else 2

    def every_slot(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Column and level (or -1) of the drawn slots of all nodes: node, drawn slot."""
        column = np.concatenate((np.arange(self.n_numeric), np.repeat(np.arange(len(self.levels)) + self.n_numeric, self.levels)))
        level = np.concatenate((np.full(self.n_numeric, -1), *[np.arange(n) for n in self.levels])).astype(np.int64)
        chosen = drawn_slots(self.trees[k][0], self.level, len(column))
        return column[chosen], level[chosen]

    def slots(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the live nodes: drawn slot, node."""
        column, level = self.every_slot(k)
        return column[self.live[k]].T, level[self.live[k]].T

    def numbers(self, k: int) -> np.ndarray:
        """Of each node its number among the live ones, or -1."""
        out = np.full(2**self.level, -1)
        out[self.live[k]] = np.arange(len(self.live[k]))
        return out

    def split(self, laws: list[Forest], weights: list[np.ndarray]):
        """Function of Arrow batches: the splits of a tree's nodes, of the counts of all tasks."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for r in range(batch.num_rows):
                    tree, m, size, counts = (c[r].as_py() for c in batch.columns)
                    sums[tree, m] = sums.get((tree, m), 0) + np.frombuffer(counts, f"u{size}").astype(np.int64)
            for k, key in enumerate(self.trees):
                if key in sums:
                    column, level = self.slots(k)
                    every = np.arange(len(self.live[k]))
                    gain, slot, cut, left, total = best_splits(sums[key].reshape(len(column), len(every), self.bins, 2), weights[key[1]], laws[key[1]].least)
                    value = np.where(level[slot, every] < 0, cut, level[slot, every])
                    found = np.column_stack((column[slot, every], value, gain, left, total)).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, found.tobytes())], names=["tree", "model", "found"])

        return run


def drawn(mark: int, tree: int, rows: int) -> np.ndarray:
    """How often each row of a block is drawn for a tree, the same whenever asked."""
    return DRAWN.take(np.random.Generator(np.random.SFC64([SEED, mark, tree])).integers(0, 65536, rows, np.uint16))


def seeds(mark: int, trees: int) -> bytes:
    """States of the generators from which the rows of a block are drawn, tree by tree."""
    return np.array([np.random.SFC64([SEED, mark, tree]).state["state"]["state"] for tree in range(trees)], "<u8").tobytes()


def grow(
    encoded: DataFrame, bins: Bins, models: Sequence[tuple[Forest, int]], part: str = "part", weighted: bool = True,
) -> tuple[list[Grown], DataFrame]:
    """Grow all models, (law, held part) each, over the rows of `encoded`; and the table of blocks they grew on.

    `encoded` as for boost.grow. weighted: the classes of a model's rows weigh the same.
    """
    spark = encoded.sparkSession
    counted = encoded.groupBy(F.col(part).cast("int").alias("part"), F.col(LABEL).cast("int").alias("y")).count().collect()  # two per part
    grown = []
    for law, held in models:
        sizes = [sum(r["count"] for r in counted if r["y"] == y and r["part"] not in (TEST, held)) for y in (0, 1)]
        weights = np.array([sum(sizes) / (2 * max(1, n)) for n in sizes]) if weighted else np.ones(2)
        inner = 2**law.depth - 1
        grown.append(Grown(
            law, held, weights, np.zeros((law.trees, inner), np.int32), np.full((law.trees, inner), NOWHERE if bins.cuts else -1, np.int32),
            np.zeros((law.trees, inner)), np.zeros((law.trees, 2 * inner + 1, 2), np.int64), np.zeros((law.trees, 2 * inner + 1), bool),
        ))
        grown[-1].live[:, 0] = sum(sizes) > 0
    rows = sum(r["count"] for r in counted)
    tasks = max(1, min(rows // LEAST_ROWS, max(spark.sparkContext.defaultParallelism, rows // ROWS_A_TASK)))
    session = iterative_session(spark, min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), blobs=True)
    trees = max(law.trees for law, _ in models)
    binned = bin_rows(encoded.repartition(tasks), bins, part, {"seeds": lambda block: seeds(zlib.crc32(block.x), trees)})
    table = session.read.schema(binned.schema).parquet(written(binned, "forest"))
    slots = len(bins.cuts) + sum(bins.levels)
    jvm = kernels.load(spark)
    ints, numeric, drawn_a_node = kernels.ints, len(bins.cuts), int(np.ceil(np.sqrt(slots)))
    current = jvm.drawn(kernels.rows_of(table), len(bins.starts) - 1).persist(getattr(spark.sparkContext._jvm.org.apache.spark.api.java.StorageLevels, STORED))
    # trees next to each other share what is drawn; a group's nodes are remembered in the blocks while its levels grow
    every = [(t, m) for t in range(trees) for m, g in enumerate(grown) if t < g.law.trees]
    together = max(1, REMEMBERED_BYTES // (2 * max(1, rows // tasks)))
    for first in range(0, len(every), together):
        group = every[first:first + together]
        splits = jvm.splits(first, ints([t for t, _ in group]), ints([m for _, m in group]), ints([g.held for g in grown]), max(2**grown[m].law.depth - 1 for _, m in group))
        for level in range(max(grown[m].law.depth for _, m in group)):
            here = slice(2**level - 1, 2**(level + 1) - 1)
            going = [(p, t, m) for p, (t, m) in enumerate(group) if level < grown[m].law.depth and grown[m].live[t, here].any()]
            width = 2 * 4 * drawn_a_node * max([2, *[len(c) + 1 for c in bins.cuts]])
            jobs, room = [], 0
            for p, t, m in going:  # so that the histograms of a job fit in a task
                need = width * int(grown[m].live[t, here].sum())
                if not jobs or room < need:
                    jobs.append([])
                    room = HISTOGRAM_BYTES
                jobs[-1].append((p, t, m))
                room -= need
            for wanted in jobs:
                job = _Level(
                    [(t, m) for _, t, m in wanted], [np.flatnonzero(grown[m].live[t, here]) for _, t, m in wanted], level, bins.starts, numeric, bins.levels)
                column, only = (np.stack(v) for v in zip(*[job.every_slot(k) for k in range(len(wanted))]))
                rows_there = jvm.counts(
                    current, splits, level, job.bins, drawn_a_node, numeric, ints([p for p, _, _ in wanted]),
                    ints([job.numbers(k) for k in range(len(wanted))]), ints(column), ints(only), DRAWN.tobytes())
                counts = kernels.frame(session, rows_there, "tree long, model long, size long, counts binary")
                found = counts.repartition("tree", "model").mapInArrow(
                    job.split([g.law for g in grown], [g.weights for g in grown]), "tree long, model long, found binary")
                for tree, m, packed in _rows(found):
                    grown[m].take(tree, level, np.frombuffer(packed))
            known = [(g.column[t, here], g.value[t, here]) if level < g.law.depth else (np.zeros(2**level),) * 2 for t, g in ((t, grown[m]) for t, m in group)]
            splits.put(level, *(ints(v) for v in zip(*known)))
    current.unpersist()
    for g in grown:
        g.prune(NOWHERE if bins.cuts else -1)
    return grown, table


def _rows(splits: DataFrame):
    found = splits.toArrow()  # one row for each tree
    return zip(*(found.column(c).to_pylist() for c in ("tree", "model", "found")))


def held_scores(table: DataFrame, grown: Sequence[Grown], bins: Bins, schema: str = "part int, y int, model int, x_score double") -> DataFrame:
    """Score of every row by each model that it is held from: the mean share of class 1 over the trees."""
    spark, jvm, ints = table.sparkSession, kernels.load(table.sparkSession), kernels.ints
    job = jvm.scores(len(bins.starts) - 1, len(bins.cuts), len(grown))
    for m, g in enumerate(grown):
        jvm.add(job, m, g.held, g.law.trees, ints(g.column), ints(g.value), kernels.doubles(g.shares()))
    return kernels.frame(spark, jvm.scored(kernels.rows_of(table), job), schema)


def to_spark(spark: SparkSession, model: Grown, bins: Bins) -> RandomForestClassificationModel:
    """The trees as a Spark model over x_features, written in the format of its writer and read back."""
    numeric, slot = len(bins.cuts), np.concatenate(([0], np.cumsum(bins.levels))).astype(int) + len(bins.cuts)
    stats = model.counts * model.weights
    trees, nodes = [], []

    def add(t: int, at: int) -> int:
        """Number of the node that was added, after which its children follow."""
        me, (a, b) = len(nodes), stats[t, at].tolist()
        both = a + b
        node = {"id": me - first, "prediction": float(b > a), "impurity": 1 - (a * a + b * b) / both**2 if both else 0.0, "impurityStats": [a, b],
                "rawCount": int(model.counts[t, at].sum()), "gain": -1.0, "leftChild": -1, "rightChild": -1,
                "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        trees.append(t)
        nodes.append(node)
        if at < model.gain.shape[1] and model.gain[t, at] > 0:
            c, v = int(model.column[t, at]), int(model.value[t, at])
            index, cut = (c, float(bins.cuts[c][v])) if c < numeric else (int(slot[c - numeric]) + v, 0.5)
            node |= {"gain": float(model.gain[t, at]), "split": {"featureIndex": index, "leftCategoriesOrThreshold": [cut], "numCategories": -1}}
            node["leftChild"] = add(t, 2 * at + 1)
            node["rightChild"] = add(t, 2 * at + 2)
        return me - first

    for t in range(model.law.trees):
        first = len(nodes)
        add(t, 0)
    uid, path = f"forest_{uuid.uuid4().hex[:12]}", f"{shared_folder(spark)}/forest-model-{uuid.uuid4().hex}"

    def about(name: str, uid: str, params: dict, **more: int) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.classification.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": uid, "paramMap": params, "defaultParamMap": {}} | more)

    params = {"impurity": "gini", "maxDepth": model.law.depth, "minInstancesPerNode": model.law.least, "seed": SEED}
    top = about("RandomForestClassificationModel", uid, params | {"numTrees": model.law.trees}, numFeatures=int(slot[-1]), numClasses=2, numTrees=model.law.trees)
    spark.createDataFrame([(top,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(t, about("DecisionTreeClassificationModel", f"{uid}_{t}", params), 1.0) for t in range(model.law.trees)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    kind = pa.struct([
        ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
        ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
        ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
    ])
    packed = pa.table({"treeID": pa.array(trees, pa.int32()), "nodeData": pa.array(nodes, kind)})
    spark.createDataFrame(packed).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
