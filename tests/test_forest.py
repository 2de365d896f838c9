"""Forests grown together: against a tree grown row by row, and as Spark models."""

import numpy as np
import pytest
from conftest import telco
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.operators import boost, features, forest, split, train
from churnspark.operators.clean import clean
from churnspark.operators.profile import profile


@pytest.fixture(scope="module")
def book(spark):
    """2,000 customers, encoded, with folds as parts and one part that nothing learns from."""
    df = telco(spark, 2000, seed=5)
    prof = profile(df, "book.csv")
    rows, _ = train.staged_inputs(clean(df, prof), prof)
    marked = split.mark_folds(rows, "x_id", 4).withColumn("part", F.col("fold") - 1)
    encoder = features.fit(rows, prof)
    encoded = encoder.transform(marked).persist()
    levels = [len(v) for v in features.levels_of(encoder)]
    return encoded, boost.learn_bins(encoded, len(prof.numeric), levels, cuts=20)


def gini(rows, w):
    share = rows * w / (rows * w).sum()
    return 1 - (share**2).sum()


def test_splits_are_the_best_of_the_drawn_slots():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 6, (3, 4, 5, 2))
    counts[1:] = counts[:1, :, ::-1]  # slots of a node count the same rows
    w = np.array([0.7, 1.9])
    gain, slot, cut, left, total = forest.best_splits(counts, w, 3)
    for node in range(4):
        whole, best = counts[0, node].sum(axis=0), 0.0
        for j in range(3):
            for b in range(4):
                a = counts[j, node, :b + 1].sum(axis=0)
                z = whole - a
                if min(a.sum(), z.sum()) >= 3:
                    best = max(best, gini(whole, w) - (a * w).sum() / (whole * w).sum() * gini(a, w) - (z * w).sum() / (whole * w).sum() * gini(z, w))
        assert gain[node] == pytest.approx(best)
        assert (left[node] == counts[slot[node], node, :cut[node] + 1].sum(axis=0)).all() and (total[node] == whole).all()


def test_nodes_hold_the_rows_that_reach_them(spark, book):
    """Counts of every node equal those of its drawn rows walked down row by row; slots are those drawn for the node."""
    encoded, bins = book
    law = forest.Forest(4, 4, 3)
    grown, table = forest.grow(encoded, bins, [(law, boost.TEST), (law, 1)])
    blocks = [b for r in table.toArrow().to_batches() for b in boost.blocks([r], bins.starts)]
    starts = np.concatenate((np.arange(len(bins.cuts)), np.repeat(np.arange(len(bins.levels)) + len(bins.cuts), bins.levels)))
    for g in grown:
        assert (g.gain[:, 0] > 0).all()
        for t in range(law.trees):
            found = np.zeros_like(g.counts[t])
            for b in blocks:
                times = forest.drawn(forest.zlib.crc32(b.x), t, len(b.y))
                for row in np.flatnonzero((b.part != boost.TEST) & (b.part != g.held)):
                    at = 0
                    while True:
                        found[at, b.y[row]] += times[row]
                        if at >= len(g.gain[t]) or g.gain[t, at] <= 0:
                            break
                        c, v = g.column[t, at], g.value[t, at]
                        assert c in starts[forest.drawn_slots(t, int(np.log2(at + 1)), len(starts))[at + 1 - 2 ** int(np.log2(at + 1))]]
                        at = 2 * at + 1 + int(b.x[c, row] > v if c < len(bins.cuts) else b.x[c, row] == v)
            reached = found.sum(axis=1) > 0
            assert (found[reached] == g.counts[t][reached]).all()


def test_spark_model_scores_like_the_blocks(spark, book, tmp_path):
    encoded, bins = book
    (g,), table = forest.grow(encoded, bins, [(forest.Forest(12, 5, 3), 1)])
    model = train._columns(forest.to_spark(spark, g, bins))
    model.write().save(str(tmp_path / "model"))
    again = RandomForestClassificationModel.load(str(tmp_path / "model"))
    want = sorted(r["x_score"] for r in forest.held_scores(table, [g], bins).collect())
    assert len(want) == encoded.where("part = 1").count()
    for m in (model, again):
        got = sorted(r["x_score"] for r in train.probability(m.transform(encoded.where("part = 1"))).select("x_score").collect())
        np.testing.assert_allclose(got, want, atol=1e-9)
        assert m.featureImportances.toArray().sum() == pytest.approx(1) and m.getNumTrees == 12


def test_drawn_rows_follow_the_law():
    times = forest.drawn(7, 3, 200_000)
    assert (times == forest.drawn(7, 3, 200_000)).all() and (times != forest.drawn(7, 4, 200_000)).any()
    assert np.bincount(times)[:3] / 200_000 == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2], abs=0.01)
    chosen = forest.drawn_slots(1, 8, 21)
    assert chosen.shape == (256, 5) and (np.diff(chosen, axis=1) > 0).all() and set(chosen.ravel()) == set(range(21))


def test_jobs_do_not_grow_with_folds(spark, book):
    encoded, bins = book
    group = {}
    for count in (1, 4):
        spark.sparkContext.setJobGroup(f"forest-{count}", "")
        forest.grow(encoded, bins, [(forest.Forest(6, 3), k) for k in range(-1, count - 1)])
        group[count] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{count}"))
    spark.sparkContext.setJobGroup("tests", "")
    assert 0 < group[4] <= group[1] + 1


def test_one_class_and_tables_of_levels_only(spark):
    rows = [(k % 2, 0, float(k % 2), 2.0) for k in range(60)]
    encoded = spark.createDataFrame(rows, f"{LABEL} int, part int, i_k0 double, i_k1 double")
    bins = boost.learn_bins(encoded, 0, [2, 2])
    (g,), table = forest.grow(encoded, bins, [(forest.Forest(10, 3), 0)])
    assert not g.gain.any()  # the only part is held
    (g,), table = forest.grow(encoded, bins, [(forest.Forest(10, 3), boost.TEST)])
    g.held = 0
    means = {r["y"]: r["m"] for r in forest.held_scores(table, [g], bins).groupBy("y").agg(F.avg("x_score").alias("m")).collect()}
    assert means[1] > means[0]
    (g,), _ = forest.grow(encoded.where(f"{LABEL} = 1"), bins, [(forest.Forest(5, 2), boost.TEST)])
    assert not g.gain.any()
