"""Kernels in the JVM: draws, differences of histograms, blocks outside memory; features of all folds in one go."""

import numpy as np
import pytest
from conftest import telco
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.operators import boost, features, forest, kernels, split, train
from churnspark.operators.clean import clean
from churnspark.operators.profile import profile


@pytest.fixture(scope="module")
def book(spark):
    df = telco(spark, 1200, seed=8)
    prof = profile(df, "book.csv")
    rows, _ = train.staged_inputs(clean(df, prof), prof)
    gaps = rows.withColumn("x_n0", F.when(F.xxhash64("x_id") % 7 != 0, F.col("x_n0")))
    return split.mark_folds(gaps, "x_id", 3).persist(), prof


@pytest.fixture(scope="module")
def encoded(book):
    marked, prof = book
    encoder = features.fit(marked, prof)
    rows = encoder.transform(marked.withColumnRenamed("fold", "part")).persist()
    return rows, boost.learn_bins(rows, len(prof.numeric), [len(v) for v in features.levels_of(encoder)], cuts=20)


def test_only_smaller_children_are_counted():
    rng = np.random.default_rng(2)
    starts, numeric = np.array([0, 5, 8]), 1
    rows = rng.integers(0, 4, 400), np.stack((rng.integers(0, 5, 400), rng.integers(0, 3, 400))), rng.normal(size=(2, 400))
    node, x, weights = rows

    def histograms(at, nodes):
        out = np.zeros((nodes, 8, 3))
        for i in range(len(at)):
            for c in range(2):
                out[at[i], starts[c] + x[c, i]] += (*weights[:, i], 1)
        return out

    column, value, gain = np.array([0, 1, 0, 0]), np.array([3, 1, 0, 99]), np.array([1.0, 2.0, 0.5, 0.0])
    right = np.where(column[node] < numeric, x[0] > value[node], x[1] == value[node])
    below = histograms(2 * node + right, 8)
    smaller = boost.smaller_children(histograms(node, 4), column, value, gain, starts, numeric)
    sizes = below[:, :5, 2].sum(axis=1).reshape(4, 2)
    assert smaller[3] == -1 and all(sizes[k, smaller[k]] <= sizes[k].min() for k in range(3))
    got = boost.children(histograms(node, 4), below[[2 * k + smaller[k] for k in range(3)]], smaller)
    np.testing.assert_allclose(got, below, atol=1e-12)


def test_a_level_counts_half_of_the_nodes(spark, encoded, monkeypatch):
    rows, bins = encoded
    jvm, wanted = kernels.load(spark), []

    class Watched:
        def __getattr__(self, name):
            def call(*given):
                if name == "histograms":
                    wanted.append((given[3], int(np.frombuffer(given[5], np.int32).sum())))
                return getattr(jvm, name)(*given)
            return call

    monkeypatch.setattr(kernels, "load", lambda spark: Watched())
    boost.grow(rows, bins, [(boost.Boosting(2, 4), boost.TEST), (boost.Boosting(2, 4), 1)])
    assert {level for level, _ in wanted} == {0, 1, 2, 3}
    assert all(n <= 2 * max(1, 2**level // 2) for level, n in wanted) and sum(n for _, n in wanted) > 20


def test_blocks_outside_memory_give_the_same(spark, encoded, monkeypatch):
    rows, bins = encoded
    models = [(boost.Boosting(5, 3, 0.3), boost.TEST), (boost.Boosting(3, 2, 0.3, second_order=True, l2=1.0), 1)]
    found = []
    for stored in ("MEMORY_AND_DISK", "DISK_ONLY"):
        monkeypatch.setattr(boost, "STORED", stored)
        monkeypatch.setattr(forest, "STORED", stored)
        monkeypatch.setattr(boost, "CHECKPOINTED_EVERY", 2)
        grown, margins = boost.grow(rows, bins, models, every=1)
        (trees,), _ = forest.grow(rows, bins, [(forest.Forest(6, 5), 1)])
        monkeypatch.setattr(forest, "REMEMBERED_BYTES", 2 * 2 * 1200)  # two trees together
        assert [len(g.column) for g in grown] == [5, 3]
        found.append((sorted(tuple(r[0]) for r in margins.select("margins").collect()), trees.counts.tolist(), trees.column.tolist()))
    np.testing.assert_allclose(found[0][0], found[1][0], atol=1e-9)
    assert found[0][1:] == found[1][1:] and len(found[0][0]) == 1200


def test_wide_bins_and_draws_of_any_length(spark):
    """More than 255 levels take two bytes; rows that are no multiple of four are drawn as numpy draws them."""
    rows = [((k * 7) % 3 % 2, k % 3, float(k % 301), float(k % 2)) for k in range(1021)]
    encoded = spark.createDataFrame(rows, f"{LABEL} int, part int, i_k0 double, i_k1 double")
    bins = boost.learn_bins(encoded, 0, [301, 2])
    (g,), table = forest.grow(encoded, bins, [(forest.Forest(5, 3), 1)])
    blocks = [b for r in table.toArrow().to_batches() for b in boost.blocks([r], bins.starts)]
    assert blocks[0].x.dtype == np.uint16 and sum(len(b.y) for b in blocks) == 1021
    for t in range(5):
        times = [forest.drawn(forest.zlib.crc32(b.x), t, len(b.y))[b.part != 1] for b in blocks]
        want = [sum(int(n[b.y[b.part != 1] == y].sum()) for n, b in zip(times, blocks)) for y in (0, 1)]
        assert g.counts[t, 0].tolist() == want
    (g,), margins = boost.grow(encoded, bins, [(boost.Boosting(2, 2), boost.TEST)])
    assert margins.count() == 1021 and np.concatenate(g.gain).any()


def test_features_without_each_fold_equal_those_of_the_other_rows(book):
    marked, prof = book
    sizes = {r["fold"]: r["count"] for r in marked.groupBy("fold").count().collect()}
    n, k = len(prof.numeric), len(prof.categorical)
    found = features.learn_without_each(marked, "fold", sizes, n, k)
    for fold in sizes:
        want = features.learn(marked.where(F.col("fold") != fold), n, k)
        for name in ("median", "mode", "levels"):
            assert getattr(found[fold], name) == getattr(want, name)
        for name in ("mean", "std"):
            assert getattr(found[fold], name) == pytest.approx(getattr(want, name), rel=1e-12)
    with pytest.raises(ValueError, match="levels"):
        features.learn_without_each(marked, "fold", sizes, n, k, max_levels=2)


def test_a_level_that_only_one_fold_has_is_unknown_without_it(spark):
    rows = [(k % 3, "rare" if k % 3 == 1 and k < 9 else "ab"[k % 2], None if k % 3 != 2 else "x") for k in range(60)]
    marked = spark.createDataFrame(rows, "fold int, x_k0 string, x_k1 string")
    found = features.learn_without_each(marked, "fold", {0: 20, 1: 20, 2: 20}, 0, 2)
    assert found[1].levels == [["a", "b"], ["x"]] and found[0].levels[0] == ["a", "b", "rare"] and found[2].levels[1] == [features.NO_VALUE]


def test_summaries_do_not_grow_with_folds(spark, book, monkeypatch):
    marked, prof = book
    asked, summary = [], features.numeric_summary
    monkeypatch.setattr(features, "numeric_summary", lambda *given: asked.append(1) or summary(*given))
    tiny = [c for c in train.default_candidates(lr_iterations=3) if c.make]
    cv = train.cross_validate(marked.drop("fold"), prof, tiny, folds=3)
    assert len(asked) == 1 and cv["logistic_regression"]["cv_roc_auc_mean"] > 0.5
