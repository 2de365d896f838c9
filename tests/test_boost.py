"""Boosters grown together: against trees grown row by row, and as Spark models."""

import numpy as np
import pytest
from conftest import telco
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.operators import boost, features, split, train
from churnspark.operators.clean import clean
from churnspark.operators.profile import profile

LAWS = [
    boost.Boosting(3, 3, 0.3),
    boost.Boosting(2, 2, 0.3, second_order=True, l2=1.0),
    boost.Boosting(3, 3, 0.2, second_order=True, l2=4.0, least=3.0),
]


def brute_force(x, y, law):
    """Margins of trees over all columns and all thresholds between seen values, one node's rows at a time."""
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(law.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def cost(rows):
            return g[rows].sum() ** 2 / ((h[rows].sum() if law.second_order else len(rows)) + law.l2)

        def enough(rows):
            return len(rows) and (h[rows].sum() if law.second_order else len(rows)) >= law.least

        def leaves(rows, depth):
            best, sides = 1e-12, None
            if depth:
                for c in range(x.shape[1]):
                    for cut in np.unique(x[rows, c])[:-1]:
                        left, right = rows[x[rows, c] <= cut], rows[x[rows, c] > cut]
                        if enough(left) and enough(right) and cost(left) + cost(right) - cost(rows) > best + 1e-12:
                            best, sides = cost(left) + cost(right) - cost(rows), (left, right)
            if sides is None:
                total = h[rows].sum() + law.l2
                yield rows, -law.rate * g[rows].sum() / total if total > 1e-12 else 0.0
                return
            for side in sides:
                yield from leaves(side, depth - 1)

        for rows, step in list(leaves(np.arange(len(y)), law.depth)):
            margin[rows] += step
    return margin


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
    return encoded, boost.learn_bins(encoded, len(prof.numeric), levels, cuts=20), len(prof.numeric)


def arrays(encoded, bins, n):
    """Slots as the models see them: numbers at their cuts, a zero or one for each level."""
    rows = encoded.select("x_id", "part", LABEL, vector_to_array("x_features")).orderBy("x_id").collect()
    x = np.array([r[3] for r in rows])
    for c in range(n):
        x[:, c] = np.searchsorted(bins.cuts[c], x[:, c], side="left")
    return x, np.array([r[2] for r in rows]), np.array([r[1] for r in rows])


def test_margins_equal_trees_grown_row_by_row(spark, book):
    encoded, bins, n = book
    x, y, part = arrays(encoded, bins, n)
    models = [(law, held) for law in LAWS for held in (boost.TEST, 1)]
    grown, margins = boost.grow(encoded, bins, models, every=2)
    found = np.array([r[0] for r in margins.select("margins").collect()])
    assert len(found) == len(y)
    for k, (law, held) in enumerate(models):
        mine = (part != boost.TEST) & (part != held)
        want = np.sort(brute_force(x[mine], y[mine], law))
        rows = margins.where((F.col("part") != boost.TEST) & (F.col("part") != held)).select(F.col("margins")[k]).collect()
        np.testing.assert_allclose(np.sort([r[0] for r in rows]), want, atol=1e-9)
        assert len(np.unique(np.round(want, 9))) > 3


def test_spark_model_scores_like_the_margins(spark, book, tmp_path):
    encoded, bins, _ = book
    (grown,), margins = boost.grow(encoded, bins, [(LAWS[2], boost.TEST)])
    model = train._columns(boost.to_spark(spark, grown, bins))
    model.write().save(str(tmp_path / "model"))
    again = GBTClassificationModel.load(str(tmp_path / "model"))
    want = sorted(r[0] for r in margins.select(1 / (1 + F.exp(-F.col("margins")[0]))).collect())
    for m in (model, again):
        got = sorted(r["x_score"] for r in train.probability(m.transform(encoded)).select("x_score").collect())
        np.testing.assert_allclose(got, want, atol=1e-9)
        assert m.featureImportances.toArray().sum() == pytest.approx(1) and m.featureImportances == model.featureImportances


def test_one_class_or_no_split_stays_at_the_base(spark, book):
    encoded, bins, _ = book
    (one,), margins = boost.grow(encoded.where(F.col(LABEL) == 0), bins, [(LAWS[0], boost.TEST)])
    assert one.column == [] and margins.select("margins").distinct().count() == 1
    stubborn = boost.Boosting(2, 2, second_order=True, least=1e9)
    (none,), margins = boost.grow(encoded, bins, [(stubborn, boost.TEST)])
    assert not np.concatenate(none.gain).any() and margins.select("margins").distinct().count() == 1
    model = train._columns(boost.to_spark(spark, none, bins))
    assert model.transform(encoded).select("x_probability").distinct().count() == 1


def test_tables_of_levels_only_and_unseen_levels(spark):
    rows = [(k % 2 if k < 40 else 1, 0, float(k % 2), 2.0) for k in range(60)]
    encoded = spark.createDataFrame(rows, f"{LABEL} int, part int, i_k0 double, i_k1 double")
    bins = boost.learn_bins(encoded, 0, [2, 2])
    (grown,), margins = boost.grow(encoded, bins, [(boost.Boosting(4, 2), boost.TEST)])
    means = {r["y"]: r["m"] for r in margins.groupBy("y").agg(F.avg(F.col("margins")[0]).alias("m")).collect()}
    assert means[1] > means[0] and not any((c == 1).any() and g[c == 1].any() for c, g in zip(grown.column, grown.gain))


def test_jobs_do_not_grow_with_models(spark, book):
    """A level is one aggregate whatever the number of candidates and folds."""
    encoded, bins, _ = book
    group = {}
    for count in (1, 6):
        spark.sparkContext.setJobGroup(f"boost-{count}", "")
        boost.grow(encoded, bins, [(LAWS[0], k) for k in range(-1, count - 1)])
        group[count] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boost-{count}"))
    spark.sparkContext.setJobGroup("tests", "")
    assert 0 < group[6] <= group[1] + 1


def test_sums_that_meet_in_a_shuffle_and_checkpoints_change_nothing(spark, book, monkeypatch):
    a = np.array([1, 4, 9]), *(np.array([1.0, 2.0, 3.0]) * k for k in (1, 2, 3))
    b = np.array([0, 4]), *(np.array([5.0, 7.0]) * k for k in (1, 2, 3))
    key, *sums = boost.added(a, b)
    assert key.tolist() == [0, 1, 4, 9] and [s.tolist() for s in sums] == [[5 * k, k, 9 * k, 3 * k] for k in (1, 2, 3)]
    encoded, bins, _ = book
    models = [(LAWS[0], 1), (LAWS[1], boost.TEST)]
    found = []
    for few, work in ((boost.FEW_TASKS, boost.LEAST_WORK), (0, 500)):
        monkeypatch.setattr(boost, "FEW_TASKS", few)
        monkeypatch.setattr(boost, "LEAST_WORK", work)
        monkeypatch.setattr(boost, "CHECKPOINTED_EVERY", 1)
        grown, margins = boost.grow(encoded, bins, models, every=1)
        found.append(sorted(tuple(np.round(r[0], 9)) for r in margins.select("margins").collect()))
        assert [len(g.column) for g in grown] == [3, 2]
    assert len(found[0]) == 2000
    np.testing.assert_allclose(*found, atol=1e-8)
