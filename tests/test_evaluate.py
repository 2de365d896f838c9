import numpy as np
import pytest
from pyspark.sql import functions as F

from churnspark.operators import evaluate as E

Y = [1, 0, 1, 1, 0, 0, 1, 0]
PRED = [1, 0, 1, 0, 0, 0, 1, 0]
P = [0.9, 0.1, 0.8, 0.4, 0.2, 0.1, 0.85, 0.15]


def frame(spark, y, p, pred=None):
    pred = pred or [int(v >= 0.5) for v in p]
    return spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, p, pred)], "_y int, p double, pred int")


def brute(y, p):
    y, p = np.array(y), np.array(p)
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    ap = 0.0
    for t in np.unique(p):
        got = (p >= t)
        ap += ((p == t) & (y == 1)).sum() / len(pos) * (y[got] == 1).sum() / got.sum()
    return auc, ap


def test_golden(spark):
    row = E.evaluate(frame(spark, Y, P, PRED), "p", "pred").first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (4, 0, 1, 3)
    assert (row["accuracy"], row["precision"], row["recall"]) == (0.875, 1.0, 0.75)
    assert row["f1"] == pytest.approx(6 / 7) and row["roc_auc"] == 1.0 and row["pr_auc"] == 1.0
    assert (row["tn_rate"], row["tp_rate"]) == (1.0, 0.75)


@pytest.mark.parametrize("cells,want", [
    ((747, 288, 81, 293), (0.7381, 0.5043, 0.7834, 0.6136)),
    ((805, 230, 101, 273), (0.7651, 0.5427, 0.7299, 0.6226)),
    ((930, 105, 179, 195), (0.7984, 0.6500, 0.5214, 0.5786)),
    ((938, 97, 178, 196), (0.8048, 0.6689, 0.5241, 0.5877)),
])
def test_published_confusions(spark, cells, want):
    counts = spark.createDataFrame([cells], "tn long, fp long, fn long, tp long")
    row = E.threshold_metrics(counts).first()
    assert tuple(round(row[m], 4) for m in ("accuracy", "precision", "recall", "f1")) == want
    report = {r["class"]: r for r in E.classification_report(counts).collect()}
    assert report["1"]["support"] == 374 and report["0"]["support"] == 1035
    assert round(report["1"]["f1"], 4) == want[3]
    assert report["macro avg"]["recall"] == pytest.approx((report["0"]["recall"] + report["1"]["recall"]) / 2)


@pytest.mark.parametrize("splits", [[], [0.5], [0.1, 0.2, 0.3, 0.9], [-1.0, 2.0]])
def test_ranking_against_brute_force(spark, splits):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(400), 2)
    p[:130] = 0.3  # one score holds a third of the rows
    y = (rng.random(400) < p).astype(int)
    groups = E.score_groups(frame(spark, y, p), "p")
    row = E._ranking(groups, splits, ()).first()
    auc, ap = brute(y, p)
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-12) and row["pr_auc"] == pytest.approx(ap, abs=1e-12)


def test_by_group_with_forced_buckets(spark, monkeypatch):
    monkeypatch.setattr(E, "SCORES_PER_TASK", 10)
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for g in "ab":
        p, y = rng.random(200), rng.integers(0, 2, 200)
        rows += [(g, int(a), float(b), int(b >= 0.5)) for a, b in zip(y, p)]
        want[g] = brute(y, p)
    df = spark.createDataFrame(rows, "g string, _y int, p double, pred int")
    assert len(E.score_splits(df, "p", 10)) > 10
    monkeypatch.setattr(E, "score_splits", lambda df, score: [0.2, 0.4, 0.4001, 0.7])
    for r in E.evaluate(df, "p", "pred", by=["g"]).collect():
        assert (r["roc_auc"], r["pr_auc"]) == pytest.approx(want[r["g"]], abs=1e-12)


def test_one_class(spark):
    row = E.evaluate(frame(spark, [1, 1], [0.2, 0.9]), "p", "pred").first()
    assert (row["roc_auc"], row["pr_auc"], row["tp"], row["fn"], row["tn_rate"]) == (0.5, 0.0, 1, 1, 0.0)


def test_roc_points_end_at_one(spark):
    pts = E.roc_points(frame(spark, Y, P), "p").orderBy(F.desc("threshold")).collect()
    assert (pts[-1]["fpr"], pts[-1]["tpr"]) == (1.0, 1.0) and pts[0]["threshold"] == 0.9 and pts[0]["tpr"] == 0.25
