"""Feature preparation, training, scoring and explanation on small planted tables."""

import numpy as np
import pytest
from conftest import telco
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnspark.functions import rules
from churnspark.operators import explain, features, score, train
from churnspark.operators.clean import clean
from churnspark.operators.profile import TableProfile, profile
from churnspark.plans.diagnostics import BOOK_PROFILE
from churnspark.plans.learning import MODEL_COLUMNS

# tests of the mechanics use small models; the registered queries use the full sizes
SMALL = dict(lr_iterations=50, trees=20, tree_depth=5, rounds=8, boost_depth=3)
from churnspark.sources import books

TINY = train.default_candidates(lr_iterations=30, trees=8, tree_depth=4, rounds=4, boost_depth=3)


@pytest.fixture(scope="module")
def small(spark):
    df = telco(spark, 160)
    prof = profile(df, "small.csv")
    return clean(df, prof), prof


@pytest.fixture(scope="module")
def models(spark, small):
    df, prof = small
    rows, _ = train.staged_inputs(df, prof)
    return {c.name: train.fit_one(rows, prof, c) for c in TINY[:3]}


def test_prepared_values(spark):
    prof = TableProfile(numeric=["x"], categorical=["k"])
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, "b"), (None, None), (10.0, "a")], "x double, k string")
    rows = features.with_inputs(df, prof)
    stats = features.learn(rows, 1, 1)
    assert stats.median == [3.0] and stats.mode == ["a"] and stats.levels == [["a", "b"]]
    filled = np.array([1, 2, 4, 3, 10.0])
    assert stats.mean[0] == pytest.approx(filled.mean()) and stats.std[0] == pytest.approx(filled.std())
    model = features.fit(rows, prof)
    unseen = spark.createDataFrame([(None, "zzz"), (3.0, None)], "x double, k string")
    out = [r[0] for r in model.transform(features.with_inputs(unseen, prof)).select(vector_to_array("x_features")).collect()]
    z = (3.0 - filled.mean()) / filled.std()
    np.testing.assert_allclose(out, [[z, 0, 0], [z, 1, 0]])
    assert features.slots(model, prof) == [(0, "x", None), (1, "k", "a"), (2, "k", "b")]


def test_ragged_levels_quotes_and_all_null(spark):
    prof = TableProfile(numeric=["x"], categorical=["k", "m", "void"])
    df = spark.createDataFrame(
        [(5.0, "it's", "p", None), (5.0, "b\\n", "q", None), (5.0, "c", "q", None)], "x double, k string, m string, void string"
    )
    rows = features.with_inputs(df, prof)
    out = features.fit(rows, prof).transform(rows)
    got = [r[0] for r in out.select(vector_to_array("x_features")).collect()]
    assert all(len(v) == 1 + 3 + 2 + 1 and v[0] == 0.0 and sum(v[1:4]) == 1 and sum(v[4:6]) == 1 for v in got)


def test_too_many_levels(spark):
    prof = TableProfile(categorical=["k"])
    rows = features.with_inputs(spark.range(50).select(F.col("id").cast("string").alias("k")), prof)
    with pytest.raises(ValueError, match="levels"):
        features.fit(rows, prof, max_levels=20)


def test_only_one_kind_of_feature(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, k string")
    for prof, width in ((TableProfile(numeric=["x"]), 1), (TableProfile(categorical=["k"]), 2)):
        rows = features.with_inputs(df, prof)
        out = features.fit(rows, prof).transform(rows).select(F.size(vector_to_array("x_features"))).first()[0]
        assert out == width


def test_train_and_compare(spark, small, tmp_path):
    df, prof = small
    result = train.train_and_compare(df, prof, TINY, folds=2, test_share=(1, 4))
    rows = {r["candidate"]: r for r in result.metrics.collect()}
    assert list(rows) == [c.name for c in TINY]
    assert all(r["training_status"] == "Completed" and r["cv_folds"] == 2 and r["cv_pr_auc_mean"] > 0 for r in rows.values())
    assert all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == 40 for r in rows.values())
    meta = result.meta.first()
    assert meta["rows_total"] == 160 and meta["rows_test"] == 40 and meta["best_model"] == result.champion
    best = max(rows.values(), key=lambda r: (round(0.6 * r["pr_auc"] + 0.4 * r["roc_auc"], 10), -r["position"]))
    assert best["candidate"] == result.champion
    # the saved model gives the same scores
    path = str(tmp_path / "model")
    result.model.write().overwrite().save(path)
    a = score.score(df, result.model, prof).select("customerID", "churn_score")
    b = score.score(df, PipelineModel.load(path), prof).select("customerID", "churn_score")
    assert a.exceptAll(b).count() == 0


def test_one_class_is_refused(spark, small):
    df, prof = small
    with pytest.raises(ValueError, match="both churned and retained"):
        train.train_and_compare(df.where("_y = 0"), prof, TINY[:1])


def test_failing_candidate_scores_zero(spark, small):
    df, prof = small

    class Broken(type(TINY[0].estimator(10))):
        def fit(self, dataset, params=None):
            raise RuntimeError("no")

    result = train.train_and_compare(df, prof, [train.Candidate("broken", lambda n: Broken()), TINY[0]], folds=2)
    rows = {r["candidate"]: r for r in result.metrics.collect()}
    assert rows["broken"]["training_status"] == "Failed" and rows["broken"]["cv_pr_auc_mean"] == 0.0
    assert result.champion == "logistic_regression"


def test_published_champion(spark):
    published = [
        ("logistic_regression", 0, 0.6326, 0.8413), ("random_forest", 1, 0.6474, 0.8403),
        ("gradient_boosting", 2, 0.6545, 0.8399), ("xgboost", 3, 0.6566, 0.8436),
    ]
    metrics = spark.createDataFrame(published, "candidate string, position int, pr_auc double, roc_auc double")
    best = train.select_champion(metrics).first()
    assert best["candidate"] == "xgboost" and round(best["champion_score"], 4) == 0.7314
    tie = spark.createDataFrame([("a", 1, 0.5, 0.5), ("b", 0, 0.5, 0.5)], metrics.schema)
    assert train.select_champion(tie).first()["candidate"] == "b"
    assert [r["candidate"] for r in train.comparison(metrics).collect()][0] == "xgboost"


def test_planted_signal_is_found(spark):
    """Holdout ROC-AUC on the main book; the label is planted, so at least 0.70 must be reached."""
    df = books.labelled(spark, "/root/testdata/sf0.01", MODEL_COLUMNS)
    for candidate in train.default_candidates(**SMALL)[:2]:
        rows, _ = train.staged_inputs(df, BOOK_PROFILE)
        from churnspark.operators.evaluate import evaluate
        from churnspark.operators.split import holdout

        learn_rows, test_rows = holdout(rows, "x_id")
        model = train.fit_one(learn_rows, BOOK_PROFILE, candidate)
        got = evaluate(train.probability(model.transform(test_rows)), "x_score", "x_prediction").first()
        assert got["roc_auc"] > 0.70


def test_score_without_label(spark, small, models):
    df, prof = small
    batch = telco(spark, 30, seed=9).drop("Churn")
    out = score.score(batch, models["random_forest"], prof)
    assert out.columns == batch.columns + score.SCORE_COLUMNS
    rows = out.collect()
    assert len(rows) == 30
    for r in rows:
        band = "High" if r["churn_score"] >= 0.6 else "Medium" if r["churn_score"] >= 0.35 else "Low"
        monthly = round(r["MonthlyCharges"], 2) if band != "Low" else 0.0
        assert (r["risk_band"], r["monthly_revenue_at_risk"]) == (band, monthly)
        assert r["annual_revenue_at_risk"] == pytest.approx(monthly * 12, abs=0.006)
        assert r["churn_probability"] == pytest.approx(r["churn_score"], abs=5.1e-5)


def test_scoring_is_map_only(spark, small, models):
    df, prof = small
    for out in (score.score(df, models["logistic_regression"], prof), score.score_explained(df, models["random_forest"], prof)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Generate" not in plan


def test_reband_equals_scoring_again(spark, small, models):
    df, prof = small
    a = score.reband(score.score(df, models["random_forest"], prof), "MonthlyCharges", 0.5, 0.2)
    b = score.score(df, models["random_forest"], prof, 0.5, 0.2)
    assert a.columns == b.columns and a.exceptAll(b).count() == 0


def test_coverage_gate(spark, small):
    _, prof = small
    score.check_coverage(["tenure", "Contract", "PaymentMethod"], prof)
    with pytest.raises(ValueError, match="missing feature columns"):
        score.check_coverage(["tenure", "Contract"], prof)


def test_single_record(spark, small, models):
    _, prof = small
    one = spark.createDataFrame(
        [(2, "₹95", "Month-to-month", "Electronic check", "Fiber optic")],
        "tenure int, MonthlyCharges string, Contract string, PaymentMethod string, InternetService string",
    )
    row = score.with_verdict(score.score_explained(one, models["logistic_regression"], prof, 0.02, 0.01)).first()
    assert 0 <= row["churn_probability"] <= 1 and row["risk_band"] == "High"
    assert row["monthly_revenue_at_risk"] == 95.0 and row["annual_revenue_at_risk"] == 1140.0
    assert row["recommended_action"] == rules.ACTION_CONTRACT
    assert row["thresholds_used"]["high"] == 0.02 and row["prediction"].startswith("Customer is likely to")


@pytest.mark.parametrize("name", ["logistic_regression", "random_forest", "gradient_boosting"])
def test_attributions_against_dense_vectors(spark, small, models, name):
    """The look-up form equals the definition on the expanded one-hot vector."""
    df, prof = small
    model = models[name]
    kind, weights = explain.model_weights(model)
    weights = np.array(weights)
    out = train.probability(model.transform(features.with_inputs(df.drop("_y"), prof)))
    effects = explain.effects(model, prof, F.col("x_score"))
    rows = out.select("x_score", vector_to_array("x_features").alias("v"), F.array(*effects).alias("e")).collect()
    feature_of = [f for _, f, _ in features.slots(model, prof)]
    for r in rows[:60]:
        v = np.array(r["v"])
        attr = v * weights if kind == "linear" else (v - v.mean()) * weights * (1 if r["x_score"] >= 0.5 else -1)
        want = [sum(a for a, f in zip(attr, feature_of) if f == name_) for name_ in prof.all_features]
        np.testing.assert_allclose(r["e"], want, atol=1e-9)


def test_lists_and_summary(spark, small, models):
    df, prof = small
    for r in score.score_explained(df, models["logistic_regression"], prof).collect():
        ups, downs = r["top_risk_elevators"], r["top_retention_anchors"]
        assert len(ups) <= 4 and len(downs) <= 3
        assert [u["effect_raw"] for u in ups] == sorted((u["effect_raw"] for u in ups), reverse=True)
        assert [d["effect_raw"] for d in downs] == sorted(d["effect_raw"] for d in downs)
        assert all(5 <= i["impact_pct"] <= 45 for i in [*ups, *downs] if i["impact_pct"] != 15)
        assert r["top_driver"] == (ups[0]["label"] if ups else explain.NO_DRIVER)
        if not ups:
            assert r["risk_summary"] == explain.NO_FACTOR
        elif r["churn_score"] < 0.35:
            assert r["risk_summary"] == explain.LOW_TEXT
        else:
            assert ups[0]["label"] in r["risk_summary"]


def test_fallback_lists(spark):
    df = spark.createDataFrame([(1.0, "a", "b", "c", 0.7)], "x double, k string, l string, m string, p double")
    parts = [(n, F.lit(0.0), F.lit("shown"), F.col(n).cast("string")) for n in ("x", "k", "l", "m")]
    row = explain.attribute(df, parts, F.col("p")).first()
    assert [(i["label"], i["impact_pct"], i["effect_raw"]) for i in row["top_risk_elevators"]] == [
        ("x: 1.0", 15, 0.05), ("k: a", 15, 0.05), ("l: b", 15, 0.05)]
    assert row["risk_summary"] == explain.HIGH_TEXT + "x: 1.0, k: a, l: b."


@pytest.mark.parametrize("name", ["logistic_regression", "random_forest", "gradient_boosting"])
def test_global_drivers(spark, small, models, name):
    _, prof = small
    rows = explain.global_drivers(spark, models[name], prof).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(prof.all_features) + 1))
    assert sum(r["importance_pct"] for r in rows) == pytest.approx(100, abs=1.5)
    assert {r["feature"]: r["feature_type"] for r in rows}["tenure"] == "Numeric"
    assert "commitment" in {r["feature"]: r["description"] for r in rows}["Contract"]
    assert explain.top_drivers(explain.global_drivers(spark, models[name], prof), 3).count() == 3


def test_uniform_when_all_weights_are_zero(spark):
    slots = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("b", 0.0), ("c", 0.0)], "feature string, importance double")
    got = {r["feature"]: r["importance_pct"] for r in explain.importance_rollup(slots, ["a", "b", "c"], []).collect()}
    assert got == {"a": 25.0, "b": 50.0, "c": 25.0}


def test_features_of_all_folds_are_learned_once(spark, small, monkeypatch):
    """Boosters, forest and the models for the held-out rows share them; each fold has its own besides."""
    df, prof = small
    learned, fit = [], features.fit
    monkeypatch.setattr(features, "fit", lambda *given: learned.append(1) or fit(*given))
    rows, _ = train.staged_inputs(df, prof)
    marked = train.mark_holdout(rows, "x_id", share=(1, 4))
    learn, test = marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")
    tiny = train.default_candidates(lr_iterations=5, trees=2, tree_depth=2, rounds=1, boost_depth=1)
    cv, held = train._measure(learn, test, prof, tiny, 2, 2, features.MAX_LEVELS)
    assert len(learned) == 3 and list(held) == [c.name for c in tiny] and all(v["cv_folds"] == 2 for v in cv.values())
