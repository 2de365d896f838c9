"""Faults that were found once and must not come back."""

import pytest
from conftest import telco
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from churnspark.functions import rules
from churnspark.operators import clean, diagnose, evaluate, explain, profile, split, summary, train, validate
from churnspark.sources.workspace import Workspace


def test_text_true_false_label(spark):
    df = telco(spark, 200).withColumn("Churn", F.when(F.col("Churn") == "Yes", " True").otherwise("false "))
    report = validate.validate(df)
    assert report.is_valid and report.profile.target_kind == "text"
    cleaned = clean.clean(df, report.profile)
    assert cleaned.where("_y = 1").count() == df.where("trim(Churn) = 'True'").count() > 0


def test_null_ids_do_not_share_a_key(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).alias("cid"), F.col("id").alias("x"), (F.col("id") % 2).cast("int").alias("_y"))
    assert split.mark_holdout(df, "cid").where("is_test").count() == 200
    sizes = [r["count"] for r in split.mark_folds(df, "cid", 5).groupBy("fold", "_y").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("high, med", [(0.604, 0.601), (0.5, 0.004), (0.5, 0.5), (1.01, 0.5)])
def test_thresholds_that_could_not_be_read_back(high, med):
    with pytest.raises(ValueError):
        rules.check_thresholds(high, med)


def test_thresholds_survive_their_own_check():
    stored = rules.check_thresholds(0.616, 0.604)
    assert rules.check_thresholds(*stored) == stored == (0.62, 0.6)


def test_buckets_follow_distinct_scores(spark):
    rows = [(0.5, k % 2) for k in range(4000)] + [(k / 5000, k % 2) for k in range(4000) if k != 2500]
    df = spark.createDataFrame(rows, "p double, _y int")
    groups = evaluate.score_groups(df, "p")
    splits = evaluate.score_splits(groups, "score", 500)
    counted = [0] * (len(splits) + 1)
    for r in groups.collect():
        counted[sum(r["score"] >= s for s in splits)] += 1
    assert len(counted) == 8 and max(counted) <= 600


def test_a_classifier_without_weights(spark):
    df = telco(spark, 150).withColumn("SeniorCitizen", F.lit(1))
    report = validate.validate(df)
    found = train.Candidate("bayes", lambda n: NaiveBayes(modelType="gaussian"))
    rows, _ = train.staged_inputs(df, report.profile)
    model = train.fit_one(rows, report.profile, found)
    drivers = explain.global_drivers(spark, model, report.profile).collect()
    assert len(drivers) == len(report.profile.all_features)
    assert sum(r["importance_score"] for r in drivers) == pytest.approx(1, abs=0.01)


def test_no_column_is_left_out(spark):
    df = telco(spark, 60).select("Churn", *[F.lit("a").alias(f"t{k}") for k in range(20)], *[F.lit(float(k)).alias(f"n{k}") for k in range(20)])
    df = df.withColumn("_y", (F.col("Churn") == "Yes").cast("int"))
    assert diagnose.segment_lift(df, [f"t{k}" for k in range(20)]).select("column").distinct().count() == 20
    assert diagnose.class_profile(df, [f"n{k}" for k in range(20)]).count() == 20
    many = spark.range(200).select(F.format_string("v%03d", "id").alias("c"))
    assert profile.category_fields(many, ["c"]).count() == 200
    assert profile.category_fields(many, ["c"], limit=7).count() == 7


def test_a_missed_sketch_is_counted_again(spark, monkeypatch):
    values = spark.range(10_000).select((F.col("id") * F.col("id") % 9973).cast("double").alias("v"))
    right = summary.numeric_summary(values, ["v"]).first()["quantiles"]
    whole, tries = summary._picked, []

    def blind(values, brackets, keys):
        tries.append(1)
        if len(tries) == 1:  # brackets far off their ranks
            brackets = brackets.withColumns({"low": F.lit(-2.0), "high": F.lit(-1.0)})
        return whole(values, brackets, keys)

    monkeypatch.setattr(summary, "_picked", blind)
    assert summary.numeric_summary(values, ["v"]).first()["quantiles"] == right and len(tries) == 2


def test_validation_of_three_books(spark):
    dirty = telco(spark, 300).withColumns({"flat": F.lit("x"), "churn_date": F.lit("2001-01-01"), "free": F.concat(F.lit("t"), F.col("customerID"))})
    found = {c[0]: c[1] for c in validate.validate(dirty).checks}
    assert found["Constant Columns"] == found["Data Leakage Prevention"] == found["Categorical Cardinality"] == "warning"
    assert found["ID Uniqueness"] == found["Class Balance"] == "pass"
    one = validate.validate(telco(spark, 60).withColumn("Churn", F.lit("Yes")))
    assert not one.is_valid and {c[0]: c[1] for c in one.checks}["Target Variance"] == "fail"
    few = validate.validate(telco(spark, 30))
    assert not few.is_valid and {c[0]: (c[1], c[2]) for c in few.checks}["Sample Size"] == ("fail", 30.0)
    assert all("{" not in c[3] for r in (one, few) for c in r.checks)


def test_training_stays_with_its_run(spark, tmp_path, monkeypatch):
    ws = Workspace(spark, str(tmp_path / "ws"))
    first = ws.ingest(telco(spark, 150), "a")["run_id"]
    whole = train.train_and_compare

    def meanwhile(*args, **kw):
        Workspace(spark, ws.root).ingest(telco(spark, 80, seed=9), "b")
        return whole(*args, **kw)

    monkeypatch.setattr(train, "train_and_compare", meanwhile)
    candidate = train.default_candidates(lr_iterations=5)[:1]
    result = ws.train(candidates=candidate, folds=2)
    assert ws.run_id() != first and ws._version() is None  # the new extract has no model
    assert spark.read.parquet(f"{ws.root}/{first}/versions").count() == 1
    assert {r["class"] for r in result.reports.collect()} == {"0", "1", "accuracy", "macro avg", "weighted avg"}


def test_fields_and_unreadable_tables(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    run = ws.ingest(telco(spark, 100), "a")["run_id"]
    fields = ws.fields()
    assert fields["id_column"] == "customerID" and fields["feature_count"] == 5
    assert fields["numeric"].count() == 2 and fields["categorical"].select("column").distinct().count() == 3
    assert ws.thresholds() == (rules.HIGH, rules.MEDIUM)
    (tmp_path / "ws" / run / "thresholds").mkdir()
    (tmp_path / "ws" / run / "thresholds" / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):
        ws.thresholds()
