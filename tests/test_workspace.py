import pytest
from conftest import telco

from churnspark.operators import activity, diagnose, playbook, report, train
from churnspark.operators.clean import clean
from churnspark.operators.profile import profile
from churnspark.sources import files
from churnspark.sources.workspace import Workspace, load_clean

TINY = train.default_candidates(lr_iterations=20, trees=5, tree_depth=3, rounds=3, boost_depth=2)[:2]


def test_whole_life(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    assert ws.status()["has_data"] is False
    with pytest.raises(ValueError):
        ws.extract()
    csv = str(tmp_path / "customers.csv")
    files.write_csv(telco(spark, 150), csv)
    done = ws.ingest(csv)
    assert done["kpis"]["customers"] == 150 and done["validation"]["is_valid"]
    assert ws.status()["has_model"] is False
    assert ws.extract().columns[-1] == "_y"
    with pytest.raises(ValueError):
        ws.model()
    analytics = ws.analytics()
    assert analytics["preview"].count() == 15 and analytics["tenure_bins"].count() == 6

    first = str(tmp_path / "book1")
    ws.export_book(first)
    assert "_y" not in files.read_csv(spark, first).columns

    result = ws.train(candidates=TINY, folds=2)
    status = ws.status()
    assert status["has_model"] and len(status["metrics"]) == 2
    scored = ws.scored()
    assert scored.count() == 150 and "_y" not in scored.columns
    before = scored.where("risk_band = 'High'").count()
    assert ws.set_thresholds(0.05, 0.01) == {"high": 0.05, "medium": 0.01}
    assert ws.scored().where("risk_band = 'High'").count() > before
    with pytest.raises(ValueError):
        ws.set_thresholds(0.2, 0.4)

    batch = str(tmp_path / "batch.csv")
    files.write_csv(telco(spark, 12, seed=3).drop("Churn"), batch)
    assert ws.predict_batch(batch).count() == 12
    assert ws.predict(telco(spark, 2, seed=4)).first()["thresholds_used"]["high"] == 0.05
    insights = ws.insights()
    assert insights["playbook"].count() >= 3 and insights["cadence"].count() == 4
    assert insights["governance"].where("role = 'Champion'").count() == 1
    made = ws.export_tables(str(tmp_path / "report"), "csv")
    assert made == ["dataset_profile", "executive_summary", "model_governance", "retention_playbook",
                    "scored_accounts", "segment_risk_matrix"]
    assert files.read_csv(spark, str(tmp_path / "report/executive_summary")).count() == 8
    second = str(tmp_path / "book2")
    ws.export_book(second)
    assert "risk_band" in files.read_csv(spark, second).columns

    # a new ingest hides model and scores, and keeps the earlier run on disk
    old = ws.run_id()
    ws.ingest(telco(spark, 60, seed=8), "second")
    assert ws.status()["has_model"] is False and ws.overview().first()["customers"] == 60
    assert spark.read.parquet(f"{tmp_path}/ws/{old}/extract").count() == 150
    assert [r["action"] for r in ws.audit_log().collect()] == [
        "DATA_INGEST", "BATCH_SCORE", "THRESHOLD_UPDATE", "MODEL_TRAIN", "DATA_INGEST"]
    ws.reset()
    assert ws.status()["has_data"] is False
    assert result.champion in {c.name for c in TINY}


def test_rejects(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no data rows"):
        ws.ingest(telco(spark, 5).where("1 = 0"))
    with pytest.raises(ValueError, match="Insufficient"):
        ws.ingest(telco(spark, 10))
    with pytest.raises(ValueError, match="No churn target"):
        ws.ingest(telco(spark, 60).drop("Churn"))


def test_csv_tokens_and_names(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(' id , x,name\n1,N/A,"a ""q"", b"\n2,, none \n3,nan,None\n')
    df = files.read_csv(spark, str(path))
    assert df.columns == ["id", "x", "name"]
    assert [tuple(r) for r in df.collect()] == [("1", None, 'a "q", b'), ("2", None, " none "), ("3", None, None)]


def test_csv_back_to_types(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    src = telco(spark, 80)
    files.write_csv(src, path)
    cleaned, prof = load_clean(spark, path)
    assert prof.numeric == ["tenure", "MonthlyCharges"] and prof.target == "Churn"
    want = clean(src, profile(src)).drop("Churn").select("customerID", "MonthlyCharges", "Contract", "_y")
    assert cleaned.select(want.columns).exceptAll(want).count() == 0


def test_partitioned_parquet(spark, tmp_path):
    files.write_parquet(telco(spark, 20), str(tmp_path / "p"), partition_by=["Contract"])
    assert files.read_table(spark, str(tmp_path / "p")).count() == 20


def test_playbook_texts(spark):
    df = telco(spark, 200)
    prof = profile(df)
    rows = playbook.pillars(clean(df, prof), prof).collect()
    assert [r["pillar"] for r in rows] == ["contract", "early", "payment"]
    top = rows[0]
    assert top["segment"] == "Month-to-month" and top["target_segment"] == "Contract: Month-to-month"
    assert "Accounts on Month-to-month exhibit" in top["strategic_rationale"]
    assert top["observed_metric"] == f"{top['churn_rate'] * 100:.1f}% churn rate ({top['lift'] * 100:+.1f}% pts vs portfolio baseline)"
    assert top["annual_revenue_at_risk"] == f"₹{top['annual_revenue']:,.2f}"
    assert rows[2]["annual_revenue_at_risk"] == "High operational friction cost"
    other = playbook.pillars(clean(df, prof), prof, overrides={"payment": "InternetService"}).collect()
    assert other[-1]["target_segment"].startswith("InternetService: ")
    assert playbook.playbook_summary(clean(df, prof), playbook.pillars(clean(df, prof), prof)).first()["pillars_count"] == 3


def test_reports(spark):
    df = telco(spark, 200)
    prof = profile(df, "f.csv")
    rows = clean(df, prof)
    summary = report.executive_summary(diagnose.kpis(rows, "MonthlyCharges", "tenure")).collect()
    assert len(summary) == 8 and summary[0]["value"] == "200"
    none = report.executive_summary(diagnose.kpis(rows, None, None)).collect()
    assert [r["value"] for r in none[4:]] == ["N/A"] * 4
    assert [r["value"] for r in report.dataset_profile(spark, prof).collect()][:2] == ["f.csv", "200 rows"]
    matrix = report.segment_matrix(diagnose.segment_lift(rows, prof.categorical)).collect()
    for r in matrix:
        assert r["severity"] == ("high" if r["lift"] > 0.1 else "medium" if r["lift"] > 0.02 else None)
    made = report.tables(rows, prof)
    assert "model_governance" not in made and made["segment_risk_matrix"].first()["churn_rate"].endswith("%")


def test_activity(spark, tmp_path):
    path = str(tmp_path / "log")
    activity.append(spark, path, "one", "d", level="critical", category="AUDIT")
    activity.append(spark, path, "two", "d", level="warning")
    log = spark.read.parquet(path)
    assert [r["title"] for r in activity.feed(log).collect()] == ["two", "one"]
    assert [r["title"] for r in activity.feed(log, ["AUDIT"]).collect()] == ["one"]
    assert activity.feed(log, [], n=1).count() == 1
    assert tuple(activity.summary(log).first()) == (2, 1, 1, 0)


def test_empty_buckets_and_bands(spark):
    df = spark.createDataFrame([(None, 1), (6, 0), (7, 1), (20000, 1), (-1, 0)], "tenure int, _y int")
    got = [(r["bucket"], r["customers"], r["churn_rate"]) for r in diagnose.tenure_buckets(df, "tenure").collect()]
    assert got[0] == ("0–6m", 2, 0.5) and got[1] == ("7–12m", 1, 1.0)
    assert got[2:] == [(b, 0, None) for b in ("13–24m", "25–36m", "37–48m", "49m+")]
    bands = diagnose.risk_band_distribution(spark.createDataFrame([("High",), ("High",)], "risk_band string")).collect()
    assert [(r["risk_band"], r["accounts"], r["share"]) for r in bands] == [("High", 2, 1.0), ("Medium", 0, 0.0), ("Low", 0, 0.0)]
