"""A workspace folder: every ingest opens a new run, nothing is deleted or overwritten in place.

    runs/                 run_id, ts           one row per ingest
    audit/                ts, action, details
    activity/             see operators.activity
    <run_id>/extract/     cleaned extract
    <run_id>/profile/     JSON text            <run_id>/validation/  JSON text
    <run_id>/thresholds/  high, medium, ts     appended, the newest row counts
    <run_id>/model/       pipeline             <run_id>/metrics/, meta/
    <run_id>/scored/      scored book; bands are re-derived from the stored score on read

A new ingest makes model, metrics and scores of the previous run invisible, because
readers look only into the newest run.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.functions import rules
from churnspark.operators import activity, diagnose, explain, playbook, report, score, train
from churnspark.operators.clean import clean
from churnspark.operators.profile import TableProfile, category_fields, numeric_fields, preview
from churnspark.operators.validate import validate
from churnspark.session import stage, tune
from churnspark.sources.files import is_csv, read_csv_checked, read_table, require_rows, strip_names, write_csv


# Names of the audited actions.
AUDIT_INGEST, AUDIT_RESET, AUDIT_TRAIN = "DATA_INGEST", "WORKSPACE_RESET", "MODEL_TRAIN"
AUDIT_THRESHOLDS, AUDIT_BATCH = "THRESHOLD_UPDATE", "BATCH_SCORE"


def load_clean(spark: SparkSession, path: str, filename: str = "") -> tuple[DataFrame, TableProfile]:
    """Read a file, infer the roles, return the cleaned frame and its profile."""
    df = require_rows(strip_names(read_table(spark, path)))
    report_ = validate(df, filename or path.rstrip("/").rsplit("/", 1)[-1])
    if not report_.is_valid:
        raise ValueError("; ".join(report_.errors))
    return clean(df, report_.profile), report_.profile


def _of_one_run(method):
    """A call reads and writes one run, even if something is ingested meanwhile."""
    @wraps(method)
    def pinned(self, *args, **kw):
        with self.one_run():
            return method(self, *args, **kw)

    return pinned


class Workspace:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = tune(spark), root.rstrip("/")
        self._pinned: str | None = None

    # --- folders ------------------------------------------------------------------------

    def _read(self, name: str, run: str | None = None) -> DataFrame | None:
        path = f"{self.root}/{run}/{name}" if run else f"{self.root}/{name}"
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise  # an unreadable table is not an absent one
            return None

    def run_id(self) -> str | None:
        runs = self._read("runs")
        return None if runs is None else runs.agg(F.max("run_id").alias("r")).first()["r"]

    def _run(self) -> str:
        """The run a call works on from beginning to end, whatever is ingested meanwhile."""
        run = self._pinned or self.run_id()
        if run is None:
            raise ValueError("Ingest a customer extract first.")
        return run

    @contextmanager
    def one_run(self):
        """Everything inside belongs to the newest run at entry."""
        outer, self._pinned = self._pinned, self._pinned or self.run_id()
        try:
            yield self._pinned
        finally:
            self._pinned = outer

    def _path(self, name: str) -> str:
        return f"{self.root}/{self._run()}/{name}"

    def _write_text(self, text: str, run: str, name: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.root}/{run}/{name}")

    def _document(self, name: str) -> str | None:
        run = self._pinned or self.run_id()
        if run is None:
            return None
        try:
            return self.spark.read.text(f"{self.root}/{run}/{name}", wholetext=True).first()["value"]
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def audit(self, action: str, details: str = "") -> None:
        now = datetime.now(timezone.utc)
        self.spark.createDataFrame([(now, action, details)], "ts timestamp, action string, details string").coalesce(
            1
        ).write.mode("append").parquet(f"{self.root}/audit")

    def audit_log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/audit").orderBy(F.desc("ts"), "action", "details")

    def log_activity(self, title: str, detail: str, **kw) -> None:
        activity.append(self.spark, f"{self.root}/activity", title, detail, **kw)

    def activities(self, categories=("ALL",)) -> DataFrame:
        return activity.feed(self.spark.read.parquet(f"{self.root}/activity"), categories)

    # --- ingest -------------------------------------------------------------------------

    def ingest(self, source: DataFrame | str, filename: str = "") -> dict:
        """Validate, clean and store an extract under a new run.

        Lines of a CSV file with too many fields or an open quote are left out, lines with too few are filled with
        nulls; the validation counts both.
        """
        malformed = 0
        if isinstance(source, str):
            filename = filename or source.rstrip("/").rsplit("/", 1)[-1]
            # parsed once; profile, checks and cleaning then read the columns they need
            source, malformed = self._uploaded(source)
        df = require_rows(strip_names(source))
        checked = validate(df, filename, malformed=malformed)
        if not checked.is_valid:
            raise ValueError("; ".join(checked.errors))
        prof = checked.profile
        now = datetime.now(timezone.utc)
        run = f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        clean(df, prof).write.parquet(f"{self.root}/{run}/extract")
        self._write_text(prof.to_json(), run, "profile")
        self._write_text(json.dumps(checked.to_dict()), run, "validation")
        # the run becomes visible only now, with everything in place
        self.spark.createDataFrame([(run, now)], "run_id string, ts timestamp").coalesce(1).write.mode("append").parquet(
            f"{self.root}/runs"
        )
        self.audit(AUDIT_INGEST, f"File: {filename} ({prof.rows} rows)")
        with self.one_run():
            return {"run_id": run, "validation": checked.to_dict(), "kpis": self.overview().first().asDict()}

    def _uploaded(self, path: str) -> tuple[DataFrame, int]:
        """The rows of a file, parsed and written once, and the number of its malformed lines."""
        if not is_csv(path):
            found = read_table(self.spark, path)
            return (stage(found, "upload") if found.columns else found), 0
        if not (plain := read_table(self.spark, path)).columns:
            return plain, 0
        found, mark = read_csv_checked(self.spark, path)
        malformed = found.where(F.col(mark).isNotNull()).count()
        return found.where(F.coalesce(F.col(mark), F.lit("short")) == "short").drop(mark), malformed

    def extract(self) -> DataFrame:
        return self.spark.read.parquet(self._path("extract"))

    def profile(self) -> TableProfile:
        text = self._document("profile")
        if text is None:
            raise ValueError("Ingest a customer extract first.")
        return TableProfile.from_json(text)

    def reset(self) -> None:
        """Open an empty run: nothing earlier is visible any more."""
        now = datetime.now(timezone.utc)
        run = f"{now:%Y%m%dT%H%M%S%f}-empty"
        self.spark.createDataFrame([(run, now)], "run_id string, ts timestamp").coalesce(1).write.mode("append").parquet(
            f"{self.root}/runs"
        )
        self.audit(AUDIT_RESET, "New empty run")

    # --- diagnostics --------------------------------------------------------------------

    @_of_one_run
    def fields(self) -> dict:
        """What an input form needs: the identifier, the number of features and both kinds of fields."""
        df, prof = self.extract(), self.profile()
        return {
            "id_column": prof.id_column, "feature_count": len(prof.all_features),
            "numeric": numeric_fields(df, prof.numeric), "categorical": category_fields(df, prof.categorical),
        }

    @_of_one_run
    def overview(self) -> DataFrame:
        prof = self.profile()
        return report.rounded_kpis(
            diagnose.kpis(self.extract(), diagnose.spend_column(prof.numeric), diagnose.tenure_column(prof.numeric))
        )

    @_of_one_run
    def analytics(self) -> dict[str, DataFrame]:
        df, prof = self.extract(), self.profile()
        out = {
            "churn_mix": diagnose.churn_mix(df),
            "segments": diagnose.segment_lift(df, prof.categorical),
            "numeric_profile": diagnose.class_profile(df, prof.numeric),
            "preview": preview(df, prof.id_column or df.columns[0]),
        }
        tenure = diagnose.tenure_column(prof.numeric)
        if tenure:
            out["tenure_bins"] = diagnose.tenure_buckets(df, tenure)
        return out

    # --- model --------------------------------------------------------------------------

    @_of_one_run
    def train(self, **options) -> train.TrainResult:
        """Train, score and store under the run that was newest at the call."""
        df, prof = self.extract(), self.profile()
        result = train.train_and_compare(df, prof, **options)
        version = uuid.uuid4().hex[:8]
        result.model.write().save(self._path(f"model/{version}"))
        high, med = self.thresholds()
        score.score(df, result.model, prof, high, med).write.parquet(self._path(f"scored/{version}"))
        result.metrics.coalesce(1).write.parquet(self._path(f"metrics/{version}"))
        result.meta.coalesce(1).write.parquet(self._path(f"meta/{version}"))
        result.reports.coalesce(1).write.parquet(self._path(f"reports/{version}"))
        row = (version, datetime.now(timezone.utc), result.champion)
        self.spark.createDataFrame([row], "version string, ts timestamp, champion string").coalesce(1).write.mode(
            "append"
        ).parquet(self._path("versions"))
        self.audit(AUDIT_TRAIN, f"Champion: {result.champion}")
        return result

    def _version(self) -> tuple[str, str] | None:
        run = self._pinned or self.run_id()
        versions = self._read("versions", run) if run else None
        if versions is None:
            return None
        row = versions.agg(F.max_by(F.struct("version", "champion"), "ts").alias("v")).first()["v"]
        return row["version"], row["champion"]

    def _model_version(self) -> str:
        found = self._version()
        if found is None:
            raise ValueError("Train a model before scoring.")
        return found[0]

    def model(self) -> PipelineModel:
        return PipelineModel.load(self._path(f"model/{self._model_version()}"))

    def metrics(self) -> DataFrame:
        return self.spark.read.parquet(self._path(f"metrics/{self._model_version()}"))

    def class_reports(self) -> DataFrame:
        return self.spark.read.parquet(self._path(f"reports/{self._model_version()}"))

    def thresholds(self) -> tuple[float, float]:
        run = self._pinned or self.run_id()
        stored = self._read("thresholds", run) if run else None
        if stored is None:
            return rules.HIGH, rules.MEDIUM
        row = stored.agg(F.max_by(F.struct("high", "medium"), "ts").alias("t")).first()["t"]
        return row["high"], row["medium"]

    @_of_one_run
    def set_thresholds(self, high: float, med: float) -> dict[str, float]:
        """Append the new pair; the scored book is re-banded when it is read."""
        high, med = rules.check_thresholds(high, med)
        row = (high, med, datetime.now(timezone.utc))
        self.spark.createDataFrame([row], "high double, medium double, ts timestamp").coalesce(1).write.mode(
            "append"
        ).parquet(self._path("thresholds"))
        self.audit(AUDIT_THRESHOLDS, f"High: {high}, Med: {med}")
        return {"high": high, "medium": med}

    @_of_one_run
    def scored(self) -> DataFrame:
        stored = self.spark.read.parquet(self._path(f"scored/{self._model_version()}"))
        return score.reband(stored, diagnose.spend_column(self.profile().numeric), *self.thresholds())

    @_of_one_run
    def predict(self, records: DataFrame) -> DataFrame:
        """Score records with explanations."""
        return score.score_explained(records, self.model(), self.profile(), *self.thresholds())

    def predict_batch(self, path: str) -> DataFrame:
        """Score a file, keep the result with the run, and return it."""
        with self.one_run():
            out = score.score_batch(self.spark, path, self.model(), self.profile(), *self.thresholds())
            stored = self._path(f"batches/{uuid.uuid4().hex[:8]}")
        out.write.parquet(stored)
        done = self.spark.read.schema(out.schema).parquet(stored)
        self.audit(AUDIT_BATCH, f"File: {path.rstrip('/').rsplit('/', 1)[-1]} ({done.count()} rows)")
        return done

    # --- bundles and exports ------------------------------------------------------------

    @_of_one_run
    def insights(self) -> dict[str, DataFrame]:
        df, prof = self.extract(), self.profile()
        rows = playbook.pillars(df, prof)
        out = {
            "kpis": self.overview(), "playbook": rows, "playbook_summary": playbook.playbook_summary(df, rows),
            "cadence": playbook.cadence(self.spark),
        }
        found = self._version()
        if found:
            out["global_drivers"] = explain.global_drivers(self.spark, self.model(), prof)
            out["governance"] = report.governance(self.metrics(), found[1])
        return out

    @_of_one_run
    def status(self) -> dict:
        text, found = self._document("profile"), self._version()
        high, med = self.thresholds()
        checked = self._document("validation")
        return {
            "has_data": text is not None, "has_model": found is not None,
            "schema": json.loads(text) if text else None, "validation": json.loads(checked) if checked else None,
            "kpis": self.overview().first().asDict() if text else None,
            "metrics": [r.asDict() for r in self.metrics().collect()] if found else None,
            "thresholds": {"high": high, "medium": med},
        }

    @_of_one_run
    def export_tables(self, folder: str, fmt: str = "parquet") -> list[str]:
        found = self._version()
        made = report.tables(
            self.extract(), self.profile(), self.metrics() if found else None, found[1] if found else "",
            self.scored() if found else None,
        )
        report.export(made, folder, fmt)
        return sorted(made)

    @_of_one_run
    def export_book(self, path: str) -> None:
        """The scored book as CSV; before training the cleaned extract without the label."""
        write_csv(self.scored() if self._version() else self.extract().drop("_y"), path)
