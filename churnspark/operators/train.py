"""Candidate training, cross-validation, champion selection."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL, outcome
from churnspark.functions.text import named
from churnspark.operators import boost, features, forest
from churnspark.operators.evaluate import classification_report, evaluate
from churnspark.operators.profile import TableProfile
from churnspark.operators.split import FOLDS, SEED, fold_count, mark_folds, mark_holdout
from churnspark.session import shared_folder, stage

log = logging.getLogger(__name__)

WEIGHT = "x_weight"
#: Training rows a core from which on folds are fitted one at a time.
BUSY_ROWS = 250_000
CV_METRICS = ["roc_auc", "pr_auc", "f1"]
HOLDOUT_METRICS = [
    "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc",
    "tn_rate", "fp_rate", "fn_rate", "tp_rate",
]


def _columns(stage):
    """The classifier or its model with this package's column names."""
    return (
        stage.setFeaturesCol("x_features").setPredictionCol("x_prediction")
        .setProbabilityCol("x_probability").setRawPredictionCol("x_raw")
    )


@dataclass(frozen=True)
class Candidate:
    """A named classifier; `make` gets the number of training rows. Any Spark classifier fits.

    A candidate with `boosting` or `forest` has no `make`: its models of all folds grow together.
    """

    name: str
    make: Callable[[int], Estimator] | None = None
    weighted: bool = False
    boosting: boost.Boosting | None = None
    forest: forest.Forest | None = None

    def estimator(self, rows: int) -> Estimator:
        out = _columns(self.make(rows)).setLabelCol(LABEL)
        return out.setWeightCol(WEIGHT) if self.weighted else out


def default_candidates(
    lr_iterations: int = 1000, trees: int = 160, tree_depth: int = 10, rounds: int = 120, boost_depth: int = 4,
) -> list[Candidate]:
    """The four candidates in their fixed order; sizes are parameters, defaults the full ones."""
    return [
        # ridge strength 1/n on the mean loss equals a unit penalty on the summed loss
        Candidate("logistic_regression", lambda n: LogisticRegression(
            maxIter=lr_iterations, regParam=1.0 / n, elasticNetParam=0.0, standardization=False), weighted=True),
        Candidate("random_forest", weighted=True, forest=forest.Forest(trees, tree_depth, 3)),
        Candidate("gradient_boosting", boosting=boost.Boosting(rounds, boost_depth, 0.08)),
        Candidate("regularised_boosting", boosting=boost.Boosting(rounds, boost_depth, 0.08, second_order=True, l2=1.0)),
    ]


@dataclass
class TrainResult:
    model: PipelineModel
    metrics: DataFrame
    meta: DataFrame
    champion: str
    reports: DataFrame  # class report of each candidate on the held-out rows


def inputs(df: DataFrame, prof: TableProfile) -> DataFrame:
    """Identifier, label and cleaned model inputs, nothing else."""
    label = named(LABEL) if LABEL in df.columns else outcome(named(prof.target), prof.target_kind)[0]
    ident = [named(prof.id_column).alias("x_id")] if prof.id_column else []
    return df.select(*ident, label.cast("int").alias(LABEL), *features.input_columns(df, prof))


def class_sizes(df: DataFrame) -> tuple[int, int]:
    row = df.agg(*[F.count_if(F.col(LABEL) == k).alias(f"n{k}") for k in (0, 1)]).first()
    return row["n0"], row["n1"]


def staged_inputs(df: DataFrame, prof: TableProfile) -> tuple[DataFrame, tuple[int, int]]:
    """The model inputs written once to the shared folder, and the class sizes.

    Rows are dealt by a hash of themselves before they are written, so every iteration of every
    fit runs on even partitions, without another shuffle, and the samples of forests and boosting
    do not depend on how the extract happened to be laid out.
    """
    narrow = inputs(df, prof)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = narrow.repartition(parts, F.xxhash64(*[named(c) for c in narrow.columns]))
    table = stage(dealt, "training")
    return table, class_sizes(table)


def weighted(df: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """Balanced class weights as two literals."""
    w = [sum(sizes) / (2.0 * max(1, n)) for n in sizes]
    return df.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, F.lit(w[1])).otherwise(F.lit(w[0])))


def probability(df: DataFrame) -> DataFrame:
    return df.withColumn("x_score", F.get(vector_to_array("x_probability"), F.lit(1)))


def fit_one(
    train: DataFrame, prof: TableProfile, candidate: Candidate, max_levels: int = features.MAX_LEVELS,
) -> PipelineModel:
    """Feature statistics and classifier from the same rows, as one saved-and-reloadable model."""
    encoder = features.fit(train, prof, max_levels)
    if candidate.boosting:
        rows = encoder.transform(train).withColumn("part", F.lit(0))
        bins = boost.learn_bins(rows, len(prof.numeric), [len(v) for v in features.levels_of(encoder)])
        (grown,), _ = boost.grow(rows, bins, [(candidate.boosting, boost.TEST)])
        return PipelineModel([encoder, _columns(boost.to_spark(train.sparkSession, grown, bins))])
    if candidate.forest:
        rows = encoder.transform(train).withColumn("part", F.lit(0))
        bins = boost.learn_bins(rows, len(prof.numeric), [len(v) for v in features.levels_of(encoder)], forest.CUTS)
        (grown,), _ = forest.grow(rows, bins, [(candidate.forest, boost.TEST)], weighted=candidate.weighted)
        return PipelineModel([encoder, _columns(forest.to_spark(train.sparkSession, grown, bins))])
    sizes = class_sizes(train)
    encoded = weighted(encoder.transform(train), sizes).select(LABEL, WEIGHT, "x_features").persist()
    try:
        return PipelineModel([encoder, candidate.estimator(sum(sizes)).fit(encoded)])
    finally:
        encoded.unpersist()


def _fit_and_evaluate(
    train: DataFrame, test: DataFrame, encoder: PipelineModel, candidates: Sequence[Candidate], parallelism: int,
) -> dict[str, dict]:
    """Metrics per candidate. `encoder` is learned on `train` only and shared by the candidates.

    All candidates' predictions are evaluated in one grouped job.
    """
    sizes = class_sizes(train)
    encoded = weighted(encoder.transform(train), sizes).select(LABEL, WEIGHT, "x_features")
    held = encoder.transform(test).select(LABEL, "x_features")
    if len(candidates) > 1:  # one alone keeps what it needs by itself
        encoded, held = encoded.persist(), held.persist()

    def one(candidate: Candidate):
        estimator = candidate.estimator(sum(sizes))
        try:
            return candidate.name, estimator.fit(encoded)
        except Exception as problem:  # a candidate that cannot be fitted scores zero, the others go on
            log.warning("%s could not be fitted: %s", candidate.name, problem)
            return candidate.name, None

    try:
        with ThreadPool(max(1, min(parallelism, len(candidates)))) as pool:
            fitted = pool.map(inheritable_thread_target(train.sparkSession)(one), candidates)
        scored = [
            probability(m.transform(held)).select(F.lit(name).alias("candidate"), LABEL, "x_score", "x_prediction")
            for name, m in fitted if m is not None
        ]
        if not scored:
            return {}
        every = scored[0]
        for more in scored[1:]:
            every = every.unionByName(more)
        rows = evaluate(every, "x_score", "x_prediction", by=["candidate"]).collect()
        return {r["candidate"]: r.asDict() for r in rows}
    finally:
        encoded.unpersist()
        held.unpersist()


def _boosted(
    marked: DataFrame, prof: TableProfile, candidates: Sequence[Candidate], parts: Sequence[int], encoder: PipelineModel,
) -> dict[tuple[str, int], dict]:
    """Metrics of the boosters by candidate and held-out part; all of them grow in the same jobs.

    `marked` has `part`: a fold, or boost.TEST for held-out rows. A booster of a fold learns from
    the other folds and is measured on its own; with TEST among `parts` one more learns from all folds and is
    measured there. Gaps are filled (by `encoder`) and columns are cut by statistics of all folds, never of TEST rows.
    """
    if not candidates:
        return {}
    rows = encoder.transform(marked)
    bins = boost.learn_bins(rows.where(F.col("part") != boost.TEST), len(prof.numeric), [len(v) for v in features.levels_of(encoder)])
    try:
        _, margins = boost.grow(rows, bins, [(c.boosting, part) for c in candidates for part in parts])
    except Exception as problem:  # candidates that cannot be fitted score zero, the others go on
        log.warning("boosters could not be fitted: %s", problem)
        return {}
    spot = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col("part")).cast("int") - 1
    each = F.array(*[
        F.struct(F.lit(c.name).alias("candidate"), F.get("margins", F.lit(k * len(parts)) + spot).alias("margin")) for k, c in enumerate(candidates)
    ])
    scored = margins.where(F.col("part").isin(list(parts))).select("part", F.col("y").alias(LABEL), F.explode(each).alias("one"))
    scored = scored.select("part", LABEL, "one.candidate", (F.lit(1) / (1 + F.exp(-F.col("one.margin")))).alias("x_score"))
    scored = scored.withColumn("x_prediction", (F.col("x_score") > 0.5).cast("double"))
    return {(r["candidate"], r["part"]): r.asDict() for r in evaluate(scored, "x_score", "x_prediction", by=["candidate", "part"]).collect()}


def _forests(
    marked: DataFrame, prof: TableProfile, candidate: Candidate, parts: Sequence[int], encoder: PipelineModel,
) -> dict[tuple[str, int], dict]:
    """Metrics of a forest by held-out part, grown and measured as the boosters are."""
    rows = encoder.transform(marked)
    bins = boost.learn_bins(rows.where(F.col("part") != boost.TEST), len(prof.numeric), [len(v) for v in features.levels_of(encoder)], forest.CUTS)
    try:
        grown, table = forest.grow(rows, bins, [(candidate.forest, part) for part in parts], weighted=candidate.weighted)
    except Exception as problem:  # a candidate that cannot be fitted scores zero, the others go on
        log.warning("%s could not be fitted: %s", candidate.name, problem)
        return {}
    scored = stage(forest.held_scores(table, grown, bins), "forest").withColumnRenamed("y", LABEL)
    scored = scored.withColumn("x_prediction", (F.col("x_score") > 0.5).cast("double"))
    return {(candidate.name, r["part"]): r.asDict() for r in evaluate(scored, "x_score", "x_prediction", by=["part"]).collect()}


def _spread(values: Sequence[float]) -> tuple[float, float]:
    mean = sum(values) / len(values)
    return mean, (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5


def _measure(
    train: DataFrame, test: DataFrame | None, prof: TableProfile, candidates: Sequence[Candidate], folds: int, parallelism: int, max_levels: int,
) -> tuple[dict[str, dict], dict[str, dict]]:
    """Cross-validation on `train`, and metrics of models of all of it on `test`.

    The boosters are one run, a forest is one; the other candidates are fitted fold by fold, `parallelism` folds at a time, beside them.
    """
    k = fold_count(class_sizes(train), folds)
    marked = mark_folds(train, "x_id" if prof.id_column else None, k).drop("x_id").persist(StorageLevel.DISK_ONLY)
    if test is not None:
        test = test.drop("x_id").persist(StorageLevel.DISK_ONLY)
    try:
        return _measured(marked, test, prof, candidates, k, parallelism, max_levels)
    finally:
        for rows in (marked, test):
            if rows is not None:
                rows.unpersist()


def _measured(
    marked: DataFrame, test: DataFrame | None, prof: TableProfile, candidates: Sequence[Candidate], k: int, parallelism: int, max_levels: int,
) -> tuple[dict[str, dict], dict[str, dict]]:
    """`_measure` of training rows marked with their fold."""
    train = marked.drop("fold")
    sizes = {r["fold"]: r["count"] for r in marked.groupBy("fold").count().collect()}  # at most k rows
    filled = sorted(sizes)
    boosted, forests = [c for c in candidates if c.boosting], [c for c in candidates if c.forest]
    others = [c for c in candidates if not c.boosting and not c.forest]
    got: dict[tuple[str, int], dict] = {}
    # one for all that learn features from every fold, and before the pool, so that the boosters start at once
    whole = features.fit(train, prof, max_levels) if boosted or forests or test is not None else None
    known: dict[int, features.Statistics] = {}
    first = Lock()

    def without(part: int) -> features.Statistics:
        """Those of all folds are learned together, by whoever needs one first."""
        with first:
            if not known:
                known.update(features.learn_without_each(marked, "fold", {f: sizes[f] for f in filled}, len(prof.numeric), len(prof.categorical), max_levels))
        return known[part]

    def together(grown: Callable, what: Sequence[Candidate] | Candidate) -> None:
        rows = marked.withColumnRenamed("fold", "part")
        if test is not None:
            rows = rows.unionByName(test.withColumn("part", F.lit(boost.TEST)))
        got.update(grown(rows, prof, what, filled + ([boost.TEST] if test is not None else []), whole))

    def apart(part: int) -> None:
        if part == boost.TEST:
            found = _fit_and_evaluate(train, test, whole, others, parallelism)
        else:
            inside, outside = marked.where(F.col("fold") == part), marked.where(F.col("fold") != part)
            found = _fit_and_evaluate(outside, inside, features.fit(outside, prof, max_levels, without(part)), others, parallelism)
        got.update({(name, part): row for name, row in found.items()})

    jobs = ([partial(together, _boosted, boosted)] if boosted else []) + [partial(together, _forests, c) for c in forests]
    if others:
        jobs += [partial(apart, part) for part in ([boost.TEST] if test is not None else []) + filled]
    if sum(sizes.values()) > BUSY_ROWS * marked.sparkSession.sparkContext.defaultParallelism:
        parallelism = 1  # every job has work for all cores, and the rows that fits keep in memory are many
        jobs = jobs[:bool(boosted)] + jobs[bool(boosted) + len(forests):] + jobs[bool(boosted):bool(boosted) + len(forests)]
    else:
        parallelism += len(forests)
    with ThreadPool(max(1, min(parallelism + bool(boosted), len(jobs)))) as pool:
        # one at a time from the list: the boosters first, as they take longest
        pool.map(inheritable_thread_target(train.sparkSession)(lambda job: job()), jobs, chunksize=1)

    cv = {}
    for c in candidates:
        rows = [got[c.name, f] for f in filled if (c.name, f) in got]
        cv[c.name] = {"cv_folds": k}
        for metric in CV_METRICS:
            mean, std = _spread([r[metric] for r in rows]) if rows and len(rows) == len(filled) else (0.0, 0.0)
            cv[c.name][f"cv_{metric}_mean"], cv[c.name][f"cv_{metric}_std"] = round(mean, 4), round(std, 4)
    return cv, {c.name: got[c.name, boost.TEST] for c in candidates if (c.name, boost.TEST) in got}


def cross_validate(
    train: DataFrame, prof: TableProfile, candidates: Sequence[Candidate], folds: int = FOLDS, parallelism: int = 4,
    max_levels: int = features.MAX_LEVELS,
) -> dict[str, dict]:
    """Mean and population std of ROC-AUC, PR-AUC and F1 over stratified folds; zeros when a fit fails.

    A fold left without rows, because copies of an id stay together, is not evaluated.
    """
    return _measure(train, None, prof, candidates, folds, parallelism, max_levels)[0]


def select_champion(metrics: DataFrame) -> DataFrame:
    """The row with the highest 0.6·PR-AUC + 0.4·ROC-AUC on four places; the earlier candidate wins ties."""
    score = F.lit(0.6) * F.round("pr_auc", 4) + F.lit(0.4) * F.round("roc_auc", 4)
    return metrics.withColumn("champion_score", score).orderBy(F.desc("champion_score"), "position").limit(1)


def comparison(metrics: DataFrame) -> DataFrame:
    """All candidates, best ROC-AUC first."""
    return metrics.orderBy(F.desc("roc_auc"), "position")


def train_and_compare(
    df: DataFrame, prof: TableProfile, candidates: Sequence[Candidate] | None = None, folds: int = FOLDS,
    test_share: tuple[int, int] = (1, 5), exact_split: bool = True, parallelism: int = 4,
    max_levels: int = features.MAX_LEVELS,
) -> TrainResult:
    """Holdout, cross-validation on the training part, champion, refit on all rows.

    The cleaned inputs are written once to the shared folder, so the many fits re-read
    a narrow table instead of the upstream plan and survive lost executors.
    """
    spark = df.sparkSession
    candidates = list(candidates or default_candidates())
    if spark.sparkContext.getCheckpointDir() is None:  # lets boosting cut its own lineage
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    table, sizes = staged_inputs(df, prof)
    if min(sizes) < 1:
        raise ValueError("Target column must contain both churned and retained customers.")

    ident = "x_id" if prof.id_column else None
    marked = mark_holdout(table, ident, share=test_share, exact=exact_split)
    train, test = marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")
    test_sizes = class_sizes(test)
    cv, held = _measure(train, test, prof, candidates, folds, parallelism, max_levels)

    rows = []
    for position, candidate in enumerate(candidates):
        got = held.get(candidate.name)
        row = {"candidate": candidate.name, "position": position, "training_status": "Completed" if got else "Failed"}
        row |= {m: round(float(got[m]), 4) if got else 0.0 for m in HOLDOUT_METRICS}
        row |= {m: int(got[m]) if got else 0 for m in ("tn", "fp", "fn", "tp")}
        row |= cv[candidate.name]
        rows.append(row)
    types = {str: "string", int: "bigint", float: "double"}
    metrics = spark.createDataFrame(
        [tuple(r.values()) for r in rows], ", ".join(f"{k} {types[type(v)]}" for k, v in rows[0].items())
    )
    if not held:
        raise ValueError("no candidate could be fitted")
    best = select_champion(metrics).first()["candidate"]
    model = fit_one(table, prof, next(c for c in candidates if c.name == best), max_levels)

    now = datetime.now(timezone.utc)
    total, n_test = sum(sizes), sum(test_sizes)
    # Names and texts of the training summary.
    summary = [
        ("model_version", "string", "v1"), ("best_model", "string", best),
        ("best_model_display", "string", best.replace("_", " ").title()),
        ("selection_metric", "string", "PR-AUC (Precision-Recall AUC) & ROC-AUC Composite"),
        ("trained_at", "timestamp", now), ("dataset_filename", "string", prof.filename),
        ("rows_total", "bigint", total), ("rows_train", "bigint", total - n_test), ("rows_test", "bigint", n_test),
        ("test_churn_count", "bigint", test_sizes[1]), ("test_retained_count", "bigint", test_sizes[0]),
        ("portfolio_churn_rate", "double", round(sizes[1] / total, 4)),
        ("feature_count", "bigint", len(prof.all_features)),
    ]
    meta = spark.createDataFrame([tuple(v for _, _, v in summary)], ", ".join(f"{k} {t}" for k, t, _ in summary))
    reports = classification_report(metrics.where("training_status = 'Completed'"), by=["candidate"])
    return TrainResult(model, metrics, meta, best, reports)
