"""Classification metrics as relational operators.

Every metric starts by grouping equal scores, so ties are handled exactly and the
ordered part sees distinct scores only. The order is a window inside score buckets;
running totals over the buckets are added afterwards, so no single task has to sort
all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.functions.text import named
from churnspark.session import stage

SCORES_PER_TASK = 500_000
_EXACT = "decimal(19,0)"


def _ratio(top: Column, bottom: Column) -> Column:
    """top/bottom, 0 when the bottom is 0."""
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def confusion(df: DataFrame, pred: str, label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp and their rates within the actual class."""
    y, p = named(label), named(pred).cast("int")
    counts = df.groupBy(*[named(b) for b in by]).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    return _with_rates(counts)


def _with_rates(counts: DataFrame) -> DataFrame:
    negatives = F.greatest(F.lit(1), F.col("tn") + F.col("fp"))
    positives = F.greatest(F.lit(1), F.col("fn") + F.col("tp"))
    return counts.withColumns({
        "tn_rate": F.col("tn") / negatives, "fp_rate": F.col("fp") / negatives,
        "fn_rate": F.col("fn") / positives, "tp_rate": F.col("tp") / positives,
    })


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 from confusion counts; an empty denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def classification_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows for both classes, accuracy, macro and support-weighted averages, from each confusion row."""
    keys = [named(b) for b in by]
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def one(name: str, hit: Column, wrong: Column, lost: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), _ratio(hit, hit + wrong).alias("precision"), _ratio(hit, hit + lost).alias("recall"),
            _ratio(2 * hit, 2 * hit + wrong + lost).alias("f1"), (hit + lost).alias("support"),
        )

    wide = counts.select(
        *keys, one("0", tn, fn, fp).alias("a"), one("1", tp, fp, fn).alias("b"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("acc"), (tp + tn + fp + fn).alias("n"),
    )

    def mean(name: str, wa: Column, wb: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[_ratio(F.col(f"a.{m}") * wa + F.col(f"b.{m}") * wb, wa + wb).alias(m) for m in ("precision", "recall", "f1")],
            F.col("n").alias("support"),
        )

    accuracy = F.struct(
        F.lit("accuracy").alias("class"), *[F.col("acc").alias(m) for m in ("precision", "recall", "f1")], F.col("n").alias("support")
    )
    rows = F.array(
        F.col("a"), F.col("b"), accuracy, mean("macro avg", F.lit(1.0), F.lit(1.0)),
        mean("weighted avg", F.col("a.support").cast("double"), F.col("b.support").cast("double")),
    )
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def score_splits(groups: DataFrame, score: str = "score", per_task: int | None = None) -> list[float]:
    """Bucket edges so that one bucket holds about per_task rows of `groups`, which has one row per distinct score.

    Ties are counted away before the edges are taken: a score that holds nearly all rows of the
    data is one row here. The number of buckets follows the number of distinct scores.
    """
    per_task = per_task or SCORES_PER_TASK
    scores = groups.select(named(score).alias("s"))
    buckets = -(-scores.count() // per_task)
    if buckets <= 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    row = scores.agg(F.percentile_approx("s", shares, max(10_000, 8 * buckets)).alias("edges")).first()
    return sorted(set(row["edges"]))


def score_groups(df: DataFrame, score: str, label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    """(by…, score, pos, neg): labels counted per distinct score."""
    y = named(label)
    return df.groupBy(*[named(b) for b in by], named(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )


def running_totals(groups: DataFrame, splits: Sequence[float] = (), by: Sequence[str] = ()) -> DataFrame:
    """Add cum_pos, cum_neg: labels with this score or a higher one."""
    keys = list(by)
    if not splits:  # one bucket
        down = Window.partitionBy(*keys).orderBy(F.desc("score"))
        return groups.withColumns({"cum_pos": F.sum("pos").over(down), "cum_neg": F.sum("neg").over(down)})
    edges = [float("-inf"), *splits, float("inf")]
    bucketed = Bucketizer(splits=edges, inputCol="score", outputCol="bucket").transform(groups)
    down = Window.partitionBy(*keys, "bucket").orderBy(F.desc("score"))
    inside = bucketed.withColumns({"in_pos": F.sum("pos").over(down), "in_neg": F.sum("neg").over(down)})
    sums = bucketed.groupBy(*keys, "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = Window.partitionBy(*keys).orderBy(F.desc("bucket"))  # one row per bucket
    offsets = sums.select(
        *keys, "bucket",
        (F.sum("pos").over(above) - F.col("pos")).alias("over_pos"),
        (F.sum("neg").over(above) - F.col("neg")).alias("over_neg"),
    )
    # `inside` is already partitioned by these keys, so only the small side moves
    return inside.join(offsets, [*keys, "bucket"]).select(
        *keys, "score", "pos", "neg",
        (F.col("in_pos") + F.col("over_pos")).alias("cum_pos"), (F.col("in_neg") + F.col("over_neg")).alias("cum_neg"),
    )


def ranking_metrics(
    df: DataFrame, score: str, label: str = LABEL, by: Sequence[str] = (), per_task: int | None = None,
) -> DataFrame:
    """roc_auc (0.5 with one class only) and pr_auc = average precision (0 with one class only)."""
    groups = stage(score_groups(df, score, label, by), "scores")
    return _ranking(groups, score_splits(groups, "score", per_task), by)


def _ranking(groups: DataFrame, splits: Sequence[float], by: Sequence[str]) -> DataFrame:
    run = running_totals(groups, splits, by)
    pos, neg = F.col("pos").cast(_EXACT), F.col("neg").cast(_EXACT)
    cum_pos = F.col("cum_pos").cast(_EXACT)
    sums = run.groupBy(*by).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        # twice the concordant pairs plus the ties, in whole numbers
        F.sum(neg * (2 * cum_pos - pos)).cast("double").alias("twice"),
        F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))).alias("precision_sum"),
    )
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    both = (p > 0) & (n > 0)
    return sums.select(
        *by,
        F.when(both, F.col("twice") / (2.0 * p * n)).otherwise(F.lit(0.5)).alias("roc_auc"),
        F.when(both, F.col("precision_sum") / p).otherwise(F.lit(0.0)).alias("pr_auc"),
    )


def roc_auc(df: DataFrame, score: str, label: str = LABEL) -> DataFrame:
    return ranking_metrics(df, score, label).select("roc_auc")


def average_precision(df: DataFrame, score: str, label: str = LABEL) -> DataFrame:
    return ranking_metrics(df, score, label).select("pr_auc")


def roc_points(df: DataFrame, score: str, label: str = LABEL) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest first to be drawn by `threshold`.

    The scored rows are read once; edges, totals and running sums come from the grouped scores.
    """
    groups = stage(score_groups(df, score, label), "scores")
    run = running_totals(groups, score_splits(groups, "score"))
    totals = groups.agg(F.sum("neg")).scalar(), groups.agg(F.sum("pos")).scalar()
    return run.select(
        F.col("score").alias("threshold"),
        (F.col("cum_neg") / F.nullif(totals[0], F.lit(0))).alias("fpr"),
        (F.col("cum_pos") / F.nullif(totals[1], F.lit(0))).alias("tpr"),
    )


def evaluate(df: DataFrame, score: str, pred: str, label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates, threshold metrics and ranking metrics, one row per `by`.

    Confusion counts and ranking are both sums over the same (score, prediction) groups, which
    are written once, so the scored rows are read once.
    """
    keys = [*by, "score"]
    judged = df.withColumn("x_pred", named(pred).cast("int"))
    groups = stage(score_groups(judged, score, label, [*by, "x_pred"]), "scores")
    splits = score_splits(groups, "score")
    p = F.col("x_pred")
    counts = groups.groupBy(*by).agg(*[
        F.coalesce(F.sum(F.when(p == k, F.col(c))), F.lit(0)).alias(name)
        for name, k, c in (("tn", 0, "neg"), ("fp", 1, "neg"), ("fn", 0, "pos"), ("tp", 1, "pos"))
    ])
    counts = threshold_metrics(_with_rates(counts))
    scores = groups.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranks = _ranking(scores, splits, by)
    if by:
        return counts.join(ranks, list(by))
    return counts.withColumns({
        "roc_auc": ranks.select("roc_auc").scalar(), "pr_auc": ranks.select("pr_auc").scalar()
    })
