"""Splits, feature preparation, training, scoring and explanation of the main book."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnspark.functions.label import LABEL
from churnspark.operators import evaluate, explain, features, levels, report, score, split, train
from churnspark.plans.books_sql import F1, sql, stacked
from churnspark.plans.diagnostics import BOOK_PROFILE
from churnspark.sources import books

CATS, NUMS = books.CATEGORICAL, books.NUMERIC
MODEL_COLUMNS = ["account_id", *NUMS, *CATS]

KEYED = """keyed AS (SELECT *, md5(concat(cast(account_id AS varchar), '-42')) AS key FROM book),
ranked AS (SELECT *, row_number() OVER (PARTITION BY _y ORDER BY key) AS rn, count(*) OVER (PARTITION BY _y) AS n FROM keyed)"""


def holdout_split(spark, sf):
    return split.mark_holdout(books.labelled(spark, sf, ["account_id"]), "account_id")


def hash_split(spark, sf):
    return split.mark_holdout(books.labelled(spark, sf, ["account_id"]), "account_id", exact=False)


def cv_folds(spark, sf):
    return split.mark_folds(books.labelled(spark, sf, ["account_id"]), "account_id", 5)


def _half_without_id(spark, sf):
    """Every second account has no id to split by; its number stays as a plain column."""
    rows = books.labelled(spark, sf, ["account_id", "tenure"])
    return rows.withColumns({"ref": F.col("account_id"), "account_id": F.when(F.col("account_id") % 2 == 0, F.col("account_id"))})


def holdout_null_ids(spark, sf):
    """Rows of each class on both sides when half of the ids are null."""
    marked = split.mark_holdout(_half_without_id(spark, sf), "account_id")
    return marked.groupBy(LABEL, "is_test").agg(F.count(F.lit(1)).alias("n"))


def cv_folds_null_ids(spark, sf):
    marked = split.mark_folds(_half_without_id(spark, sf), "account_id", 5)
    return marked.groupBy(LABEL, "fold").agg(F.count(F.lit(1)).alias("n"))


def cv_folds_heavy_id(spark, sf):
    """Rows of each class in every fold when one customer holds three tenths of the accounts."""
    rows = books.labelled(spark, sf, ["account_id"])
    heavy = rows.withColumn("account_id", F.when(F.col("account_id") % 10 < 3, F.lit(-1)).otherwise(F.col("account_id")))
    marked = split.mark_folds(heavy, "account_id", 5)
    return marked.groupBy(LABEL, "fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("account_id") == -1).alias("of_the_heavy_id"),
    )


HEAVY = """h AS (SELECT _y, count(*) FILTER (account_id % 10 < 3) AS heavy, count(*) FILTER (account_id % 10 >= 3) AS light FROM book GROUP BY 1)"""

SIZES = "c AS (SELECT _y, count(*) AS n FROM book GROUP BY 1)"


def class_weights(spark, sf):
    return split.class_weights(books.labelled(spark, sf, []))


def _inputs(spark, sf, columns=MODEL_COLUMNS):
    return features.with_inputs(books.labelled(spark, sf, columns), BOOK_PROFILE)


def median_impute(spark, sf):
    df = _inputs(spark, sf, ["account_id", *NUMS])
    stats = features.learn(df, len(NUMS), 0)
    out = features.impute(df, stats)
    return out.select("account_id", *[F.col(f"x_n{i}").alias(c) for i, c in enumerate(NUMS)])


def mode_impute(spark, sf):
    df = _inputs(spark, sf, ["account_id", *CATS])
    stats = features.learn(df, 0, len(CATS))
    out = features.impute(df, stats)
    return out.select("account_id", *[F.col(f"x_k{j}").alias(c) for j, c in enumerate(CATS)])


def _encoded(spark, sf):
    df = _inputs(spark, sf)
    return features.fit(df, BOOK_PROFILE).transform(df)


def standard_scale(spark, sf):
    return _encoded(spark, sf).select("account_id", *[F.round(f"z_n{i}", 6).alias(c) for i, c in enumerate(NUMS)])


def one_hot_totals(spark, sf):
    """How many rows light up each one-hot slot."""
    out = _encoded(spark, sf)
    slots = out.select(F.posexplode(vector_to_array("x_features"))).where(F.col("pos") >= len(NUMS))
    return slots.groupBy(F.col("pos").alias("slot")).agg(F.sum("col").alias("rows"))


ONE_HOT = """filled AS (SELECT "column", coalesce(value, top) AS value FROM long JOIN (
    SELECT "column", min_by(value, (-n, value)) AS top FROM (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING ("column")),
per AS (SELECT "column", value, count(*)::double AS rows FROM filled GROUP BY 1, 2)"""

MEDIANS = "m AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in NUMS) + " FROM book)"
FILLED = "filled AS (SELECT account_id, " + ", ".join(f"coalesce(cast({c} AS double), m_{c}) AS {c}" for c in NUMS) + " FROM book CROSS JOIN m)"
MODES = "m AS (SELECT " + ", ".join(
    f"(SELECT {c} FROM book WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS m_{c}" for c in CATS
) + ")"


LEVELS = ["account_id", *CATS]


def level_dictionary(spark, sf):
    """All levels of the texts and of the account numbers, with their index: as many as the book has rows."""
    return levels.dictionary(books.accounts(spark, sf).select(*LEVELS), LEVELS)


def one_hot_slots(spark, sf):
    """The one-hot row of every account, account numbers included, as slots."""
    rows = books.accounts(spark, sf).select(*LEVELS)
    found = levels.dictionary(rows, LEVELS)
    first = levels.offsets(found, LEVELS)
    return levels.attach(rows, found, LEVELS).select("account_id", F.concat_ws(",", levels.slots(first)).alias("slots"))


LEVEL_SQL = f"""long AS ({stacked(LEVELS, 'f1')}),
levels AS (SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS index
    FROM long WHERE value IS NOT NULL GROUP BY 1, 2)"""
SLOT_SQL = "SELECT account_id, concat_ws(',', " + ", ".join(
    f"cast((SELECT count(*) FROM levels WHERE \"column\" IN ({', '.join(repr(x) for x in ['', *LEVELS[:i]])})) + l{i}.index AS varchar)"
    for i in range(len(LEVELS))
) + ") AS slots FROM f1" + "".join(
    f" LEFT JOIN levels l{i} ON l{i}.\"column\" = '{c}' AND l{i}.value = cast(f1.{c} AS varchar)" for i, c in enumerate(LEVELS)
)


# --- models ----------------------------------------------------------------------------------------


_MADE: dict[tuple, object] = {}


def _once(spark, sf, what, make):
    """Models are trained once per session and book, whichever query asks first."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def _trained(spark, sf):
    return _once(spark, sf, "all", lambda: train.train_and_compare(books.labelled(spark, sf, MODEL_COLUMNS), BOOK_PROFILE))


def train_champion(spark, sf):
    """All candidates at full size with cross-validation; one row each, best ROC-AUC first."""
    result = _trained(spark, sf)
    table = train.comparison(result.metrics)
    return table.withColumn("is_champion", F.col("candidate") == result.champion)


def _fitted(spark, sf, position: int):
    def fit():
        rows, _ = train.staged_inputs(books.labelled(spark, sf, MODEL_COLUMNS), BOOK_PROFILE)
        return train.fit_one(rows, BOOK_PROFILE, train.default_candidates()[position])

    return _once(spark, sf, position, fit)


def score_book(spark, sf):
    """Fit a logistic regression and score every account."""
    model = _fitted(spark, sf, 0)
    return score.score(books.accounts(spark, sf, MODEL_COLUMNS), model, BOOK_PROFILE)


def explain_book_linear(spark, sf):
    model = _fitted(spark, sf, 0)
    return score.score_explained(books.accounts(spark, sf, MODEL_COLUMNS), model, BOOK_PROFILE)


def explain_book_forest(spark, sf):
    model = _fitted(spark, sf, 1)
    return score.score_explained(books.accounts(spark, sf, MODEL_COLUMNS), model, BOOK_PROFILE)


def global_drivers(spark, sf):
    return explain.top_drivers(explain.global_drivers(spark, _fitted(spark, sf, 1), BOOK_PROFILE), 8)


def holdout_evaluation(spark, sf):
    """Every metric of a boosted model on the held-out fifth."""
    df = books.labelled(spark, sf, MODEL_COLUMNS)
    rows, _ = train.staged_inputs(df, BOOK_PROFILE)
    learn_rows, test_rows = split.holdout(rows, "x_id")
    model = train.fit_one(learn_rows, BOOK_PROFILE, train.default_candidates()[2])
    scored = train.probability(model.transform(test_rows)).select(LABEL, "x_score", "x_prediction")
    return evaluate.evaluate(scored, "x_score", "x_prediction")


def training_facts(spark, sf):
    """What must be true of a training whatever the models learned, one row per candidate."""
    result = _trained(spark, sf)
    c = F.col
    facts = result.metrics.select(
        "candidate", "training_status", (c("tn") + c("fp")).alias("test_retained"), (c("fn") + c("tp")).alias("test_churned"), "cv_folds",
        (c("roc_auc") > 0.5).alias("better_than_chance"),
        (F.least("cv_roc_auc_std", "cv_pr_auc_std", "cv_f1_std") >= 0).alias("spread_is_real"),
        (F.greatest("roc_auc", "pr_auc", "accuracy", "f1") <= 1).alias("within_one"),
    )
    best = result.metrics.orderBy(F.desc(F.lit(0.6) * c("pr_auc") + F.lit(0.4) * c("roc_auc")), "position").first()["candidate"]
    totals = result.meta.first()
    return facts.withColumns(
        {"champion_by_rule": F.lit(result.champion == best)}
        | {name: F.lit(totals[name]) for name in ("rows_total", "rows_train", "rows_test", "feature_count")}
    )


FACTS = """SELECT candidate, 'Completed' AS training_status, sum(t) FILTER (_y = 0) AS test_retained, sum(t) FILTER (_y = 1) AS test_churned,
  5 AS cv_folds, true AS better_than_chance, true AS spread_is_real, true AS within_one, true AS champion_by_rule,
  sum(n) AS rows_total, sum(n) - sum(t) AS rows_train, sum(t) AS rows_test, 8 AS feature_count
FROM (SELECT _y, n, (2 * n + 5) // 10 AS t FROM c) CROSS JOIN (VALUES ('logistic_regression'), ('random_forest'), ('gradient_boosting'), ('regularised_boosting')) AS v(candidate)
GROUP BY candidate"""


def governance_table(spark, sf):
    result = _trained(spark, sf)
    return report.governance(result.metrics, result.champion)


QUERIES = {
    "holdout_split": (holdout_split, sql("SELECT account_id, _y, rn <= (2 * n + 5) // 10 AS is_test FROM ranked", F1, KEYED)),
    "hash_split": (hash_split, sql("SELECT account_id, _y, substr(key, 1, 4) < '3333' AS is_test FROM keyed", F1, KEYED)),
    "cv_folds": (cv_folds, sql(
        "SELECT account_id, _y, " + " + ".join(f"(rn > (2 * {f} * n + 5) // 10)::int" for f in range(1, 5)) + " AS fold FROM ranked", F1, KEYED)),
    "holdout_null_ids": (holdout_null_ids, sql(
        "SELECT _y, true AS is_test, (2 * n + 5) // 10 AS n FROM c UNION ALL SELECT _y, false, n - (2 * n + 5) // 10 FROM c", F1, SIZES)),
    "cv_folds_null_ids": (cv_folds_null_ids, sql(
        "SELECT _y, f AS fold, (2 * (f + 1) * n + 5) // 10 - (2 * f * n + 5) // 10 AS n FROM c, (SELECT unnest(range(5))::int AS f)", F1, SIZES)),
    # the heavy id is more than a fold of either class; the other rows share the four folds that are left
    "cv_folds_heavy_id": (cv_folds_heavy_id, sql(
        "SELECT _y, 0 AS fold, heavy AS n, heavy AS of_the_heavy_id FROM h UNION ALL "
        "SELECT _y, f AS fold, (2 * f * light + 4) // 8 - (2 * (f - 1) * light + 4) // 8, 0 FROM h, (SELECT unnest(range(1, 5))::int AS f)", F1, HEAVY)),
    "class_weights": (class_weights, sql(
        "SELECT _y, count(*) AS n, (SELECT count(*) FROM book) / (2 * count(*)) AS weight FROM book GROUP BY 1")),
    "median_impute": (median_impute, sql("SELECT * FROM filled", F1, MEDIANS, FILLED)),
    "mode_impute": (mode_impute, sql(
        "SELECT account_id, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in CATS) + " FROM book CROSS JOIN m", F1, MODES)),
    "standard_scale": (standard_scale, sql(
        "SELECT account_id, " + ", ".join(
            f"round(({c} - (SELECT avg({c}) FROM filled)) / (SELECT stddev_pop({c}) FROM filled), 6) AS {c}" for c in NUMS
        ) + " FROM filled", F1, MEDIANS, FILLED)),
    "one_hot_totals": (one_hot_totals, sql(
        f"""SELECT cast({len(NUMS)} - 1 + row_number() OVER (ORDER BY CASE "column" {' '.join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATS))} END, value) AS int) AS slot, rows FROM per""",
        F1, f"long AS ({stacked(CATS, 'book')})", ONE_HOT)),
    "level_dictionary": (level_dictionary, sql('SELECT "column", value, n, index FROM levels', F1, LEVEL_SQL)),
    "one_hot_slots": (one_hot_slots, sql(SLOT_SQL, F1, LEVEL_SQL)),
    "training_facts": (training_facts, sql(FACTS, F1, SIZES)),
    "train_champion": (train_champion, None),
    "score_book": (score_book, None),
    "explain_book_linear": (explain_book_linear, None),
    "explain_book_forest": (explain_book_forest, None),
    "global_drivers": (global_drivers, None),
    "holdout_evaluation": (holdout_evaluation, None),
    "governance_table": (governance_table, None),
}
