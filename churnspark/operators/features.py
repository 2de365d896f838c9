"""Feature preparation: imputation, scaling, one-hot, as one Spark ML pipeline.

Internal columns: x_n<i>/x_k<j> cleaned inputs, z_n<i> scaled numbers, i_k<j> level
index, x_features the assembled vector. They are positional, so no column name of the
data can break or shadow them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from churnspark.operators.clean import feature_columns
from churnspark.operators.profile import TableProfile
from churnspark.operators.summary import frequencies, long_text, numeric_summary

# A linear or tree model holds one weight per level on the driver and in every task, so the
# number of levels is checked before they are fetched. It is a limit on the model, not on
# rows; callers that can hold wider models raise it.
MAX_LEVELS = 20_000
NO_VALUE = "(none)"  # the only level of a column that is empty in the training rows


def with_inputs(df: DataFrame, prof: TableProfile) -> DataFrame:
    """Add the cleaned model inputs x_n<i>, x_k<j> to any table."""
    return df.select("*", *input_columns(df, prof))


def input_columns(df: DataFrame, prof: TableProfile) -> list:
    names = [f"x_n{i}" for i in range(len(prof.numeric))] + [f"x_k{j}" for j in range(len(prof.categorical))]
    return [col.alias(name) for col, name in zip(feature_columns(df, prof), names)]


@dataclass(frozen=True)
class Statistics:
    """What is learned from the training rows."""

    median: list[float]
    mean: list[float]  # after imputation
    std: list[float]  # population std after imputation, 1 when zero
    mode: list[str]
    levels: list[list[str]]


def learn(df: DataFrame, n_numeric: int, n_categorical: int, max_levels: int = MAX_LEVELS) -> Statistics:
    """Medians, moments, modes and levels of the x_ columns."""
    numbers: dict[str, Row] = {}
    if n_numeric:
        numbers = _numbers(df, [f"x_n{i}" for i in range(n_numeric)])
    counted: list[Row] = []
    if n_categorical:
        counted = frequencies(df, [f"x_k{j}" for j in range(n_categorical)]).limit(max_levels + 1).collect()
    return _statistics(numbers, [f"x_n{i}" for i in range(n_numeric)], None, counted, "n", n_categorical, max_levels)


def learn_without_each(
    df: DataFrame, part: str, sizes: dict[int, int], n_numeric: int, n_categorical: int, max_levels: int = MAX_LEVELS,
) -> dict[int, Statistics]:
    """What `learn` finds in the rows outside each part, for all parts from the same passes.

    `sizes`: rows of each part. The columns of every choice of rows stand next to each other, with gaps for the rows left out.
    """
    inside = {p: F.col(part) != p for p in sizes}
    numbers: dict[str, Row] = {}
    if n_numeric:
        cells = [F.when(inside[p], F.col(f"x_n{i}")).alias(f"c{k}_{i}") for k, p in enumerate(sizes) for i in range(n_numeric)]
        numbers = _numbers(df.select(*cells), [f"c{k}_{i}" for k in range(len(sizes)) for i in range(n_numeric)])
    counted: list[Row] = []
    if n_categorical:
        # a level is outside all parts but one at least, so with more than twice as many, one choice has too many
        cells = [F.count_if(inside[p]).alias(f"n{k}") for k, p in enumerate(sizes)]
        found = long_text(df, [f"x_k{j}" for j in range(n_categorical)], [part]).where(F.col("value").isNotNull())
        counted = found.groupBy("column", "value").agg(*cells).limit(2 * max_levels + 1).collect()
    total = sum(sizes.values())
    return {
        p: _statistics(
            numbers, [f"c{k}_{i}" for i in range(n_numeric)], total - sizes[p],
            counted if len(counted) > 2 * max_levels else [r for r in counted if r[f"n{k}"]], f"n{k}", n_categorical, max_levels)
        for k, p in enumerate(sizes)
    }


def _numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, Row]:
    found = numeric_summary(df, columns, [0.5]).select(
        "column", "rows", "count", "mean", "std_pop", F.get("quantiles", F.lit(0)).alias("median")
    )
    return {r["column"]: r for r in found.collect()}


def _statistics(
    numbers: dict[str, Row], columns: Sequence[str], rows: int | None, counted: Sequence[Row], n: str, n_categorical: int, max_levels: int,
) -> Statistics:
    """Of the summaries of `columns` over `rows` rows (None: those summarised) and the counts `n` of the levels."""
    median, mean, std = [0.0] * len(columns), [0.0] * len(columns), [1.0] * len(columns)
    for i, r in ((i, numbers[c]) for i, c in enumerate(columns) if c in numbers):
        known, total = r["count"], r["rows"] if rows is None else rows
        # moments after filling the gaps with the median, from the moments before
        mu = (known * r["mean"] + (total - known) * r["median"]) / total
        var = (known * (r["std_pop"] ** 2 + (r["mean"] - mu) ** 2) + (total - known) * (r["median"] - mu) ** 2) / total
        median[i], mean[i], std[i] = r["median"], mu, var**0.5 or 1.0
    if len(counted) > max_levels:
        raise ValueError(
            f"more than {max_levels} levels in the categorical features: drop the identifier-like "
            "columns (see the cardinality check) or raise max_levels"
        )
    mode, levels = [NO_VALUE] * n_categorical, [[] for _ in range(n_categorical)]
    best: dict[int, tuple] = {}
    for r in counted:
        j = int(r["column"][3:])
        levels[j].append(r["value"])
        best[j] = min(best.get(j, (0, "")), (-r[n], r["value"]))
    for j, (_, value) in best.items():
        mode[j] = value
    levels = [sorted(v) or [NO_VALUE] for v in levels]
    return Statistics(median, mean, std, mode, levels)


def impute(df: DataFrame, stats: Statistics) -> DataFrame:
    """x_ columns with gaps filled: median for numbers, most frequent value for texts."""
    filled = {f"x_n{i}": F.coalesce(F.col(f"x_n{i}"), F.lit(m)) for i, m in enumerate(stats.median)}
    filled |= {f"x_k{j}": F.coalesce(F.col(f"x_k{j}"), F.lit(m)) for j, m in enumerate(stats.mode)}
    return df.withColumns(filled)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def build(spark: SparkSession, stats: Statistics) -> PipelineModel:
    """Turn the statistics into pipeline stages; no data is read."""
    n, k = len(stats.median), len(stats.mode)
    parts = [
        f"(coalesce(x_n{i}, {_double(stats.median[i])}) - {_double(stats.mean[i])}) / {_double(stats.std[i])} AS z_n{i}"
        for i in range(n)
    ] + [f"coalesce(x_k{j}, {_text(stats.mode[j])}) AS f_k{j}" for j in range(k)]
    stages = [SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")]
    vectors = []
    if k:
        # one model per column: the several-columns constructor pads shorter level lists with nulls
        indexers = [
            StringIndexerModel.from_labels(found, inputCol=f"f_k{j}", outputCol=f"i_k{j}", handleInvalid="keep")
            for j, found in enumerate(stats.levels)
        ]
        # The unseen level gets the last slot and dropLast removes it: unseen -> all zeros.
        empty = PipelineModel(indexers).transform(
            spark.createDataFrame([], ", ".join(f"f_k{j} string" for j in range(k)))
        )
        encoder = OneHotEncoder(
            inputCols=[f"i_k{j}" for j in range(k)], outputCols=[f"v_k{j}" for j in range(k)], dropLast=True
        ).fit(empty)
        stages += [*indexers, encoder]
        vectors = [f"v_k{j}" for j in range(k)]
    stages.append(VectorAssembler(inputCols=[f"z_n{i}" for i in range(n)] + vectors, outputCol="x_features"))
    return PipelineModel(stages)


def fit(df: DataFrame, prof: TableProfile, max_levels: int = MAX_LEVELS, known: Statistics | None = None) -> PipelineModel:
    """Fit on a frame that already has the x_ columns. `known`: its statistics, if they have been learned."""
    return build(df.sparkSession, known or learn(df, len(prof.numeric), len(prof.categorical), max_levels))


def levels_of(model: PipelineModel) -> list[list[str]]:
    """Levels per categorical feature of a fitted (or reloaded) pipeline."""
    found = []
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            found.append(list(stage.labels))
        elif isinstance(stage, PipelineModel):
            found += levels_of(stage)
    return found


def slots(model: PipelineModel, prof: TableProfile) -> list[tuple[int, str, str | None]]:
    """(vector index, feature, level or None) for every slot of x_features."""
    names = [(c, None) for c in prof.numeric]
    names += [(c, level) for c, found in zip(prof.categorical, levels_of(model)) for level in found]
    return [(i, c, level) for i, (c, level) in enumerate(names)]
