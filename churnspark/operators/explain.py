"""Global drivers and per-customer attributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark.functions import rules
from churnspark.functions.text import named
from churnspark.operators.features import levels_of, slots
from churnspark.operators.profile import TableProfile

# Keywords of a feature name and the sentence shown for it, first match wins.
DRIVER_TEXTS = [
    (["contract"], "Contract commitment length strongly distinguishes loyal from at-risk accounts."),
    (["tenure"], "Customer account tenure indicates relationship maturity and early lifecycle vulnerability."),
    (["monthly", "charge", "spend"], "Recurring spend levels impact price sensitivity and competitive vulnerability."),
    (["payment", "bill"], "Payment automation reduces friction compared to manual or check payment methods."),
    (["support", "tech"], "Technical assistance and support touchpoints act as retention anchors."),
    (["security", "backup"], "Account security and value-add add-on subscriptions raise switching barriers."),
    (["fiber", "internet"], "Internet tier and delivery modality correlate with service expectations and pricing perception."),
]
# Summary sentences.
NO_FACTOR = "Balanced risk profile with no single dominant churn factor."
HIGH_TEXT = "High predictive risk driven predominantly by: "
MODERATE_TEXT = "Moderate risk profile influenced by: "
LOW_TEXT = "Low churn probability; portfolio retention anchors outweigh risk factors."
NO_DRIVER = "Overall Profile"

MIN_EFFECT = 0.01
IMPACT_RANGE = (5, 45)
FALLBACK_EFFECT, FALLBACK_IMPACT, FALLBACK_FEATURES = 0.05, 15, 3


def driver_text(feature: Column) -> Column:
    name = F.lower(feature)
    out = None
    for words, text in DRIVER_TEXTS:
        hit = name.contains(words[0])
        for word in words[1:]:
            hit = hit | name.contains(word)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise(F.concat(F.lit("Key predictor '"), feature, F.lit("' contributing to portfolio churn differentiation.")))


def model_weights(model: PipelineModel) -> tuple[str, list[float]]:
    """('linear', coefficients) or ('tree', importances) of the classifier, one number per slot.

    A classifier that knows neither counts every slot alike.
    """
    classifier = model.stages[-1]
    if hasattr(classifier, "coefficients"):
        return "linear", [float(v) for v in classifier.coefficients.toArray()]
    if hasattr(classifier, "featureImportances"):
        return "tree", [float(v) for v in classifier.featureImportances.toArray()]
    return "tree", [1.0] * classifier.numFeatures


def importance_rollup(importances: DataFrame, features: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Rank features by the summed, normalised importance of their slots.

    importances: (feature, importance ≥ 0), one row per slot; all zero counts as uniform.
    """
    spark = importances.sparkSession
    listed = spark.createDataFrame(
        [(i, c, "Numeric" if c in set(numeric) else "Categorical") for i, c in enumerate(features)],
        "position int, feature string, feature_type string",
    )
    weight = F.when(F.col("grand") > 0, F.col("total") / F.col("grand")).otherwise(F.col("slots") / F.col("all_slots"))
    summed = importances.groupBy("feature").agg(F.sum("importance").alias("total"), F.count(F.lit(1)).alias("slots"))
    whole = summed.agg(F.sum("total").alias("grand"), F.sum("slots").alias("all_slots"))
    shares = summed.withColumns({
        "grand": whole.select("grand").scalar(), "all_slots": whole.select("all_slots").scalar()
    }).select("feature", weight.alias("score"))
    joined = listed.join(F.broadcast(shares), "feature", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "position"))  # one row per feature
    return joined.select(
        rank.alias("rank"), "feature", "feature_type", F.round("score", 4).alias("importance_score"),
        F.round(F.col("score") * 100, 1).alias("importance_pct"), driver_text(F.col("feature")).alias("description"),
    )


def global_drivers(spark: SparkSession, model: PipelineModel, prof: TableProfile) -> DataFrame:
    """Features ranked by what the model uses. Driver-side metadata, no data is read."""
    _, weights = model_weights(model)
    rows = [(feature, abs(weights[i])) for i, feature, _ in slots(model, prof)]
    return importance_rollup(spark.createDataFrame(rows, "feature string, importance double"), prof.all_features, prof.numeric)


def top_drivers(drivers: DataFrame, k: int = 6) -> DataFrame:
    return drivers.where(F.col("rank") <= k)


def effects(model: PipelineModel, prof: TableProfile, score: Column) -> list[Column]:
    """Attribution per feature, numeric first, from z_n<i> and i_k<j>.

    The one-hot vector is never expanded: a category contributes the weight of its
    level, looked up by index. Linear: value × coefficient. Tree: (value − mean of the
    encoded row) × importance, sign by the predicted side.
    """
    kind, weights = model_weights(model)
    n, levels = len(prof.numeric), levels_of(model)
    z = [F.col(f"z_n{i}") for i in range(n)]
    tables, start = [], n
    for found in levels:
        tables.append(weights[start:start + len(found)])
        start += len(found)

    def level_weight(j: int) -> Column:
        table = F.array(*[F.lit(w) for w in tables[j]])
        return F.coalesce(F.get(table, F.col(f"i_k{j}").cast("int")), F.lit(0.0))

    if kind == "linear":
        return [z[i] * F.lit(weights[i]) for i in range(n)] + [level_weight(j) for j in range(len(levels))]
    total = F.lit(0.0)
    for value in z:
        total = total + value
    for j, found in enumerate(levels):  # a known level adds one, an unseen one adds nothing
        total = total + (F.col(f"i_k{j}") < len(found)).cast("double")
    mean, sign = total / F.lit(float(start)), F.when(score >= 0.5, 1.0).otherwise(-1.0)
    numbers = [(z[i] - mean) * F.lit(weights[i]) * sign for i in range(n)]
    return numbers + [(level_weight(j) - mean * F.lit(sum(tables[j]))) * sign for j in range(len(levels))]


def value_text(col: Column, dtype: T.DataType) -> Column:
    """Numbers with separators and two places, everything else as it is."""
    if isinstance(dtype, T.NumericType):
        return F.coalesce(F.format_number(col.cast("double"), 2), F.lit(""))
    return F.coalesce(col.cast("string"), F.lit(""))


def attribute(
    df: DataFrame, parts: Sequence[tuple[str, Column, Column, Column]], score: Column, up: int = 4, down: int = 3,
) -> DataFrame:
    """Add top_risk_elevators, top_retention_anchors, risk_summary and top_driver.

    parts: (feature, effect, shown value, plain value). Sorting and cutting happen inside
    the row, so nothing is exploded or shuffled; no lambda is involved, so it all compiles.
    """
    low, high = IMPACT_RANGE
    kept = [named(c) for c in df.columns]
    # effects, then their roundings, as plain columns: each is needed several times below
    raw = df.select(
        *kept, score.alias("x_p"),
        *[effect.alias(f"x_e{i}") for i, (_, effect, _, _) in enumerate(parts)],
        *[shown.alias(f"x_v{i}") for i, (_, _, shown, _) in enumerate(parts)],
        *[plain.alias(f"x_t{i}") for i, (_, _, _, plain) in enumerate(parts[:FALLBACK_FEATURES])],
    )
    numbered = raw.select("*", *[F.round(f"x_e{i}", 4).alias(f"x_r{i}") for i in range(len(parts))])

    def item(feature: str, value: Column, effect: Column, impact: Column, rising: bool) -> Column:
        return F.struct(
            F.lit(feature).alias("feature"), value.alias("value"),
            F.concat(F.lit(f"{feature}: "), value).alias("label"), effect.alias("effect_raw"),
            impact.cast("int").alias("impact_pct"),
            F.lit("increases_risk" if rising else "reduces_risk").alias("direction"),
        )

    def ranked(rising: bool, k: int) -> Column:
        """The k strongest items of one direction; descending order puts the nulls last."""
        entries, hits = [], F.lit(0)
        for i, (feature, *_) in enumerate(parts):
            e, r = F.col(f"x_e{i}"), F.col(f"x_r{i}")
            hit = e > MIN_EFFECT if rising else e < -MIN_EFFECT
            impact = F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.abs(e) * 100)))
            entries.append(F.when(hit, F.struct(
                (r if rising else -r).alias("strength"), F.lit(-i).alias("order"),
                item(feature, F.col(f"x_v{i}"), r, impact, rising).alias("item"),
            )))
            hits = hits + F.coalesce(hit.cast("int"), F.lit(0))
        best = F.slice(F.sort_array(F.array(*entries), False), F.lit(1), F.least(F.lit(k), hits))
        return best.getField("item")

    fallback = F.array(*[
        item(feature, F.col(f"x_t{i}"), F.lit(FALLBACK_EFFECT), F.lit(FALLBACK_IMPACT), True)
        for i, (feature, *_) in enumerate(parts[:FALLBACK_FEATURES])
    ])
    listed = numbered.select(*kept, "x_p", *[f"x_t{i}" for i in range(len(parts[:FALLBACK_FEATURES]))],
                             ranked(True, up).alias("x_up"), ranked(False, down).alias("top_retention_anchors"))
    nothing = (F.size("x_up") == 0) & (F.size("top_retention_anchors") == 0)
    chosen = listed.select(
        *kept, "x_p", F.when(nothing, fallback).otherwise(F.col("x_up")).alias("top_risk_elevators"), "top_retention_anchors"
    )
    labels = F.concat_ws(", ", F.slice("top_risk_elevators", 1, 3).getField("label"))
    summary = (
        F.when(F.size("top_risk_elevators") == 0, NO_FACTOR)
        .when(F.col("x_p") >= F.lit(rules.HIGH), F.concat(F.lit(HIGH_TEXT), labels, F.lit(".")))
        .when(F.col("x_p") >= F.lit(rules.MEDIUM), F.concat(F.lit(MODERATE_TEXT), labels, F.lit(".")))
        .otherwise(LOW_TEXT)
    )
    first = F.get("top_risk_elevators", F.lit(0))["label"]
    return chosen.select(
        *kept, "top_risk_elevators", "top_retention_anchors", summary.alias("risk_summary"),
        F.coalesce(first, F.lit(NO_DRIVER)).alias("top_driver"),
    )


def local(transformed: DataFrame, model: PipelineModel, prof: TableProfile, score: Column, up: int = 4, down: int = 3) -> DataFrame:
    """Attributions for rows that went through the model's pipeline."""
    types = {f.name: f.dataType for f in transformed.schema}
    parts = []
    for feature, effect in zip(prof.all_features, effects(model, prof, score)):
        if feature in types:
            raw = named(feature)
            parts.append((feature, effect, value_text(raw, types[feature]), F.coalesce(raw.cast("string"), F.lit(""))))
        else:
            parts.append((feature, effect, F.lit(""), F.lit("")))
    return attribute(transformed, parts, score, up, down)
