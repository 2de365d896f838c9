import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnspark.operators.moments import Moments, pair_moments
from churnspark.operators.profile import correlations


def table(rows=3_000, columns=12, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, columns)) @ rng.normal(size=(columns, columns)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = 0.1
    return x


def test_pairs_equal_pandas_over_complete_rows(spark):
    frame = pd.DataFrame(table(), columns=[f"c.{k}" for k in range(12)])
    df = spark.createDataFrame(frame).repartition(7)
    found = correlations(df, list(frame.columns)).toPandas()
    assert len(found) == 144
    right = frame.corr(min_periods=1)
    for a, b, r in found[["a", "b", "r"]].itertuples(index=False):
        if "c.3" in (a, b):
            assert np.isnan(r)
        else:
            assert r == pytest.approx(right.loc[a, b], abs=1e-9)


def test_three_hundred_columns(spark):
    """The plan does not grow with the pairs; every pair equals SQL's own correlation."""
    names = [f"n{k}" for k in range(300)]
    df = spark.range(500).select(*[
        F.when(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(9)) > 0, F.pmod(F.xxhash64("id", F.lit(-k - 1)), F.lit(1000)).cast("double")).alias(n)
        for k, n in enumerate(names)
    ])
    found = {(r["a"], r["b"]): r["r"] for r in correlations(df, names).collect()}
    assert len(found) == 300 * 300
    right = df.toPandas().corr()
    worst = max(abs(found[a, b] - right.loc[a, b]) for a in names for b in names)
    assert worst < 1e-9
    checked = df.agg(*[F.corr(names[0], names[k]).alias(f"r{k}") for k in range(1, 300, 50)]).first()
    assert all(checked[f"r{k}"] == pytest.approx(found[names[0], names[k]], abs=1e-9) for k in range(1, 300, 50))


def test_pair_constant_only_on_its_complete_rows(spark):
    rows = [(0.1, 1.0), (0.1, 2.0), (0.1, 4.0), (7.0, None), (float("inf"), 3.0), (float("nan"), 3.0)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    found = {(r["a"], r["b"]): r["r"] for r in correlations(df, ["a", "b"]).collect()}
    assert found["a", "b"] is None and found["a", "a"] == pytest.approx(1)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert {r["n"] for r in pair_moments(empty, ["a", "b"]).collect()} <= {0}
    assert {r["r"] for r in correlations(spark.createDataFrame([(None, 1.0)], "a double, b double"), ["a", "b"]).collect()} == {None}


def test_blocks_merge_like_one():
    x = table(900, 5)
    whole, parts = Moments(5), Moments(5)
    whole.add(x)
    for at in range(0, 900, 130):
        parts.add(x[at:at + 130])
    for a in ("n", "mean", "dev", "co"):
        np.testing.assert_allclose(getattr(parts, a), getattr(whole, a), rtol=1e-8, atol=1e-6)
