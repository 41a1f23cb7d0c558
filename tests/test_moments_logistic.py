"""One-pass co-moments and the Newton solver."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadlens.operators import moments, profile
from leadlens.operators.logistic import LogisticModel, NewtonLogistic
from leadlens.sources.io import load_model, save_model


def frame(spark, values, parts=5):
    cols = [f"v{k}" for k in range(values.shape[1])]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in values]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(parts), cols


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_correlations_with_missing_values(spark, shift):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6)) + rng.normal(size=(700, 1)) + shift
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 0.1                      # constant
    x[:, 5] = np.nan                   # nothing
    df, cols = frame(spark, x)
    got = {(r.var1, r.var2): r["corr"] for r in profile.corr_matrix(df, cols).collect()}
    want = pd.DataFrame(x - shift, columns=cols).corr().to_numpy()
    assert len(got) == 36
    for i in range(6):
        for j in range(6):
            c = got[cols[i], cols[j]]
            assert (np.isnan(c) and max(i, j) >= 4) or abs(c - want[i, j]) < 1e-6


def test_one_pass_and_any_number_of_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32)) @ rng.normal(size=(32, 32))
    df, cols = frame(spark, x)
    out = profile.corr_matrix(df, cols)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r.var1, r.var2): r["corr"] for r in out.collect()}
    want = np.corrcoef(x.T)
    assert all(abs(got[cols[i], cols[j]] - want[i, j]) < 1e-9 for i in range(32) for j in range(32))
    assert len(profile.corr_matrix(df.limit(0), cols[:2]).collect()) == 4


def test_sums_in_blocks(spark):
    df = spark.range(1000).repartition(7)
    got = moments.summed(df, lambda b: np.full((130, 3), float(np.sum(b.column("id").to_numpy()))), (130, 3))
    assert (got == 499500.0).all()


def logit_table(spark, n=600, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ np.linspace(-2, 2, d) - 1)))).astype(float)
    w = np.where(y == 1, 3.0, 1.0)
    df = spark.createDataFrame([(r.tolist(), float(a), float(b)) for r, a, b in zip(x, y, w)],
                               "features array<double>, converteu double, weight double")
    return df, x, y, w


def test_newton_reaches_the_stationary_point_on_any_partitioning(spark):
    df, x, y, w = logit_table(spark)
    models = [NewtonLogistic().fit(df.repartition(k)) for k in (1, 3, 16)]
    first = np.append(models[0].coefficients.toArray(), models[0].intercept)
    for m in models:
        beta = np.append(m.coefficients.toArray(), m.intercept)
        assert np.abs(beta - first).max() < 1e-9 and m.passes < 15
        p = 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))
        grad = np.append(x.T @ (w * (y - p)) - beta[:-1], np.sum(w * (y - p)))
        assert np.abs(grad).max() < 1e-7


def test_far_start_is_damped_and_separable_rows_stay_finite(spark):
    rows = [([float(k)], float(k > 0), 1.0) for k in range(-50, 51)]
    df = spark.createDataFrame(rows, "features array<double>, converteu double, weight double")
    m = NewtonLogistic(c=1e4).fit(df)
    assert np.isfinite(m.coefficients[0]) and m.coefficients[0] > 1 and m.passes < 100
    one = NewtonLogistic().fit(df.withColumn("converteu", F.lit(1.0)))
    assert one.coefficients[0] == 0.0 and one.intercept == float("inf")


def test_no_rows_are_refused(spark):
    df, *_ = logit_table(spark, 5)
    with pytest.raises(ValueError):
        NewtonLogistic().fit(df.limit(0))


def test_saved_and_loaded(spark, tmp_path):
    from leadlens.operators.preprocess import Preprocessor
    df, x, *_ = logit_table(spark, 100)
    m = NewtonLogistic().fit(df)
    save_model(spark, str(tmp_path / "m"), Preprocessor(), m, {})
    _, back, _ = load_model(spark, str(tmp_path / "m"))
    assert isinstance(back, LogisticModel) and back.to_json() == m.to_json()
    z = df.select(back.margin(F.col("features")).alias("z")).limit(3).collect()
    assert np.allclose([r.z for r in z], x[:3] @ m.coefficients.toArray() + m.intercept)
