"""Null and degenerate inputs: each with its defined result."""

import math

import pytest
from pyspark.sql import functions as F

from leadlens.functions.bands import band_left, band_right
from leadlens.operators import explain as H
from leadlens.operators import management as J
from leadlens.operators import metrics as M
from leadlens.operators import profile as P


def test_curves_of_an_empty_table(spark):
    df = spark.createDataFrame([], "score double, converteu int")
    assert M.roc_auc(df).first().auc is None
    assert M.average_precision(df).first().avg_precision == 0.0
    assert [tuple(r) for r in M.roc_points(df).collect()] == [(math.inf, None, None)]
    assert [tuple(r) for r in M.pr_points(df).collect()] == [(None, 1.0, 0.0)]
    assert P.box_stats(spark.createDataFrame([(1, None)], "converteu int, v double"), "v").collect() == []


def test_roc_points_of_one_class(spark):
    df = spark.createDataFrame([(0.2, 1), (0.7, 1)], "score double, converteu int")
    got = sorted((r.threshold, r.fpr, r.tpr) for r in M.roc_points(df, drop_intermediate=False).collect())
    assert got == [(0.2, None, 1.0), (0.7, None, 0.5), (math.inf, None, 0.0)]


def test_constant_columns_correlate_as_nan(spark):
    df = spark.createDataFrame([(1, 2.0, 0), (1, 3.0, 1), (1, 5.0, 1)], "c int, x double, converteu int")
    got = {(r.var1, r.var2): r.corr for r in P.corr_matrix(df).collect()}
    assert all(math.isnan(v) == ("c" in k) for k, v in got.items()) and got[("x", "x")] == 1.0
    rows = P.corr_with_target(df).collect()
    assert [r.variable for r in rows] == ["x", "c"] and math.isnan(rows[1].corr)


def test_null_keys_are_no_groups(spark):
    df = spark.createDataFrame([("a", 0.2, 1, 0), (None, 0.9, 0, 1), ("b", 0.4, None, 1), ("b", None, 1, 0)],
                               "canal string, score double, respondeu_contato int, converteu int")
    assert [r.canal for r in J.mean_score_by(df, "canal").collect()] == ["a", "b"]
    assert J.best_by(df, "canal").first().canal == "b"
    assert {r.canal for r in P.conversion_by(df, "canal").collect()} == {"a", "b"}
    assert J.response_rate(df).first().pct_resposta == 50.0
    assert J.response_rate(df.limit(0)).first().pct_resposta is None


def test_no_class_without_a_score(spark):
    df = spark.createDataFrame([(None,), (0.7,)], "score double").select(band_left(), band_right()).collect()
    assert [tuple(r) for r in df] == [(None, None), ("Alto", "Alto")]


def test_unknown_impacts_come_last(spark):
    df = spark.createDataFrame([(1, None, 0.5, -2.0)], "lead_id long, x double, y double, z double")
    terms = {c: F.col(c) for c in ("x", "y", "z")}
    means = dict.fromkeys(terms, 0.0)
    row = H.top_k(df, terms, means, 3).first()
    assert [t.feature for t in row.top_features] == ["z", "y", "x"] and row.top_feature == "z"
    assert [t.feature for t in df.select(H.top_features_column(terms, means, 2).alias("t")).first().t] == ["z", "y"]


def test_a_null_binary_is_refused_or_filled(spark):
    from leadlens.operators.preprocess import Preprocessor
    df = spark.createDataFrame([(1.0, "a", 1), (2.0, "b", None)], "x double, c string, z int")
    with pytest.raises(ValueError, match="z"):
        Preprocessor(numeric=["x"], categorical=["c"], binary=["z"]).fit(df)
    pp = Preprocessor(numeric=["x"], categorical=["c"], binary=["z"], binary_fill=0.0).fit(df)
    assert [r["binarias__z"] for r in pp.transform(df).collect()] == [1.0, 0.0]
