"""Operators that no registered query calls, and the join under every lead query."""

import pytest
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.functions.scorecard import add_scorecard
from leadlens.operators import explain as H
from leadlens.operators import messages as MSG
from leadlens.operators import metrics as M
from leadlens.operators import profile as P
from leadlens.operators import scoring
from leadlens.operators import select as sel
from leadlens.operators.permutation import exact_attribution, permutation_attribution
from leadlens.sources.io import read_new_leads, write_table
from leadlens.sources.leads import leads_view

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def leads(spark):
    return leads_view(spark, SF_SMALL)


def test_model_input(leads):
    x, label, names = sel.prepare(leads)
    assert x.columns == ["lead_id", "converteu", *S.MODEL_INPUT_COLS] and label == "converteu" and len(names) == 16
    assert "lead_id" not in sel.drop_non_features(x).columns and "canal_captacao" in sel.drop_non_features(x).columns
    assert S.numeric_and_categorical() == (S.NUMERIC_COLS, S.CATEGORICAL_COLS)
    n = leads.where("renda_estimada IS NOT NULL").count()
    assert sel.drop_nulls(leads, ["renda_estimada"]).count() == n < leads.count()


def test_lookup_relabel_and_validity(spark, leads, new_leads):
    scored = scoring.score_with_scorecard(leads)
    assert sel.lookup_one(scored, 7).first().lead_id == 7 and sel.lookup_one(scored, -7).first() is None
    assert sel.display_relabel(scored).columns == list(sel.DISPLAY_LABELS.values())
    good, bad = sel.split_valid(new_leads)
    assert (good.count(), bad.count()) == (6, 3)
    types = {r.dtype: r.n_columns for r in P.dtype_counts(leads).collect()}
    assert types == {"bigint": 1, "string": 6, "int": 4, "double": 1}


def test_payload_files_and_impact_table(spark, leads, new_leads, tmp_path):
    new_leads.write.json(str(tmp_path / "new"))
    back = read_new_leads(spark, str(tmp_path / "new"))
    assert sorted(map(str, back.collect())) == sorted(map(str, new_leads.collect()))
    impact = M.impact_sweep(scoring.score_with_scorecard(leads))
    write_table(impact, str(tmp_path / "impact"))
    assert spark.read.option("header", True).csv(str(tmp_path / "impact")).count() == 9


def test_context_and_scorecard_columns(leads):
    out = add_scorecard(leads, logit_col="z")
    assert {"score", "z"} <= set(out.columns)
    row = out.withColumn("top_features", F.array(F.lit("x"))).select(MSG.message_context(out).alias("c")).first().c
    assert set(row.asDict()) == {"nome_ficticio", "curso_interesse", "canal_captacao", "dias_sem_contato", "n_tentativas",
                                 "score", "shap_top_features"}


def test_exact_values_agree_with_sampled_orderings_and_sum_up(leads):
    from leadlens.functions.common import sigmoid
    from leadlens.functions.scorecard import log_odds, scorecard_terms
    some, bg = leads.where("lead_id <= 6"), leads.orderBy("lead_id").limit(20)
    exact = exact_attribution(some, scorecard_terms(), bg, sigmoid, S.SCORECARD_INTERCEPT)
    values = {(r.lead_id, r.feature): r.impact for r in exact.collect()}
    base = bg.agg(F.avg(sigmoid(log_odds()))).first()[0]
    for r in some.select("lead_id", sigmoid(log_odds()).alias("s")).collect():
        assert abs(sum(v for (i, _), v in values.items() if i == r.lead_id) - (r.s - base)) < 1e-12
    names = ["canal_captacao", "respondeu_contato", "dias_sem_contato", "n_tentativas", "curso_interesse"]
    sampled = permutation_attribution(some, lambda d: d.withColumn("score", sigmoid(log_odds())), names, bg, n_permutations=24)
    for r in sampled.collect():
        assert abs(values[r.lead_id, r.feature] - r.impact) < 0.03
    plan = exact._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lead_id" not in plan


def test_a_customer_with_a_third_of_all_orders(spark, tmp_path):
    """The lead view without broadcasts: a sort-merge join whose frequent key is split at run time."""
    for name in ("customer", "nation"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    hot = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("o_custkey")))
    hot.write.parquet(str(tmp_path / "orders.parquet"))
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        view = leads_view(spark, str(tmp_path))
        assert view.count() == orders.count()
        view = leads_view(spark, str(tmp_path)).select("lead_id", "canal_captacao")
        assert len(view.collect()) == orders.count()
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_linear_terms_of_named_slots(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "lead_id long, `a__x` double, `b__y z` double")
    terms = H.linear_terms({"a__x": 2.0, "b__y z": -1.0})
    row = H.explain_wide(df, terms, {"a__x": 1.0, "b__y z": 0.0}).first()
    assert row["shap_a__x"] == 3.0 and row["shap_b__y z"] == -3.0 and row.shap_sum == 0.0
