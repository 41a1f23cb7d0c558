from pyspark.sql import functions as F

from leadlens.functions.common import sigmoid
from leadlens.functions.scorecard import log_odds, scorecard_terms
from leadlens.operators import explain as H
from leadlens.operators.permutation import exact_attribution, permutation_attribution
from leadlens.sources.leads import leads_view

from conftest import SF_SMALL

FEATS = ["canal_captacao", "respondeu_contato", "dias_sem_contato", "n_tentativas", "curso_interesse"]


def test_additive_model_gives_exact_linear_values(spark):
    leads = leads_view(spark, SF_SMALL).select("lead_id", *FEATS).limit(40)
    bg = H.background(leads, 7)
    got = permutation_attribution(leads, lambda d: d.withColumn("score", log_odds()), FEATS, bg, n_permutations=3)
    terms = scorecard_terms()
    exact = H.explain_long(leads, terms, H.background_means(bg, terms))
    j = got.join(exact, ["lead_id", "feature"])
    assert j.count() == 40 * len(FEATS)
    assert j.where(F.abs(F.col("impact") - exact["impact"]) > 1e-9).count() == 0 if False else \
        j.select((F.abs(got["impact"] - exact["impact"])).alias("e")).where("e > 1e-9").count() == 0


def test_efficiency_in_probability_units(spark):
    leads = leads_view(spark, SF_SMALL).select("lead_id", *FEATS).limit(30)
    bg = H.background(leads, 5)
    got = permutation_attribution(leads, lambda d: d.withColumn("score", sigmoid(log_odds())), FEATS, bg, 2)
    base = bg.agg(F.avg(sigmoid(log_odds()))).collect()[0][0]
    sums = got.groupBy("lead_id").agg(F.sum("impact").alias("s"))
    f = leads.select("lead_id", sigmoid(log_odds()).alias("fx"))
    assert sums.join(f, "lead_id").where(F.abs(F.col("s") - (F.col("fx") - F.lit(base))) > 1e-9).count() == 0


def test_exact_values_in_numpy_batches_spread_over_tasks_and_unknown_terms(spark):
    from math import factorial

    import numpy as np
    rng = np.random.default_rng(0)
    t = np.round(rng.normal(size=(60, 3)), 3)
    rows = [(i // 2, *map(float, r)) for i, r in enumerate(t)]      # ids repeat
    rows.append((99, None, 1.0, 2.0))
    df = spark.createDataFrame(rows, "lead_id long, a double, b double, c double").coalesce(1)
    bg = df.limit(7)

    def link(z):
        assert isinstance(z, np.ndarray) and z.ndim == 2     # many rows and background sums at a time
        return 1 / (1 + np.exp(-z))
    got = exact_attribution(df, {k: F.col(k) for k in "abc"}, bg, link, 0.25)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and "aggregate(" not in plan.lower().replace("hashaggregate(", "")
    value = lambda r, m: np.mean([1 / (1 + np.exp(-(0.25 + sum(r[j] if m >> j & 1 else b[j] for j in range(3))))) for b in t[:7]])
    want = sorted((i // 2, "abc"[j], round(sum(
        factorial(m.bit_count()) * factorial(2 - m.bit_count()) / 6 * (value(r, m | 1 << j) - value(r, m))
        for m in range(8) if not m >> j & 1), 9)) for i, r in enumerate(t) for j in range(3))
    found = got.collect()
    assert sorted((r.lead_id, r.feature, round(r.impact, 9)) for r in found if r.lead_id != 99) == want
    assert [r.impact for r in found if r.lead_id == 99] == [None] * 3
