"""Model checks: the fitted logistic model is a stationary point of the
objective it is meant to solve (class-balanced log-loss + L2 with C = 1)."""

from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.functions.common import sigmoid
from leadlens.plans.training import TrainConfig, prepared, score_with, train_all
from leadlens.sources.leads import leads_view

from conftest import SF_SMALL


def test_logistic_gradient_near_zero(spark):
    leads = leads_view(spark, SF_SMALL)
    cfg = TrainConfig(models=("LogisticRegression",))
    tm = train_all(spark, leads, cfg)
    model, pp = tm.models["LogisticRegression"], tm.preprocessor
    train = prepared(leads, cfg).where(F.col("split") == "train")
    counts = {r[0]: r[1] for r in train.groupBy(S.LABEL_COL).count().collect()}
    n = sum(counts.values())
    w = F.when(F.col(S.LABEL_COL) == 1, F.lit(n / (2 * counts[1]))).otherwise(F.lit(n / (2 * counts[0])))
    coefs = list(model.coefficients.toArray())
    slots = pp.slot_columns()
    z = F.lit(float(model.intercept))
    for b, c in zip(coefs, slots):
        z = z + F.lit(float(b)) * c
    r = w * (sigmoid(z) - F.col(S.LABEL_COL))
    g = train.agg(F.sum(w).alias("sw"), F.sum(r).alias("g0"),
                  *[F.sum(r * c).alias(f"g{i + 1}") for i, c in enumerate(slots)]).collect()[0]
    reg = 1.0 / n                                      # regParam = 1 / (C * sum of weights), C = 1
    grads = [g["g0"] / g["sw"]] + [g[f"g{i + 1}"] / g["sw"] + reg * b for i, b in enumerate(coefs)]
    assert max(abs(x) for x in grads) < 1e-3, grads


def test_comparison_and_metadata(spark):
    from leadlens.plans.training import metadata_frame
    leads = leads_view(spark, SF_SMALL)
    tm = train_all(spark, leads, TrainConfig(models=("LogisticRegression", "RandomForest"), rf_trees=10,
                                             rf_max_depth=4))
    rows = tm.comparison.collect()
    assert [r.model for r in rows] == ["LogisticRegression", "RandomForest"]       # insertion order
    assert sum(r.best for r in rows) == 1
    best = [r for r in rows if r.best][0]
    assert best.auc_roc == max(r.auc_roc for r in rows) and best.model == tm.best
    meta = metadata_frame(spark, tm.metadata).collect()[0]
    assert meta.melhor_modelo == tm.best and meta.n_features == 16 and meta.n_treino + meta.n_teste == leads.count()


def test_service_with_tree_model(spark, new_leads):
    from leadlens.plans.service import LeadService
    leads = leads_view(spark, SF_SMALL)
    tm = train_all(spark, leads, TrainConfig(models=("RandomForest",), rf_trees=5, rf_max_depth=3))
    svc = LeadService.start(spark, leads, tm.preprocessor, tm.models["RandomForest"], tm.metadata)
    rows = svc.score(new_leads).collect()
    valid = [r for r in rows if r.is_valid]
    assert len(valid) == 6 and all(0.0 <= r.score <= 1.0 for r in valid)
    assert all((r.top_features is None) != (r.is_valid == 1) for r in rows)
    assert all(len(r.top_features) == 3 and abs(r.top_features[0].impact) >= abs(r.top_features[2].impact) for r in valid)
    assert svc.list_leads(limit=5).count() == 5
    some = leads.where("lead_id <= 4")
    base = score_with(svc.preprocessor, svc.model, svc.background).agg({"score": "avg"}).first()[0]
    total = {r.lead_id: r.s for r in svc.attributions(some).groupBy("lead_id").agg(F.sum("impact").alias("s")).collect()}
    for r in svc.scored.where("lead_id <= 4").collect():
        assert abs(total[r.lead_id] - (r.score - base)) < 1e-9     # impacts sum to score minus base
