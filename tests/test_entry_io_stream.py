import os
import shutil
import tempfile

import pandas as pd
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as E
from leadlens import schema as S
from leadlens.sources.io import load_model, read_leads, save_model, write_leads
from leadlens.sources.leads import leads_view
from leadlens.streaming.score_stream import run_scoring_stream, score_frame

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["lead_id", "nome_ficticio", "canal_captacao", "curso_interesse", "dias_sem_contato",
                          "n_tentativas", "respondeu_contato", "score", "classificacao"]


def test_every_sql_twin_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def test_csv_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="leadlens-test-")
    leads = leads_view(spark, SF_SMALL)
    write_leads(leads, f"{d}/leads")
    back = read_leads(spark, f"{d}/leads")
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in leads.schema]
    assert back.exceptAll(leads).count() == 0 and leads.exceptAll(back).count() == 0


@pytest.mark.parametrize("mark", [True, False])
def test_csv_byte_order_mark(spark, mark):
    """Every part file starts with the mark and its first column keeps its name; the reader takes both kinds."""
    d = tempfile.mkdtemp(prefix="leadlens-test-")
    leads = leads_view(spark, SF_SMALL)
    write_leads(leads.repartition(3), f"{d}/leads", byte_order_mark=mark)
    parts = [f for f in os.listdir(f"{d}/leads") if f.endswith(".csv")]
    assert len(parts) >= 1
    n = 0
    for f in parts:
        with open(f"{d}/leads/{f}", "rb") as file:
            assert file.read(3) == "\ufeff".encode() if mark else file.read(3) != "\ufeff".encode()
        table = pd.read_csv(f"{d}/leads/{f}", encoding="utf-8-sig")
        assert list(table.columns) == [c.name for c in S.LEADS_SCHEMA.fields]
        n += len(table)
    back = read_leads(spark, f"{d}/leads")
    assert n == leads.count() == back.count() and back.exceptAll(leads).count() == 0


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="leadlens-test-")
    leads = leads_view(spark, SF_SMALL)
    leads.repartition(3).write.parquet(f"{d}/src")
    run_scoring_stream(spark, f"{d}/src", f"{d}/out", checkpoint=f"{d}/ckpt").awaitTermination()
    got = spark.read.parquet(f"{d}/out")
    exp = score_frame(leads).select("lead_id", "score", "classificacao")
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_model_save_load_scores_equal(spark):
    from leadlens.plans.training import TrainConfig, score_with, train_all
    leads = leads_view(spark, SF_SMALL)
    tm = train_all(spark, leads, TrainConfig(models=("LogisticRegression",)))
    d = tempfile.mkdtemp(prefix="leadlens-test-")
    model = tm.models[tm.best]
    save_model(spark, f"{d}/m", tm.preprocessor, model, tm.metadata)
    pp2, m2, meta = load_model(spark, f"{d}/m")
    a = score_with(tm.preprocessor, model, leads).select("lead_id", "score")
    b = score_with(pp2, m2, leads).select("lead_id", F.col("score").alias("s2"))
    assert a.join(b, "lead_id").where(F.abs(F.col("score") - F.col("s2")) > 1e-12).count() == 0
    assert meta["melhor_modelo"] == "LogisticRegression" and len(meta["transformed_feature_names"]) == 32
    # native linear scoring equals the ML model's own probability
    from leadlens.plans.training import positive_probability
    x = tm.preprocessor.transform(leads.transform(lambda d_: __import__("leadlens.functions.features", fromlist=["x"]).add_features(d_)),
                                  keep=["lead_id"], vector_col="features")
    ml = model.transform(x).select("lead_id", positive_probability().alias("p"))
    assert a.join(ml, "lead_id").where(F.abs(F.col("score") - F.col("p")) > 1e-9).count() == 0


def test_new_lead_payload_stream(spark, new_leads):
    from leadlens.functions.scorecard import scorecard_terms
    from leadlens.operators import explain as H
    from leadlens.streaming.score_stream import run_new_lead_stream
    d = tempfile.mkdtemp(prefix="leadlens-test-")
    new_leads.coalesce(1).write.json(f"{d}/in")
    terms = scorecard_terms()
    means = H.background_means(H.background(leads_view(spark, SF_SMALL), 100), terms)
    run_new_lead_stream(spark, f"{d}/in", f"{d}/out", terms, means, checkpoint=f"{d}/ckpt").awaitTermination()
    rows = spark.read.parquet(f"{d}/out").collect()
    assert len(rows) == new_leads.count()
    bad = [r for r in rows if r.is_valid == 0]
    assert len(bad) == 3 and all(r.score is None and r.top_features is None for r in bad), bad
    good = [r for r in rows if r.is_valid == 1]
    assert all(r.score is not None and 0 <= r.score < 1 and len(r.top_features) == 3 for r in good), good


def test_sql_views(spark):
    from leadlens.sources.leads import register_views
    register_views(spark, SF_SMALL, prefix="t_")
    n = spark.sql("SELECT COUNT(*) FROM t_scored_leads WHERE classificacao IS NOT NULL").collect()[0][0]
    assert n > 0


def test_service_methods(spark, new_leads):
    from leadlens.plans.service import LeadService
    from leadlens.plans.training import TrainConfig, train_all
    leads = leads_view(spark, SF_SMALL)
    tm = train_all(spark, leads, TrainConfig(models=("LogisticRegression",)))
    svc = LeadService.start(spark, leads, tm.preprocessor, tm.models[tm.best], tm.metadata)
    lst = svc.list_leads(canal="Instagram", score_min=0.2).collect()
    assert lst and all(r.canal_captacao == "Instagram" and r.score >= 0.2 for r in lst)
    assert [r.score for r in lst] == sorted([r.score for r in lst], reverse=True)
    sc = svc.score(new_leads).collect()
    assert sum(r.is_valid for r in sc) == 6 and all(len(r.top_features) == 3 for r in sc if r.is_valid)
    req = spark.createDataFrame([(1,), (2,), (10 ** 9,)], "lead_id long")
    scr = {r.lead_id: r for r in svc.scripts(req).collect()}
    assert scr[10 ** 9].found == 0 and scr[1].found == 1 and scr[1].script.startswith("Oi ")


def test_stream_rejects_faulty_rows(spark, tmp_path):
    from leadlens.sources.io import write_table
    from leadlens.streaming.score_stream import run_scoring_stream
    dirty = leads_view(spark, SF_SMALL, dirty=True)
    write_table(dirty, str(tmp_path / "src"), fmt="parquet")
    run_scoring_stream(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt"),
                       columns=["lead_id", "reasons", "score", "classificacao"]).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    faulty = [r for r in rows if r.reasons]
    assert len(rows) == dirty.count() and faulty
    assert all(r.score is None and r.classificacao is None for r in faulty)
    assert all(r.score is not None and r.classificacao for r in rows if not r.reasons)


def test_missing_metadata_is_optional_but_a_damaged_one_is_not(spark, tmp_path):
    from leadlens.plans.training import TrainConfig, train_all
    from leadlens.sources.io import load_model, save_model
    tm = train_all(spark, leads_view(spark, SF_SMALL), TrainConfig(models=("RandomForest",), rf_trees=3, rf_max_depth=2))
    path = str(tmp_path / "m")
    save_model(spark, path, tm.preprocessor, tm.models["RandomForest"], tm.metadata)
    spark.createDataFrame([("{",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    with pytest.raises(ValueError):
        load_model(spark, path)
    shutil.rmtree(f"{path}/metadata")
    pp, model, meta = load_model(spark, path)
    assert meta == {} and type(model).__name__ == "RandomForestClassificationModel" and pp == tm.preprocessor
    assert set(tm.reports) == set(tm.pr_curves) == {"RandomForest"}
    assert tm.reports["RandomForest"].count() == 5 and tm.pr_curves["RandomForest"].count() > 1


def test_materialized_leads_equal_view(spark):
    from leadlens.sources.leads import materialize_leads
    d = tempfile.mkdtemp(prefix="leadlens-test-")
    t = materialize_leads(spark, SF_SMALL, f"{d}/leads", partitions=4)
    v = leads_view(spark, SF_SMALL)
    assert t.exceptAll(v).count() == 0 and v.exceptAll(t).count() == 0


def test_score_leads_without_terms(spark, new_leads):
    from leadlens.operators.scoring import score_leads
    rows = score_leads(new_leads, {}, {}).collect()
    assert all(r.top_features is None for r in rows) and sum(r.is_valid for r in rows) == 6
