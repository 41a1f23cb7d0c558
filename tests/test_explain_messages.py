from pyspark.sql import functions as F

from leadlens.functions import text as TX
from leadlens.functions.scorecard import log_odds, scorecard_terms
from leadlens.operators import explain as H
from leadlens.sources.leads import leads_view

from conftest import SF_SMALL


def test_attributions_sum_to_logodds_minus_base(spark):
    leads = leads_view(spark, SF_SMALL)
    terms = scorecard_terms()
    bg = H.background(leads, 100)
    means = H.background_means(bg, terms)
    base = bg.agg(F.avg(log_odds())).collect()[0][0]
    w = H.explain_wide(leads, terms, means, keep=["lead_id", "canal_captacao", "respondeu_contato",
                                                  "dias_sem_contato", "n_tentativas", "curso_interesse"])
    bad = w.where(F.abs(F.col("shap_sum") - (log_odds() - F.lit(base))) > 1e-9).count()
    assert bad == 0


def test_top3_order_and_ties(spark):
    df = spark.createDataFrame([(1, 0.5, -0.5, 0.1, 0.0)], "lead_id long, a double, b double, c double, d double")
    terms = {n: F.col(n) for n in "abcd"}
    means = {n: 0.0 for n in "abcd"}
    r = H.flatten_top(H.top_k(df, terms, means, 3)).collect()[0]
    assert (r.top1_feature, r.top2_feature, r.top3_feature) == ("a", "b", "c")   # tie keeps original order
    assert r.top1_direction == H.FAVOURS and r.top2_direction == H.DISFAVOURS
    g = H.global_importance(df, terms, means, k=2).collect()
    assert [x.feature for x in g] == ["a", "b"]


def test_explanation_text(spark):
    df = spark.createDataFrame([([("x", 0.3149), ("y", -0.125)],), ([],)],
                               "top array<struct<feature:string,impact:double>>")
    got = [r[0] for r in df.select(TX.explanation_text("top")).collect()]
    assert got == ["x (0.31), y (0.12)", TX.NO_EXPLANATION]     # 0.125 -> 0.12 (half-even)


def test_fallback_scripts(spark):
    df = spark.createDataFrame([("Ana Souza", "Espanhol", "Indicação", 5), ("  Bia", "Francês", "Instagram", 3),
                                ("", None, "Instagram", 0)],
                               "nome_ficticio string, curso_interesse string, canal_captacao string, n_tentativas int")
    s = [r[0] for r in df.select(TX.fallback_script()).collect()]
    assert s[0].startswith("Oi Ana!  Soube que alguém te indicou pra conhecer nosso curso de Espanhol.\n")
    assert s[1].startswith("Oi Bia, tudo bem?") and "curso de Francês — sem compromisso" in s[1]
    assert s[2].startswith("Oi Lead! Vi que você demonstrou interesse no nosso curso de idiomas.")
    assert all(x.endswith("\nFica à vontade pra responder quando puder! ") for x in s)


def test_prompt_fills_all_placeholders(spark):
    df = spark.createDataFrame([("Ana", "Espanhol", "Instagram", 4, 2, 0.125, "x (0.31)")],
                               "nome_ficticio string, curso_interesse string, canal_captacao string, "
                               "dias_sem_contato int, n_tentativas int, score double, shap_text string")
    p = df.select(TX.prompt()).collect()[0][0]
    assert "{" not in p and "- Nome: Ana\n" in p and "- Score de conversão: 12%\n" in p
    assert p.endswith("Escreva apenas a mensagem, sem explicações adicionais.\n")
