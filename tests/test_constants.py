"""The fixed values as literals: the SQL twins are built from the same tables, so they cannot see a wrong one."""

import pytest

from leadlens import schema as S
from leadlens.functions.bands import band_left, band_right
from leadlens.functions.scorecard import log_odds
from leadlens.operators.profile import days_band
from leadlens.sources.leads import AGE_CUTS, CHANNEL_CUTS, COURSE_CUTS, SHIFT_CUTS

CASES = [  # channel, responded, days, attempts, course, log-odds worked out by hand
    ("Indicação", 1, 0, 2, "Inglês Adulto", -0.4),
    ("Evento Presencial", 0, 10, 0, "Inglês Intermediário", -2.6),
    ("Tráfego Orgânico", 0, 0, 2, "Inglês Básico", -2.4),
    ("Google Ads", 1, 25, 4, "Inglês Teens", -3.9),
    ("Instagram", 0, 0, 2, "Espanhol", -3.5),
    ("Facebook Ads", 0, 50, 8, "Francês", -11.3),
    ("Outro", 1, 0, 1, "Outro", -2.35),
]


def test_scorecard_by_hand(spark):
    df = spark.createDataFrame(CASES, "canal_captacao string, respondeu_contato int, dias_sem_contato int, n_tentativas int, "
                                      "curso_interesse string, want double")
    for r in df.select("want", log_odds().alias("got")).collect():
        assert r.got == pytest.approx(r.want, abs=1e-12)


def test_classes_and_bands(spark):
    df = spark.createDataFrame([(0.0,), (0.29,), (0.3,), (0.59,), (0.6,), (0.61,), (1.0,)], "score double")
    assert [r[0] for r in df.select(band_left()).collect()] == ["Baixo", "Baixo", "Médio", "Médio", "Alto", "Alto", "Alto"]
    assert [r[0] for r in df.select(band_right()).collect()] == [None, "Baixo", "Baixo", "Médio", "Médio", "Alto", "Alto"]
    days = spark.createDataFrame([(d,) for d in (0, 1, 3, 4, 7, 8, 14, 15, 30, 31, 60, 61)], "dias_sem_contato int")
    assert [r[0] for r in days.select(days_band()).collect()] == [
        None, "0-3d", "0-3d", "4-7d", "4-7d", "8-14d", "8-14d", "15-30d", "15-30d", "31-60d", "31-60d", None]


def test_roles_and_names():
    assert S.MODEL_INPUT_COLS == [
        "dias_sem_contato", "n_tentativas", "renda_estimada", "score_engajamento", "urgencia_estimada",
        "canal_captacao", "curso_interesse", "faixa_etaria", "turno_preferencia",
        "respondeu_contato", "is_indicacao", "is_evento", "contato_rapido", "tentativas_ideal", "turno_noite", "curso_adulto"]
    assert (S.ALL_OPTION, S.DEFAULT_NAME, S.CLASS_LOW, S.CLASS_MID, S.CLASS_HIGH) == ("Todos", "Lead", "Baixo", "Médio", "Alto")
    assert sorted(S.RAW_INPUT_COLS) == sorted(f.name for f in S.NEW_LEAD_SCHEMA.fields if f.name != "nome_ficticio")


@pytest.mark.parametrize("cuts,shares,of", [(CHANNEL_CUTS, [15, 25, 20, 15, 15, 10], 20), (COURSE_CUTS, [30, 20, 20, 15, 10, 5], 20),
                                            (AGE_CUTS, [20, 35, 25, 13, 7], 100), (SHIFT_CUTS, [25, 30, 45], 20)])
def test_shares_of_the_lead_view(cuts, shares, of):
    edges = [0] + [c for c, _ in cuts]
    assert [(b - a) * 100 / of for a, b in zip(edges, edges[1:])] == shares
