
from leadlens import schema as S
from leadlens.functions.bands import band_left, band_right
from leadlens.functions.features import add_features
from leadlens.functions.scorecard import log_odds, response_propensity
from leadlens.operators.select import default_name, validate


def _rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_features_boundaries(new_leads):
    f = add_features(new_leads).collect()
    by_name = {r["nome_ficticio"]: r for r in f}
    ana = by_name["Ana Maria Souza"]          # referral, 0 days, 0 attempts, evening, adult course
    assert (ana.is_indicacao, ana.is_evento, ana.contato_rapido, ana.tentativas_ideal) == (1, 0, 1, 0)
    assert (ana.turno_noite, ana.curso_adulto, ana.urgencia_estimada) == (1, 1, 0)
    assert abs(ana.score_engajamento - (0.3 + 0.4)) < 1e-12
    r = [x for x in f if x["nome_ficticio"] is None][0]   # null shift -> 0, days 2 -> fast contact
    assert (r.turno_noite, r.contato_rapido, r.tentativas_ideal, r.urgencia_estimada) == (0, 1, 1, 4)
    assert by_name[""].contato_rapido == 0 and by_name[""].tentativas_ideal == 1        # days 3, attempts 3
    joao = by_name["  João  Silva"]                                                    # days 60 -> recency 0
    assert abs(joao.score_engajamento - 0.3 * 4 / 5) < 1e-12 and joao.tentativas_ideal == 0
    bia = by_name["Bia"]                                                               # days 61 clipped
    assert abs(bia.score_engajamento - (0.3 + 0.3)) < 1e-12 and bia.is_evento == 1
    caio = by_name["Caio"]                                                             # attempts 9 clipped to 5
    assert abs(caio.score_engajamento - (0.4 * (1 - 10 / 60) + 0.3)) < 1e-12
    assert by_name["Duda"].score_engajamento > 0.3 + 0.4 - 1e-12                       # negative days clip to 1
    fab = by_name["Fábio"]                                                             # null channel -> 0, not null
    assert fab.is_indicacao == 0 and fab.is_evento == 0


def test_null_days_are_zero_for_features_only(spark):
    df = spark.createDataFrame([(None, None, None, "Instagram", None, None)],
                               "dias_sem_contato int, n_tentativas int, respondeu_contato int, "
                               "canal_captacao string, turno_preferencia string, curso_interesse string")
    r = add_features(df).collect()[0]
    assert r.dias_sem_contato is None and r.urgencia_estimada == 0 and r.contato_rapido == 1
    assert abs(r.score_engajamento - 0.4) < 1e-12


def test_validation_reasons(new_leads):
    v = {r["nome_ficticio"]: (r["is_valid"], r["reasons"]) for r in validate(new_leads).collect()}
    assert v["Ana Maria Souza"] == (1, "")
    assert v["Duda"] == (0, "negative_dias_sem_contato")
    assert v["Eva"] == (0, "respondeu_contato_out_of_range")
    assert v["Fábio"] == (0, "missing_canal_captacao")
    assert v["Caio"] == (1, "")            # unknown channel / course values are allowed


def test_default_name(new_leads):
    names = {r[0] for r in default_name(new_leads).select("nome_ficticio").collect()}
    assert None not in names and S.DEFAULT_NAME in names


def test_bands_differ_at_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.30001,), (0.6,), (0.61,), (1.0,)], "score double")
    got = _rows(df.select("score", band_right("score").alias("r"), band_left("score").alias("l")), "score", "r", "l")
    assert got == [(0.0, None, "Baixo"), (0.3, "Baixo", "Médio"), (0.30001, "Médio", "Médio"),
                   (0.6, "Médio", "Alto"), (0.61, "Alto", "Alto"), (1.0, "Alto", "Alto")]


def test_scorecard_and_propensity(spark):
    df = spark.createDataFrame([("Indicação", 1, 0, 2, "Inglês Adulto"), ("Desconhecido", 0, 10, 0, "X")],
                               "canal_captacao string, respondeu_contato int, dias_sem_contato int, "
                               "n_tentativas int, curso_interesse string")
    r = df.select(log_odds().alias("lo"), response_propensity().alias("p")).collect()
    assert abs(r[0].lo - (-3.2 + 1.5 + 0.7 + 0.3 + 0.3)) < 1e-12
    assert abs(r[1].lo - (-3.2 - 0.4 - 0.6 + 0.3)) < 1e-12         # unknown channel/course add 0
    assert abs(r[0].p - 0.50) < 1e-12 and abs(r[1].p - max(0.05, 0.45 - 0.08 - 0.10)) < 1e-12
