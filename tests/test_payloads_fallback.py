"""Broken payload lines, and rows that fall back alone."""

import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from leadlens.operators import scoring
from leadlens.sources import payloads

GOOD = {"canal_captacao": "Instagram", "curso_interesse": "Espanhol", "faixa_etaria": None, "turno_preferencia": "Noite",
        "dias_sem_contato": 3, "n_tentativas": 2, "respondeu_contato": 1, "renda_estimada": 2500.5, "nome_ficticio": "Ana"}
LINES = {
    json.dumps(GOOD): "", json.dumps({**GOOD, "extra": {"a": 1}, "tag": "t"}): "",
    json.dumps({**GOOD, "dias_sem_contato": "soon"}): "bad_type_dias_sem_contato,missing_dias_sem_contato",
    json.dumps({**GOOD, "renda_estimada": [1]}): "bad_type_renda_estimada",
    json.dumps({**GOOD, "dias_sem_contato": None}): "missing_dias_sem_contato",
    json.dumps({**GOOD, "n_tentativas": -1}): "negative_n_tentativas",
    json.dumps(GOOD)[:-1]: "malformed", "{": "malformed", "not json": "malformed", "[1, 2]": "malformed", "17": "malformed",
    "": "empty", "   ": "empty", None: "empty",
    "{}": "missing_canal_captacao,missing_curso_interesse,missing_dias_sem_contato,missing_n_tentativas,missing_respondeu_contato",
}


def test_each_line_is_scored_or_rejected(spark):
    df = spark.createDataFrame([(i, v, 9) for i, v in enumerate(LINES)], "n int, value string, rescued int")
    both = {r.n: r for r in payloads.checked(df).collect()}
    assert {i: both[i].reasons for i in both} == dict(enumerate(LINES.values()))
    assert json.loads(both[1].rescued).keys() == {"extra", "tag"} and both[0].rescued is None
    assert both[0].dias_sem_contato == 3 and both[0].renda_estimada == 2500.5 and both[6].canal_captacao is None
    good, bad = payloads.divided(df)
    assert good.count() == 2 and bad.count() == len(LINES) - 2
    assert {r.raw for r in bad.collect()} | {r.raw for r in good.collect()} == set(LINES)


def test_stream_of_payload_files_restarts_without_repeats(spark, tmp_path):
    src, good, bad, ckpt = (str(tmp_path / n) for n in ("src", "good", "bad", "ckpt"))
    lines = [v for v in LINES if v]
    for part in (lines[:7], lines[7:]):
        spark.createDataFrame([(v,) for v in part], "value string").coalesce(1).write.mode("append").text(src)
        payloads.run_payload_stream(spark, src, good, bad, {}, {}, checkpoint=ckpt).awaitTermination()
    accepted, rejected = spark.read.parquet(good), spark.read.parquet(bad)
    assert sorted(r.raw for r in accepted.collect()) == sorted(v for v in lines if LINES[v] == "")
    assert sorted((r.raw, r.reasons) for r in rejected.collect()) == sorted((v, LINES[v]) for v in lines if LINES[v])
    assert accepted.where("score is null").count() == 0 and accepted.select("batch").distinct().count() >= 1


def test_rows_fall_back_alone_and_are_counted_in_the_same_pass(spark):
    rows = [(1, "Instagram", "Espanhol", 3, 2, 1), (2, "Instagram", "Espanhol", None, 2, 1), (3, "Instagram", "Espanhol", 3, 2_000_000_000, 1),
            (4, "Instagram", "Espanhol", -3, None, 1), (5, None, None, 3, 2, 0), (6, "Instagram", "Espanhol", 3, 2, 7)]
    df = spark.createDataFrame(rows, "lead_id long, canal_captacao string, curso_interesse string, dias_sem_contato int, "
                                     "n_tentativas int, respondeu_contato int")
    seen = Observation("status")
    got = {r.lead_id: r for r in scoring.score_or_default(df, observation=seen).collect()}
    assert [got[i].status for i in range(1, 7)] == ["scored", "degraded", "degraded", "rejected", "scored", "rejected"]
    assert got[2].error == "missing_dias_sem_contato" and got[3].error == "failed_n_tentativas" and got[2].score == 0.5
    assert got[4].error == "negative_dias_sem_contato" and got[4].score is None and got[4].classificacao is None
    assert got[2].classificacao == "Médio" and got[1].error is None
    want = scoring.score_with_scorecard(df.where("lead_id in (1, 5)")).collect()
    assert all(abs(got[r.lead_id].score - r.score) < 1e-12 and got[r.lead_id].classificacao == r.classificacao for r in want)
    assert seen.get == {"scored": 2, "degraded": 2, "rejected": 2}
    assert scoring.score_or_default(df.where(F.lit(False))).count() == 0
