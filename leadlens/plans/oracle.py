"""SQL twins (for an independent engine) of the catalogue queries."""

from __future__ import annotations

import math
import re

from .. import schema as S
from ..functions import text as TX
from .catalog import BOOST_CUTS, FIXED_FOREST, FOREST_FEATURES
from .oracle_models import boosting_sql, forest_sql, newton_ctes, tree_shap_ctes
from .sql import band_left_sql, band_right_sql, case_map, d, log_odds_sql, q, sigmoid_sql, with_ctes

ORACLE: dict[str, str] = {}


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def sql(name: str, text: str):
    ORACLE[name] = text


LEAD_COLS = ", ".join(f.name for f in S.LEADS_SCHEMA.fields)

sql("leads_view", with_ctes(f"SELECT {LEAD_COLS} FROM leads"))

_reasons = ", ".join(
    [f"CASE WHEN {c} IS NULL THEN 'missing_{c}' END" for c in
     ["canal_captacao", "curso_interesse", "dias_sem_contato", "n_tentativas", "respondeu_contato"]]
    + ["CASE WHEN dias_sem_contato < 0 THEN 'negative_dias_sem_contato' END",
       "CASE WHEN n_tentativas < 0 THEN 'negative_n_tentativas' END",
       "CASE WHEN NOT (respondeu_contato BETWEEN 0 AND 1) THEN 'respondeu_contato_out_of_range' END"])
sql("validate_leads", with_ctes(
    f"SELECT lead_id, CASE WHEN r = '' THEN 1 ELSE 0 END AS is_valid, r AS reasons "
    f"FROM (SELECT lead_id, concat_ws(',', {_reasons}) AS r FROM leads) t", dirty=True))

sql("options", with_ctes(
    "SELECT DISTINCT 'canal_captacao' AS field, canal_captacao AS value FROM leads WHERE canal_captacao IS NOT NULL "
    "UNION SELECT DISTINCT 'curso_interesse' AS field, curso_interesse AS value FROM leads WHERE curso_interesse IS NOT NULL"))

sql("features", with_ctes(
    "SELECT lead_id, round(score_engajamento, 6) AS score_engajamento, is_indicacao, is_evento, "
    "urgencia_estimada, contato_rapido, tentativas_ideal, turno_noite, curso_adulto FROM feat"))

sql("scorecard", with_ctes(
    f"SELECT lead_id, round({log_odds_sql()}, 6) AS log_odds, round({sigmoid_sql(log_odds_sql())}, 6) AS score FROM leads"))

sql("response_propensity", with_ctes(
    "SELECT lead_id, round(least(greatest((45e-2 + -8e-3 * dias_sem_contato) + "
    "CASE WHEN n_tentativas >= 1 THEN 5e-2 ELSE -1e-1 END, 5e-2), 9e-1), 6) AS prob_resposta FROM leads"))

sql("bands_right", with_ctes(f"SELECT lead_id, round(score, 6) AS score, {band_right_sql()} AS classificacao FROM scored0"))
sql("bands_left_nulls", with_ctes(
    f"SELECT lead_id, round(score, 6) AS score, {band_left_sql()} AS classificacao FROM scored0", nulls=True))
sql("bands_left", with_ctes(f"SELECT lead_id, round(score, 6) AS score, {band_left_sql()} AS classificacao FROM scored0"))

_LIST = ("lead_id, nome_ficticio, canal_captacao, curso_interesse, dias_sem_contato, n_tentativas, "
         "respondeu_contato, round(score, 6) AS score, classificacao")
sql("list_leads", with_ctes(
    f"SELECT {_LIST} FROM scored WHERE canal_captacao = {q('Indicação')} AND score BETWEEN {d(0.1)} AND 1e0 "
    "ORDER BY score DESC, lead_id"))
for _name, _nulls in (("list_all", False), ("list_all_nulls", True)):
    sql(_name, with_ctes(f"SELECT {_LIST} FROM scored ORDER BY score DESC NULLS LAST, lead_id", nulls=_nulls))

sql("lookup_batch", with_ctes(
    "SELECT r.lead_id, CASE WHEN s.lead_id IS NULL THEN 0 ELSE 1 END AS found, s.nome_ficticio, "
    "round(s.score, 6) AS score, s.classificacao "
    "FROM (SELECT DISTINCT o_orderkey * 2 + 1 AS lead_id FROM orders) r LEFT JOIN scored s ON r.lead_id = s.lead_id"))

def _lookup_sql(requests: str) -> str:
    return with_ctes("SELECT r.lead_id, CASE WHEN s.lead_id IS NULL THEN 0 ELSE 1 END AS found, s.nome_ficticio, "
                     f"round(s.score, 6) AS score, s.classificacao FROM ({requests}) r LEFT JOIN scored s ON r.lead_id = s.lead_id")


sql("lookup_bucketed", _lookup_sql("SELECT DISTINCT o_orderkey * 2 + 1 AS lead_id FROM orders"))
_first = "(SELECT MIN(o_orderkey) AS k FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 10)"
sql("lookup_few", _lookup_sql(f"SELECT k + 1 AS lead_id FROM {_first} UNION SELECT -k - 1 FROM {_first}"))

# ---------------------------------------------------------------- evaluation of the scorecard score
_CURVE = [
    "sc AS (SELECT log_odds, MAX(score) AS score, SUM(converteu) AS pos, COUNT(*) - SUM(converteu) AS neg "
    "FROM scored GROUP BY log_odds)",
    "rt AS (SELECT *, SUM(pos) OVER (ORDER BY log_odds DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps, "
    "SUM(neg) OVER (ORDER BY log_odds DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps, "
    "LEAD(pos) OVER (ORDER BY log_odds DESC) AS next_pos, LEAD(neg) OVER (ORDER BY log_odds DESC) AS next_neg FROM sc)",
    "tot AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM sc)",
]
sql("roc_auc", with_ctes(
    "SELECT round(CASE WHEN P > 0 AND N > 0 THEN (P * N - above) / (P * N) END, 6) AS auc "
    "FROM (SELECT SUM(pos) AS P, SUM(neg) AS N, SUM(pos * (fps - 5e-1 * neg)) AS above FROM rt) t", _CURVE))
sql("avg_precision", with_ctes(
    "SELECT round(CASE WHEN P > 0 THEN s / P ELSE 0e0 END, 6) AS avg_precision "
    "FROM (SELECT SUM(pos) AS P, SUM(pos * (tps / (tps + fps))) AS s FROM rt) t", _CURVE))


def _confusion(t: str) -> str:
    p = f"(score > {t})"
    return (f"SELECT COUNT(*) FILTER (WHERE converteu = 0 AND NOT {p}) AS tn, "
            f"COUNT(*) FILTER (WHERE converteu = 0 AND {p}) AS fp, "
            f"COUNT(*) FILTER (WHERE converteu = 1 AND NOT {p}) AS fn, "
            f"COUNT(*) FILTER (WHERE converteu = 1 AND {p}) AS tp FROM scored")


sql("confusion", with_ctes(_confusion("5e-1")))
sql("confusion_at_0_2", with_ctes(_confusion(d(0.2))))


def _sdiv(a, b):
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE 0e0 END)"


_cr = [f"cm AS ({_confusion(d(0.2))})",
       "pr AS (SELECT *, " + ", ".join([
           f"{_sdiv('tn', 'tn + fn')} AS p0", f"{_sdiv('tn', 'tn + fp')} AS r0",
           f"{_sdiv('tp', 'tp + fp')} AS p1", f"{_sdiv('tp', 'tp + fn')} AS r1",
           "tn + fp AS s0", "tp + fn AS s1", "tn + fp + fn + tp AS n",
           f"{_sdiv('tp + tn', 'tn + fp + fn + tp')} AS acc"]) + " FROM cm)",
       f"pr2 AS (SELECT *, {_sdiv('2 * p0 * r0', 'p0 + r0')} AS f0, {_sdiv('2 * p1 * r1', 'p1 + r1')} AS f1 FROM pr)"]
sql("class_report", with_ctes(
    "SELECT '0' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM pr2 "
    "UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM pr2 "
    "UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 6), n FROM pr2 "
    "UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM pr2 "
    f"UNION ALL SELECT 'weighted avg', round({_sdiv('p0 * s0 + p1 * s1', 'n')}, 6), round({_sdiv('r0 * s0 + r1 * s1', 'n')}, 6), "
    f"round({_sdiv('f0 * s0 + f1 * s1', 'n')}, 6), n FROM pr2", _cr))

_roc_sel = ("SELECT round(threshold, 6) AS threshold, round(fps / N, 6) AS fpr, round(tps / P, 6) AS tpr FROM ("
            "SELECT 'inf'::DOUBLE AS threshold, 0 AS tps, 0 AS fps UNION ALL "
            "SELECT score, tps, fps FROM rt {where}) pts, tot")
sql("roc_points", with_ctes(_roc_sel.format(
    where="WHERE tps + fps = pos + neg OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"), _CURVE))
sql("roc_points_all", with_ctes(_roc_sel.format(where=""), _CURVE))
sql("pr_points", with_ctes(
    "SELECT round(score, 6) AS threshold, round(tps / (tps + fps), 6) AS precision, "
    "round(CASE WHEN P > 0 THEN tps / P ELSE 1e0 END, 6) AS recall FROM rt, tot "
    "UNION ALL SELECT NULL, 1e0, 0e0", _CURVE))

_ts = [float(x) for x in __import__("numpy").arange(0.1, 1.0, 0.1)]
_tv = ", ".join(f"({d(round(t, 1))}, {d(t)})" for t in _ts)
sql("impact_sweep", with_ctes(
    "SELECT label AS threshold, c AS leads_contatados, CAST(m AS BIGINT) AS matriculas_esperadas, "
    "round(CASE WHEN c > 0 THEN m / c ELSE 0e0 END, 6) AS taxa_conversao_grupo, "
    "round(CASE WHEN total > 0 THEN c / total ELSE 0e0 END, 6) AS esforco_relativo, "
    "CAST(trunc(c * CASE WHEN total > 0 THEN 1200e0 / total ELSE 0e0 END) AS BIGINT) AS leads_mensal_projetado, "
    "CAST(trunc(m * CASE WHEN total > 0 THEN 1200e0 / total ELSE 0e0 END) AS BIGINT) AS matriculas_mensal_projetado "
    f"FROM (SELECT t.label, COUNT(*) FILTER (WHERE s.score >= t.t) AS c, "
    "COALESCE(SUM(CASE WHEN s.score >= t.t THEN s.converteu ELSE 0 END), 0) AS m, COUNT(*) AS total "
    f"FROM (VALUES {_tv}) t(label, t) CROSS JOIN scored s GROUP BY t.label) x"))


def density_sql(value: str, bins: int, src: str = "scored", label: str = "converteu") -> list[str]:
    """CTEs dens_* computing the per-class density histogram; select from dens_out."""
    return [
        f"dens_d AS (SELECT {label} AS label, CAST({value} AS DOUBLE) AS x FROM {src} WHERE {value} IS NOT NULL)",
        "dens_r0 AS (SELECT label, MIN(x) AS mn, MAX(x) AS mx, COUNT(*) AS n FROM dens_d GROUP BY label)",
        "dens_r AS (SELECT label, n, CASE WHEN mn = mx THEN mn - 5e-1 ELSE mn END AS lo, "
        "CASE WHEN mn = mx THEN mx + 5e-1 ELSE mx END AS hi FROM dens_r0)",
        f"dens_c AS (SELECT d.label, least(CAST(floor((d.x - r.lo) * ({bins} / (r.hi - r.lo))) AS INTEGER), {bins - 1}) AS bin, "
        "COUNT(*) AS cnt FROM dens_d d JOIN dens_r r ON d.label = r.label GROUP BY 1, 2)",
        f"dens_g AS (SELECT label, n, lo, hi, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM dens_r)",
        f"dens_out AS (SELECT g.label, g.bin, g.lo + g.bin * ((g.hi - g.lo) / {bins}) AS bin_lo, "
        f"g.lo + (g.bin + 1) * ((g.hi - g.lo) / {bins}) AS bin_hi, CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count, "
        f"COALESCE(c.cnt, 0) / (g.n * (g.hi - g.lo) / {bins}) AS density "
        "FROM dens_g g LEFT JOIN dens_c c ON g.label = c.label AND g.bin = c.bin)",
    ]


sql("density_by_class", with_ctes(
    "SELECT label, bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, count, round(density, 6) AS density "
    "FROM dens_out", density_sql("score", 40)))

# ---------------------------------------------------------------- exploratory profile
_NUM = ["lead_id", "dias_sem_contato", "n_tentativas", "respondeu_contato", "renda_estimada", "converteu"]
sql("shape", with_ctes(f"SELECT COUNT(*) AS n_rows, {len(S.LEADS_SCHEMA.fields)} AS n_cols FROM leads"))
sql("describe", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column, COUNT({c}) AS count, round(AVG({c}), 6) AS mean, round(STDDEV_SAMP({c}), 6) AS std, "
    f"round(CAST(MIN({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, "
    f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, "
    f"round(CAST(MAX({c}) AS DOUBLE), 6) AS max FROM leads" for c in _NUM)))
sql("target_rate", with_ctes(
    "SELECT n, converted, n - converted AS not_converted, round(rate, 6) AS rate, "
    "round(CASE WHEN converted > 0 THEN (n - converted) / converted END, 6) AS imbalance, round(rr, 6) AS response_rate "
    "FROM (SELECT COUNT(*) AS n, CAST(SUM(converteu) AS BIGINT) AS converted, AVG(converteu) AS rate, "
    "AVG(respondeu_contato) AS rr FROM leads) t"))
sql("null_profile", with_ctes("SELECT \"column\", nulls, round(nulls / n * 100, 6) AS pct FROM (" + " UNION ALL ".join(
    f"SELECT '{f.name}' AS column, COUNT(*) FILTER (WHERE {f.name} IS NULL) AS nulls, COUNT(*) AS n FROM leads"
    for f in S.LEADS_SCHEMA.fields) + ") t WHERE nulls > 0"))
sql("missing_effect", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(AVG(converteu) FILTER (WHERE {c} IS NOT NULL) * 100, 6) AS rate_with, "
    f"round(AVG(converteu) FILTER (WHERE {c} IS NULL) * 100, 6) AS rate_without FROM leads "
    f"HAVING COUNT(*) FILTER (WHERE {c} IS NULL) > 0" for c in ["renda_estimada", "faixa_etaria", "turno_preferencia"])))


def _conv_sql(key: str, nulls: bool = False) -> str:
    return with_ctes(
        f"SELECT {key}, total, converted, round(rate, 6) AS rate, round(rate * 100, 6) AS rate_pct, "
        "repeat('█', CAST(trunc(round(rate * 100, 1)) AS INTEGER)) AS bar FROM ("
        f"SELECT {key}, COUNT(converteu) AS total, CAST(SUM(converteu) AS BIGINT) AS converted, AVG(converteu) AS rate "
        f"FROM leads WHERE {key} IS NOT NULL GROUP BY {key}) t", nulls=nulls)


sql("conv_channel", _conv_sql("canal_captacao"))
sql("conv_channel_nulls", _conv_sql("canal_captacao", nulls=True))
sql("conv_attempts_nulls", _conv_sql("n_tentativas", nulls=True))
sql("conv_course", _conv_sql("curso_interesse"))
sql("conv_attempts", _conv_sql("n_tentativas"))
sql("conv_age", _conv_sql("faixa_etaria"))
sql("conv_shift", _conv_sql("turno_preferencia"))


def _vc_sql(key: str) -> str:
    return with_ctes(f"SELECT {key}, count, round(count / SUM(count) OVER (), 6) AS share FROM ("
                     f"SELECT {key}, COUNT(*) AS count FROM leads WHERE {key} IS NOT NULL GROUP BY {key}) t")


sql("value_counts_target", _vc_sql("converteu"))
sql("value_counts_channel", _vc_sql("canal_captacao"))

_band = "CASE " + " ".join(
    f"WHEN dias_sem_contato > {S.DAYS_BAND_EDGES[i]} AND dias_sem_contato <= {S.DAYS_BAND_EDGES[i + 1]} THEN {q(lbl)}"
    for i, lbl in enumerate(S.DAYS_BAND_LABELS)) + " END"
sql("days_bands", with_ctes(
    f"SELECT faixa_dias, COUNT(*) AS total, round(AVG(converteu) * 100, 6) AS rate_pct FROM "
    f"(SELECT {_band} AS faixa_dias, converteu FROM leads) t WHERE faixa_dias IS NOT NULL GROUP BY faixa_dias"))


def _box_sql(col: str) -> str:
    return with_ctes(
        "SELECT b.label, w.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
        "round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi, outliers "
        "FROM bq b JOIN (SELECT s.label, MIN(v) FILTER (WHERE v >= lo_f AND v <= hi_f) AS whisker_lo, "
        "MAX(v) FILTER (WHERE v >= lo_f AND v <= hi_f) AS whisker_hi, "
        "COUNT(*) FILTER (WHERE NOT (v >= lo_f AND v <= hi_f)) AS outliers, COUNT(*) AS n "
        "FROM bs s JOIN bq ON s.label = bq.label GROUP BY s.label) w ON b.label = w.label",
        [f"bs AS (SELECT converteu AS label, CAST({col} AS DOUBLE) AS v FROM leads WHERE {col} IS NOT NULL)",
         "bq0 AS (SELECT label, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, "
         "quantile_cont(v, 0.75) AS q3 FROM bs GROUP BY label)",
         "bq AS (SELECT *, q1 - 15e-1 * (q3 - q1) AS lo_f, q3 + 15e-1 * (q3 - q1) AS hi_f FROM bq0)"])


sql("box_days", _box_sql("dias_sem_contato"))
sql("box_income", _box_sql("renda_estimada"))
_dens_sel = ("SELECT label, bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, count, "
             "round(density, 6) AS density FROM dens_out")
sql("hist_days", with_ctes(_dens_sel, density_sql("dias_sem_contato", 30, src="leads")))
sql("hist_income", with_ctes(_dens_sel, density_sql("renda_estimada", 40, src="leads")))
sql("group_means", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(m1, 6) AS mean_converted, round(m0, 6) AS mean_not_converted, "
    f"round(m0 - m1, 6) AS difference FROM (SELECT AVG({c}) FILTER (WHERE converteu = 1) AS m1, "
    f"AVG({c}) FILTER (WHERE converteu = 0) AS m0 FROM leads) t" for c in ["dias_sem_contato", "renda_estimada"])))
_pairs = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]
sql("corr_matrix", with_ctes(" UNION ALL ".join(
    [f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS corr FROM leads" for a, b in _pairs]
    + [f"SELECT '{b}', '{a}', round(corr({a}, {b}), 6) FROM leads" for a, b in _pairs]
    + [f"SELECT '{c}', '{c}', 1e0" for c in _NUM])))
sql("corr_target", with_ctes(
    "SELECT variable, round(c, 6) AS corr, round(abs(c), 6) AS abs_corr, CASE WHEN c > 0 THEN '+' ELSE '-' END AS sign "
    "FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, corr({c}, converteu) AS c FROM leads"
                                  for c in _NUM if c != "converteu") + ") t ORDER BY abs(c) DESC"))
sql("crosstab_age", with_ctes(
    "SELECT faixa_etaria, COUNT(*) FILTER (WHERE converteu = 0) AS n_0, COUNT(*) FILTER (WHERE converteu = 1) AS n_1 "
    "FROM leads WHERE faixa_etaria IS NOT NULL GROUP BY faixa_etaria"))
sql("numeric_summary", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(AVG({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, "
    f"round(CAST(MIN({c}) AS DOUBLE), 6) AS min, round(CAST(MAX({c}) AS DOUBLE), 6) AS max FROM leads"
    for c in ["dias_sem_contato", "n_tentativas", "renda_estimada"])))

# ---------------------------------------------------------------- management view
sql("kpis", with_ctes(
    "SELECT total_leads, round(media_score, 6) AS media_score, leads_alto, "
    "round(CASE WHEN total_leads > 0 THEN leads_alto / total_leads * 100 ELSE 0e0 END, 6) AS pct_alto FROM ("
    f"SELECT COUNT(*) AS total_leads, AVG(score) AS media_score, COUNT(*) FILTER (WHERE classificacao = {q(S.CLASS_HIGH)}) "
    "AS leads_alto FROM scored) t"))
sql("score_hist", with_ctes(
    "SELECT bin, round(bin * 5e-2, 6) AS bin_lo, COUNT(*) AS count FROM (SELECT least(CAST(floor(score / 5e-2) AS INTEGER), 19) "
    "AS bin FROM scored WHERE score IS NOT NULL) t GROUP BY bin"))
for _name, _key, _nulls in [("by_channel", "canal_captacao", False), ("by_course", "curso_interesse", False),
                            ("by_channel_nulls", "canal_captacao", True)]:
    sql(_name, with_ctes(f"SELECT {_key}, round(AVG(score), 6) AS score_medio, COUNT(score) AS quantidade "
                         f"FROM scored WHERE {_key} IS NOT NULL GROUP BY {_key}", nulls=_nulls))
sql("class_counts", with_ctes(
    "SELECT classificacao, count, round(count / SUM(count) OVER (), 6) AS share FROM (SELECT classificacao, COUNT(*) AS count "
    "FROM scored WHERE classificacao IS NOT NULL GROUP BY classificacao) t"))


def _focus_sql(where: str = "") -> str:
    pct = "CASE WHEN n > 0 THEN leads_foco / n * 100 ELSE 0e0 END"
    return with_ctes(
        f"SELECT leads_foco, round({pct}, 6) AS pct_foco, round(100e0 - ({pct}), 6) AS esforco_poupado, "
        "round(score_medio_foco, 6) AS score_medio_foco FROM ("
        f"SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE classificacao = {q(S.CLASS_HIGH)}) AS leads_foco, "
        f"AVG(score) FILTER (WHERE classificacao = {q(S.CLASS_HIGH)}) AS score_medio_foco FROM scored {where}) t")


sql("focus_impact", _focus_sql())
sql("focus_impact_channel", _focus_sql(f"WHERE canal_captacao = {q('Indicação')} AND score BETWEEN 0e0 AND 1e0"))
for _name, _key, _nulls in [("best_channel", "canal_captacao", False), ("best_course", "curso_interesse", False),
                            ("best_channel_nulls", "canal_captacao", True)]:
    sql(_name, with_ctes(f"SELECT {_key}, round(AVG(score), 6) AS score_medio FROM scored WHERE {_key} IS NOT NULL "
                         f"GROUP BY {_key} ORDER BY AVG(score) DESC, {_key} LIMIT 1", nulls=_nulls))
for _name, _nulls in (("response_rate", False), ("response_rate_nulls", True)):
    sql(_name, with_ctes("SELECT round(SUM(respondeu_contato) / COUNT(*) * 100, 6) AS pct_resposta FROM scored", nulls=_nulls))
_label = ("nome_ficticio || ' — Score: ' || printf('%.0f', score * 100) || '% (' || COALESCE(classificacao, 'nan') || ')'")
sql("selector_labels", with_ctes(
    f"SELECT label, lead_id FROM (SELECT {_label} AS label, lead_id, ROW_NUMBER() OVER (PARTITION BY {_label} "
    "ORDER BY score ASC, lead_id DESC) AS rn FROM scored) t WHERE rn = 1"))
sql("display_table", with_ctes(
    "SELECT lead_id AS \"ID\", nome_ficticio AS \"Nome\", canal_captacao AS \"Canal\", curso_interesse AS \"Curso\", "
    "dias_sem_contato AS \"Dias s/ Contato\", n_tentativas AS \"Tentativas\", "
    "CASE WHEN respondeu_contato = 1 THEN '✅' ELSE '❌' END AS \"Respondeu\", "
    "printf('%.1f', score * 100) || '%' AS \"Score\", classificacao AS \"Classificação\" FROM scored ORDER BY score DESC, lead_id"))

# ---------------------------------------------------------------- split, class balance, preprocessing
SPLIT_CTES = [
    "cc AS (SELECT converteu AS label, COUNT(*) AS n_c FROM feat GROUP BY converteu)",
    "tt AS (SELECT SUM(n_c) AS n, CAST(ceil(2e-1 * SUM(n_c)) AS BIGINT) AS n_test FROM cc)",
    "al AS (SELECT label, n_c, (n_c * (n - n_test)) // n AS fl, (n_c * (n - n_test)) % n AS rem, "
    "n - n_test AS n_train FROM cc, tt)",
    "al2 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rem DESC, label) AS rk, n_train - SUM(fl) OVER () AS need FROM al)",
    "alloc AS (SELECT label, n_c - (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS test_c FROM al2)",
    "rnk AS (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY converteu ORDER BY md5(CAST(lead_id AS VARCHAR) || '|42'), "
    "lead_id) AS r FROM feat f)",
    "splitted AS (SELECT rnk.*, CASE WHEN r <= test_c THEN 'test' ELSE 'train' END AS split FROM rnk "
    "JOIN alloc ON rnk.converteu = alloc.label)",
    "train AS (SELECT * FROM splitted WHERE split = 'train')",
]
sql("strat_split", with_ctes("SELECT lead_id, converteu, split FROM splitted", SPLIT_CTES))
sql("split_sizes", with_ctes("SELECT split, converteu, COUNT(*) AS n FROM splitted GROUP BY split, converteu", SPLIT_CTES))
sql("class_weights", with_ctes(
    "SELECT converteu, n_c, round(SUM(n_c) OVER () / (COUNT(*) OVER () * n_c), 6) AS weight FROM "
    "(SELECT converteu, COUNT(*) AS n_c FROM train GROUP BY converteu) t", SPLIT_CTES))
sql("pos_ratio", with_ctes(
    "SELECT neg, pos, round(neg / CASE WHEN pos > 0 THEN pos ELSE 1 END, 6) AS scale_pos_weight FROM "
    "(SELECT COUNT(*) FILTER (WHERE converteu = 0) AS neg, COUNT(*) FILTER (WHERE converteu = 1) AS pos FROM train) t",
    SPLIT_CTES))

_STATS = ("stats AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS med_{c}" for c in S.NUMERIC_COLS) + " FROM train)")
_STATS2 = ("stats2 AS (SELECT " + ", ".join(
    f"AVG(COALESCE(CAST({c} AS DOUBLE), med_{c})) AS mean_{c}, "
    f"CASE WHEN stddev_pop(COALESCE(CAST({c} AS DOUBLE), med_{c})) = 0 THEN 1e0 "
    f"ELSE stddev_pop(COALESCE(CAST({c} AS DOUBLE), med_{c})) END AS std_{c}" for c in S.NUMERIC_COLS)
    + " FROM train, stats GROUP BY ALL)")
sql("impute_median", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(med_{c}, 6) AS median FROM stats" for c in S.NUMERIC_COLS), SPLIT_CTES + [_STATS]))
sql("standardise", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(mean_{c}, 6) AS mean, round(std_{c}, 6) AS std FROM stats2" for c in S.NUMERIC_COLS),
    SPLIT_CTES + [_STATS, _STATS2]))
_MODES = ("modes_long AS (SELECT \"column\", value FROM (SELECT \"column\", value, ROW_NUMBER() OVER (PARTITION BY \"column\" "
          "ORDER BY n DESC, value) AS rn FROM (" + " UNION ALL ".join(
              f"SELECT '{c}' AS column, {c} AS value, COUNT(*) AS n FROM train WHERE {c} IS NOT NULL GROUP BY {c}"
              for c in S.CATEGORICAL_COLS) + ") v) w WHERE rn = 1)")
sql("impute_mode", with_ctes("SELECT \"column\", value AS mode FROM modes_long", SPLIT_CTES + [_MODES]))
_MODES_WIDE = ("modes AS (SELECT " + ", ".join(
    f"MAX(value) FILTER (WHERE \"column\" = '{c}') AS mode_{c}" for c in S.CATEGORICAL_COLS) + " FROM modes_long)")
_CATS = {"canal_captacao": sorted(S.CHANNELS), "curso_interesse": sorted(S.COURSES),
         "faixa_etaria": sorted(S.AGE_BANDS), "turno_preferencia": sorted(S.SHIFTS)}


def _onehot_cols() -> list[str]:
    out = []
    for c in S.CATEGORICAL_COLS:
        for v in _CATS[c]:
            out.append(f"CASE WHEN COALESCE({c}, mode_{c}) = {q(v)} THEN 1e0 ELSE 0e0 END AS \"categoricas__{c}_{v}\"")
    return out


sql("one_hot", with_ctes("SELECT lead_id, " + ", ".join(_onehot_cols()) + " FROM splitted, modes",
                         SPLIT_CTES + [_MODES, _MODES_WIDE]))
sql("transform", with_ctes(
    "SELECT lead_id, " + ", ".join(
        [f"round((COALESCE(CAST({c} AS DOUBLE), med_{c}) - mean_{c}) / std_{c}, 6) AS \"numericas__{c}\""
         for c in S.NUMERIC_COLS] + _onehot_cols()
        + [f"CAST({c} AS DOUBLE) AS \"binarias__{c}\"" for c in S.BINARY_COLS])
    + " FROM splitted, stats, stats2, modes", SPLIT_CTES + [_STATS, _STATS2, _MODES, _MODES_WIDE]))

# ---------------------------------------------------------------- additive explanations of the scorecard
_TERMS = {
    "canal_captacao": case_map("canal_captacao", S.SCORECARD_CHANNEL),
    "respondeu_contato": f"CAST(respondeu_contato * {d(S.SCORECARD_RESPONDED)} AS DOUBLE)",
    "dias_sem_contato": f"-({d(S.SCORECARD_DAYS)} * dias_sem_contato)",
    "n_tentativas": f"({d(S.SCORECARD_ATTEMPTS_CURVE)} * ((n_tentativas - 2) * (n_tentativas - 2)) + {d(S.SCORECARD_ATTEMPTS_BONUS)})",
    "curso_interesse": case_map("curso_interesse", S.SCORECARD_COURSE),
}
_EXPL = [
    "bg AS (SELECT * FROM leads ORDER BY lead_id LIMIT 100)",
    "bgm AS (SELECT " + ", ".join(f"AVG({t}) AS m_{n}" for n, t in _TERMS.items()) + " FROM bg)",
    "att AS (SELECT lead_id, " + ", ".join(f"{t} - m_{n} AS shap_{n}" for n, t in _TERMS.items()) + " FROM leads, bgm)",
    "att_long AS (" + " UNION ALL ".join(
        f"SELECT lead_id, {i} AS slot, '{n}' AS feature, shap_{n} AS impact FROM att" for i, n in enumerate(_TERMS)) + ")",
    "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lead_id ORDER BY abs(impact) DESC NULLS LAST, slot) AS rn FROM att_long)",
]
_dir = f"CASE WHEN impact IS NULL THEN NULL WHEN impact > 0 THEN {q('favorece conversão')} ELSE {q('desfavorece')} END"
_TOP3 = ("SELECT lead_id, " + ", ".join(
    f"MAX(feature) FILTER (WHERE rn = {i}) AS top{i}_feature, round(MAX(impact) FILTER (WHERE rn = {i}), 6) AS top{i}_impact, "
    f"MAX({_dir}) FILTER (WHERE rn = {i}) AS top{i}_direction" for i in (1, 2, 3)) + " FROM ranked GROUP BY lead_id")
sql("linear_shap_top3", with_ctes(_TOP3, _EXPL))
sql("linear_shap_top3_nulls", with_ctes(_TOP3, _EXPL, nulls=True))
sql("shap_long", with_ctes("SELECT lead_id, slot, feature, round(impact, 6) AS impact FROM att_long", _EXPL))
sql("shap_sum", with_ctes("SELECT lead_id, round(" + " + ".join(f"shap_{n}" for n in _TERMS) + ", 6) AS shap_sum FROM att",
                          _EXPL))
sql("top_feature", with_ctes("SELECT lead_id, feature AS top_feature FROM ranked WHERE rn = 1", _EXPL))
sql("global_importance", with_ctes(
    "SELECT feature, round(AVG(abs(impact)), 6) AS mean_abs_impact FROM att_long GROUP BY feature "
    "ORDER BY AVG(abs(impact)) DESC, feature LIMIT 10", _EXPL))



# ---------------------------------------------------------------- messages (built from leadlens.functions.text)
def _fill_sql(template: str, vals: dict) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                out.append(q(p).replace("\n", "' || chr(10) || '"))
        else:
            out.append(vals[p])
    return "(" + " || ".join(out) + ")"


def script_sql(p: str = "") -> str:
    """SQL twin of ``text.fallback_script`` (column prefix ``p``)."""
    tok = f"regexp_extract(COALESCE({p}nome_ficticio, ''), '^\\s*(\\S+)', 1)"
    vals = {"nome": f"(CASE WHEN {tok} = '' THEN {q(S.DEFAULT_NAME)} ELSE {tok} END)",
            "curso": f"COALESCE({p}curso_interesse, {q(TX.FALLBACK_COURSE)})"}
    ref = f"{p}canal_captacao IS NOT DISTINCT FROM {q(S.CHANNEL_REFERRAL)}"
    retry = f"COALESCE({p}n_tentativas, 0) > {TX.RETRY_ATTEMPTS}"

    def pick(a, b, c):
        return (f"CASE WHEN {ref} THEN {_fill_sql(a, vals)} WHEN {retry} THEN {_fill_sql(b, vals)} "
                f"ELSE {_fill_sql(c, vals)} END")

    intro = pick(TX.REFERRAL_INTRO, TX.RETRY_INTRO, TX.DEFAULT_INTRO)
    body = pick(TX.REFERRAL_BODY, TX.RETRY_BODY, TX.DEFAULT_BODY)
    return f"(({intro}) || chr(10) || ({body}) || chr(10) || {q(TX.CLOSING)})"


def prompt_sql() -> str:
    dft = TX.PROMPT_DEFAULTS
    vals = {"nome": f"COALESCE(nome_ficticio, {q(dft['nome'])})",
            "curso_interesse": f"COALESCE(curso_interesse, {q(dft['curso_interesse'])})",
            "canal_captacao": f"COALESCE(canal_captacao, {q(dft['canal_captacao'])})",
            "dias_sem_contato": f"COALESCE(CAST(dias_sem_contato AS VARCHAR), {q(dft['dias_sem_contato'])})",
            "n_tentativas": f"COALESCE(CAST(n_tentativas AS VARCHAR), {q(dft['n_tentativas'])})",
            "score": "(printf('%.0f', COALESCE(score, 0e0) * 100e0) || '%')",
            "shap_top_features": f"COALESCE(shap_text, {q(TX.NO_EXPLANATION)})"}
    return _fill_sql(TX.PROMPT_TEMPLATE, vals)


_TEXT = ["shap_txt AS (SELECT lead_id, string_agg(feature || ' (' || printf('%.2f', abs(impact)) || ')', ', ' ORDER BY rn) "
         "AS shap_text FROM ranked WHERE rn <= 3 GROUP BY lead_id)",
         "sx AS (SELECT s.*, t.shap_text FROM scored s JOIN shap_txt t ON s.lead_id = t.lead_id)"]
sql("shap_text", with_ctes("SELECT lead_id, shap_text FROM sx", _EXPL + _TEXT))
sql("prompt", with_ctes(f"SELECT lead_id, {prompt_sql()} AS prompt FROM sx", _EXPL + _TEXT))
sql("fallback_script", with_ctes(f"SELECT lead_id, {script_sql()} AS script, 'fallback' AS fonte FROM scored"))
sql("script_table", with_ctes(
    "SELECT r.lead_id, CASE WHEN s.lead_id IS NULL THEN 0 ELSE 1 END AS found, s.nome_ficticio AS nome, "
    f"round(s.score, 6) AS score, CASE WHEN s.lead_id IS NOT NULL THEN {script_sql('s.')} END AS script, "
    "CASE WHEN s.lead_id IS NOT NULL THEN 'fallback' END AS fonte "
    "FROM (SELECT DISTINCT o_orderkey * 2 + 1 AS lead_id FROM orders) r LEFT JOIN scored s ON r.lead_id = s.lead_id"))

# ---------------------------------------------------------------- streaming scoring (same result as batch, left-closed bands)
sql("stream_score", with_ctes(f"SELECT lead_id, round(score, 6) AS score, {band_left_sql()} AS classificacao FROM scored0"))

_KEPT = [
    "latest AS (SELECT * REPLACE (CAST(n_tentativas + CASE WHEN lead_id % 5 = 0 THEN 1 WHEN lead_id % 11 = 0 THEN 2 ELSE 0 END AS INTEGER) "
    "AS n_tentativas, CASE WHEN lead_id % 5 = 0 THEN 1 - respondeu_contato ELSE respondeu_contato END AS respondeu_contato), "
    "CASE WHEN lead_id % 5 = 0 THEN 3 WHEN lead_id % 11 = 0 THEN 2 ELSE 1 END AS event_day FROM leads)",
    f"latest_s AS (SELECT *, {sigmoid_sql(log_odds_sql())} AS score FROM latest)",
    f"kept AS (SELECT *, {band_right_sql()} AS classificacao FROM latest_s)"]
sql("kept_list", with_ctes("SELECT lead_id, n_tentativas, respondeu_contato, event_day, round(score, 6) AS score, classificacao FROM kept", _KEPT))
_hi = f"COUNT(*) FILTER (WHERE classificacao = {q(S.CLASS_HIGH)})"
_pct = f"CASE WHEN COUNT(*) > 0 THEN {_hi} / COUNT(*) * 100 ELSE 0e0 END"
_heads = [("mean_score", "COUNT(*)", "AVG(score)"), ("focus_share", _hi, _pct), ("effort_saved", f"COUNT(*) - {_hi}", f"100e0 - ({_pct})"),
          ("focus_mean_score", _hi, f"AVG(score) FILTER (WHERE classificacao = {q(S.CLASS_HIGH)})"),
          ("response_rate", "COUNT(*)", "SUM(respondeu_contato) / COUNT(*) * 100")]
_cards = [f"SELECT '{n}' AS card, CAST(NULL AS VARCHAR) AS key, {c} AS leads, {v} AS value FROM kept" for n, c, v in _heads]
for _c, _k in (("channel", "canal_captacao"), ("course", "curso_interesse")):
    _mean = f"AS card, {_k} AS key, COUNT(*) AS leads, AVG(score) AS value FROM kept WHERE {_k} IS NOT NULL GROUP BY {_k}"
    _cards += [f"SELECT 'by_{_c}' {_mean}", f"(SELECT 'best_{_c}' {_mean} ORDER BY AVG(score) DESC, {_k} LIMIT 1)"]
for _c, _k in (("class", "classificacao"), ("score_bin", "CAST(least(CAST(floor(score * 20) AS INTEGER), 19) AS VARCHAR)")):
    _cards.append(f"SELECT '{_c}' AS card, key, leads, leads / SUM(leads) OVER () AS value FROM (SELECT {_k} AS key, COUNT(*) AS leads "
                  f"FROM kept WHERE {_k} IS NOT NULL GROUP BY 1) t")
sql("kept_cards", with_ctes("SELECT card, key, leads, round(value, 6) AS value FROM (" + " UNION ALL ".join(_cards) + ") t", _KEPT))

# ---------------------------------------------------------------- scoring new leads, explained list
_valid = "(" + " AND ".join(
    [f"{c} IS NOT NULL" for c in ["canal_captacao", "curso_interesse", "dias_sem_contato", "n_tentativas",
                                  "respondeu_contato"]]
    + ["dias_sem_contato >= 0", "n_tentativas >= 0", "respondeu_contato BETWEEN 0 AND 1"]) + ")"
_NEW = [
    "bg AS (SELECT * FROM lead_lab ORDER BY lead_id LIMIT 100)",
    "bgm AS (SELECT " + ", ".join(f"AVG({t}) AS m_{n}" for n, t in _TERMS.items()) + " FROM bg)",
    f"nv AS (SELECT *, CASE WHEN {_valid} THEN 1 ELSE 0 END AS is_valid, concat_ws(',', {_reasons}) AS reasons FROM leads)",
    "att AS (SELECT lead_id, " + ", ".join(f"{t} - m_{n} AS shap_{n}" for n, t in _TERMS.items()) + " FROM nv, bgm WHERE is_valid = 1)",
    "att_long AS (" + " UNION ALL ".join(
        f"SELECT lead_id, {i} AS slot, '{n}' AS feature, shap_{n} AS impact FROM att" for i, n in enumerate(_TERMS)) + ")",
    "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lead_id ORDER BY abs(impact) DESC, slot) AS rn FROM att_long)",
    "top AS (SELECT lead_id, " + ", ".join(
        f"MAX(feature) FILTER (WHERE rn = {i}) AS top{i}_feature, round(MAX(impact) FILTER (WHERE rn = {i}), 6) AS top{i}_impact, "
        f"MAX({_dir}) FILTER (WHERE rn = {i}) AS top{i}_direction" for i in (1, 2, 3)) + " FROM ranked GROUP BY lead_id)",
]
sql("score_new_leads", with_ctes(
    f"SELECT nv.lead_id, is_valid, reasons, CASE WHEN is_valid = 1 THEN round({sigmoid_sql(log_odds_sql())}, 6) END AS score, "
    f"CASE WHEN is_valid = 1 THEN {band_left_sql(sigmoid_sql(log_odds_sql()))} END AS classificacao, "
    + ", ".join(f"top{i}_feature, top{i}_impact, top{i}_direction" for i in (1, 2, 3))
    + " FROM nv LEFT JOIN top ON nv.lead_id = top.lead_id", _NEW, dirty=True))
sql("list_explained", with_ctes(
    f"SELECT {_LIST}, " + ", ".join(
        f"MAX(feature) FILTER (WHERE rn = {i}) AS top{i}_feature, round(MAX(impact) FILTER (WHERE rn = {i}), 6) AS top{i}_impact, "
        f"MAX({_dir}) FILTER (WHERE rn = {i}) AS top{i}_direction" for i in (1, 2, 3))
    + f" FROM scored JOIN ranked USING (lead_id) WHERE canal_captacao = {q('Indicação')} AND score BETWEEN {d(0.1)} AND 1e0 "
    "GROUP BY ALL", _EXPL))

sql("default_score", with_ctes(f"SELECT lead_id, 5e-1 AS score, {q(S.CLASS_MID)} AS classificacao FROM leads"))
sql("preview", with_ctes(f"SELECT {LEAD_COLS} FROM leads ORDER BY lead_id LIMIT 5"))


_bd, _bi = ORACLE["box_days"], ORACLE["box_income"]
sql("box_stats", f"SELECT *, 'dias_sem_contato' AS \"column\" FROM ({_bd}) a "
                 f"UNION ALL SELECT *, 'renda_estimada' AS \"column\" FROM ({_bi}) b")
sql("hist_class", f"SELECT *, 'dias_sem_contato' AS \"column\" FROM ({ORACLE['hist_days']}) a "
                  f"UNION ALL SELECT *, 'renda_estimada' AS \"column\" FROM ({ORACLE['hist_income']}) b")

# ---------------------------------------------------------------- exact Shapley values of the scorecard probability
_NAMES = list(_TERMS)


def _shapley_sql() -> str:
    d_ = len(_NAMES)
    weight = [math.factorial(s) * math.factorial(d_ - s - 1) / math.factorial(d_) for s in range(d_)]
    total = lambda m: " + ".join([d(S.SCORECARD_INTERCEPT)] + [f"{'x' if m >> j & 1 else 'b'}.t{j}" for j in range(d_)])
    v = ", ".join(f"AVG({sigmoid_sql(total(m))}) AS v{m}" for m in range(1 << d_))
    terms = ", ".join(f"{t} AS t{j}" for j, t in enumerate(_TERMS.values()))
    phi = " UNION ALL ".join(
        f"SELECT lead_id, '{n}' AS feature, round(" + " + ".join(
            f"{d(weight[m.bit_count()])} * (v{m | 1 << j} - v{m})" for m in range(1 << d_) if not m >> j & 1)
        + ", 6) AS impact FROM v" for j, n in enumerate(_NAMES))
    return with_ctes(phi, [
        f"b AS (SELECT {terms} FROM (SELECT * FROM leads ORDER BY lead_id LIMIT 100) l)",
        f"x AS (SELECT lead_id, {terms} FROM leads)",
        f"v AS (SELECT x.lead_id, {v} FROM x CROSS JOIN b GROUP BY x.lead_id)"])


sql("permutation_shap", _shapley_sql())

# ---------------------------------------------------------------- a linear model of fixed coefficients over the slots
_SLOTS = ([(f"numericas__{c}", f"(COALESCE(CAST({c} AS DOUBLE), med_{c}) - mean_{c}) / std_{c}") for c in S.NUMERIC_COLS]
          + [(f"categoricas__{c}_{v}", f"CASE WHEN COALESCE({c}, mode_{c}) = {q(v)} THEN 1e0 ELSE 0e0 END")
             for c in S.CATEGORICAL_COLS for v in _CATS[c]]
          + [(f"binarias__{c}", f"CAST({c} AS DOUBLE)") for c in S.BINARY_COLS])
_COEF = [(i * 7 % 11 - 5) / 10 for i in range(len(_SLOTS))]
_FIXED = SPLIT_CTES + [_STATS, _STATS2, _MODES, _MODES_WIDE,
    "slots AS (SELECT lead_id, converteu, split, dias_sem_contato, " + ", ".join(f"{e} AS s{i}" for i, (_, e) in enumerate(_SLOTS))
    + " FROM splitted, stats, stats2, modes)",
    "fixed AS (SELECT *, " + "(" * len(_COEF) + d(-1.0) + "".join(f" + {d(b)} * s{i})" for i, b in enumerate(_COEF)) + " AS z FROM slots)"]
sql("fixed_model_score", with_ctes(
    f"SELECT lead_id, split, round({sigmoid_sql('z')}, 6) AS score, {band_right_sql(sigmoid_sql('z'))} AS classificacao FROM fixed", _FIXED))
_FIXED_SHAP = _FIXED + [
    "fm AS (SELECT " + ", ".join(f"AVG({d(b)} * s{i}) AS m{i}" for i, b in enumerate(_COEF))
    + " FROM (SELECT * FROM slots ORDER BY lead_id LIMIT 100) t)",
    "att_long AS (" + " UNION ALL ".join(f"SELECT lead_id, {i} AS slot, {q(n)} AS feature, {d(b)} * s{i} - m{i} AS impact FROM slots, fm"
                                         for i, ((n, _), b) in enumerate(zip(_SLOTS, _COEF))) + ")",
    "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lead_id ORDER BY abs(round(impact, 9)) DESC NULLS LAST, slot) AS rn FROM att_long)"]
sql("fixed_model_shap_top3", with_ctes(_TOP3, _FIXED_SHAP))


def _auc_ap_sql(name: str, key: str) -> str:
    return (f"SELECT '{name}' AS model, (SUM(pos) * SUM(neg) - SUM(pos * (fps - 5e-1 * neg))) / (SUM(pos) * SUM(neg)) AS auc_roc, "
            "SUM(pos * (tps / (tps + fps))) / SUM(pos) AS avg_precision FROM (SELECT *, "
            "SUM(pos) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps, "
            "SUM(neg) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps FROM ("
            f"SELECT {key} AS k, SUM(f.converteu) AS pos, COUNT(*) - SUM(f.converteu) AS neg FROM fixed f "
            "JOIN scored00 c ON f.lead_id = c.lead_id WHERE f.split = 'test' GROUP BY 1) g) h")


# ---------------------------------------------------------------- rows that fail alone, broken payloads
_FAULTY = [
    "faulty AS (SELECT * REPLACE (CASE WHEN lead_id % 101 = 0 THEN 2000000000 ELSE n_tentativas END AS n_tentativas, "
    "CASE WHEN lead_id % 103 <> 0 THEN dias_sem_contato END AS dias_sem_contato) FROM leads)",
    "reasoned AS (SELECT *, concat_ws(',', CASE WHEN dias_sem_contato < 0 THEN 'negative_dias_sem_contato' END, "
    "CASE WHEN n_tentativas < 0 THEN 'negative_n_tentativas' END, "
    "CASE WHEN NOT (respondeu_contato BETWEEN 0 AND 1) THEN 'respondeu_contato_out_of_range' END) AS outside, "
    "concat_ws(',', CASE WHEN dias_sem_contato IS NULL THEN 'missing_dias_sem_contato' END, "
    "CASE WHEN CAST(n_tentativas - 2 AS BIGINT) * CAST(n_tentativas - 2 AS BIGINT) > 2147483647 THEN 'failed_n_tentativas' END) AS failed "
    "FROM faulty)",
    f"graded AS (SELECT lead_id, CASE WHEN outside <> '' THEN 'rejected' WHEN failed <> '' THEN 'degraded' ELSE 'scored' END AS status, "
    f"CASE WHEN outside <> '' THEN outside WHEN failed <> '' THEN failed END AS error, CASE WHEN outside <> '' THEN NULL "
    f"WHEN failed <> '' THEN 5e-1 ELSE {sigmoid_sql(log_odds_sql(att='CAST(n_tentativas AS BIGINT)'))} END AS score FROM reasoned)"]
sql("row_fallback", with_ctes(
    f"SELECT lead_id, status, error, round(score, 6) AS score, CASE WHEN status = 'degraded' THEN {q(S.CLASS_MID)} "
    f"ELSE {band_right_sql()} END AS classificacao FROM graded", _FAULTY, dirty=True))
_ok = "(lead_id % 97 <> 0 AND lead_id % 79 <> 0 AND lead_id % 89 <> 0)"
sql("payload_lines", with_ctes(
    f"SELECT lead_id, CASE WHEN {_ok} THEN 1 ELSE 0 END AS is_valid, CASE WHEN lead_id % 97 = 0 THEN 'malformed' "
    "WHEN lead_id % 79 = 0 THEN 'empty' WHEN lead_id % 89 = 0 THEN 'bad_type_dias_sem_contato,missing_dias_sem_contato' ELSE '' END AS reasons, "
    f"CASE WHEN {_ok} AND lead_id % 83 = 0 THEN '{{\"utm\":\"x\"}}' END AS rescued, CASE WHEN {_ok} THEN round(score, 6) END AS score, "
    f"CASE WHEN {_ok} THEN {band_left_sql()} END AS classificacao FROM scored0"))

# ---------------------------------------------------------------- fitted and fixed models
NEWTON_STEPS = 9
_NEWTON = _FIXED + newton_ctes(len(_SLOTS), NEWTON_STEPS)
sql("score_all", recursive(with_ctes(
    f"SELECT lead_id, split, round({sigmoid_sql('z')}, 6) AS score, {band_right_sql(sigmoid_sql('z'))} AS classificacao FROM newton", _NEWTON)))
sql("train_logistic", recursive(with_ctes(
    "SELECT model, round(auc_roc, 6) AS auc_roc, round(avg_precision, 6) AS avg_precision, TRUE AS best FROM ("
    + _auc_ap_sql("LogisticRegression", "round(f.z, 9)").replace("FROM fixed f", "FROM newton f") + ") t", _NEWTON)))
sql("tree_scores", with_ctes(f"SELECT lead_id, round({forest_sql(FIXED_FOREST, 0.05, str)}, 6) AS score FROM feat"))
sql("tree_shap_top3", with_ctes(_TOP3.replace("SELECT lead_id, ", "SELECT lead_id, round(SUM(impact), 6) AS shap_sum, "),
                                tree_shap_ctes(FIXED_FOREST, 0.05, FOREST_FEATURES)))
sql("boosted_two_rounds", boosting_sql(BOOST_CUTS, 2, 2, 0.3))

sql("model_comparison", with_ctes(
    "SELECT model, round(auc_roc, 6) AS auc_roc, round(avg_precision, 6) AS avg_precision, "
    "ROW_NUMBER() OVER (ORDER BY auc_roc DESC, model) = 1 AS best FROM ("
    + " UNION ALL ".join(_auc_ap_sql(n, k) for n, k in (("scorecard", "c.log_odds"), ("fixed_linear", "round(f.z, 9)"),
                                                       ("recency", "-f.dias_sem_contato"))) + ") t", _FIXED))
