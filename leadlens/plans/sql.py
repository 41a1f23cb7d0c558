"""SQL twins of the lead view, features and scorecard.

These strings are written for an independent SQL engine (the oracle) and are
built from the same fixed values as the DataFrame code.  Double literals use
an exponent (``5e-1``) because ``0.5`` is a DECIMAL literal in SQL.
"""

from __future__ import annotations

from .. import schema as S
from ..sources.leads import AGE_CUTS, CHANNEL_CUTS, COURSE_CUTS, SHIFT_CUTS


def d(x: float) -> str:
    """Double literal."""
    r = repr(float(x))
    return r if ("e" in r or "inf" in r or "nan" in r) else r + "e0"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_map(col: str, mapping: dict, default: str = "0e0") -> str:
    parts = " ".join(f"WHEN {col} = {q(k)} THEN {d(v)}" for k, v in mapping.items())
    return f"CASE {parts} ELSE {default} END"


def case_cuts(expr: str, cuts) -> str:
    parts = " ".join(f"WHEN {expr} < {hi} THEN {q(label)}" for hi, label in cuts[:-1])
    return f"CASE {parts} ELSE {q(cuts[-1][1])} END"


def log_odds_sql(canal="canal_captacao", resp="respondeu_contato", days="dias_sem_contato",
                 att="n_tentativas", curso="curso_interesse") -> str:
    a = f"({att} - {S.SCORECARD_ATTEMPTS_PEAK})"
    return (f"(((({d(S.SCORECARD_INTERCEPT)} + {case_map(canal, S.SCORECARD_CHANNEL)})"
            f" + {resp} * {d(S.SCORECARD_RESPONDED)})"
            f" - {d(S.SCORECARD_DAYS)} * {days})"
            f" + ({d(S.SCORECARD_ATTEMPTS_CURVE)} * ({a} * {a}) + {d(S.SCORECARD_ATTEMPTS_BONUS)}))"
            f" + {case_map(curso, S.SCORECARD_COURSE)}")


def sigmoid_sql(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


LEAD_COLS = [f.name for f in S.LEADS_SCHEMA.fields]


def leads_ctes(dirty: bool = False, nulls: bool = False) -> list[str]:
    base = """lead_base AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, o.o_orderstatus, o.o_totalprice,
         cn.c_name, cn.c_acctbal, cn.n_name
  FROM orders o
  JOIN (SELECT cu.c_custkey, cu.c_name, cu.c_acctbal, n.n_name
        FROM customer cu JOIN nation n ON cu.c_nationkey = n.n_nationkey) cn
    ON o.o_custkey = cn.c_custkey)"""
    cols = f"""lead_cols AS (
  SELECT k, c,
    k + 1 AS lead_id,
    c_name || ' ' || n_name AS nome_ficticio,
    n_name AS municipio,
    {case_cuts('(7 * k + 13 * c) % 20', CHANNEL_CUTS)} AS canal_captacao,
    {case_cuts('(11 * k + 3 * c) % 20', COURSE_CUTS)} AS curso_interesse,
    CASE WHEN k % 10 = 7 THEN NULL ELSE {case_cuts('(17 * c + 5) % 100', AGE_CUTS)} END AS faixa_etaria,
    CASE WHEN k % 25 IN (4, 5) THEN NULL ELSE {case_cuts('(29 * c + k) % 20', SHIFT_CUTS)} END AS turno_preferencia,
    CAST(floor(o_totalprice) % 22 + CASE WHEN c % 25 = 0 THEN 35 ELSE 0 END AS INTEGER) AS dias_sem_contato,
    CAST((5 * k + c) % 9 AS INTEGER) AS n_tentativas,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS respondeu_contato,
    CASE WHEN k % 25 < 3 THEN NULL ELSE 1000e0 + abs(c_acctbal) END AS renda_estimada
  FROM lead_base)"""
    u = "(((7919 * k + 104729 * c) % 10007 + 5e-1) / 10007e0)"
    label = f"CASE WHEN {u} < {sigmoid_sql(log_odds_sql() + ' + 15e-1')} THEN 1 ELSE 0 END"
    if not dirty and not nulls:
        sel = ", ".join(LEAD_COLS[:-1])
        leads = f"leads AS (\n  SELECT {sel}, {label} AS converteu FROM lead_cols)"
        return [base, cols, leads]
    labelled = f"lead_lab AS (\n  SELECT *, {label} AS converteu FROM lead_cols)"
    repl = {
        "dias_sem_contato": "CASE WHEN k % 97 = 0 THEN -1 ELSE dias_sem_contato END AS dias_sem_contato",
        "respondeu_contato": "CASE WHEN k % 89 = 0 THEN 2 ELSE respondeu_contato END AS respondeu_contato",
        "canal_captacao": "CASE WHEN k % 83 = 0 THEN NULL ELSE canal_captacao END AS canal_captacao",
    }
    if nulls:
        repl = {"canal_captacao": "CASE WHEN k % 83 <> 0 THEN canal_captacao END AS canal_captacao",
                "dias_sem_contato": "CASE WHEN k % 61 <> 0 THEN dias_sem_contato END AS dias_sem_contato",
                "n_tentativas": "CASE WHEN k % 71 <> 0 THEN n_tentativas END AS n_tentativas",
                "respondeu_contato": "CASE WHEN k % 53 <> 0 THEN respondeu_contato END AS respondeu_contato"}
    sel = ", ".join(repl.get(cname, cname) for cname in LEAD_COLS)
    return [base, cols, labelled, f"leads AS (\n  SELECT {sel} FROM lead_lab)"]


def features_select() -> str:
    days = "COALESCE(dias_sem_contato, 0)"
    att = "COALESCE(n_tentativas, 0)"
    resp = "COALESCE(respondeu_contato, 0)"
    eng = (f"((3e-1 * {resp} + 4e-1 * least(greatest(1e0 - {days} / 6e1, 0e0), 1e0))"
           f" + 3e-1 * (least(greatest({att}, 0), 5) / 5e0))")

    def f(cond):
        return f"CASE WHEN {cond} THEN 1 ELSE 0 END"

    return ",\n    ".join([
        f"{eng} AS score_engajamento",
        f"{f('canal_captacao IS NOT DISTINCT FROM ' + q(S.CHANNEL_REFERRAL))} AS is_indicacao",
        f"{f('canal_captacao IS NOT DISTINCT FROM ' + q(S.CHANNEL_EVENT))} AS is_evento",
        f"CAST({days} * ({att} + 1) AS INTEGER) AS urgencia_estimada",
        f"{f(days + ' < 3')} AS contato_rapido",
        f"{f(att + ' BETWEEN 1 AND 3')} AS tentativas_ideal",
        f"{f('turno_preferencia IS NOT DISTINCT FROM ' + q(S.SHIFT_EVENING))} AS turno_noite",
        f"{f('curso_interesse IS NOT DISTINCT FROM ' + q(S.COURSE_ADULT))} AS curso_adulto",
    ])


def band_right_sql(s: str = "score") -> str:
    lo, hi = S.BAND_EDGES
    return (f"CASE WHEN {s} > 0e0 AND {s} <= {d(lo)} THEN {q(S.CLASS_LOW)} "
            f"WHEN {s} > {d(lo)} AND {s} <= {d(hi)} THEN {q(S.CLASS_MID)} "
            f"WHEN {s} > {d(hi)} AND {s} <= 1e0 THEN {q(S.CLASS_HIGH)} END")


def band_left_sql(s: str = "score") -> str:
    lo, hi = S.BAND_EDGES
    return (f"CASE WHEN {s} < {d(lo)} THEN {q(S.CLASS_LOW)} WHEN {s} < {d(hi)} "
            f"THEN {q(S.CLASS_MID)} WHEN {s} IS NOT NULL THEN {q(S.CLASS_HIGH)} END")


def standard_ctes(dirty: bool = False, nulls: bool = False) -> list[str]:
    """leads -> feat (leads + derived columns) -> scored (+ score, classificacao)."""
    return leads_ctes(dirty, nulls) + [
        f"feat AS (\n  SELECT *,\n    {features_select()}\n  FROM leads)",
        f"scored00 AS (\n  SELECT *, {log_odds_sql()} AS log_odds FROM feat)",
        f"scored0 AS (\n  SELECT *, {sigmoid_sql('log_odds')} AS score FROM scored00)",
        f"scored AS (\n  SELECT *, {band_right_sql()} AS classificacao FROM scored0)",
    ]


def with_ctes(select: str, extra: list[str] | None = None, dirty: bool = False, nulls: bool = False) -> str:
    ctes = standard_ctes(dirty, nulls) + list(extra or [])
    return "WITH " + ",\n".join(ctes) + "\n" + select
