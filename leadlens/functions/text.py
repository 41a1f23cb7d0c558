"""Message text as native string expressions: explanation text, the
prompt of an outreach message and the rule-based message.

Numbers are formatted with ``format_number`` (half-even on the binary value,
grouping separators removed), which gives the same digits as fixed-point
formatting with that many places.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .common import as_col

# ---------------------------------------------------------------------------
# Texts that must equal the source system's message texts.
# ---------------------------------------------------------------------------
NO_EXPLANATION = "Não disponível"
PROMPT_TEMPLATE = 'Você é um consultor de vendas especialista em educação e idiomas.\nSua tarefa é escrever uma mensagem de WhatsApp para primeiro contato com um lead.\n\nRegras:\n- Máximo 4 linhas\n- Tom consultivo, humano, direto — sem ser robótico ou agressivo\n- Sem pressão de vendas\n- Mencione o interesse específico do lead de forma natural\n- Se o lead veio por indicação, mencione isso positivamente\n- Se já houve tentativas anteriores sem resposta, seja empático\n- Foco no benefício para o perfil específico deste lead\n\nPerfil do lead:\n- Nome: {nome}\n- Interesse declarado: {curso_interesse}\n- Canal de origem: {canal_captacao}\n- Dias sem contato: {dias_sem_contato}\n- Tentativas anteriores: {n_tentativas}\n- Score de conversão: {score}\n- Principal fator de score: {shap_top_features}\n\nEscreva apenas a mensagem, sem explicações adicionais.\n'
PROMPT_DEFAULTS = {"nome": "Lead", "curso_interesse": "Não informado", "canal_captacao": "Não informado",
                   "dias_sem_contato": "N/A", "n_tentativas": "0"}
FALLBACK_COURSE = "idiomas"
REFERRAL_INTRO = "Oi {nome}!  Soube que alguém te indicou pra conhecer nosso curso de {curso}."
REFERRAL_BODY = "Fico feliz com a confiança! Posso te contar como funciona e tirar suas dúvidas?"
RETRY_INTRO = "Oi {nome}, tudo bem? Sei que já tentamos contato antes."
RETRY_BODY = "Só queria saber se ainda tem interesse no curso de {curso} — sem compromisso, tá? "
DEFAULT_INTRO = "Oi {nome}! Vi que você demonstrou interesse no nosso curso de {curso}."
DEFAULT_BODY = "Posso te contar um pouco sobre como funciona e responder suas dúvidas?"
CLOSING = "Fica à vontade pra responder quando puder! "
SOURCE_FALLBACK = "fallback"
RETRY_ATTEMPTS = 2


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text with ``digits`` places, no grouping separators."""
    return F.regexp_replace(F.format_number(x.cast("double"), digits), ",", "")


def whole_percent(score) -> Column:
    """0.4567 -> '46%'."""
    return F.concat(fixed(as_col(score) * F.lit(100.0), 0), F.lit("%"))


def explanation_text(top_features="top_features", k: int = 3) -> Column:
    """'feature (0.31), feature (0.12), ...' for up to k (feature, impact)
    structs; absolute values with 2 places; no entries -> fixed text."""
    arr = F.slice(as_col(top_features), 1, k)
    parts = F.transform(arr, lambda s: F.concat(s["feature"], F.lit(" ("), fixed(F.abs(s["impact"]), 2), F.lit(")")))
    return F.when(F.coalesce(F.size(arr), F.lit(0)) <= 0, F.lit(NO_EXPLANATION)).otherwise(F.array_join(parts, ", "))


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Concatenate the literal pieces of ``template`` and the placeholder columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    out = []
    for i, p in enumerate(pieces):
        if i % 2 == 0:
            if p:
                out.append(F.lit(p))
        else:
            out.append(values[p])
    return F.concat(*out)


def prompt(nome="nome_ficticio", curso="curso_interesse", canal="canal_captacao", dias="dias_sem_contato",
           tentativas="n_tentativas", score="score", shap_text="shap_text") -> Column:
    """The prompt with its seven placeholders filled (defaults for missing values)."""
    d = PROMPT_DEFAULTS
    vals = {
        "nome": F.coalesce(as_col(nome), F.lit(d["nome"])),
        "curso_interesse": F.coalesce(as_col(curso), F.lit(d["curso_interesse"])),
        "canal_captacao": F.coalesce(as_col(canal), F.lit(d["canal_captacao"])),
        "dias_sem_contato": F.coalesce(as_col(dias).cast("string"), F.lit(d["dias_sem_contato"])),
        "n_tentativas": F.coalesce(as_col(tentativas).cast("string"), F.lit(d["n_tentativas"])),
        "score": whole_percent(F.coalesce(as_col(score), F.lit(0.0))),
        "shap_top_features": F.coalesce(as_col(shap_text), F.lit(NO_EXPLANATION)),
    }
    return _fill(PROMPT_TEMPLATE, vals)


def first_name(nome="nome_ficticio") -> Column:
    """First whitespace-separated token; a missing or blank name gives 'Lead'."""
    tok = F.regexp_extract(F.coalesce(as_col(nome), F.lit("")), r"^\s*(\S+)", 1)
    return F.when(tok == "", F.lit(S.DEFAULT_NAME)).otherwise(tok)


def fallback_script(nome="nome_ficticio", curso="curso_interesse", canal="canal_captacao",
                    tentativas="n_tentativas") -> Column:
    """Rule-based message: referral -> else more than two attempts -> else default."""
    vals = {"nome": first_name(nome), "curso": F.coalesce(as_col(curso), F.lit(FALLBACK_COURSE))}
    referral = as_col(canal).eqNullSafe(S.CHANNEL_REFERRAL)
    retry = F.coalesce(as_col(tentativas), F.lit(0)) > F.lit(RETRY_ATTEMPTS)
    intro = (F.when(referral, _fill(REFERRAL_INTRO, vals)).when(retry, _fill(RETRY_INTRO, vals))
             .otherwise(_fill(DEFAULT_INTRO, vals)))
    body = (F.when(referral, _fill(REFERRAL_BODY, vals)).when(retry, _fill(RETRY_BODY, vals))
            .otherwise(_fill(DEFAULT_BODY, vals)))
    return F.concat_ws("\n", intro, body, F.lit(CLOSING))
