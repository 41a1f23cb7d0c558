"""Deterministic scorecard: the lead generator's label rule without its noise.

log-odds = intercept + channel weight + 0.7*responded - 0.04*days
           + (-0.15*(attempts-2)^2 + 0.3) + course weight
Unknown channel / course values add 0.  Terms are added in this order so the
floating-point result is reproducible in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .common import as_col, clip, lookup, sigmoid


def channel_weight(canal) -> Column:
    return lookup(canal, S.SCORECARD_CHANNEL, 0.0)


def course_weight(curso) -> Column:
    return lookup(curso, S.SCORECARD_COURSE, 0.0)


def attempts_term(attempts) -> Column:
    d = as_col(attempts) - F.lit(S.SCORECARD_ATTEMPTS_PEAK)
    return F.lit(S.SCORECARD_ATTEMPTS_CURVE) * (d * d) + F.lit(S.SCORECARD_ATTEMPTS_BONUS)


def scorecard_terms(canal="canal_captacao", responded="respondeu_contato",
                    days="dias_sem_contato", attempts="n_tentativas",
                    curso="curso_interesse") -> dict[str, Column]:
    """Additive terms of the log-odds, keyed by the raw feature they depend on."""
    return {
        "canal_captacao": channel_weight(canal),
        "respondeu_contato": as_col(responded) * F.lit(S.SCORECARD_RESPONDED),
        "dias_sem_contato": -(F.lit(S.SCORECARD_DAYS) * as_col(days)),
        "n_tentativas": attempts_term(attempts),
        "curso_interesse": course_weight(curso),
    }


def safe_terms() -> dict[str, Column]:
    """The terms as ``try_`` expressions: an input that overflows gives an unknown term, not a failed job."""
    d = F.try_subtract(F.col("n_tentativas"), F.lit(S.SCORECARD_ATTEMPTS_PEAK))
    curve = F.lit(S.SCORECARD_ATTEMPTS_CURVE) * F.try_multiply(d, d) + F.lit(S.SCORECARD_ATTEMPTS_BONUS)
    return {**scorecard_terms(), "n_tentativas": curve}


def log_odds(canal="canal_captacao", responded="respondeu_contato", days="dias_sem_contato",
             attempts="n_tentativas", curso="curso_interesse") -> Column:
    t = scorecard_terms(canal, responded, days, attempts, curso)
    return ((((F.lit(S.SCORECARD_INTERCEPT) + t["canal_captacao"])
              + t["respondeu_contato"])
             - F.lit(S.SCORECARD_DAYS) * as_col(days))
            + t["n_tentativas"]) + t["curso_interesse"]


def score(**kw) -> Column:
    return sigmoid(log_odds(**kw))


def add_scorecard(df: DataFrame, score_col: str = "score", logit_col: str | None = None) -> DataFrame:
    lo = log_odds()
    cols = {score_col: sigmoid(lo)}
    if logit_col:
        cols[logit_col] = lo
    return df.withColumns(cols)


def response_propensity(days="dias_sem_contato", attempts="n_tentativas") -> Column:
    """0.45 - 0.008*days + (0.05 if attempts >= 1 else -0.10), clipped to [0.05, 0.90]."""
    adj = F.when(as_col(attempts) >= F.lit(1), F.lit(0.05)).otherwise(F.lit(-0.10))
    return clip((F.lit(0.45) + F.lit(-0.008) * as_col(days)) + adj, 0.05, 0.90)
