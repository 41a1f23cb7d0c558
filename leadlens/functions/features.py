"""Derived business features of a lead (one pass, input columns untouched).

Nulls in days / attempts / responded are read as 0 for the derived columns
only; the raw columns keep their nulls (the preprocessing step imputes them
with the training median later).  Comparisons are null-safe: a null channel,
shift or course gives 0, never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .common import clip, flag


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def engagement(responded: Column, days: Column, attempts: Column) -> Column:
    """0.3*responded + 0.4*clip(1 - days/60, 0, 1) + 0.3*clip(attempts, 0, 5)/5."""
    return ((F.lit(0.3) * responded
             + F.lit(0.4) * clip(F.lit(1.0) - days / F.lit(60.0), 0.0, 1.0))
            + F.lit(0.3) * (clip(attempts, 0, 5) / F.lit(5.0)))


def feature_columns() -> dict[str, Column]:
    days = _filled("dias_sem_contato")
    attempts = _filled("n_tentativas")
    responded = _filled("respondeu_contato")
    return {
        "score_engajamento": engagement(responded, days, attempts),
        "is_indicacao": flag(F.col("canal_captacao").eqNullSafe(S.CHANNEL_REFERRAL)),
        "is_evento": flag(F.col("canal_captacao").eqNullSafe(S.CHANNEL_EVENT)),
        "urgencia_estimada": (days * (attempts + F.lit(1))).cast("int"),
        "contato_rapido": flag(days < F.lit(3)),
        "tentativas_ideal": flag(attempts.between(1, 3)),
        "turno_noite": flag(F.col("turno_preferencia").eqNullSafe(S.SHIFT_EVENING)),
        "curso_adulto": flag(F.col("curso_interesse").eqNullSafe(S.COURSE_ADULT)),
    }


def add_features(df: DataFrame) -> DataFrame:
    """All eight derived columns in one ``withColumns`` (a single projection)."""
    return df.withColumns(feature_columns())
