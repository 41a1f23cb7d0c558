"""Score classes.

``right``: (0, 0.3] Baixo, (0.3, 0.6] Médio, (0.6, 1] Alto; a score of 0 (or
outside (0, 1]) gets no class (null).  Used for tables.
``left``: < 0.3 Baixo, < 0.6 Médio, else Alto; no class without a score.  Used for a single
scored lead.
The two differ exactly at 0, 0.3 and 0.6.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .common import as_col


def band_right(score="score") -> Column:
    s = as_col(score)
    lo, hi = S.BAND_EDGES
    return (F.when((s > F.lit(0.0)) & (s <= F.lit(lo)), F.lit(S.CLASS_LOW))
            .when((s > F.lit(lo)) & (s <= F.lit(hi)), F.lit(S.CLASS_MID))
            .when((s > F.lit(hi)) & (s <= F.lit(1.0)), F.lit(S.CLASS_HIGH)))


def band_left(score="score") -> Column:
    s = as_col(score)
    lo, hi = S.BAND_EDGES
    return (F.when(s < F.lit(lo), F.lit(S.CLASS_LOW))
            .when(s < F.lit(hi), F.lit(S.CLASS_MID))
            .when(s.isNotNull(), F.lit(S.CLASS_HIGH)))


def band(score="score", rule: str = "right") -> Column:
    if rule == "right":
        return band_right(score)
    if rule == "left":
        return band_left(score)
    raise ValueError(f"unknown band rule {rule!r}")
