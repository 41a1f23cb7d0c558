"""Small expression helpers shared by the function modules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c, mapping: dict, default=None) -> Column:
    """``CASE c WHEN k1 THEN v1 ... ELSE default END`` for a small literal mapping."""
    c = as_col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def flag(cond: Column) -> Column:
    """Boolean condition -> 0/1 int, with null treated as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def clip(c, lo, hi) -> Column:
    return F.least(F.greatest(as_col(c), F.lit(lo)), F.lit(hi))


def sigmoid(x) -> Column | np.ndarray:
    """Of a column (or its name), or of the numbers of an array."""
    if isinstance(x, np.ndarray):
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-x))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(x)))
