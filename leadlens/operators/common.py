"""Helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    The aggregate runs once as a scalar subquery (a struct of its columns);
    its value is then a constant of the outer plan: no join."""
    s = one.select(F.struct(*[F.col(c) for c in one.columns]).alias("_s")).scalar()
    return df.withColumns({c: s[c] for c in one.columns})
