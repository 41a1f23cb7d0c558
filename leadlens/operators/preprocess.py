"""Leak-free preprocessing: fit on training rows, apply anywhere.

numeric      median imputation (exact), then standardisation with the
             population deviation (a zero deviation divides by 1)
categorical  most-frequent imputation (ties: smallest value), then one-hot
             over the sorted training categories (unknown -> all zeros)
binary       passed through; nulls are refused when fitting, or filled with ``binary_fill``

Fitting reads the training rows in three aggregations (the exact medians take two); only
the fitted constants (a median, mean and deviation per numeric column, a mode and the
category list per categorical column) reach the driver.  Applying is one projection of
native expressions: the wide view for display, or an ML vector built from one indexed
category per column (``vector_col``), whose plan does not grow with the categories.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .profile import quantiles_long

MAX_CATEGORIES = 10_000   # different values of all categorical columns; more are refused when fitting


@dataclass
class Preprocessor:
    numeric: list[str] = field(default_factory=lambda: list(S.NUMERIC_COLS))
    categorical: list[str] = field(default_factory=lambda: list(S.CATEGORICAL_COLS))
    binary: list[str] = field(default_factory=lambda: list(S.BINARY_COLS))
    medians: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)
    binary_fill: float | None = None

    # ------------------------------------------------------------------ fit
    def fit(self, df: DataFrame) -> "Preprocessor":
        q = quantiles_long(df, self.numeric, [0.5]).collect()
        self.medians = {r["column"]: r["quantile"] for r in q}
        # categorical value counts: one row per (column, value)
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in self.categorical])))
        vc = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        rows = vc.limit(MAX_CATEGORIES + 1).collect()   # the categories are part of the model
        if len(rows) > MAX_CATEGORIES:
            raise ValueError(f"over {MAX_CATEGORIES} different values in the categorical columns {self.categorical}")
        self.modes, self.categories = {}, {}
        for c in self.categorical:
            vals = [(r["value"], r["n"]) for r in rows if r["column"] == c]
            self.categories[c] = sorted(v for v, _ in vals)
            self.modes[c] = min(vals, key=lambda t: (-t[1], t[0]))[0] if vals else None
        imputed = [F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c))) for c in self.numeric]
        st = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(imputed)],
                    *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(imputed)],
                    *[F.count_if(F.col(c).isNull()).alias(f"b{i}") for i, c in enumerate(self.binary)]).collect()[0]
        unknown = [c for i, c in enumerate(self.binary) if st[f"b{i}"]]
        if unknown and self.binary_fill is None:
            raise ValueError(f"null values in binary columns {unknown}: drop those rows or set binary_fill")
        self.means = {c: st[f"m{i}"] for i, c in enumerate(self.numeric)}
        self.scales = {c: (st[f"s{i}"] if st[f"s{i}"] else 1.0) for i, c in enumerate(self.numeric)}
        # categories after imputation: the mode is always among them
        return self

    # ------------------------------------------------------------ transform
    def slot_names(self) -> list[str]:
        names = [f"{S.SLOT_NUMERIC}{c}" for c in self.numeric]
        for c in self.categorical:
            names += [f"{S.SLOT_CATEGORICAL}{c}_{v}" for v in self.categories.get(c, [])]
        names += [f"{S.SLOT_BINARY}{c}" for c in self.binary]
        return names

    def slot_columns(self) -> list[Column]:
        cols = self.numeric_columns()
        for c in self.categorical:
            v = F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))
            cols += [F.when(v == F.lit(cat), F.lit(1.0)).otherwise(F.lit(0.0)) for cat in self.categories[c]]
        return cols + self.binary_columns()

    def numeric_columns(self) -> list[Column]:
        return [(F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - F.lit(self.means[c])) / F.lit(self.scales[c])
                for c in self.numeric]

    def binary_columns(self) -> list[Column]:
        fill = None if self.binary_fill is None else F.lit(float(self.binary_fill))
        return [F.col(c).cast("double") if fill is None else F.coalesce(F.col(c).cast("double"), fill) for c in self.binary]

    def transform(self, df: DataFrame, keep: list[str] | None = None, vector_col: str | None = None) -> DataFrame:
        """``keep`` columns plus one column per slot (named as ``slot_names``), or, with
        ``vector_col``, plus one sparse ML vector of the same slots in the same order."""
        keep = [c for c in (keep or []) if c in df.columns]
        if not vector_col:
            return df.select(*keep, *[c.alias(n) for c, n in zip(self.slot_columns(), self.slot_names())])
        from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
        cats = [c for c in self.categorical if self.categories.get(c)]
        text, index, hot = ([f"_{k}{i}" for i in range(len(cats))] for k in ("text", "index", "hot"))
        number = [f"_number{i}" for i in range(len(self.numeric))]
        flag = [f"_flag{i}" for i in range(len(self.binary))]
        out = df.select(*keep, *[c.alias(n) for c, n in zip(self.numeric_columns(), number)],
                        *[F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c])).alias(n) for c, n in zip(cats, text)],
                        *[c.alias(n) for c, n in zip(self.binary_columns(), flag)])
        for c, t, i in zip(cats, text, index):   # an unknown category is the last index, which the encoder drops: all zeros
            out = StringIndexerModel.from_labels(self.categories[c], inputCol=t, outputCol=i, handleInvalid="keep").transform(out)
        if cats:
            out = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True).fit(out).transform(out)
        out = VectorAssembler(inputCols=number + hot + flag, outputCol=vector_col, handleInvalid="keep").transform(out)
        return out.select(*keep, vector_col)

    # ---------------------------------------------------------- persistence
    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "Preprocessor":
        return cls(**json.loads(text))

