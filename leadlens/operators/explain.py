"""Additive explanations.

For a model whose log-odds is a sum of per-feature terms f_j(x_j) (a linear
model over the transformed slots, or the scorecard over raw features), the
exact Shapley value of feature j against a background set B is
    phi_j(x) = f_j(x_j) - mean_{b in B} f_j(b_j)
(interventional expectation; Lundberg & Lee 2017, linear case).  The
background means are one aggregation over B (bounded: B is a fixed-size
sample), the attributions one projection per row.

Tree ensembles get exact values too, from their node table (see ``trees``).  For other models
``permutation_attribution`` estimates Shapley values by sampled feature orderings, as a
distributed Spark job (see there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

# Direction texts of an attribution.
FAVOURS = "favorece conversão"
DISFAVOURS = "desfavorece"


def background(df: DataFrame, n: int = 100, order: str = S.ID_COL) -> DataFrame:
    """The first n rows by id: a deliberate, bounded background sample."""
    return df.orderBy(order).limit(n)


def background_means(bg: DataFrame, terms: dict[str, Column]) -> dict[str, float]:
    """Mean of every term over the background (one aggregation; one number
    per feature reaches the driver)."""
    row = bg.agg(*[F.avg(t.cast("double")).alias(f"t{i}") for i, t in enumerate(terms.values())]).collect()[0]
    return {name: (row[f"t{i}"] if row[f"t{i}"] is not None else 0.0) for i, name in enumerate(terms)}


def attribution_columns(terms: dict[str, Column], means: dict[str, float]) -> dict[str, Column]:
    return {name: t.cast("double") - F.lit(float(means[name])) for name, t in terms.items()}


def explain_wide(df: DataFrame, terms: dict[str, Column], means: dict[str, float],
                 keep: list[str] | None = None, prefix: str = "shap_") -> DataFrame:
    """One ``shap_<feature>`` column per feature plus ``shap_sum`` and
    ``top_feature`` (first feature with the largest absolute value)."""
    keep = [c for c in (keep or [S.ID_COL]) if c in df.columns]
    att = attribution_columns(terms, means)
    out = df.select(*keep, *[c.alias(prefix + n) for n, c in att.items()])
    names = list(att)
    total = None
    for n in names:
        total = F.col(prefix + n) if total is None else total + F.col(prefix + n)
    return out.withColumns({"shap_sum": total, "top_feature": _ranked(names, prefix)[0]["feature"]})


def explain_long(df: DataFrame, terms: dict[str, Column], means: dict[str, float],
                 id_col: str = S.ID_COL) -> DataFrame:
    """(id, slot, feature, impact): the long form of the explanation table."""
    att = attribution_columns(terms, means)
    rows = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(n).alias("feature"), c.alias("impact"))
                     for i, (n, c) in enumerate(att.items())])
    return df.select(id_col, F.inline(rows))


def _rank_key(impact: Column) -> Column:
    return F.coalesce(-F.abs(impact), F.lit(1.0)).alias("k")


def _ranked(names: list[str], prefix: str) -> Column:
    """Array of (feature, impact) sorted by |impact| desc, original order on ties, unknown impacts last."""
    arr = F.array(*[F.struct(_rank_key(F.col(prefix + n)), F.lit(i).alias("slot"),
                             F.lit(n).alias("feature"), F.col(prefix + n).alias("impact"))
                    for i, n in enumerate(names)])
    return F.array_sort(arr)


def top_features_column(terms: dict[str, Column], means: dict[str, float], k: int = 3) -> Column:
    """Top-k (feature, impact) structs by |impact| (original order on ties),
    computed from the row's own columns: a projection, no join."""
    att = attribution_columns(terms, means)
    ranked = F.array_sort(F.array(*[
        F.struct(_rank_key(c), F.lit(i).alias("slot"), F.lit(n).alias("feature"), c.alias("impact"))
        for i, (n, c) in enumerate(att.items())]))
    return F.transform(F.slice(ranked, 1, k),
                       lambda t: F.struct(t["feature"].alias("feature"), t["impact"].alias("impact")))


def top_k(df: DataFrame, terms: dict[str, Column], means: dict[str, float], k: int = 3,
          keep: list[str] | None = None) -> DataFrame:
    """Top-k features by absolute impact per row as ``top_features``: an
    array of (feature, impact) structs, plus ``shap_sum``."""
    w = explain_wide(df, terms, means, keep)
    top = F.slice(_ranked(list(terms), "shap_"), 1, k)
    top = F.transform(top, lambda s: F.struct(s["feature"].alias("feature"), s["impact"].alias("impact")))
    keep = [c for c in (keep or [S.ID_COL]) if c in df.columns]
    return w.select(*keep, top.alias("top_features"), "shap_sum", "top_feature")


def flatten_top(df: DataFrame, k: int = 3, col: str = "top_features") -> DataFrame:
    """top<i>_feature / top<i>_impact / top<i>_direction columns."""
    cols = {}
    for i in range(k):
        item = F.element_at(F.col(col), i + 1)
        cols[f"top{i + 1}_feature"] = item["feature"]
        cols[f"top{i + 1}_impact"] = item["impact"]
        cols[f"top{i + 1}_direction"] = direction(item["impact"])
    return df.withColumns(cols).drop(col)


def direction(impact: Column) -> Column:
    return F.when(impact.isNull(), F.lit(None)).when(impact > 0, F.lit(FAVOURS)).otherwise(F.lit(DISFAVOURS))


def global_importance(df: DataFrame, terms: dict[str, Column], means: dict[str, float],
                      k: int = 10) -> DataFrame:
    """Mean absolute impact per feature over all rows (one aggregation), top k."""
    att = attribution_columns(terms, means)
    one = df.agg(*[F.avg(F.abs(c)).alias(f"a{i}") for i, c in enumerate(att.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"a{i}").alias("mean_abs_impact"))
                     for i, n in enumerate(att)])
    return one.select(F.inline(rows)).orderBy(F.desc("mean_abs_impact"), F.asc("feature")).limit(k)


def linear_terms(coefficients: dict[str, float]) -> dict[str, Column]:
    """Terms of a linear model over named (slot) columns: coef * x."""
    return {n: F.lit(float(b)) * F.col(f"`{n}`").cast("double") for n, b in coefficients.items()}


def choose_method(model) -> str:
    """'linear' for linear models (exact additive attribution), 'tree' for tree ensembles (exact, from
    the node table), 'permutation' for any other model."""
    name = type(model).__name__
    if name in ("LogisticModel", "LogisticRegressionModel", "LinearRegressionModel", "LinearSVCModel"):
        return "linear"
    if name in ("TreeEnsemble", "StoredTrees", "RandomForestClassificationModel", "GBTClassificationModel", "DecisionTreeClassificationModel"):
        return "tree"
    return "permutation"
