"""Exploratory profile of the raw lead table.

Every statistic of a step is folded into one aggregation (partial
aggregation on the map side, one small result); wide results are reshaped
with ``stack``/``inline``.  Exact quantiles go through
``ordered.exact_quantiles`` so no single task holds a column's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..session import cut_lineage
from .common import attach_one_row
from .metrics import density_by_class
from .moments import pair_moments
from .ordered import exact_quantiles

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per Spark type (schema-only, no scan)."""
    spark = df.sparkSession
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return (spark.createDataFrame(rows, "column string, dtype string")
            .groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns")))


def preview(df: DataFrame, n: int = 5, order: str = S.ID_COL) -> DataFrame:
    """First rows by id (a deliberate top-n)."""
    return df.orderBy(order).limit(n)


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column; rows
    are columns.  Moments in one aggregation; quartiles exact."""
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    m = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                              F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                              F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
                     for c in cols])
    mom = m.select(F.inline(rows))
    q = quantiles_long(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("column").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
    qw = qw.select("column", F.col("`0.25`").alias("p25"), F.col("`0.5`").alias("p50"), F.col("`0.75`").alias("p75"))
    return mom.join(qw, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def quantiles_long(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., column, prob, quantile) for several columns: the columns are
    unpivoted to (column, value) and handled as groups in one exact pass."""
    by = list(by or [])
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])))
    return exact_quantiles(long, "value", probs, by=[*by, "column"])


def target_summary(df: DataFrame, label: str = S.LABEL_COL, responded: str = "respondeu_contato") -> DataFrame:
    """Total, converted, not converted, conversion rate, imbalance ratio and response rate."""
    y = F.col(label)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("converted"),
                  F.avg(y).alias("rate"), F.avg(F.col(responded)).alias("response_rate")).select(
        "n", "converted", (F.col("n") - F.col("converted")).alias("not_converted"), "rate",
        F.when(F.col("converted") > 0, (F.col("n") - F.col("converted")) / F.col("converted")).alias("imbalance"),
        "response_rate")


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and share per column, columns with at least one null only."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])
    long = one.select("_n", F.inline(rows))
    return long.where(F.col("nulls") > 0).select(
        "column", F.col("nulls").cast("long").alias("nulls"), (F.col("nulls") / F.col("_n") * 100).alias("pct"))


def missing_effect(df: DataFrame, cols=("renda_estimada", "faixa_etaria", "turno_preferencia"),
                   label: str = S.LABEL_COL) -> DataFrame:
    """Conversion rate (%) among rows with and without a value, per column
    (columns without nulls are skipped)."""
    y = F.col(label)
    aggs = []
    for c in cols:
        aggs += [F.avg(F.when(F.col(c).isNotNull(), y)).alias(f"{c}__with"),
                 F.avg(F.when(F.col(c).isNull(), y)).alias(f"{c}__without"),
                 F.count_if(F.col(c).isNull()).alias(f"{c}__nulls")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"{c}__with") * 100).alias("rate_with"),
                              (F.col(f"{c}__without") * 100).alias("rate_without"),
                              F.col(f"{c}__nulls").alias("_nulls")) for c in cols])
    return one.select(F.inline(rows)).where(F.col("_nulls") > 0).drop("_nulls")


def conversion_by(df: DataFrame, key: str, label: str = S.LABEL_COL, drop_null_keys: bool = True,
                  order: str = "rate") -> DataFrame:
    """total, converted, rate and rate in % per key value.  ``order`` = 'rate'
    (descending) or 'key' (ascending).  A text bar of width int(rate %) is
    included (``bar``).  A null key is no group unless ``drop_null_keys`` is off."""
    src = df.where(F.col(key).isNotNull()) if drop_null_keys else df
    y = F.col(label)
    out = src.groupBy(key).agg(F.count(y).alias("total"), F.sum(y).cast("long").alias("converted"),
                               F.avg(y).alias("rate"))
    out = out.withColumn("rate_pct", F.col("rate") * 100)
    out = out.withColumn("bar", text_bar(F.col("rate_pct")))
    return out.orderBy(F.desc("rate"), F.asc(key)) if order == "rate" else out.orderBy(key)


def text_bar(pct, char: str = "█"):
    """A bar of ``char`` as long as the integer part of pct rounded to 1 place."""
    return F.repeat(F.lit(char), F.round(pct, 1).cast("int"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """count and share per value (nulls excluded)."""
    # one row per value, materialised once: the total is then read from it,
    # not from another pass over the source
    c = cut_lineage(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count")))
    tot = c.agg(F.sum("count").alias("_tot"))
    return attach_one_row(c, tot).select(key, "count", (F.col("count") / F.col("_tot")).alias("share"))


def days_band(days="dias_sem_contato"):
    """Right-closed bands (0,3],(3,7],(7,14],(14,30],(30,60]; 0 and values
    outside (0, 60] fall in no band (null)."""
    d = F.col(days)
    e, lbl = S.DAYS_BAND_EDGES, S.DAYS_BAND_LABELS
    out = None
    for i in range(len(lbl)):
        cond = (d > F.lit(e[i])) & (d <= F.lit(e[i + 1]))
        out = F.when(cond, F.lit(lbl[i])) if out is None else out.when(cond, F.lit(lbl[i]))
    return out


def conversion_by_days_band(df: DataFrame, label: str = S.LABEL_COL) -> DataFrame:
    """Conversion rate (%) per days band; leads in no band are dropped."""
    b = df.withColumn("faixa_dias", days_band())
    return (b.where(F.col("faixa_dias").isNotNull()).groupBy("faixa_dias")
             .agg(F.count(F.lit(1)).alias("total"), (F.avg(F.col(label)) * 100).alias("rate_pct")))


def box_stats(df: DataFrame, value: str, label: str = S.LABEL_COL) -> DataFrame:
    """Box statistics per class: quartiles (exact, linear), whiskers at the
    most extreme values within 1.5 IQR of the box, and the outlier count."""
    src = df.where(F.col(value).isNotNull()).select(F.col(label).alias("label"), F.col(value).cast("double").alias("v"))
    q = exact_quantiles(src, "v", [0.25, 0.5, 0.75], by=["label"])
    qw = q.groupBy("label").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("quantile")).select(
        "label", F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("median"), F.col("`0.75`").alias("q3"))
    qw = qw.withColumns({"lo_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                         "hi_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    # one row per class: broadcast bounded by the number of classes
    j = src.join(F.broadcast(qw), "label")
    inside = (F.col("v") >= F.col("lo_fence")) & (F.col("v") <= F.col("hi_fence"))
    w = j.groupBy("label").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"), F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n"))
    return qw.join(w, "label").select("label", "n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "outliers")


def class_histograms(df: DataFrame, label: str = S.LABEL_COL) -> dict[str, DataFrame]:
    """Density histograms by class: days (30 bins) and income (40 bins)."""
    return {"dias_sem_contato": density_by_class(df, "dias_sem_contato", label, 30),
            "renda_estimada": density_by_class(df, "renda_estimada", label, 40)}


def group_means(df: DataFrame, cols=("dias_sem_contato", "renda_estimada"), label: str = S.LABEL_COL) -> DataFrame:
    """Mean per class and the difference (not converted - converted) per column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.when(F.col(label) == 1, F.col(c))).alias(f"{c}__1"),
                 F.avg(F.when(F.col(label) == 0, F.col(c))).alias(f"{c}__0")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__1").alias("mean_converted"),
                              F.col(f"{c}__0").alias("mean_not_converted"),
                              (F.col(f"{c}__0") - F.col(f"{c}__1")).alias("difference")) for c in cols])
    return one.select(F.inline(rows))


def correlations(df: DataFrame, cols: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """(a, b, corr) for pairs of columns, by number, from one pass over ``df``.

    Each pair takes the rows where both are present; NaN if either is constant there."""
    listed = df.sparkSession.createDataFrame([(i, j, cols[i], cols[j]) for i, j in pairs], "i int, j int, a string, b string")
    found = pair_moments(df, cols, pairs)
    corr = F.try_divide(F.col("sij"), F.sqrt("si") * F.sqrt("sj"))
    return listed.join(found, ["i", "j"], "left").select(
        "a", "b", F.when(F.col("i") == F.col("j"), F.when(F.col("si") > 0, 1.0)).otherwise(corr).alias("corr")) \
        .withColumn("corr", F.coalesce("corr", F.lit(float("nan"))))


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, pairwise-complete
    (a pair skips rows where either value is null), all pairs in one
    pass.  Long form (var1, var2, corr), both orders plus the diagonal.  A pair
    with a constant column, and the diagonal of one, is NaN."""
    cols = cols or numeric_columns(df)
    one = correlations(df, cols, [(i, j) for i in range(len(cols)) for j in range(i, len(cols))])
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("var1"), F.col("b").alias("var2")))) \
        .otherwise(F.array(F.struct(F.col("a").alias("var1"), F.col("b").alias("var2")),
                           F.struct(F.col("b").alias("var1"), F.col("a").alias("var2"))))
    return one.select(F.inline(both), "corr")


def corr_with_target(df: DataFrame, label: str = S.LABEL_COL, cols: list[str] | None = None) -> DataFrame:
    """Correlations with the label sorted by magnitude, ties by name, with the sign; NaN for a constant column, last."""
    cols = [c for c in (cols or numeric_columns(df)) if c != label]
    one = correlations(df, [*cols, label], [(i, len(cols)) for i in range(len(cols))])
    return (one.select(F.col("a").alias("variable"), "corr")
               .withColumns({"abs_corr": F.abs("corr"),
                             "sign": F.when(F.col("corr") > 0, F.lit("+")).otherwise(F.lit("-"))})
               .orderBy(F.isnan("abs_corr"), F.desc("abs_corr"), "variable"))


def crosstab(df: DataFrame, row: str, label: str = S.LABEL_COL, values=(0, 1)) -> DataFrame:
    """Counts of row value x label (null row values dropped, empty cells 0)."""
    src = df.where(F.col(row).isNotNull())
    out = src.groupBy(row).pivot(label, list(values)).count().na.fill(0)
    return out.select(row, *[F.col(str(v)).cast("long").alias(f"n_{v}") for v in values])


def numeric_summary(df: DataFrame, cols=("dias_sem_contato", "n_tentativas", "renda_estimada")) -> DataFrame:
    """mean, exact median, min, max per column, nulls ignored."""
    cols = list(cols)
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in cols
                   for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"),
                              F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max")) for c in cols])
    mom = one.select(F.inline(rows))
    med = quantiles_long(df, cols, [0.5]).select("column", F.col("quantile").alias("median"))
    return mom.join(med, "column", "left").select("column", "mean", "median", "min", "max")
