"""Exact stratified train/test split and class balance.

Each lead gets a reproducible pseudo-random order key, md5(lead_id|seed).  Within each class
the first t_c leads of that order form the test set, with t_c set so the test set has
ceil(test_size * n) rows shared over classes by largest remainder (the train share of class c
is floor(n_c * n_train / n) plus one for the classes with the largest remainders, ties by
class value).

The t_c-th key of each class is found exactly by bracket and select: one pass gives the class
sizes and a sketch of the keys, a second one ranks only the keys inside the class's bracket; a
bracket that may hold over ``ordered.BRACKET_ROWS`` rows is sketched again before.
The split itself is then a comparison with one key for each class: no shuffle, no window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from . import ordered
from .ordered import POINTS, bracket_rows, sketched


def order_key(id_col: str = S.ID_COL, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def _prefix52(h: Column) -> Column:
    """The key's first 52 bits, which a double holds exactly."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long")


def _at_class(label: str, values: dict, otherwise=None) -> Column:
    """The value of a row's class; a null class is one too."""
    out = F.lit(otherwise)
    for c, v in values.items():
        out = F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(v)).otherwise(out)
    return out


def allocate_test(counts: dict, test_size: float = 0.2) -> dict:
    """{class: test rows} for class sizes ``counts``."""
    n = sum(counts.values())
    if n == 0:
        return {c: 0 for c in counts}
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    fl = {c: (k * n_train) // n for c, k in counts.items()}
    rem = {c: (k * n_train) % n for c, k in counts.items()}
    need = n_train - sum(fl.values())
    for c in sorted(counts, key=lambda c: (-rem[c], c is None, 0 if c is None else c))[:need]:
        fl[c] += 1
    return {c: counts[c] - fl[c] for c in counts}


def _narrowed(points: list | None, n: int, at: int, low: int, high: int) -> tuple[int, int]:
    """A bracket that surely holds the rank ``at`` among ``n`` sketched keys (see exact_quantiles)."""
    if at < 0 or not n:   # at the lower end, or nothing between the ends
        return low, low if at < 0 else high
    if at >= n:
        return high, high
    left, right = math.floor(at / n * POINTS) - 1, math.ceil((at + 1) / n * POINTS) + 1
    return points[left] if left >= 0 else low, points[right] if right <= POINTS else high


def cut_offs(df: DataFrame, label: str = S.LABEL_COL, test_size: float = 0.2, seed: int = 42,
             id_col: str = S.ID_COL) -> dict:
    """{class: (order key, id) of the last test row}, null-free; classes without a test row are absent.

    Two passes over (label, id), and one more for each further sketch; one row for each class reaches
    the driver each time."""
    keyed = df.select(label, id_col, order_key(id_col, seed).alias("_h")).withColumn("_p", _prefix52(F.col("_h")))
    rows = keyed.groupBy(label).agg(F.count("*").alias("n"), sketched("_p").alias("points")).collect()
    test_n = allocate_test({r[label]: r["n"] for r in rows}, test_size)
    wanted = {c: t - 1 for c, t in test_n.items() if t}
    low, high, under = {c: -1 for c in wanted}, {c: 1 << 52 for c in wanted}, {c: 0 for c in wanted}
    while True:
        for r in rows:
            if r[label] in wanted:
                c = r[label]
                low[c], high[c] = _narrowed(r["points"], r["n"], wanted[c] - under[c], low[c], high[c])
        if bracket_rows(max((r["n"] for r in rows), default=0)) <= ordered.BRACKET_ROWS:
            break
        p, a, b = F.col("_p"), _at_class(label, low), _at_class(label, high)
        between = (p > a) & (p < b)
        rows = keyed.where(p < b).groupBy(label).agg(
            F.count_if(between).alias("n"), F.count_if(~between).alias("under"),
            sketched(F.when(between, p)).alias("points")).collect()
        under.update({r[label]: r["under"] for r in rows if r[label] in wanted})
    inside = F.col("_p") >= _at_class(label, low)
    counts = keyed.where(F.col("_p") <= _at_class(label, high)).groupBy(
        label, F.when(inside, F.struct("_h", F.col(id_col).alias("id"))).alias("_in")).agg(F.count("*").alias("_c"))
    end = F.sum("_c").over(Window.partitionBy(label).orderBy(F.col("_in").asc_nulls_first()))
    rank = _at_class(label, wanted)
    last = counts.withColumn("_end", end).where(
        F.col("_in").isNotNull() & (F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end"))).collect()
    return {r[label]: (r["_in"]["_h"], r["_in"]["id"]) for r in last}


def stratified_split(df: DataFrame, label: str = S.LABEL_COL, test_size: float = 0.2, seed: int = 42,
                     id_col: str = S.ID_COL) -> DataFrame:
    """Adds ``split`` = 'train' / 'test', a comparison of each row with its class's cut-off."""
    cuts = cut_offs(df, label, test_size, seed, id_col)
    h = order_key(id_col, seed)
    key, last = _at_class(label, {c: k for c, (k, _) in cuts.items()}), _at_class(label, {c: i for c, (_, i) in cuts.items()})
    test = (h < key) | ((h == key) & (F.col(id_col) <= last))
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def allocation(df: DataFrame, label: str = S.LABEL_COL, test_size: float = 0.2) -> DataFrame:
    """Class sizes of the split (label, n, n_train, n_test) from one count: no split is needed for them."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    test = allocate_test(counts, test_size)
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame([(c, n, n - test[c], test[c]) for c, n in counts.items()],
                                           f"`{label}` {kind}, n long, n_train long, n_test long")


def negative_positive_ratio(df: DataFrame, label: str = S.LABEL_COL) -> DataFrame:
    """count(0) / count(1); 1 when there is no positive (positives default to 1)."""
    y = F.col(label)
    one = df.agg(F.count_if(y == 0).alias("neg"), F.count_if(y == 1).alias("pos"))
    return one.select("neg", "pos", (F.col("neg") / F.when(F.col("pos") > 0, F.col("pos")).otherwise(F.lit(1)))
                      .alias("scale_pos_weight"))


def balanced_weights(sizes: DataFrame, label: str = S.LABEL_COL, size: str = "n_train") -> DataFrame:
    """Balanced weights n / (k * n_c) for each class (k = number of classes) from a table of class sizes."""
    from .common import attach_one_row
    some = sizes.where(F.col(size) > 0)
    tot = some.agg(F.sum(size).alias("_n"), F.count("*").alias("_k"))
    return attach_one_row(some, tot).select(
        label, F.col(size).alias("n_c"), (F.col("_n") / (F.col("_k") * F.col(size))).alias("weight"))


def class_weights(df: DataFrame, label: str = S.LABEL_COL) -> DataFrame:
    """Balanced weights of the classes of ``df``."""
    from ..session import cut_lineage
    sizes = cut_lineage(df.groupBy(label).agg(F.count("*").alias("n_train")))   # one row per class
    return balanced_weights(sizes, label)


def weight_column(df: DataFrame, weights: dict, label: str = S.LABEL_COL, name: str = "weight") -> DataFrame:
    """Per-row weight from a small {class: weight} dict."""
    return df.withColumn(name, _at_class(label, {c: float(v) for c, v in weights.items()}, 1.0))
