"""Exact order statistics without a single-task window.

A window ordered over a whole table (running sums of ROC and precision-recall curves, exact
quantiles) would put every row into one task.  Two primitives avoid this; both take the same
path whatever the number of rows or groups, and group keys may be null.

``running_totals`` cuts the order into buckets at approximate quantiles of a numeric key (a
mergeable sketch for each group).  Each bucket's totals, one small row each, become offsets by
a window over that small table; one window partitioned by (group, bucket) finishes the sums.

``exact_quantiles`` brackets and selects: a sketch bounds each wanted order statistic from
below and above, one aggregation counts the rows under the bracket and the values inside
it, and the exact rank is found among those few values.  A bracket that may hold over
``BRACKET_ROWS`` rows is sketched again inside, each time to about 1/200 of its rows, so the
window over its values never has more.  It reads the input twice, and once more for each
further sketch, and shuffles counts only.

Results are exact whatever the sketches say: they only decide how the work is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import attach_one_row

POINTS = 1000              # equally spaced quantile points kept of each group
BROADCAST_GROUPS = 10_000  # tables of one row a group are broadcast up to this many rows
BRACKET_ROWS = 200_000     # rows between the ends of a bracket, above which it is sketched again


def default_buckets(spark) -> int:
    """Two buckets for each shuffle partition: a cluster sizes those to its data."""
    return max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_groups(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of ``groups`` (one row for each key ``by``, already materialised).

    Null keys match.  The table is broadcast if it is small; with many groups, whose rows
    spread over tasks by themselves, it is joined as Spark sees fit."""
    if not by:
        return attach_one_row(df, groups)
    right = groups.select(*[F.col(g).alias(f"_g_{g}") for g in by], *[c for c in groups.columns if c not in by])
    if groups.count() <= BROADCAST_GROUPS:
        right = F.broadcast(right)
    cond = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in by]
    return df.join(right, cond).drop(*[f"_g_{g}" for g in by])


def count_below(points: Column, value: Column, size: int) -> Column:
    """How many of the sorted array ``points`` (at most ``size``) are below ``value``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(size.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(points)) & (F.get(points, at + step - 1) < value), at + step).otherwise(at))


def running_totals(df: DataFrame, order: list[Column], key: Column, sums: dict[str, str],
                   by: list[str] | None = None, n_buckets: int | None = None,
                   next_cols: list[str] | None = None) -> DataFrame:
    """Inclusive running sums in the given order within groups ``by``.

    order      sort expressions (with asc/desc); ties must be broken by them
    key        numeric column non-decreasing along ``order`` (bucketing key)
    sums       {output name: input column}; a sum keeps its type
    next_cols  also return ``next_<c>``: the value of c on the following row in order
               (null on a group's last row); needs a key that is unique per row

    ``df`` is read three times, so callers pass a materialised table.
    """
    by, b = list(by or []), "_bucket"
    n = n_buckets or default_buckets(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    sketch = cut_lineage(df.groupBy(*by).agg(
        F.array_distinct(F.percentile_approx(key.cast("double"), probs, max(10_000, 20 * n))).alias("_points")))
    bucketed = join_groups(df, sketch, by).withColumn(
        b, F.coalesce(count_below(F.col("_points"), key.cast("double"), n), F.lit(0))).drop("_points")
    totals = bucketed.groupBy(*by, b).agg(
        *[F.sum(src).alias(f"_t_{o}") for o, src in sums.items()],
        *([F.min_by(F.struct(*next_cols), key).alias("_first")] if next_cols else []))
    small = Window.partitionBy(*by).orderBy(b)   # at most n rows a group
    offsets = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in by], F.col(b).alias("_b"),
        *[F.sum(f"_t_{o}").over(small.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_o_{o}") for o in sums],
        *([F.lead("_first").over(small).alias("_following")] if next_cols else []))
    joined = bucketed.join(offsets, [F.col(b) == F.col("_b"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in by]])
    w = Window.partitionBy(*by, b).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {o: F.sum(src).over(run) + F.coalesce(F.col(f"_o_{o}"), F.lit(0)) for o, src in sums.items()}
    if next_cols:
        last = F.lead(F.lit(1)).over(w).isNull()
        new.update({f"next_{c}": F.when(last, F.col("_following")[c]).otherwise(F.lead(c).over(w)) for c in next_cols})
    return joined.withColumns(new).select(*df.columns, *new)


def sketched(value: Column | str) -> Column:
    """The equally spaced quantile points of a column, each off by at most 1/10 of their distance."""
    return F.percentile_approx(value, [i / POINTS for i in range(POINTS + 1)], 10 * POINTS)


def bracket_rows(n: int) -> int:
    """At most so many of n sketched rows lie between the ends of a bracket: five steps, and the sketch's error."""
    return 6 * n // POINTS


def _narrowed(points: Column, n: Column, at: Column, low: Column, high: Column) -> list[Column]:
    """``low`` and ``high`` of the ranks about ``at`` among ``n`` sketched rows; an end beyond the points stays as given."""
    # the ranks lie between grid points; one more on each side covers the sketch's error
    left = F.floor(F.floor(at) / n * POINTS).cast("int") - 1
    right = F.ceil((F.ceil(at) + 1) / n * POINTS).cast("int") + 1
    return [F.when(left < 0, low).otherwise(F.get(points, left)).alias("low"),
            F.when(right > POINTS, high).otherwise(F.get(points, right)).alias("high")]


def _sketched_again(src: DataFrame, wanted: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """The brackets of ``wanted`` narrowed by a sketch of the values between their ends, and the rows of the largest sketch.

    Rows equal to an end are counted, not sketched: however many they are, they are one value."""
    each = join_groups(src, wanted, by).select(*by, "_v", F.explode("_t").alias("t")).where("_v <= t.high")
    between = (F.col("_v") > F.col("t.low")) & (F.col("_v") < F.col("t.high"))
    inside = each.groupBy(*by, F.col("t").alias("t")).agg(
        F.count_if(F.col("_v") <= F.col("t.low")).alias("_under"), F.count_if(between).alias("_n"),
        sketched(F.when(between, F.col("_v"))).alias("_points"))
    at, n, low, high = F.col("t.at") - F.col("_under"), F.col("_n"), F.col("t.low"), F.col("t.high")
    first, last = _narrowed(F.col("_points"), n, at, low, high)
    ends = [F.when(F.floor(at) >= n, high).when((n == 0) | (F.ceil(at) < 0), low).otherwise(first).alias("low"),
            F.when(F.ceil(at) < 0, low).when((n == 0) | (F.floor(at) >= n), high).otherwise(last).alias("high")]
    out = cut_lineage(inside.select(*by, "_n", F.struct("t.prob", "t.at", *ends).alias("t")).groupBy(*by).agg(
        F.max("_n").alias("_n"), F.collect_list("t").alias("_t")))   # one entry a probability
    return out, out.agg(F.max("_n")).first()[0] or 0


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., prob, quantile): exact quantiles with linear interpolation between order
    statistics (the 'linear' definition), nulls ignored; no row for a group without values."""
    by = list(by or [])
    src = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    sketch = cut_lineage(src.groupBy(*by).agg(F.count("*").alias("_n"), sketched("_v").alias("_points")).where("_n > 0"))
    target = []
    for p in probs:
        at = (F.col("_n") - 1) * F.lit(float(p))
        ends = _narrowed(F.col("_points"), F.col("_n"), at, F.lit(float("-inf")), F.lit(float("nan")))   # NaN is the largest value
        target.append(F.struct(F.lit(float(p)).alias("prob"), at.alias("at"), *ends))
    wanted = cut_lineage(sketch.select(*by, "_n", F.array(*target).alias("_t")))
    rows = wanted.agg(F.max("_n")).first()[0] or 0
    while bracket_rows(rows) > BRACKET_ROWS:
        wanted, rows = _sketched_again(src, wanted, by)
    wanted = wanted.select(*by, "_t")
    hits = join_groups(src, wanted, by).select(*by, "_v", F.explode("_t").alias("t")).where("_v <= t.high")
    counts = hits.groupBy(*by, F.col("t.prob").alias("prob"), F.col("t.at").alias("_at"),
                          F.when(F.col("_v") >= F.col("t.low"), F.col("_v")).alias("_in")) \
        .agg(F.count("*").alias("_c"))   # the rows under the bracket are one count, with a null value
    end = F.sum("_c").over(Window.partitionBy(*by, "prob").orderBy(F.col("_in").asc_nulls_first()))
    placed = counts.withColumn("_end", end).where(F.col("_in").isNotNull())
    first, second = F.floor("_at"), F.ceil("_at")
    holds = lambda r: (F.col("_end") - F.col("_c") <= r) & (r < F.col("_end"))
    found = placed.groupBy(*by, "prob", "_at").agg(F.max(F.when(holds(first), F.col("_in"))).alias("_lo"),
                                                   F.max(F.when(holds(second), F.col("_in"))).alias("_hi"))
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - first)
    return found.select(*by, "prob", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias("quantile"))
