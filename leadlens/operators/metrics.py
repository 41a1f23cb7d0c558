"""Evaluation of a scored table (one row per lead: score, 0/1 label).

Every curve metric first reduces the table to one row per distinct score
(partial aggregation), then uses ``ordered.running_totals`` for the running
sums, so no step needs all rows in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import attach_one_row
from .ordered import running_totals


def score_counts(df: DataFrame, score: str = "score", label: str = "converteu",
                 key: str | None = None) -> DataFrame:
    """(key, score, pos, neg) per distinct threshold.

    ``key`` is an optional column strictly increasing with the score (for a
    logistic score, its log-odds) that defines the distinct thresholds; it lets
    two engines whose ``exp`` differ in the last bit agree on ties."""
    y = F.col(label).cast("long")
    k = F.col(key or score)
    df = df.where(k.isNotNull() & F.col(score).isNotNull() & y.isNotNull())
    return df.groupBy(k.alias("key")).agg(
        F.max(F.col(score)).alias("score"), F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))


def curve(df: DataFrame, score: str = "score", label: str = "converteu", key: str | None = None) -> DataFrame:
    """The threshold table under every curve metric: key, score, pos, neg, running tps and fps, next_pos, next_neg.

    One row per distinct threshold, materialised once in the shared folder: the bucketing
    passes read this reduced table, not the source.  Each metric below takes it as ``table``."""
    sc = cut_lineage(score_counts(df, score, label, key))
    return running_totals(sc, [F.col("key").desc()], -F.col("key"), {"tps": "pos", "fps": "neg"}, next_cols=["pos", "neg"])


def roc_auc(df: DataFrame, score: str = "score", label: str = "converteu",
            key: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """AUC-ROC with ties counted half: sum over distinct scores of
    pos(s) * (negatives below s + neg(s)/2), over P*N.  One row ``auc``
    (null when a class is absent)."""
    rt = table or curve(df, score, label, key)
    # fps is the count of negatives with score >= s, so negatives strictly
    # below s = N - fps.
    tot = rt.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                 F.sum(F.col("pos") * (F.col("fps") - F.lit(0.5) * F.col("neg"))).alias("above"))
    # pairs won = pos * (N - fps + neg/2) summed = P*N - sum(pos*(fps - neg/2))
    auc = (F.col("P") * F.col("N") - F.col("above")) / (F.col("P") * F.col("N"))
    return tot.select(F.when((F.col("P") > 0) & (F.col("N") > 0), auc).alias("auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "converteu",
                      key: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """Step-wise average precision: sum over thresholds of (R_k - R_{k-1}) * P_k
    (no interpolation).  One row ``avg_precision``; 0 when there is no positive."""
    rt = table or curve(df, score, label, key)
    tot = rt.agg(F.sum("pos").alias("P"),
                 F.sum(F.col("pos") * (F.col("tps") / (F.col("tps") + F.col("fps")))).alias("s"))
    return tot.select(F.when(F.col("P") > 0, F.col("s") / F.col("P")).otherwise(F.lit(0.0)).alias("avg_precision"))


def auc_ap(df: DataFrame, score: str = "score", label: str = "converteu", key: str | None = None,
           table: DataFrame | None = None) -> DataFrame:
    """AUC-ROC and step-wise average precision from one curve pass: one row
    (auc, avg_precision)."""
    rt = table or curve(df, score, label, key)
    t = rt.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
               F.sum(F.col("pos") * (F.col("fps") - F.lit(0.5) * F.col("neg"))).alias("above"),
               F.sum(F.col("pos") * (F.col("tps") / (F.col("tps") + F.col("fps")))).alias("s"))
    pn = F.col("P") * F.col("N")
    return t.select(F.when((F.col("P") > 0) & (F.col("N") > 0), (pn - F.col("above")) / pn).alias("auc"),
                    F.when(F.col("P") > 0, F.col("s") / F.col("P")).otherwise(F.lit(0.0)).alias("avg_precision"))


def predict(score: str = "score", threshold: float = 0.5):
    """Hard prediction: positive when the probability is above the cut."""
    return F.when(F.col(score) > F.lit(threshold), F.lit(1)).otherwise(F.lit(0))


def confusion(df: DataFrame, score: str = "score", label: str = "converteu",
              threshold: float = 0.5) -> DataFrame:
    """One row: tn, fp, fn, tp."""
    p, y = predict(score, threshold), F.col(label)
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def _safe_div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def class_report(df: DataFrame, score: str = "score", label: str = "converteu",
                 threshold: float = 0.5) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and
    weighted means (zero denominators give 0).  Rows keyed by ``label``;
    the accuracy row carries the accuracy in ``f1`` as a text report does."""
    c = confusion(df, score, label, threshold)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def prf(tp_, fp_, fn_):
        pr = _safe_div(tp_, tp_ + fp_)
        rc = _safe_div(tp_, tp_ + fn_)
        f1 = _safe_div(2 * pr * rc, pr + rc)
        return pr, rc, f1

    p0, r0, f0 = prf(tn, fn, fp)
    p1, r1, f1 = prf(tp, fp, fn)
    s0, s1 = tn + fp, tp + fn
    w = c.select(
        p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"),
        _safe_div(tp + tn, n).alias("acc"), n.alias("n"))

    def row(lbl, pr, rc, f, sup):
        return F.struct(F.lit(lbl).alias("label"), pr.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        sup.cast("long").alias("support"))

    P = F.col
    rows = F.array(
        row("0", P("p0"), P("r0"), P("f0"), P("s0")),
        row("1", P("p1"), P("r1"), P("f1"), P("s1")),
        row("accuracy", F.lit(None), F.lit(None), P("acc"), P("n")),
        row("macro avg", (P("p0") + P("p1")) / 2, (P("r0") + P("r1")) / 2, (P("f0") + P("f1")) / 2, P("n")),
        row("weighted avg", _safe_div(P("p0") * P("s0") + P("p1") * P("s1"), P("n")),
            _safe_div(P("r0") * P("s0") + P("r1") * P("s1"), P("n")),
            _safe_div(P("f0") * P("s0") + P("f1") * P("s1"), P("n")), P("n")),
    )
    return w.select(F.inline(rows))


def roc_points(df: DataFrame, score: str = "score", label: str = "converteu",
               drop_intermediate: bool = True, key: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """ROC curve: (threshold, fpr, tpr) per distinct score, descending, with an
    opening (0, 0) point at an infinite threshold.  ``drop_intermediate``
    removes points collinear with both neighbours (the own counts of the next
    point equal the own counts of this one).  The rate of an absent class is null."""
    rt = table or curve(df, score, label, key)
    P_N = rt.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pts = rt
    if drop_intermediate:
        first = (F.col("tps") + F.col("fps")) == (F.col("pos") + F.col("neg"))
        last = F.col("next_pos").isNull()
        change = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        pts = rt.filter(first | last | change)
    pts = pts.select(F.col("score").cast("double").alias("threshold"), "tps", "fps")
    spark = df.sparkSession
    opening = spark.createDataFrame([(float("inf"), 0, 0)], "threshold double, tps long, fps long")
    allp = attach_one_row(opening.unionByName(pts), P_N)
    return allp.select("threshold", F.when(F.col("N") > 0, F.col("fps") / F.col("N")).alias("fpr"),
                       F.when(F.col("P") > 0, F.col("tps") / F.col("P")).alias("tpr"))


def pr_points(df: DataFrame, score: str = "score", label: str = "converteu",
              key: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """Precision-recall curve: (threshold, precision, recall) per distinct score
    plus the closing (precision 1, recall 0) point with a null threshold."""
    rt = table or curve(df, score, label, key)
    P_N = rt.agg(F.sum("pos").alias("P"))
    pts = rt.select(F.col("score").cast("double").alias("threshold"),
                    _safe_div(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"), "tps")
    pts = attach_one_row(pts, P_N).select(
        "threshold", "precision",
        F.when(F.col("P") > 0, F.col("tps") / F.col("P")).otherwise(F.lit(1.0)).alias("recall"))
    closing = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(closing)


def sweep_thresholds(start: float = 0.1, stop: float = 1.0, step: float = 0.1) -> list[float]:
    """Thresholds exactly as an arange of floats produces them (0.3 is
    0.30000000000000004, 0.7 is 0.7000000000000001)."""
    return [float(x) for x in np.arange(start, stop, step)]


def impact_sweep(df: DataFrame, score: str = "score", label: str = "converteu",
                 monthly_leads: int = 1200, thresholds: list[float] | None = None,
                 digits: int | None = None) -> DataFrame:
    """Business impact per threshold t (score >= t contacted): contacted,
    conversions, conversion rate in the group, relative effort, and monthly
    projections truncated to whole leads.  One pass of conditional sums over
    the table, then one row per threshold."""
    ts = thresholds or sweep_thresholds()
    s, y = F.col(score), F.col(label).cast("long")
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, t in enumerate(ts):
        aggs += [F.count_if(s >= F.lit(t)).alias(f"c{i}"),
                 F.sum(F.when(s >= F.lit(t), y).otherwise(F.lit(0))).alias(f"m{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(round(t, 1)).alias("threshold"), F.col(f"c{i}").alias("contacted"),
                              F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("conv"))
                     for i, t in enumerate(ts)])
    long = one.select("total", F.inline(rows))
    total, c, m = F.col("total"), F.col("contacted"), F.col("conv")
    factor = F.when(total > 0, F.lit(float(monthly_leads)) / total).otherwise(F.lit(0.0))
    rate = F.when(c > 0, m / c).otherwise(F.lit(0.0))
    effort = F.when(total > 0, c / total).otherwise(F.lit(0.0))
    if digits is not None:
        rate, effort = F.round(rate, digits), F.round(effort, digits)
    return long.select(
        "threshold", c.cast("long").alias("leads_contatados"), m.cast("long").alias("matriculas_esperadas"),
        rate.alias("taxa_conversao_grupo"), effort.alias("esforco_relativo"),
        (c * factor).cast("long").alias("leads_mensal_projetado"),
        (m * factor).cast("long").alias("matriculas_mensal_projetado"))


def density_by_class(df: DataFrame, value: str, label: str = "converteu", bins: int = 40) -> DataFrame:
    """Density histogram per class over each class's own [min, max] range
    (equal-width bins, last bin closed; a constant class uses min-0.5..max+0.5).
    Returns every bin, empty ones included: (label, bin, bin_lo, bin_hi, count, density).

    Two passes: the per-class ranges (one row per class, collected), then the
    bin counts with those ranges as literals."""
    x = F.col(value).cast("double")
    d = df.where(F.col(value).isNotNull()).select(F.col(label).alias("label"), x.alias("x"))
    ranges = d.groupBy("label").agg(F.min("x").alias("mn"), F.max("x").alias("mx"),
                                    F.count(F.lit(1)).alias("n")).collect()
    spark = df.sparkSession
    lo_hi = {}
    for r in ranges:
        lo, hi = (r["mn"] - 0.5, r["mx"] + 0.5) if r["mn"] == r["mx"] else (r["mn"], r["mx"])
        lo_hi[r["label"]] = (lo, hi, r["n"])
    schema = "label {}, bin int, lo double, hi double, n long".format(
        dict(df.select(F.col(label)).dtypes)[label])
    grid = spark.createDataFrame([(k, b, lo, hi, n) for k, (lo, hi, n) in lo_hi.items() for b in range(bins)],
                                 schema)
    if not lo_hi:
        return grid.select("label", "bin", F.col("lo").alias("bin_lo"), F.col("hi").alias("bin_hi"),
                           F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("density"))

    def per_class(i):
        e = None
        for k, t in lo_hi.items():
            cond = F.col("label") == F.lit(k)
            e = F.when(cond, F.lit(t[i])) if e is None else e.when(cond, F.lit(t[i]))
        return e

    lo, hi = per_class(0), per_class(1)
    nb = F.lit(bins)
    idx = F.floor((F.col("x") - lo) * (nb / (hi - lo))).cast("int")
    counts = d.select("label", F.least(idx, nb - 1).alias("bin")).groupBy("label", "bin") \
              .agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("hi") - F.col("lo")) / nb
    out = grid.join(counts, ["label", "bin"], "left")      # grid: classes x bins rows
    cnt = F.coalesce(F.col("count"), F.lit(0)).cast("long")
    return out.select("label", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                      (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), cnt.alias("count"),
                      (cnt / (F.col("n") * (F.col("hi") - F.col("lo")) / nb)).alias("density"))


def evaluation_bundle(df: DataFrame, score: str = "score", label: str = "converteu",
                      threshold: float = 0.5) -> dict[str, DataFrame]:
    """All evaluation tables of one scored table.  The two columns and the curve are
    materialised once in the shared folder; every table below reads those."""
    base = cut_lineage(df.select(F.col(score).alias("score"), F.col(label).alias("converteu")))
    table = cut_lineage(curve(base))
    return {
        "auc_ap": auc_ap(base, table=table), "auc_roc": roc_auc(base, table=table),
        "avg_precision": average_precision(base, table=table),
        "confusion": confusion(base, threshold=threshold),
        "class_report": class_report(base, threshold=threshold),
        "roc_points": roc_points(base, table=table), "pr_points": pr_points(base, table=table),
        "impact": impact_sweep(base),
    }
