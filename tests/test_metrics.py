import numpy as np
import pytest

from leadlens.operators import metrics as M

SCORED = [  # id, y, score: 0, 0.3, 0.6, 1, exact ties, values next to the float thresholds
    (1, 0, 0.0), (2, 1, 0.3), (3, 0, 0.3), (4, 1, 0.6), (5, 0, 0.6), (6, 1, 1.0), (7, 0, 0.7),
    (8, 1, 0.7000000000000001), (9, 0, 0.30000000000000004), (10, 0, 0.1), (11, 1, 0.45), (12, 0, 0.45),
    (13, 0, 0.2), (14, 1, 0.9), (15, 0, 0.05), (16, 0, 0.45),
]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(SCORED, "id long, converteu int, score double")


def _arrays():
    y = np.array([r[1] for r in SCORED])
    s = np.array([r[2] for r in SCORED])
    return y, s


def _curve(y, s):
    """Distinct thresholds descending with cumulative tp / fp (reference definition)."""
    th = np.unique(s)[::-1]
    tps = np.array([((s >= t) & (y == 1)).sum() for t in th])
    fps = np.array([((s >= t) & (y == 0)).sum() for t in th])
    return th, tps, fps


def test_auc_equals_pair_count(scored):
    y, s = _arrays()
    pos, neg = s[y == 1], s[y == 0]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(M.roc_auc(scored).collect()[0]["auc"] - pairs) < 1e-12


def test_auc_ap_one_pass(scored):
    r = M.auc_ap(scored).collect()[0]
    assert r["auc"] == M.roc_auc(scored).collect()[0]["auc"]
    assert abs(r["avg_precision"] - M.average_precision(scored).collect()[0]["avg_precision"]) < 1e-15


def test_average_precision_stepwise(scored):
    y, s = _arrays()
    th, tps, fps = _curve(y, s)
    prec, rec = tps / (tps + fps), tps / tps[-1]
    ap = np.sum(np.diff(np.r_[0, rec]) * prec)
    assert abs(M.average_precision(scored).collect()[0]["avg_precision"] - ap) < 1e-12


def test_roc_points_drop_intermediate(scored):
    y, s = _arrays()
    th, tps, fps = _curve(y, s)
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    exp = [(np.inf, 0.0, 0.0)] + [(th[i], fps[i] / fps[-1], tps[i] / tps[-1]) for i in keep]
    got = sorted((r.threshold, r.fpr, r.tpr) for r in M.roc_points(scored).collect())
    assert len(got) == len(exp)
    for a, b in zip(got, sorted(exp)):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 and abs(a[2] - b[2]) < 1e-12
    assert M.roc_points(scored, drop_intermediate=False).count() == len(th) + 1


def test_pr_points_close_at_recall_zero(scored):
    rows = M.pr_points(scored).collect()
    assert any(r.threshold is None and r.precision == 1.0 and r.recall == 0.0 for r in rows)
    assert len(rows) == len(np.unique(_arrays()[1])) + 1


def test_confusion_and_report(scored):
    c = M.confusion(scored).collect()[0]
    y, s = _arrays()
    p = (s > 0.5).astype(int)
    assert (c.tn, c.fp, c.fn, c.tp) == (((y == 0) & (p == 0)).sum(), ((y == 0) & (p == 1)).sum(),
                                        ((y == 1) & (p == 0)).sum(), ((y == 1) & (p == 1)).sum())
    rep = {r.label: r for r in M.class_report(scored).collect()}
    tp, fp = c.tp, c.fp
    assert abs(rep["1"].precision - tp / (tp + fp)) < 1e-12
    assert rep["accuracy"].f1 == pytest.approx((c.tp + c.tn) / len(SCORED))


def test_sweep_uses_float_thresholds(scored):
    rows = {r.threshold: r for r in M.impact_sweep(scored).collect()}
    y, s = _arrays()
    assert rows[0.3].leads_contatados == int((s >= 0.30000000000000004).sum())   # 0.3 itself is below
    assert rows[0.7].leads_contatados == int((s >= 0.7000000000000001).sum())
    counts = [rows[t].leads_contatados for t in sorted(rows)]
    assert counts == sorted(counts, reverse=True)
    r = rows[0.5]
    assert r.leads_mensal_projetado == int(r.leads_contatados * (1200 / len(SCORED)))


def test_density_integrates_to_one(scored):
    d = M.density_by_class(scored, "score", bins=40).toPandas()
    for _, g in d.groupby("label"):
        assert len(g) == 40
        assert abs(((g.bin_hi - g.bin_lo) * g.density).sum() - 1) < 1e-9


def test_edge_cases(spark):
    one_class = spark.createDataFrame([(1, 0.2), (1, 0.4)], "converteu int, score double")
    assert M.roc_auc(one_class).collect()[0]["auc"] is None
    equal = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "converteu int, score double")
    assert M.roc_auc(equal).collect()[0]["auc"] == 0.5
    empty = spark.createDataFrame([], "converteu int, score double")
    assert M.impact_sweep(empty).count() == 9
    single = spark.createDataFrame([(1, 0.9)], "converteu int, score double")
    assert M.average_precision(single).collect()[0]["avg_precision"] == 1.0


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40))
def test_auc_ap_properties(spark, pairs):
    y = np.array([p[0] for p in pairs])
    s = np.array([p[1] / 6 for p in pairs])               # many ties by construction
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "converteu int, score double")
    auc = M.roc_auc(df).collect()[0]["auc"]
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        assert auc is None
    else:
        exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(auc - exp) < 1e-12
        th = np.unique(s)[::-1]
        tps = np.array([((s >= t) & (y == 1)).sum() for t in th])
        fps = np.array([((s >= t) & (y == 0)).sum() for t in th])
        ap = np.sum(np.diff(np.r_[0, tps / tps[-1]]) * tps / (tps + fps))
        assert abs(M.average_precision(df).collect()[0]["avg_precision"] - ap) < 1e-12


def test_evaluation_bundle(scored):
    b = M.evaluation_bundle(scored)
    assert set(b) >= {"auc_roc", "avg_precision", "confusion", "class_report", "roc_points", "pr_points", "impact"}
    assert b["auc_roc"].collect()[0]["auc"] == M.roc_auc(scored).collect()[0]["auc"]
    assert b["impact"].count() == 9
