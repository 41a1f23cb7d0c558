"""Second-order boosting against a plain version that adds up every node's rows."""

import numpy as np
import pytest

from leadlens.operators.boosting import BoostedTrees
from leadlens.operators.trees import score_trees
from pyspark.sql import functions as F


def made(seed, n=500):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 2, n)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.6 * x[:, 0] - 3 + x[:, 1] * (2 * x[:, 2] - 1))))).astype(float)
    return x, y, np.where(y == 1, 1.7, 1.0)


def plain(x, y, w, cuts, rounds, rate, depth, lam=1.0, least=1.0):
    """Margins after ``rounds``: every node looks at its own rows for every cut."""
    margin = np.zeros(len(y))
    worth = lambda r, g, h: g[r].sum() ** 2 / (h[r].sum() + lam)

    def grow(rows, left, g, h, out):
        best = None
        if left:
            for f, points in enumerate(cuts):
                for k, t in enumerate(points):
                    a, b = rows[x[rows, f] <= t], rows[~(x[rows, f] <= t)]
                    if h[a].sum() >= least and h[b].sum() >= least:
                        gain = round(worth(a, g, h) + worth(b, g, h) - worth(rows, g, h), 6)
                        if gain > 1e-6 and (best is None or gain > best[0]):
                            best = (gain, a, b)
        if best is None:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + lam)
        else:
            grow(best[1], left - 1, g, h, out)
            grow(best[2], left - 1, g, h, out)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        grow(np.arange(len(y)), depth, w * (p - y), w * p * (1 - p), out)
        margin = margin + out
    return margin


def frame(spark, x, y, w):
    return spark.createDataFrame([(i, r.tolist(), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, w))],
                                 "id long, features array<double>, converteu double, pos_weight double").repartition(5)


@pytest.mark.parametrize("seed,depth,refresh", [(0, 2, 20), (1, 4, 2)])
def test_rounds_equal_the_plain_version(spark, seed, depth, refresh):
    x, y, w = made(seed)
    cuts = [[1.0, 3.0, 5.0, 7.0], [-1.0, -0.3, 0.0, 0.4, 1.2], [0.0], [0.0]]
    df = frame(spark, x, y, w)
    model = BoostedTrees(rounds=5, rate=0.3, depth=depth, cuts=cuts, refresh=refresh).fit(df)
    assert len(model.root) == 5
    want = plain(x, y, w, cuts, 5, 0.3, depth)
    assert np.allclose(model.sums(x), want, atol=1e-9)
    got = {r.id: r.score for r in score_trees(df, model, F.col("features"), ["id"]).collect()}
    assert all(abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9 for i, z in enumerate(want))


def test_quantile_cuts_learn_and_unknown_values_go_right(spark):
    x, y, w = made(3, 800)
    x[::17, 1] = np.nan
    df = frame(spark, x, y, w)
    df = df.withColumn("features", F.transform("features", lambda v: F.when(~F.isnan(v), v)))
    model = BoostedTrees(rounds=12, depth=3, rate=0.3, bins=16).fit(df)
    s = model.sums(x)
    order = np.argsort(s)
    ranks = np.empty(len(s))
    ranks[order] = np.arange(len(s))
    pos = y == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.8
    assert np.isfinite(s).all()


def test_one_class_and_no_rows(spark):
    x, y, w = made(4, 40)
    df = frame(spark, x, np.ones(40), w)
    model = BoostedTrees(rounds=2, depth=2, cuts=[[1.0], [0.0], [0.0], [0.0]]).fit(df)
    assert (model.sums(x) > 0).all()
    with pytest.raises(ValueError):
        BoostedTrees(rounds=1).fit(df.limit(0))


def test_a_pass_is_one_job_over_held_blocks_of_enough_rows(spark, monkeypatch):
    from leadlens.operators import boosting as B
    x, y, w = made(5)
    seen, histograms = [], BoostedTrees.histograms
    monkeypatch.setattr(BoostedTrees, "histograms", lambda self, blocks, *a: seen.append(
        (blocks.is_cached, blocks.getNumPartitions())) or histograms(self, blocks, *a))
    df, kw = frame(spark, x, y, w), dict(rounds=3, depth=2, cuts=[[1.0, 4.0], [0.0], [0.0], [0.0]], refresh=2)
    few = BoostedTrees(**kw).fit(df)
    assert set(seen) == {(True, 1)}          # five small partitions, one task
    seen.clear()
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    many = BoostedTrees(**kw).fit(df)
    assert set(seen) == {(True, 5)} and (few.feature == many.feature).all() and np.allclose(few.value, many.value)
    monkeypatch.setattr(B, "DIRECT_BYTES", 0)   # sums met in tasks
    assert np.allclose(BoostedTrees(**kw).fit(df).value, many.value)


def test_given_cuts_and_no_rows_add_nothing(spark):
    x, y, w = made(6, 20)
    df = frame(spark, x, y, w).where("id < 0")
    model = BoostedTrees(rounds=2, depth=2, cuts=[[1.0], [0.0], [0.0], [0.0]]).fit(df)
    assert (model.sums(x) == 0).all()
    assert (BoostedTrees(rounds=1, depth=2, cuts=[[1.0], [0.0], [0.0], [0.0]]).fit(df.limit(0)).sums(x) == 0).all()


def test_rounds_in_one_task_equal_passes(spark, monkeypatch):
    from leadlens.operators import boosting as B
    x, y, w = made(7, 600)
    passes, histograms = [], BoostedTrees.histograms
    monkeypatch.setattr(BoostedTrees, "histograms", lambda self, *a: passes.append(1) or histograms(self, *a))
    kw = dict(rounds=6, rate=0.3, depth=3, cuts=[[1.0, 3.0, 5.0, 7.0], [-1.0, -0.3, 0.0, 0.4, 1.2], [0.0, 1.0], []])
    one = BoostedTrees(**kw).fit(frame(spark, x, y, w))
    assert len(passes) <= 3             # those of the first round, whatever the rounds
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    many = BoostedTrees(**kw).fit(frame(spark, x, y, w))
    assert len(passes) > 12 and (one.feature == many.feature).all() and (one.threshold == many.threshold).all()
    assert np.allclose(one.value, many.value, atol=1e-12)
    want = plain(x, y, w, kw["cuts"], 6, 0.3, 3)
    assert np.allclose(one.sums(x), want, atol=1e-9)
