"""Forests without a depth limit: exact on deep fixtures, bounded tasks, equal on any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlens.operators import forest as FO


def frame(spark, x, y, parts=4):
    rows = [(i, r.tolist(), float(t), 1.0) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "lead_id long, features array<double>, converteu double, weight double").repartition(parts)


def depth(e, node):
    best, todo = 0, [(int(node), 0)]
    while todo:
        at, n = todo.pop()
        best = max(best, n)
        if e.feature[at] >= 0:
            todo += [(int(e.left[at]), n + 1), (int(e.right[at]), n + 1)]
    return best


def chain(n=45):
    """One feature, alternating labels with weights that make every best split peel off the largest value."""
    return np.arange(n, dtype=float)[:, None], np.arange(n) % 2.0, 3.0 ** np.arange(n)


def test_a_chain_of_more_than_forty_levels_is_fitted_exactly():
    x, y, w = chain()
    nodes = FO.subtree(x, y, w, 1, 0, 0, 0)
    f, t, left, right, value = (np.array(c) for c in zip(*nodes))
    e = FO.TreeEnsemble(["x"], np.array([0]), f, t, left, right, np.where(f < 0, value, 0.0))
    assert depth(e, 0) >= 40 and (e.sums(x) == y).all()


def test_a_deep_forest_through_spark_is_exact(spark):
    x, y, w = chain()
    df = frame(spark, x, y).withColumn("weight", F.pow(F.lit(3.0), F.col("lead_id").cast("double")))
    e = FO.DeepForest(trees=2, bootstrap=False).fit(df)
    assert depth(e, e.root[1]) >= 40 and np.allclose(e.sums(x), y)


def test_large_nodes_are_split_by_passes_and_tasks_stay_bounded(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=1500), rng.integers(0, 4, 1500), rng.normal(size=1500)])
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 1)).astype(float)
    df = frame(spark, x, y)
    est = FO.DeepForest(trees=3, local_rows=150, pass_nodes=2, bins=16, max_features=3, bootstrap=False)
    rows = df.select(F.col("features").alias("x"), F.col("converteu").alias("y"), F.col("weight").alias("w"), F.col("lead_id").alias("k"))
    top, closed = est.large_nodes(rows, 3, 1500, 3)
    assert all(len(t) > 10 for t in top)
    for t, leaves in zip(top, closed):
        at = FO._locate(t, x)
        assert all((at == n).sum() <= 150 or n in leaves for n in set(at.tolist()))
        assert all(len(set(y[at == n])) == 1 and y[at == n][0] == v for n, v in leaves.items())
    largest = est.local_nodes(rows, top, closed, 3, 3).groupBy("tree", "node").count()
    assert largest.count() == sum(len(set(FO._locate(t, x).tolist()) - set(c)) for t, c in zip(top, closed))
    assert (np.round(est.fit(df).sums(x)) == y).all()


def test_a_fit_does_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    a, b = (FO.DeepForest(trees=6, local_rows=r).fit(frame(spark, x, y, p)) for r, p in ((10_000, 1), (10_000, 7)))
    assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and np.allclose(a.value, b.value)
    s = a.sums(x)
    assert ((s >= 0) & (s <= 1)).all() and ((s > 0.5) == y).mean() > 0.9


def test_draws_are_poisson():
    c = FO.copies(np.arange(200_000), 3, 42)
    assert abs(c.mean() - 1) < 0.01 and abs((c == 0).mean() - np.exp(-1)) < 0.005
    assert not (c == FO.copies(np.arange(200_000), 4, 42)).all()


def test_defined_cases(spark):
    x = np.array([[1.0], [1.0], [1.0]])
    e = FO.DeepForest(trees=1, bootstrap=False).fit(frame(spark, x, np.array([0.0, 1.0, 1.0])))
    assert e.sums(x) == pytest.approx([2 / 3] * 3)      # nothing to split by
    with pytest.raises(ValueError):
        FO.DeepForest(trees=1).fit(frame(spark, x, np.zeros(3)).limit(0))
    with pytest.raises(ValueError):
        FO.DeepForest(trees=1).fit(frame(spark, x * np.nan, np.zeros(3)))


def test_a_forest_of_more_nodes_than_one_broadcast_stays_in_a_table_and_scores_the_same(spark, monkeypatch):
    from leadlens.operators import trees as TT
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 0.4).astype(float)
    df = frame(spark, x, y)
    est = FO.DeepForest(trees=5, local_rows=100, bins=16)
    whole = est.fit(df)
    assert isinstance(whole, FO.TreeEnsemble)
    monkeypatch.setattr(TT, "MAX_NODES", len(whole.feature) // 2)
    stored = est.fit(df)
    assert isinstance(stored, FO.StoredTrees) and len(stored.ranges()) > 1 and sum(stored.sizes) == len(whole.feature)
    for e in (stored, FO.StoredTrees.from_frame(stored.to_frame(spark))):
        got = {r.lead_id: r.score for r in TT.score_trees(df, e, F.col("features"), ["lead_id"]).collect()}
        assert [got[i] for i in range(300)] == whole.sums(x).tolist()
        some = df.where("lead_id < 8")
        impacts = {r.lead_id: r.impacts for r in TT.tree_impacts(some, e, some, F.col("features"), ["lead_id"]).collect()}
        assert np.allclose([impacts[i] for i in range(8)], whole.impacts(x[:8], x[:8]))


def plain_subtree(x, y, w, tried, seed):
    """One feature and one node at a time, on the values themselves."""
    out, todo = [], [(np.arange(len(y)), None)]
    while todo:
        rows, parent = todo.pop()
        at, one, all_ = len(out), float(w[rows] @ y[rows]), float(w[rows].sum())
        out.append([-1, 0.0, -1, -1, one / all_])
        if parent is not None:
            out[parent[0]][parent[1]] = at
        if one <= 0 or one >= all_:
            continue
        best, seen = None, 0
        for f in np.random.default_rng([seed, 0, at]).permutation(x.shape[1]):
            v = np.unique(x[rows, f])
            if len(v) < 2 or seen == tried:
                continue
            seen += 1
            for low, high in zip(v, v[1:]):
                left = rows[x[rows, f] <= low]
                a, b = w[left].sum(), w[left] @ y[left]
                cost = FO._gini(b, a) + FO._gini(one - b, all_ - a)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, low + (high - low) / 2)
        if best is None:
            continue
        out[at][:2] = [int(best[1]), float(best[2])]
        low = x[rows, best[1]] <= best[2]
        todo += [(rows[~low], (at, 3)), (rows[low], (at, 2))]
    return [tuple(n) for n in out]


def test_subtrees_equal_a_plain_version_for_small_and_large_nodes(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 5, 400), rng.integers(0, 2, (400, 4))]).astype(float)
    y, w = (rng.random(400) < 0.3).astype(float), rng.integers(1, 4, 400).astype(float)
    want = plain_subtree(x, y, w, 3, 9)
    assert FO.subtree(x, y, w, 3, 9, 0, 0) == want
    monkeypatch.setattr(FO, "TOGETHER", 20)
    assert FO.subtree(x, y, w, 3, 9, 0, 0) == want


def test_small_nodes_take_their_features_in_one_go(monkeypatch):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(1000, 9)), (rng.random(1000) < 0.5).astype(float)
    calls, cheapest = [], FO._cheapest
    monkeypatch.setattr(FO, "_cheapest", lambda v, *a: calls.append(v.shape) or cheapest(v, *a))
    nodes = FO.subtree(x, y, np.ones(1000), 3, 0, 0, 0)
    assert len(calls) == sum(n[0] >= 0 for n in nodes) and {c for _, c in calls} == {3}


def test_orders_made_together_are_those_of_the_generator():
    from leadlens.operators import subtrees as ST
    rng = np.random.default_rng(8)
    trees, nodes = rng.integers(0, 200, 400), rng.integers(0, 1 << 32, 400)
    for d in (1, 2, 9, 32):
        assert (ST.orders(d, 42, trees, nodes) == [ST.order(d, 42, int(t), int(k)) for t, k in zip(trees, nodes)]).all()
    assert (ST.orders(5, 1 << 40, trees[:3], nodes[:3]) == [ST.order(5, 1 << 40, int(t), int(k)) for t, k in zip(trees, nodes[:3])]).all()


def test_subtrees_grown_side_by_side_equal_those_grown_alone(monkeypatch):
    from leadlens.operators import subtrees as ST
    rng = np.random.default_rng(9)
    n = 900
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.integers(0, 2, (n, 5)), np.ones(n)]).astype(float)
    y = (rng.random(n) < 0.3).astype(float)
    w = np.where(y == 1, 4.185559818625741, 0.5678323001940093)
    values, codes = zip(*(np.unique(v, return_inverse=True) for v in x.T))
    data, calls, split = ST.Rows.of(codes, list(values), n), [], ST._Lanes.split
    monkeypatch.setattr(ST._Lanes, "split", lambda self, lanes: calls.append(len(lanes)) or split(self, lanes))
    drawn = [(t, node, FO.copies(np.arange(n), t, 3)) for t in range(12) for node in (0, 7)]
    members = [ST.Member(t, node, np.flatnonzero(c), (w * c)[c > 0]) for t, node, c in drawn]
    member, local, *columns = ST.grow(data, y, members, 3, 3)
    for m, (t, node, c) in enumerate(drawn):
        some = c > 0
        got = [tuple(v) for v in zip(*(k[member == m].tolist() for k in columns))]
        assert got == FO.subtree(x[some], y[some], (w * c)[some], 3, 3, t, node)
    inner = int((columns[0] >= 0).sum())
    assert len(calls) * 4 < inner and max(calls) > 4      # many nodes a call


def test_a_task_grows_a_group_and_rows_come_once(spark):
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=(300, 4)), (rng.random(300) < 0.4).astype(float)
    df = frame(spark, x, y)
    fits = [FO.DeepForest(trees=6, group_rows=g, local_rows=100, bins=16, spare=s).fit(df) for g, s in ((200, 0), (10_000, 0), (10_000, 3))]
    for e in fits[1:]:       # the same forest, however its subtrees are put together
        assert (e.feature == fits[0].feature).all() and (e.threshold == fits[0].threshold).all() and (e.value == fits[0].value).all()
    est = FO.DeepForest(trees=6, group_rows=200)
    rows = df.select(F.col("features").alias("x"), F.col("converteu").alias("y"), F.col("weight").alias("w"), F.col("lead_id").alias("k"))
    top, none = [[[-1, 0.0, -1, -1]] for _ in range(6)], [{} for _ in range(6)]
    groups = est.groups(rows, top, none, 4)
    assert sorted(v for g in groups for v in g) == [(t, 0) for t in range(6)] and len(groups) == 6
    assert len(FO.DeepForest(trees=6, spare=3).groups(rows, top, none, 4)) == 1


def test_a_forest_is_sent_out_in_small_parts_of_whole_trees(spark, monkeypatch):
    from leadlens.operators import trees as TT
    e = FO.StoredTrees(["x"], spark.createDataFrame([], FO.NODE_ROWS), [200_000] * 5 + [3_000_000, 200_000])
    assert e.ranges() == [(0, 2), (2, 4), (4, 5), (5, 6), (6, 7)] and e.loaded() is e
    assert max(sum(e.sizes[a:b]) for a, b in e.ranges() if b > a + 1) <= TT.PART_NODES
