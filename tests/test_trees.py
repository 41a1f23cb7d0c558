"""Node tables: scores, and exact attributions against all coalitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from leadlens.operators import trees as TT
from leadlens.sources.io import load_model, save_model


def random_tree(rng, depth, names):
    if depth == 0 or rng.random() < 0.15:
        return float(rng.normal())
    return (names[rng.integers(len(names))], float(rng.integers(0, 6)) + 0.5 * (rng.random() < 0.5),
            random_tree(rng, depth - 1, names), random_tree(rng, depth - 1, names))


def walk(node, row, names):
    while isinstance(node, tuple):
        f, t, low, high = node
        node = low if row[names.index(f)] <= t else high
    return node


def by_coalitions(score, x, background):
    d = x.shape[1]
    v = {m: np.mean([score(np.where([m >> j & 1 for j in range(d)], x, b)) for b in background], axis=0) for m in range(1 << d)}
    out = np.zeros_like(x)
    for j, m in itertools.product(range(d), range(1 << d)):
        if not m >> j & 1:
            s = m.bit_count()
            out[:, j] += math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) * (v[m | 1 << j] - v[m])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_impacts_equal_the_sum_over_all_coalitions(seed):
    rng, names = np.random.default_rng(seed), list("abcde")
    trees = [random_tree(rng, 5, names) for _ in range(4)]
    e = TT.TreeEnsemble.of(names, trees, base=0.3)
    x, b = rng.integers(0, 7, (20, 5)).astype(float), rng.integers(0, 7, (12, 5)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    b[rng.random(b.shape) < 0.1] = np.nan
    assert np.allclose(e.sums(x), [0.3 + sum(walk(t, r, names) for t in trees) for r in x])
    got = e.impacts(x, b)
    assert np.allclose(got, by_coalitions(e.sums, x, b), atol=1e-12)
    assert np.allclose(got.sum(axis=1), e.sums(x) - e.sums(b).mean())


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n), rng.integers(0, 5, n), rng.normal(size=n)]).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.normal(size=n) > 0.5).astype(int)
    df = spark.createDataFrame([(i, Vectors.dense(r), int(t)) for i, (r, t) in enumerate(zip(x, y))], ["id", "features", "y"])
    return df, x


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_fitted_spark_models_against_enumeration(spark, kind):
    df, x = table(spark)
    est = RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=5, seed=3) if kind == "forest" else \
        GBTClassifier(labelCol="y", maxIter=5, maxDepth=4, seed=3)
    model = est.fit(df)
    names = list("abcd")
    e = TT.from_spark_model(spark, model, names)
    array = vector_to_array("features")
    want = {r.id: r.p for r in model.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r.id: r.score for r in TT.score_trees(df, e, array, ["id"]).collect()}
    assert all(abs(got[i] - p) < 1e-9 for i, p in want.items())
    impacts = {r.id: r.impacts for r in TT.tree_impacts(df.where("id < 30"), e, df.where("id < 20"), array, ["id"]).collect()}
    assert np.allclose([impacts[i] for i in range(30)], by_coalitions(e.sums, x[:30], x[:20]), atol=1e-12)


def test_wide_and_deep_forests_sum_to_the_score():
    rng, names = np.random.default_rng(5), [f"f{k}" for k in range(40)]

    def chain(depth):
        return float(rng.normal()) if depth == 0 else (names[depth % 40], float(rng.normal()), float(rng.normal()), chain(depth - 1))

    e = TT.TreeEnsemble.of(names, [chain(55), *[random_tree(rng, 7, names) for _ in range(10)]])
    x, b = rng.normal(size=(50, 40)), rng.normal(size=(100, 40))
    assert np.allclose(e.impacts(x, b).sum(axis=1), e.sums(x) - e.sums(b).mean(), atol=1e-10)


def test_defined_cases(spark):
    e = TT.TreeEnsemble.of(["a", "b"], [("a", 1, 2.0, ("b", 0, 1.0, 3.0)), 5.0], base=1.0)
    df = spark.createDataFrame([(1, 0.0, None), (2, None, 0.0), (3, 2.0, None)], "id long, a double, b double")
    x = TT.features_of(e)
    assert {r.id: r.score for r in TT.score_trees(df, e, x, ["id"]).collect()} == {1: 8.0, 2: 7.0, 3: 9.0}
    assert TT.score_trees(df.limit(0), e, x, ["id"]).count() == 0
    with pytest.raises(ValueError):
        TT.tree_impacts(df, e, df.limit(0), x, ["id"])
    same = TT.tree_impacts(df, e, df.where("id = 1"), x, ["id"]).where("id = 1").first().impacts
    assert same == [0.0, 0.0]
    top = df.select(TT.top_impacts(F.array(F.lit(-1.0), F.lit(1.0)), ["a", "b"], 1).alias("t")).first().t
    assert top[0].feature == "a"   # a tie goes to the earlier feature


def test_too_many_nodes_are_refused(monkeypatch):
    monkeypatch.setattr(TT, "MAX_NODES", 2)
    with pytest.raises(ValueError):
        TT.TreeEnsemble.of(["a"], [("a", 1, 2.0, 3.0)])


def test_saved_and_loaded(spark, tmp_path):
    from leadlens.operators.preprocess import Preprocessor
    e = TT.TreeEnsemble.of(["a", "b"], [("a", 1, 2.0, ("b", 0, 1.0, 3.0)), 5.0], base=1.0, link="logit")
    save_model(spark, str(tmp_path / "m"), Preprocessor(), e, {"x": 1})
    _, back, meta = load_model(spark, str(tmp_path / "m"))
    rows = np.array([[0.0, 1.0], [2.0, 0.0], [2.0, 1.0]])
    assert (back.sums(rows) == e.sums(rows)).all() and back.link == "logit" and back.names == e.names and meta["x"] == 1
