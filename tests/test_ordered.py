import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadlens.operators import ordered
from leadlens.operators.ordered import exact_quantiles, running_totals
from leadlens.operators.split import allocate_test, cut_offs, stratified_split


def test_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "v": np.round(rng.normal(size=3000), 1)})
    pdf.loc[::3, "v"] = 0.5      # a heavy repeated value
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), "v", probs, by=["g"]).collect()
    for r in got:
        assert abs(np.percentile(pdf[pdf.g == r["g"]].v, r["prob"] * 100) - r["quantile"]) < 1e-9


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_running_totals_and_next(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int").groupBy("v").agg(F.count("*").alias("n"))
    out = running_totals(df, [F.col("v").asc()], F.col("v"), {"cum": "n"}, n_buckets=4, next_cols=["v"]).toPandas()
    out = out.sort_values("v")
    s = pd.Series(values).value_counts().sort_index()
    assert list(out.cum) == list(s.cumsum())
    assert list(out.next_v.iloc[:-1]) == list(s.index[1:]) and pd.isna(out.next_v.iloc[-1])


def test_many_groups_stay_distributed(spark):
    """Split points, totals and offsets stay in tables."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 100, 4000), "v": rng.integers(0, 50, 4000)})
    df = spark.createDataFrame(pdf)
    q = exact_quantiles(df, "v", [0.1, 0.5, 0.9], by=["g"]).toPandas()
    assert len(q) == 300
    for _, r in q.iterrows():
        assert abs(np.percentile(pdf[pdf.g == r["g"]].v, r["prob"] * 100) - r["quantile"]) < 1e-9
    vc = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    rt = running_totals(vc, [F.col("v").asc()], F.col("v"), {"cum": "n"}, by=["g"], n_buckets=4,
                        next_cols=["v"]).toPandas()
    for g, grp in rt.groupby("g"):
        grp = grp.sort_values("v")
        s = pdf[pdf.g == g].v.value_counts().sort_index()
        assert list(grp.cum) == list(s.cumsum()) and list(grp.next_v.iloc[:-1]) == list(s.index[1:])


@pytest.mark.parametrize("groups", [0, 10, 64, 65, 200])
def test_a_null_group_is_kept_at_any_number_of_groups(spark, groups):
    rows = [(g, float(v) / 2, v) for g in [None, *range(groups)] for v in range(5)]
    df = spark.createDataFrame(rows, "g int, part double, v int")
    rt = running_totals(df, [F.col("v").asc()], F.col("v"), {"cum": "part"}, by=["g"], n_buckets=4, next_cols=["v"]).collect()
    assert len(rt) == len(rows)
    for g in (None, *range(groups)):
        own = sorted((r.v, r.cum, r.next_v) for r in rt if r.g == g)
        assert own == [(0, 0.0, 1), (1, 0.5, 2), (2, 1.5, 3), (3, 3.0, 4), (4, 5.0, None)]
    q = {r.g: r.quantile for r in exact_quantiles(df, "v", [0.5], by=["g"]).collect()}
    assert q == {g: 2.0 for g in (None, *range(groups))}


def test_fractional_sums_and_large_keys(spark):
    df = spark.createDataFrame([((1 << 60) + i, 0.3) for i in range(40)], "k long, x double")
    rt = sorted(running_totals(df, [F.col("k").asc()], F.col("k"), {"cum": "x"}, n_buckets=8, next_cols=["k"]).collect())
    assert abs(rt[-1].cum - 12.0) < 1e-9
    assert [r.next_k for r in rt] == [(1 << 60) + i for i in range(1, 40)] + [None]


def test_no_rows_and_no_values(spark):
    none = spark.createDataFrame([], "g int, v double")
    null = spark.createDataFrame([(1, None)], "g int, v double")
    for df in (none, null):
        for by in (["g"], None):
            assert exact_quantiles(df, "v", [0.5], by=by).collect() == []
    assert running_totals(none, [F.col("v").asc()], F.col("v"), {"cum": "g"}, next_cols=["g"]).collect() == []
    assert stratified_split(spark.createDataFrame([], "lead_id long, converteu int")).collect() == []


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, float("inf"), float("-inf")])), min_size=1, max_size=60))
def test_quantiles_of_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.prob: r.quantile for r in exact_quantiles(df, "v", [0.0, 0.3, 1.0]).collect()}
    kept = np.array(sorted(v for v in values if v is not None))
    if not len(kept):
        assert got == {}
        return
    assert got[0.0] == kept[0] and got[1.0] == kept[-1]
    if np.isfinite(kept).all():
        assert abs(got[0.3] - np.percentile(kept, 30)) <= 1e-9 * max(1, np.abs(kept).max())


def test_split_takes_the_smallest_keys_of_each_class(spark):
    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(2000)]
    got = {r.lead_id: r.split for r in stratified_split(spark.createDataFrame(rows, "lead_id long, converteu int")).collect()}
    counts = {c: sum(x == c for _, x in rows) for c in (None, 0, 1, 2)}
    test = allocate_test(counts)
    for c in counts:
        ordered = sorted((hashlib.md5(f"{i}|42".encode()).hexdigest(), i) for i, x in rows if x == c)
        assert {i for _, i in ordered[:test[c]]} == {i for i, x in rows if x == c and got[i] == "test"}


@pytest.mark.parametrize("bound", [0, 20])
def test_wide_brackets_are_sketched_again(spark, monkeypatch, bound):
    """The quantiles stay exact, with heavy values, infinities and brackets down to no row between their ends."""
    monkeypatch.setattr(ordered, "BRACKET_ROWS", bound)
    again = []
    step = ordered._sketched_again
    monkeypatch.setattr(ordered, "_sketched_again", lambda src, wanted, by: again.append(1) or step(src, wanted, by))
    rng = np.random.default_rng(5)
    n = 12_000
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n), "v": rng.normal(size=n), "part": np.round(rng.normal(size=n), 1)})
    pdf.loc[::3, "v"] = 0.25      # a third of all rows in one value
    pdf.loc[:20, "v"] = float("-inf")
    df = spark.createDataFrame(pdf).repartition(3).cache()
    probs = [0.0, 0.001, 0.25, 0.5, 0.6, 0.999, 1.0]
    for value in ("v", "part"):
        for by in ([], ["g"]):
            for r in exact_quantiles(df, value, probs, by=by).collect():
                own = np.sort(pdf[pdf.g == r["g"]][value] if by else pdf[value])
                at = r["prob"] * (len(own) - 1)
                a, b = own[int(np.floor(at))], own[int(np.ceil(at))]
                want = a if a == b else a + (b - a) * (at - np.floor(at))
                assert r["quantile"] == want or abs(r["quantile"] - want) < 1e-9, (value, by, r)
    assert len(again) >= 4


@pytest.mark.parametrize("bound", [0, 2])
def test_split_with_brackets_sketched_again(spark, monkeypatch, bound):
    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(3000)] + [(None, 1)] * 50
    df = spark.createDataFrame(rows, "lead_id long, converteu int").repartition(3)
    want = cut_offs(df)
    monkeypatch.setattr(ordered, "BRACKET_ROWS", bound)
    assert cut_offs(df) == want
