import math

import numpy as np
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.functions.features import add_features
from leadlens.operators.preprocess import Preprocessor
from leadlens.operators.split import allocate_test, stratified_split
from leadlens.sources.leads import leads_view

from conftest import SF_SMALL


def test_allocation_is_exact():
    for counts in [{0: 1603, 1: 197}, {0: 5, 1: 5}, {0: 1, 1: 0}, {0: 13300, 1: 1700}]:
        t = allocate_test(counts)
        assert sum(t.values()) == math.ceil(0.2 * sum(counts.values()))
        assert all(0 <= t[c] <= counts[c] for c in counts)


def test_split_sizes_exact(spark):
    df = stratified_split(add_features(leads_view(spark, SF_SMALL)))
    got = {(r.split, r.converteu): r["count"] for r in df.groupBy("split", "converteu").count().collect()}
    n = sum(got.values())
    assert got[("test", 0)] + got[("test", 1)] == math.ceil(0.2 * n)
    counts = {c: got[("test", c)] + got[("train", c)] for c in (0, 1)}
    assert {c: got[("test", c)] for c in (0, 1)} == allocate_test(counts)
    again = stratified_split(add_features(leads_view(spark, SF_SMALL)))   # reproducible
    assert df.where("split = 'test'").select("lead_id").exceptAll(again.where("split = 'test'").select("lead_id")).count() == 0


def test_preprocessor_fit_transform(spark):
    rows = [(1.0, "b", 0), (2.0, "a", 1), (3.0, "b", 1), (10.0, None, 0), (None, "a", 1)]
    df = spark.createDataFrame(rows, "x double, c string, z int")
    pp = Preprocessor(numeric=["x"], categorical=["c"], binary=["z"]).fit(df)
    assert pp.medians["x"] == 2.5                      # exact median of {1,2,3,10}
    assert pp.modes["c"] == "a"                        # tie a/b -> smallest
    imputed = np.array([1, 2, 3, 10, 2.5])
    assert abs(pp.scales["x"] - imputed.std()) < 1e-12  # population deviation
    assert pp.slot_names() == ["numericas__x", "categoricas__c_a", "categoricas__c_b", "binarias__z"]
    new = spark.createDataFrame([(None, "zzz", 1), (4.0, None, 0)], "x double, c string, z int")
    out = pp.transform(new).collect()
    assert (out[0]["categoricas__c_a"], out[0]["categoricas__c_b"]) == (0.0, 0.0)   # unknown -> zeros
    assert (out[1]["categoricas__c_a"], out[1]["categoricas__c_b"]) == (1.0, 0.0)   # null -> mode
    assert abs(out[0]["numericas__x"] - (2.5 - imputed.mean()) / imputed.std()) < 1e-12
    assert Preprocessor.from_json(pp.to_json()) == pp


def test_one_hot_rows_sum_to_one(spark):
    df = add_features(leads_view(spark, SF_SMALL))
    pp = Preprocessor().fit(df)
    assert len(pp.slot_names()) == 32
    x = pp.transform(df)
    for c in S.CATEGORICAL_COLS:
        cols = [F.col(f"`{n}`") for n in pp.slot_names() if n.startswith(f"categoricas__{c}_")]
        s = sum(cols[1:], cols[0])
        assert x.where(s != 1.0).count() == 0


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 5), st.integers(0, 10_000), min_size=1, max_size=6))
def test_allocation_properties(counts):
    n = sum(counts.values())
    t = allocate_test(counts)
    assert sum(t.values()) == math.ceil(0.2 * n)
    n_train = n - math.ceil(0.2 * n)
    for c, k in counts.items():
        train_c = k - t[c]
        assert 0 <= t[c] <= k
        if n:
            assert abs(train_c - k * n_train / n) < 1 + 1e-9      # largest remainder: within one row


def test_vector_equals_the_wide_slots(spark):
    df = add_features(leads_view(spark, SF_SMALL))
    pp = Preprocessor().fit(df)
    odd = df.limit(40).withColumn("canal_captacao", F.when(F.col("lead_id") % 2 == 0, F.lit("Canal Novo")))
    wide = {r.lead_id: [r[n] for n in pp.slot_names()] for r in pp.transform(odd, keep=["lead_id"]).collect()}
    rows = pp.transform(odd, keep=["lead_id"], vector_col="v").collect()
    assert len(rows) == len(wide) == 40
    for r in rows:
        assert np.allclose(r.v.toArray(), wide[r.lead_id], atol=0, rtol=1e-12)
