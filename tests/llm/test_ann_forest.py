import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlens.llm import ann_forest as A


def plain(rows, dim, k=20, each=20):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and len(v) == dim
          and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)]
    out = {}
    for i, q in ok:
        if i % each == 0 and i not in out:
            best = {}
            for j, x in ok:
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float(q @ x))
            out[i] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def made(n, dim, seed, hot=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32) * rng.uniform(0.2, 3, size=(n, 1)).astype(np.float32)
    if hot:
        x[rng.permutation(n)[:hot]] = x[0]
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    out = {}
    for r in sorted(A.nearest(df, F.col("vec_id") % 20 == 0, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    return out


@pytest.mark.parametrize("n,dim,hot", [(1500, 8, 0), (1500, 16, 500), (30, 4, 10), (3, 2, 0), (1, 3, 0)])
def test_recall_order_and_scores(spark, n, dim, hot):
    rows = made(n, dim, 3, hot)
    want, got = plain(rows, dim), run(spark, rows)
    vec = dict(rows)
    found = total = 0
    for q, best in want.items():
        mine = got.get(q, [])
        assert [r for *_, r in mine] == list(range(1, len(mine) + 1))
        assert [(-s, j) for j, s, _ in mine] == sorted((-s, j) for j, s, _ in mine)
        assert len(mine) == len(best)
        for j, s, _ in mine:
            assert j != q and abs(s - np.dot(np.float64(vec[q]), np.float64(vec[j]))) < 1e-9
        low = best[-1][1] if best else 0
        found += sum(s >= low - 1e-9 for _, s, _ in mine)
        total += len(best)
    assert found >= 0.9 * total


def test_a_frequent_vector_keeps_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 64)
    rows = [(i, [1.0, 0.0] if i % 3 else [0.6, 0.8 + i / 1e4]) for i in range(400)]
    got, want = run(spark, rows), plain(rows, 2)
    assert [j for j, *_ in got[20]] == [j for j, _ in want[20]]


def test_rows_that_take_no_part(spark):
    rows = made(200, 4, 5) + [(1000, None), (1020, [0.0] * 4), (1040, [1.0, float("nan"), 0.0, 0.0]), (1060, [float("inf"), 0.0, 0.0, 0.0]),
                              (1080, [1.0, 2.0]), (1100, []), (None, [1.0] * 4), (1120, [1.0, None, 0.0, 0.0])]
    rows += [rows[4], rows[4], rows[20], (21, [9.0, 9.0, 9.0, 9.0])]
    got, want = run(spark, rows), plain(rows, 4)
    assert set(got) == set(want)
    assert all(len({j for j, *_ in v}) == 20 for v in got.values())
    hits = sum(len({j for j, *_ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_the_walk_has_an_exchange_of_its_own(spark):
    """The queries walk the trees in as many tasks as the session has shuffle partitions."""
    df = spark.createDataFrame(made(500, 4, 1), "vec_id long, embedding array<float>")
    plan = A.nearest(df, F.col("vec_id") % 20 == 0)._jdf.queryExecution().executedPlan().toString()
    own = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line and "xxhash64" in line]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    assert own and all(f", {parts})" in line for line in own)
