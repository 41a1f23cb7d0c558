import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlens.llm import hilbert_shards as H


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_unit_steps(dims, bits):
    side = 1 << bits
    cells = np.array(np.meshgrid(*[np.arange(side)] * dims, indexing="ij")).reshape(dims, -1).T
    index = H.hilbert_index(cells, bits)
    assert sorted(index) == list(range(side ** dims))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


ROWS = [(i, f"text {i} " * (i % 17), ["en", "de", None][i % 3], f"s{i % 5 if i % 2 else 0}", (i % 17) * 7) for i in range(300)]
ROWS += [(1000 + i, "a copy", "en", "s0", 6) for i in range(150)] + [(7, None, None, None, None), (8, "", "en", "s1", 0),
                                                                   (8, "", "en", "s1", 0), (None, "é🙂", "fr", "s2", 2)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, shard int, size long")


@pytest.mark.parametrize("law,shards,rows", [("rows", 24, ROWS), ("bytes", 24, ROWS), ("rows", 24, ROWS[:5]), ("bytes", 4, ROWS[:1])])
def test_runs_of_the_curve(spark, law, shards, rows):
    got = H.assign(frame(spark, rows), shards, law).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    in_order = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.hilbert, r.text_crc32) for r in in_order]
    assert keys == sorted(keys)
    if law == "rows":
        counts = Counter({s: len(by[s]) for s in range(shards)})
        assert max(counts.values()) - min(counts.values()) <= 1
    elif len(rows) > 100:
        sizes = [sum(r.size for r in by[s]) for s in range(shards)]
        largest = max(r.size for r in got)
        assert max(sizes) - min(sizes) <= 2 * largest


def test_empty_table(spark):
    assert H.assign(frame(spark, []), 24).count() == 0
    with pytest.raises(ValueError):
        H.assign(frame(spark, []), 24, "other")


def test_written_shards_prune(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None]
    df = frame(spark, rows)
    manifest = H.write_shards(df, str(tmp_path / "out"), 24)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(str(tuple(r)) for r in back.select("doc_id", "text", "lang", "source", "n_chars").collect()) == \
        sorted(str(r) for r in rows)
    hit = {r.shard for r in H.prune(manifest, doc_id=(40, 60)).collect()}
    assert {r.shard for r in back.where("doc_id between 40 and 60").select("shard").distinct().collect()} <= hit
    assert len(hit) < 24


def test_filters_read_few_shards(spark):
    """Every language and source is looked for in the shards that hold it, and at most two more; a tenth of a number in two thirds."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    placed = docs.join(H.assign(docs, 24).select("doc_id", "shard"), "doc_id").drop("text").cache()
    manifest = placed.groupBy("shard").agg(*[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "doc_id", "n_chars")
                                             for n, f in (("min", F.min), ("max", F.max))]).toPandas().set_index("shard")
    seen = placed.toPandas()

    def hit(c, low, high):
        return int(((manifest[f"max_{c}"] >= low) & (manifest[f"min_{c}"] <= high)).sum())

    for c in ("lang", "source"):
        for v in seen[c].unique():
            assert hit(c, v, v) <= seen.loc[seen[c] == v, "shard"].nunique() + 2
    assert hit("lang", "es", "es") <= 10 and hit("lang", "fr", "fr") <= 10
    for c in ("doc_id", "n_chars"):
        at = seen[c].quantile([i / 10 for i in range(11)]).to_list()
        # the tenth in the middle lies on both sides of the curve's first turn
        assert all(hit(c, a, b) <= 16 for i, (a, b) in enumerate(zip(at, at[1:])) if i != 4)
    placed.unpersist()


def test_string_cells_keep_the_order(spark):
    words = ["", "a", "ab", "b", "é", "zz", "zzz", "\u4e2d\u6587", None]
    for prefix in ("", "https://x.example/", "\u00e9" * 1200):
        texts = [w if w is None else prefix + w for w in words for _ in range(5)]
        df = spark.createDataFrame([(t,) for t in texts], "s string")
        got = {r.s: r.c for r in df.select("s", H._cells(df, [], ["s"], 5)[0].alias("c")).distinct().collect()}
        assert len(got) == 9 and got[None] == 0
        order = sorted((t for t in got if t is not None), key=lambda t: t.encode())
        cells = [got[t] for t in order]
        assert cells == sorted(cells) and 1 <= min(cells) and max(cells) <= 31


def test_written_shards_keep_clashing_columns(spark, tmp_path):
    cols = ["shard", "size", "slot", "hilbert", "_slot", "rows"]
    df = frame(spark, [r for r in ROWS if r[0] is not None]).withColumns({c: F.col("doc_id") * (i + 2) for i, c in enumerate(cols)})
    manifest = H.write_shards(df, str(tmp_path / "out"), 24)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*df.columns, "shard_"}
    assert back.select(df.columns).exceptAll(df).count() == 0 and back.count() == df.count()
    assert manifest.agg(F.sum("rows")).first()[0] == df.count()
    assert {r.shard for r in manifest.collect()} == {r.shard_ for r in back.select("shard_").distinct().collect()}
