import random
import time
from collections import defaultdict

import duckdb
import pytest

from leadlens.llm import line_dedup as L


def plain(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for line in (t.split("\n") if t is not None else []):
            if line:
                if s is not None:
                    sites[line].add(s)
                else:
                    sites[line]
                if i is not None:
                    first[line] = min(first.get(line, i), i)
    out = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        gone = [bool(x) and len(sites[x]) >= min_sites and first.get(x) != i for x in lines]
        if all(g for x, g in zip(lines, gone) if x):   # nothing but empty lines would stay
            gone = [False] * len(lines)
        out.append((i, None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=str)


def made(seed, n=150, sites=15):
    rnd = random.Random(seed)
    pool = [f"shared line {k}" for k in range(12)]
    rows = [(i, "\n".join([rnd.choice(pool) if rnd.random() < 0.3 else f"own {i} {rnd.random()} of this text"
                           for _ in range(rnd.randint(0, 8))]), f"s{rnd.randrange(sites)}") for i in range(n)]
    rows += [(500, None, "s1"), (501, "", "s1"), (None, "shared line 1\nmy own much longer line here", "s2"),
             (502, "shared line 2\nand a longer line of its own here", None), (rows[3]), (rows[3]),
             (503, "shared line 4\n\nlong own line that is not shared\nshared line 4", "s4"), (3, "same id, other text here", "s3")]
    return rows


@pytest.mark.parametrize("min_sites", [2, 9, 10, 12, 15])
def test_matches_plain_counts(spark, min_sites):
    rows = made(min_sites)
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = L.remove_boilerplate(df, min_sites).select("doc_id", "text", "n_lines", "n_removed")
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(rows, min_sites)


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert L.remove_boilerplate(df).count() == 0
    rows = [(i, "head\n" + "\n".join(f"{i} {k}" for k in range(20_000)), f"s{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, L.remove_boilerplate(df, 3).select("doc_id", "text", "n_lines", "n_removed").collect()),
                  key=str) == plain(rows, 3)


def test_many_lines_in_one_document(spark):
    n = 100_000
    rows = [(i, f"head\n{i} " + "\n".join(f"{k}" for k in range(n)), f"s{i}") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    start = time.time()
    got = {r.doc_id: r for r in L.remove_boilerplate(df, 2).collect()}
    assert time.time() - start < 30
    assert got[0].text == rows[0][1] and got[0].n_lines == n + 1 and got[1].text == "1 0" and got[1].n_removed == n


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "a\nb", "s1", 5, 6, 7), (2, "a\nc", "s2", 5, 6, 7)],
                               "doc_id long, text string, source string, row_a int, Row_B int, removed int")
    got = L.remove_boilerplate(df, 2)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb", "s1", 5, 6, 7, 2, 0), (2, "c", "s2", 5, 6, 7, 2, 1)]


def test_sql_twin(spark):
    rows = [r for r in made(10) if r[0] is not None and r[0] != 3 and r[1] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in L.remove_boilerplate(df).select("doc_id", "text", "n_lines", "n_removed").collect()), key=str)
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    assert sorted(con.execute(f"SELECT doc_id, text, n_lines, n_removed FROM ({L.SQL})").fetchall(), key=str) == got
