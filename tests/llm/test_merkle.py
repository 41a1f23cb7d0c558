import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from leadlens.llm import merkle as M


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(t):
    par = [sha(p) for p in t.split("\n")]
    sec, own = [], []
    for i, p in enumerate(par):
        own.append(p)
        if p[-1] in "08" or i + 1 == len(par):
            sec.append(sha("".join(own)))
            own = []
    return par, sec, [sha(x)[:8] for x in re.findall(r"[^.!?\n]{1,160}", t)]


def plain_print(t):
    _, sec, leaf = plain_tree(t)
    return "/".join([sha("".join(sec)), "".join(s[:16] for s in sec), "".join(leaf)])


def plain_like(a, b):
    a, b = plain_tree(a), plain_tree(b)
    x, y = (set(a[2]), set(b[2])) if a[2] or b[2] else (set(a[0]), set(b[0]))
    return 2 * len(x & y) / (len(x) + len(y))


def plain(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        e = t[:len(t) - h] + nxt[:h]
        a, b = plain_tree(t)[0], plain_tree(e)[0]
        first = next((j for j in range(max(len(a), len(b))) if a[j:j + 1] != b[j:j + 1]), max(len(a), len(b)))
        out.append((i, len(t), sha(e), plain_print(t), plain_print(e), plain_like(t, e), plain_like(t, nxt), first))
    return out


ROWS = [(3, "one. two three!\nfour\n\nfive?"), (9, None), (4, ""), (4, "é🙂 ü\nb"), (4, "é🙂 ü\nb"), (None, "null id"), (None, "a"),
        (-5, "x" * 1000), (60, "..."), (61, "??!!"), (62, "??!!"), (63, "...\n??!!"), (10 ** 15, "far away. " * 3000)] + [(100 + i, "\n".join(f"paragraph {i % 5} {k}. more {k}" for k in range(40))) for i in range(60)]


def test_documents(spark):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in ROWS], "doc_id long, text string, par int, next_text string")
    got = [tuple(r) for r in M.compare_with_edited(df).collect()]
    assert sorted(got, key=str) == sorted(plain(ROWS), key=str)
    assert M.compare_with_edited(df.limit(0)).count() == 0
    one = [(7, "only. one\nhere")]
    assert [tuple(r) for r in M.compare_with_edited(spark.createDataFrame(one, "doc_id long, text string")).collect()] == plain(one)


def test_sql_twin(spark):
    con = duckdb.connect()
    rows = {i: (i, t) for i, t in ROWS if i is not None}
    documents = spark.createDataFrame(list(rows.values()), "doc_id long, text string").toPandas()  # noqa: F841
    got = con.execute(f"SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, "
                      f"edit_paragraph FROM ({M.SQL})").fetchall()
    assert sorted(got, key=str) == sorted(plain(list(rows.values())), key=str)


def test_an_inserted_paragraph_changes_one_section(spark):
    lines = [f"line number {k} of the text" for k in range(200)]
    other = lines[:100] + ["an inserted line"] + lines[100:]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    row = M.with_tree(M.with_tree(df, "a", "a_"), "b", "b_").select(
        F.size(F.array_except("a_sec.digest", "b_sec.digest")).alias("changed"), F.size("a_sec").alias("all"),
        M.first_edit(F.col("a_par"), F.col("a_sec"), F.col("b_par"), F.col("b_sec")).alias("at"),
        (M.root(F.col("a_sec")) == M.root(F.col("b_sec"))).alias("same"),
        M.first_edit(F.col("a_par"), F.col("a_sec"), F.col("a_par"), F.col("a_sec")).alias("none")).first()
    assert row.changed == 1 and row.all > 10 and row.at == 100 and not row.same and row.none == 200


def test_texts_without_a_sentence_are_compared_by_paragraphs(spark):
    rows = [(1, "..."), (2, "??!!"), (3, "??!!"), (4, "??!!\n..."), (5, "")]
    got = {r.doc_id: r.near_next for r in M.compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 2 / 3, 4: 0.0, 5: 0.0}


def test_clumped_ids_spread_over_the_buckets(spark):
    clumped = spark.range(40_000).select((F.col("id") % 20 * (1 << 40) + F.floor(F.col("id") / 20)).alias("_at"))
    for at in (clumped, spark.range(40_000).select((F.col("id") * F.col("id")).alias("_at"))):
        sizes = {r["_bucket"]: r["count"] for r in M.bucketed(at, 64).groupBy("_bucket").count().collect()}
        assert max(sizes.values()) <= 2 * 40_000 / 64 and sum(sizes.values()) == 40_000
        ends = M.bucketed(at, 64).groupBy("_bucket").agg(F.min("_at").alias("a"), F.max("_at").alias("b")).orderBy("_bucket").collect()
        assert all(x.b < y.a for x, y in zip(ends, ends[1:]))
    hot = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).cast("long").alias("_at"))
    sizes = {r["_bucket"]: (r["n"], r["d"]) for r in M.bucketed(hot, 30).groupBy("_bucket").agg(
        F.count("*").alias("n"), F.count_distinct("_at").alias("d")).collect()}
    assert all(n <= 2 * 300 for n, d in sizes.values() if n - d < 3000 - 1)   # all buckets but that of the repeated id
    assert M.bucketed(hot.limit(0), 30).count() == 0
