import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from leadlens.llm import periodic_runs as runs
from leadlens.llm.queries import QUERIES, looped_tail

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every maximal stretch of equalities at every lag; the smallest lag of each stretch is its period."""
    n, best = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(12, 2 * q):
                best.setdefault((a, i - a + q), q)
    return sorted(((a, m, q) for (a, m), q in best.items()), key=lambda r: (r[0], r[2]))


def is_run(words, start, length, q):
    part = words[start:start + length]
    smaller = any(all(part[i] == part[i + p] for i in range(length - p)) for p in range(1, q))
    holds = all(part[i] == part[i + q] for i in range(length - q))
    grows = start > 0 and words[start - 1] == words[start - 1 + q] or \
        start + length < len(words) and words[start + length] == words[start + length - q]
    return holds and not smaller and not grows


def made(rng):
    n, kind = rng.randrange(90), rng.randrange(4)
    letters = [str(k) for k in range(rng.choice([1, 2, 3, 5, 30]))]
    words = [rng.choice(letters) for _ in range(n)]
    if kind == 1 and n:
        a = rng.randrange(n)
        p = rng.randrange(1, n - a + 1)
        words = words[:a] + [words[a + k % p] for k in range(n - a)]
    if kind == 2:
        words = words[:n // 3] * 3 + words[:n // 5]
    return words


def test_runs_against_every_lag():
    rng = random.Random(11)
    for _ in range(1500):
        words = made(rng)
        got = runs.runs_of(runs.codes_of(words))
        assert got == plain_runs(words)
        assert all(is_run(words, *r) for r in got)


def test_fibonacci_words_and_blocks_of_lags(monkeypatch):
    a, b = ["a"], ["a", "b"]
    while len(b) < 300:
        a, b = b, b + a
    want = plain_runs(b)
    assert runs.runs_of(runs.codes_of(b)) == want and len(want) > 50
    monkeypatch.setattr(runs, "PAIRS", 7)
    assert runs.runs_of(runs.codes_of(b)) == want


def test_splitting_keeps_only_repeated_words():
    words = "p q r".split() + ["u%d" % k for k in range(20)] + "x y z".split() * 5 + ["v"] + "x y".split() * 3
    codes = runs.codes_of(words)
    assert [(a, b) for a, b in runs.surviving_segments(codes)] == [(23, 38)]
    assert runs.runs_of(codes) == [(23, 15, 3)]
    assert runs.surviving_segments(np.arange(100)) == []


def collapsed(words, found):
    gone = set()
    for s, n, q in found:
        gone |= set(range(s + q, s + n))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), s, m, q, None if s is None else 1000 * m // q, sha("".join("%d,%d,%d\n" % r for r in found)),
            sha(collapsed(words, found)))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    short = [d for d in docs if len(d.text) < 12_000]
    assert len(short) > 0.9 * len(docs)
    for i, text in short:   # the plain version is quadratic
        assert tuple(got[i])[1:] == plain_row(i, text)
    assert list(got[docs[0].doc_id].asDict()) == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                                                  "runs_sha256", "collapsed_sha256"]
    assert sum(r.n_runs > 0 for r in got.values()) >= 0.05 * len(docs)


def test_long_documents_of_the_table_hold_true_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) >= 12000").select("doc_id", "text")
    for r in runs.find_runs(docs, prepare=looped_tail, reads=("doc_id",)).collect():
        words = looped_tail({"doc_id": r.doc_id}, runs.WORD.findall(r.text))
        assert r.n_words == len(words)
        x = np.array(runs.codes_of(words))
        for s, n, q in r.runs:
            part = x[s:s + n]
            assert (part[q:] == part[:-q]).all() and all((part[p:] != part[:-p]).any() for p in range(1, q))


def test_defined_cases(spark):
    loop = " ".join(["one two three"] * 6)
    rows = [(1, None, 5, "a"), (2, "", 5, "a"), (3, " \n ", 5, "a"), (None, loop, 5, "a"), (4, loop, 5, "a"), (4, loop, 5, "a"),
            (5, "x" * 500_000, 5, "a"), (6, "a\x85a " * 12, 5, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, extra string")
    out = runs.find_runs(df)
    assert out.columns == ["doc_id", "text", "extra", "n_words", "runs", "collapsed"]
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ([], "")
    assert got[None] == got[4] == ([(0, 18, 3)], "one two three")
    assert got[6] == ([(0, 12, 1)], "a\x85a")
    assert runs.find_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["one word", "two words", "long period", "prose"])
def test_long_texts(kind):
    rng = random.Random(5)
    n = 200_000
    words = {"one word": ["w"] * n, "two words": [rng.choice("ab") for _ in range(n)],
             "long period": [str(k % 70_001) for k in range(n)],
             "prose": [f"w{min(int(rng.paretovariate(0.6)), 10 ** 6)}" for _ in range(n)]}[kind]
    start = time.time()
    found = runs.runs_of(runs.codes_of(words))
    assert time.time() - start < 60
    if kind == "one word":
        assert found == [(0, n, 1)]
    if kind == "long period":
        assert found == [(0, n, 70_001)]
