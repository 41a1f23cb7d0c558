import random

import numpy as np
import pytest
import xxhash

from leadlens.llm import simhash_dedup as S
from leadlens.llm.tables import connected_components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for ch in "\t\n\x0b\x0c\r":
        low = low.replace(ch, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    small = {}
    for i, k in enumerate(ids):
        r = find(i)
        small[r] = k if small.get(r) is None else small[r] if k is None else min(small[r], k)
    return [small[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "a b c d A b C d", "É é x y z",
                                  "x " * 300_000, "lone \x1c sep a\x85b c d e"])
def test_fingerprint_matches_brute_force(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def near_prints(n, seed, flips=6):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(max(1, n // 20))]
    out = set()
    while len(out) < n:
        v = rnd.choice(centres)
        for _ in range(rnd.randint(0, flips)):
            v ^= 1 << rnd.randrange(64)
        out.add(v)
    return sorted(out)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("bucket_rows,n,seed", [(200_000, 300, 1), (3, 300, 2), (200_000, 1, 4)])
def test_links_connect_what_brute_force_connects(spark, bucket_rows, n, seed):
    prints = near_prints(n, seed)
    df = spark.createDataFrame([(signed(p),) for p in prints], "simhash long")
    got = S.near_links(df, 3, bucket_rows).collect()
    un = [(r.u % (1 << 64), r.v % (1 << 64)) for r in got]
    together = dict(zip(prints, brute_components(prints, prints)))
    assert all(together[a] == together[b] for a, b in un)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for a, b in un:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert [find(p) for p in prints] == brute_components(prints, prints)


def test_large_group_of_near_copies_reports_a_forest():
    rnd = random.Random(5)
    keys = sorted({(1 << 40) ^ (1 << rnd.randrange(48)) ^ (1 << rnd.randrange(48)) for _ in range(900)})
    k = np.array(keys, dtype=np.uint64)
    u, _ = S.links_of(np.zeros(len(k), np.int64), np.full(len(k), 16), (k >> np.uint64(48)).astype(np.int64), np.zeros(len(k), np.int64), k, 16, 3)
    assert len(u) < len(k)
    assert len(set(brute_components(keys, keys))) == len(k) - len(u)


def test_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from all of them at once today"
    rows = [(5, base), (3, base.upper()), (9, None), (7, ""), (8, " \n"), (4, "something else entirely here now"),
            (None, base), (3, base), (11, base + " indeed " + base)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, simhash string, component_id int")
    got = S.near_duplicates(df).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], prints)
    assert sorted((str(r.doc_id), r.simhash % (1 << 64), r.component_id) for r in got) == \
        sorted((str(i), p, c) for (i, _), p, c in zip(rows, prints, want))
    assert S.near_duplicates(df.limit(0)).count() == 0
    components = brute_components(list(range(len(rows))), prints)
    groups = {}
    for (i, t), c in zip(rows, components):
        groups.setdefault(c, []).append((i is None, i or 0, t))
    want = sorted((None if none else i) or 0 for none, i, _ in (min(g, key=lambda r: r[:2]) for g in groups.values()))
    stay = S.one_of_each(df)
    assert stay.columns == df.columns and sorted(r.doc_id or 0 for r in stay.collect()) == want
    assert S.one_of_each(df.limit(0)).count() == 0


def test_a_segment_shared_by_many_different_fingerprints(spark):
    rnd = random.Random(8)
    lead = 0xABCD << 48
    prints = {lead | rnd.getrandbits(48) for _ in range(900)}
    for p in list(prints)[:200]:     # near ones, some across the levels at which nodes are unrolled
        for _ in range(2):
            prints.add(p ^ sum(1 << b for b in rnd.sample(range(48), rnd.randint(1, 4))))
    prints = sorted(prints)
    rows = spark.createDataFrame([(signed(p), 0xABCD) for p in prints], "k long, low long") \
        .selectExpr("0L AS r", "k", "low", "0L AS delta")
    dealt, total = S.units(rows, 16, 3, 40)
    sizes = dealt.groupBy("r", "depth", "low", "delta").count().collect()
    assert len(sizes) > 50 and max(r["count"] for r in sizes) <= 40 and total >= sum(r["count"] for r in sizes if r["count"] > 1)
    got = S.near_links(spark.createDataFrame([(signed(p),) for p in prints], "simhash long"), 3, 40).collect()
    want = brute_components(prints, prints)
    together = dict(zip(prints, want))
    pairs = [(r.u % (1 << 64), r.v % (1 << 64)) for r in got]
    assert all(together[a] == together[b] for a, b in pairs)
    seen = {r.node: r.root for r in connected_components(spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "u long, v long")).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(together[p], set()).add(seen.get(signed(p), ("alone", p)))
    assert all(len(g) == 1 for g in groups.values()) and len(set(want)) < len(prints)


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 7, 8)], "doc_id long, text string, _id int, _hash int")
    assert [tuple(r) for r in S.one_of_each(df).collect()] == [(1, "a b c d", 5, 6)]


def test_components_of_chains_and_hubs(spark):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 600 + i) for i in range(80)] + [(7, 7)]
    rnd.shuffle(links)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in [500, *range(600, 680)]}}
