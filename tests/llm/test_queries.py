"""Each registered query against a brute-force version of its contract on the small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from leadlens.llm import pii
from leadlens.llm import sentencepiece_fst as fst
from leadlens.llm.queries import ORACLE_SQL, QUERIES
from test_pii import plain_spans
from test_simhash_dedup import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
COPY = "The same words again and again until the copy is as long as it needs to be for the check. " * 3


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, name):
    documents = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'")  # noqa: F841
    twin = duckdb.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(twin.columns)
    assert sorted(map(tuple, df.select(*twin.columns).collect())) == sorted(twin.fetchall())


def test_op1(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op1_langid")}
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {d[0] for d in held}
    assert all(0 <= r.score <= 1 for r in got.values())
    right = [got[d[0]].lang_pred == d[2] for d in held if d[2] and re.search(r"[^\W\d_]", d[1] or "")]
    assert np.mean(right) >= 0.97


def test_op2(spark, docs):
    prints = [brute_fingerprint(d[1]) for d in docs]
    want = list(zip([d[0] for d in docs], [f"{p:016x}" for p in prints], brute_components([d[0] for d in docs], prints)))
    assert sorted(map(tuple, rows(spark, "op2_simhash"))) == want


def test_op3(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op3_pii")}
    for i, text, *_ in docs:
        base, r = plain_spans(text), got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, *_ in base) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert r.spans.startswith(pii.joined(base))


def test_op4(spark, docs):
    from test_token_counts import plain_count, plain_edit
    got = {r.doc_id: r for r in rows(spark, "op4_token_counts")}
    for i, text, *_ in docs:
        n, new = len(text), text
        for e in ((n // 3, 0, text[:20]), (n // 2, 15, ""), (n + 5, 0, " end.")):
            new = plain_edit(new, *e)
        r = got[i]
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited) == (plain_count(text), plain_count(new), len(new))
        assert r.recut_chars < 2000


def check_packing(got, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids, at = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_op6(spark, docs):
    check_packing(rows(spark, "op6_packing"), {d[0]: d[1] for d in docs})


def test_op7(spark, docs):
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=fst.model_path())
    got = {r.doc_id: r for r in rows(spark, "op7_sentencepiece")}
    want = spark.createDataFrame([(d[0], sp.encode(d[1])) for d in docs], "doc_id long, pieces array<int>") \
        .selectExpr("doc_id", "size(pieces) AS n", "xxhash64(pieces) AS h").collect()
    assert all(got[r.doc_id].n_pieces == r.n and got[r.doc_id].pieces_hash == r.h and got[r.doc_id].round_trip for r in want)


def test_op9(spark):
    data = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    ids, x = np.array([d[0] for d in data]), np.array([d[1] for d in data], dtype=np.float64)
    got = defaultdict(list)
    for r in sorted(rows(spark, "op9_ann_forest"), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    found = 0
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q, mine in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))][:20]
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-9 for r in mine)
        found += len(set(best) & {r.vec_id for r in mine})
    assert found >= 0.9 * 20 * len(got)


def test_op10(spark, docs):
    got = rows(spark, "op10_hilbert")
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == \
        [(d[0], len(d[1].encode()) + 8, zlib.crc32(d[1].encode())) for d in docs]
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def made_corpus(n=120):
    """Texts with null and empty ones, copies, near copies, a boilerplate line and personal data."""
    out = []
    for i in range(n):
        own = " ".join(f"word{(i * 7919 + k * 104729) % 9973} of text" for k in range(30 + i % 40))
        text = f"{own}.\nThis line stands on every site.\nAnd {own[::-1][:60]} here."
        if i % 10 == 0:
            text = COPY + ("" if i % 20 else " ")
        if i % 11 == 1:
            text += f" Write to me{i}@host{i % 3}.org or call +1 (743) 555-38{i % 90 + 10}."
        out.append((i, text, "en", f"s{i % 13}", len(text)))
    return out + [(900, None, None, "s1", None), (901, "", "en", "s2", 0), (902, "12 34 --", "en", None, 8)]


def test_pipeline(spark):
    source = made_corpus()
    docs = spark.createDataFrame(source, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [("start", docs)]
    for name, stage in corpus_pipeline.STAGES:
        kept.append((name, stage(spark, kept[-1][1], SF)))
    by = {name: df.collect() for name, df in kept}
    assert all(df.columns == corpus_pipeline.COLUMNS for _, df in kept[:-1])
    lettered = {r[0] for r in source if r[1] and re.search(r"[^\W\d_]", r[1])}
    assert {r.doc_id for r in by["language ID"]} == lettered
    lined = {r.doc_id: r for r in by["line dedup"]}
    assert set(lined) == lettered
    for r in by["language ID"]:
        left = lined[r.doc_id].text
        shared = "This line stands on every site."
        assert left == (r.text if r.doc_id == 1 else r.text.replace(shared + "\n", "")) and lined[r.doc_id].n_chars == len(left)
    items = sorted((i, r.text) for i, r in lined.items())
    components = brute_components([i for i, _ in items], [brute_fingerprint(t) for _, t in items])
    assert sorted(r.doc_id for r in by["SimHash near-dedup"]) == sorted(set(components))
    clean = {r.doc_id: r for r in by["PII"]}
    assert set(clean) == set(components)
    for r in by["SimHash near-dedup"]:
        t = clean[r.doc_id].text
        assert plain_spans(t) == [] and (plain_spans(r.text) or t == r.text) and clean[r.doc_id].n_chars == len(t)
    check_packing(by["packing"], {i: r.text for i, r in clean.items()})


def test_pipeline_on_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_run_of_the_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {r.doc_id for r in got} <= {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet'").fetchall()}
