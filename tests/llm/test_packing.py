import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlens.llm import bpe
from leadlens.llm import packing as K


@lru_cache(maxsize=1)
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x260, exclude_categories=("Cs",)), max_size=40))
def test_ids_are_those_of_the_tokenizers_library(text):
    assert bpe.encoder()(text).tolist() == library()(text)


@pytest.mark.parametrize("text", ["<|endoftext|> a", "end <|endoftext|> of", "a  <|endoftext|><|endoftext|>  b<|endoftext", "日本 <|endoftext|> x", "日本語 text x", "🙂🙂 é", "it's we'll  \n\n x\t\t", "\x85a \xa0b\x1cc", "a" * 3000])
def test_ids_of_odd_texts(text):
    assert bpe.encoder()(text).tolist() == library()(text)


def plain_level(counts, n, size):
    best = None
    for h in range(0, size - n + 1):
        if h and not counts[h]:
            continue
        after = counts.copy()
        if h:
            after[h] -= 1
        if h + n < size:
            after[h + n] += 1
        value = (sum(int(c) ** 2 for c in after[1:size]), -h)
        if best is None or value < best[0]:
            best = (value, h)
    return best[1]


def test_level_is_the_one_with_the_smallest_sum_of_squares():
    rng = np.random.default_rng(3)
    p = K.Packer(32)
    for i in range(600):
        n = int(rng.integers(1, 32))
        assert p.level_for(n) == plain_level(p.counts, n, 32)
        p.add(i, np.full(n, i, dtype="<u4"))
        assert [len(x) for x in p.open[1:]] == p.counts[1:32].tolist()


@pytest.mark.parametrize("size,lengths", [(32, list(range(1, 200))), (32, [1] * 45), (32, [31] * 7), (2048, [5000, 1, 2048]), (16, [])])
def test_windows_hold_each_id_once_without_padding(size, lengths):
    p, windows = K.Packer(size), []
    docs = {i: np.arange(n, dtype="<u4") + 7 * i for i, n in enumerate(lengths)}
    for i, ids in docs.items():
        windows += p.add(i, ids)
    windows += p.finish()
    seen = {i: np.zeros(len(v), int) for i, v in docs.items()}
    for w in windows:
        assert w.fill == sum(len(x.ids) for x in w.pieces) and (w.fill == size or w.fill & (w.fill - 1) == 0)
        for x in w.pieces:
            assert len(x.ids) and (docs[x.doc][x.start:x.start + len(x.ids)] == x.ids).all()
            seen[x.doc][x.start:x.start + len(x.ids)] += 1
    assert all((v == 1).all() for v in seen.values())
    assert sum(w.fill != size for w in windows) < 12


def test_documents(spark):
    rows = [(1, "hello world"), (2, None), (2, ""), (3, "word " * 9000), (None, "x y z"), (1, "hello world")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, offset int").repartition(2)
    got = K.pack(df).collect()
    encode = library()
    want = sorted(((str(i), len(encode(t or "")) + 1) for i, t in rows))
    full = {}
    for r in got:
        ids = np.array(encode({1: "hello world", 3: "word " * 9000, None: "x y z"}.get(r.doc_id, "")) + [1], dtype="<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        full[str(r.doc_id)] = full.get(str(r.doc_id), 0) + r.length
    total = {}
    for i, n in want:
        total[i] = total.get(i, 0) + n
    assert full == total
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    assert K.pack(df.limit(0)).count() == 0


def test_workers_can_import_the_package(spark):
    import os

    import leadlens
    K.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(leadlens.__file__)))
    assert root in spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep)
