import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadlens.llm import token_counts as C

COUNT = C.Counter()


def plain_count(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    if not hasattr(plain_count, "t"):
        plain_count.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return len(plain_count.t.encode(text, add_special_tokens=False).ids)


def plain_edit(t, start, removed, inserted):
    start = min(max(start, 0), len(t))
    return t[:start] + inserted + t[start + max(removed, 0):]


@pytest.fixture()
def small_leaves(monkeypatch):
    monkeypatch.setattr(C, "LEAF", 3)
    monkeypatch.setattr(C, "GROWN", 9)


WORDS = st.sampled_from(["a", "the", " ", "  ", "\n", "'", "'re", "s", "12", "é", "!", "\t ", "don't", "x" * 9, "🙂", "\xa0", "<|endoftext|>", "<|endof", "text|>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(WORDS, max_size=60), st.lists(st.tuples(st.integers(0, 130), st.integers(0, 40), st.lists(WORDS, max_size=25)), max_size=4))
def test_edits_equal_a_new_count(words, edits):
    C.LEAF, C.GROWN = 3, 9
    try:
        text = "".join(words)
        tree = C.PreTokenTree.of(text, COUNT)
        assert tree.total() == plain_count(text)
        for start, removed, inserted in edits:
            want = plain_edit(text, start, removed, "".join(inserted))
            text, _, tree = tree.edit(text, start, removed, "".join(inserted), COUNT)
            assert text == want and tree.total() == plain_count(text) and tree.chars[1] == len(text)
            width = tree.width
            for node in range(1, width):
                assert tree.tokens[node] == tree.tokens[2 * node] + tree.tokens[2 * node + 1]
    finally:
        C.LEAF, C.GROWN = 32, 256


def test_an_edit_cuts_only_its_region():
    text = "some words of a long text " * 20_000
    tree = C.PreTokenTree.of(text, COUNT)
    new, recut, tree = tree.edit(text, 250_000, 5, "other", COUNT)
    assert recut < 1000 and tree.total() == plain_count(new)


def test_documents(spark):
    rnd = random.Random(4)
    rows = [(1, "hello world, it's me " * 50), (2, None), (3, ""), (4, "x"), (5, " \n\n " * 40), (6, "word " * 30_000), (7, "日本語🙂 " * 9)]
    rows += [rows[0]] + [(10 + i, "".join(rnd.choice("ab c'\n1é!") for _ in range(300))) for i in range(20)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    before = C.with_trees(df).withColumn("edits", C.sample_edits(F.coalesce("text", F.lit(""))))
    assert sorted(r.n_tokens for r in before.collect()) == sorted(plain_count(t or "") for _, t in rows)
    got = sorted((r.doc_id, r.text, r.n_tokens) for r in C.apply_edits(before).collect())
    want = []
    for i, t in rows:
        t = t or ""
        n, head = len(t), t[:20]
        for e in ((n // 3, 0, head), (n // 2, 15, ""), (n + 5, 0, " end.")):
            t = plain_edit(t, *e)
        want.append((i, t, plain_count(t)))
    assert got == sorted(want)
    none = C.with_trees(df).withColumn("edits", F.lit(None).cast("array<struct<start:long,removed:long,inserted:string>>"))
    assert sorted(r.n_tokens for r in C.apply_edits(none).collect()) == sorted(plain_count(t or "") for _, t in rows)
    assert C.with_trees(df.limit(0)).count() == 0
