import random
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from leadlens.llm import sentencepiece_fst as S


@lru_cache
def library():
    return SentencePieceProcessor(model_file=S.model_path())


def check(text):
    t = S.transducer(S.model_path())
    ids = S._ids(t.encode(text))
    assert ids == library().encode(text), text
    assert t.decode(ids) == text.replace(S.MARK, " ")


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "aa", " ", "  ", "\n", S.MARK, "the", "ing", "é", "0", "!!", "🙂", "<s>"]), max_size=40))
def test_pieces_that_meet_equal_the_library(parts):
    check("".join(parts))


@pytest.mark.parametrize("text", ["x" * 5000, " " * 300 + "q", "ab" * 3000, "<unk></s><0x0A>", "日本語" * 500])
def test_long_runs(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(3, 31_999), max_size=20))
def test_decoding_of_any_ids(ids):
    assert S.transducer(S.model_path()).decode(ids) == library().decode(ids)


def test_path_is_the_only_one_of_weight_zero():
    t, rnd = S.transducer(S.model_path()), random.Random(3)

    def paths(text, before):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            piece = library().piece_to_id(text[:n])
            if text[:n] in t.score and t.agree(before, piece):
                for rest in paths(text[n:], piece):
                    yield [piece, *rest]
    for _ in range(60):
        text = S.MARK + "".join(rnd.choice("theinrao") for _ in range(rnd.randint(1, 9)))
        assert list(paths(text, -1)) == [S._ids(t.shortest_path(text))]


def test_documents(spark):
    rows = [(1, "hello  world\n"), (2, None), (3, ""), (4, " lead"), (5, "word 🙂 " * 4000), (1, "hello  world\n")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pieces string, decoded int")
    got = S.decode(S.encode(df)).collect()
    assert sorted((r.doc_id, r.pieces, r.decoded) for r in got if r.text is not None) == \
        sorted((i, library().encode(t), t) for i, t in rows if t is not None)
    assert [(r.pieces, r.decoded) for r in got if r.text is None] == [(None, None)]
    assert S.encode(df.limit(0)).count() == 0
