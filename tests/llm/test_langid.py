import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadlens.llm import langid

WORDS = {"aa": "kalo mira setu pano lira deno", "bb": "wyrf xoquz jugh bweck zyft quorh", "cc": "čoža šuňe řadě žlúť ďábe ťuko"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(lang, chars, seed):
    rnd, out = random.Random(seed), ""
    while len(out) < chars:
        out += rnd.choice(WORDS[lang].split()) + " "
    return out[:chars]


def corpus(spark, sizes, n=60):
    """Rows of each language, of the given numbers of characters in turn."""
    rows = [(1000 * k + i, text_of(lang, of[i % len(of)], 1000 * k + i), lang, "s", None)
            for k, (lang, of) in enumerate(sorted(sizes.items())) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("other", [(30, 40), (5000, 9000), (45, 6000)])
def test_languages_outside_the_range_are_learned(spark, other):
    docs = corpus(spark, {"aa": (300,), "bb": other, "cc": (500, 30)})
    model = langid.fit(docs)
    assert model.langs == ["aa", "bb", "cc"]
    got = langid.annotate(docs, model).where(langid.held_out(F.col("doc_id"))).collect()
    assert {r.lang for r in got} == {"aa", "bb", "cc"} and all(r.lang_pred == r.lang for r in got)


def test_no_row_inside_the_range(spark):
    docs = corpus(spark, {"aa": (20,), "bb": (5000,)})
    assert all(r.lang_pred == r.lang for r in langid.annotate(docs, langid.fit(docs)).collect())
    assert corpus_pipeline.language_id(spark, docs, "").count() == docs.count()


def test_no_label_drops_no_document_with_letters(spark):
    rows = [(1, "a text without a label", None, "s", 3), (2, "12 34", None, "s", 5), (3, None, None, "s", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert langid.fit(docs).langs == []
    assert [tuple(r) for r in corpus_pipeline.language_id(spark, docs, "").collect()] == rows[:1]


def test_sample_is_bounded():
    inside, short, longer = langid.INSIDE, langid.SHORT, 2
    assert langid.sample_cuts({inside: (100, 50_000, 0.01), short: (9, 90, 0.2)}, 50, 1000) == {inside: 0.5}
    assert langid.sample_cuts({inside: (10, 500, 0.1), longer: (80, 1000, 0.1), short: (100, 500, 0.1)}, 50, 1000) == \
        {inside: 1.0, longer: 0.5}
    cuts = langid.sample_cuts({longer: (5, 1000, 0.01), 3: (5, 1500, 0.1), short: (100, 500, 0.1)}, 50, 1750)
    assert cuts == {longer: 1.0, 3: 0.5, short: 0.425}
    assert langid.sample_cuts({9: (3, 9_000_000, 0.3)}, 50, 100) == {9: 0.3 + langid.HASH_STEP}  # one, however long


def test_texts_without_letters_teach_nothing(spark):
    docs = corpus(spark, {"aa": (300,)}).unionByName(
        spark.createDataFrame([(k, "12 34 " * 40, "zz", "s", None) for k in range(7000, 7040)], SCHEMA))
    assert langid.fit(docs).langs == ["aa"]


def test_the_stage_acts_on_the_decision(spark):
    rows = [(40001, text_of("aa", 300, 1), None, "s", 300), (40002, text_of("bb", 40, 2), None, "s", 40),
            (40003, "日本語", None, "s", 3), (40005, "日本語", "ja", "s", 3),  # 40005 is held out
            (40006, "12 34", "aa", "s", 5)]
    docs = corpus(spark, {"aa": (300,), "bb": (300,)}).unionByName(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert (got[40001], got[40002], got[40005]) == ("aa", "bb", "ja")
    assert 40003 not in got and 40006 not in got and len(got) == docs.count() - 2


def common(a, b):
    """The kernel by its definition: n-grams that both have, over the geometric mean of their own counts."""
    a, b = (set(langid.text_grams(t, 3).tolist()) for t in (a, b))
    return a & b, a, b


@pytest.mark.parametrize("slot_bits, columns", [(20, 1 << 18), (8, 1 << 18), (4, 64)])
def test_no_gram_leaves_the_kernel(monkeypatch, slot_bits, columns):
    """Also where most n-grams share a slot, and where the landmark matrix is unpacked in pieces."""
    monkeypatch.setattr(langid, "SLOT_BITS", slot_bits)
    monkeypatch.setattr(langid, "COLUMNS", columns)
    texts = [text_of(lang, 400, i) for i, lang in enumerate(["aa", "bb", "cc"] * 3)]
    model = langid.train(texts, ["aa", "bb", "cc"] * 3)
    land = [t for lang in range(3) for t in texts[lang::3]]
    vocab = set().union(*(langid.text_grams(t, 3).tolist() for t in land))
    assert set(model.vocab.tolist()) == vocab
    new = ["kalo wyrf", "řadě a xyz 12", "日本", "", None]
    got = model.scorer().kernel(new)
    for t, row in zip(new, got):
        for x, value in zip(land, row):
            both, a, b = common(t, x)
            assert value == pytest.approx(len(both) / max(1, len(a & vocab) * len(b)) ** 0.5, abs=1e-6)


def test_many_labels_stay_within_the_bounds(spark, monkeypatch):
    """Whatever the number of labels, rows, labels and landmarks of the fit are bounded."""
    rows = [(1000 * i + j, f"text of the label number {i} written {j} times over " * 3, f"l{i:03d}")
            for i in range(200) for j in range(12 if i % 4 else 8)]
    seen = {}
    train = langid.train
    monkeypatch.setattr(langid, "train", lambda texts, labels, *a: seen.update(texts=texts, labels=labels) or train(texts, labels, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, landmarks=20, max_labels=50, max_rows=150)
    learned = {i: sum(zlib.crc32(str(d).encode()) % 4 != 2 for d, _, x in rows if x == i) for i in {r[2] for r in rows}}
    assert model.langs == sorted(sorted(learned, key=lambda i: (-learned[i], i))[:50])
    assert 50 <= len(seen["texts"]) <= 300 and len(model.landmarks) == 20
    assert all(p.lang_pred in model.langs for p in langid.annotate(docs, model).collect())
