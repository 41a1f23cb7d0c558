import hashlib
import random
import re
import time

import pytest

from leadlens.llm import fill_in_middle as fim
from leadlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """The contract, read literally: tokens one after another, joined again by counts."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(("42:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_fill_in_middle"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        n, form, p, m, out = plain(i, text)
        assert got[i] == (n, form, p, m, sha(out), sha(text or ""))


def test_token_ends_are_those_of_the_units():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85  aé<\U0001F600") for _ in range(rng.randrange(30)))
        assert fim.token_ends(text) == [m.end() for m in TOKEN.finditer(text)]


def test_defined_cases(spark):
    texts = [None, "", " ", "a", "  a  ", "x <P> y", "tail <", "<S", "P>", "<\n<", "é ü \U0001F600", "same words here", "same words here"]
    rows = [(i, t, 1, "kept", i) for i in (None, *range(60)) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, OUTPUT string, extra int")
    out = fim.restore(fim.fill_in_middle(df))
    assert out.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = out.collect()
    assert len(got) == len(rows) and {"plain", "spm", "psm"} == {r.form for r in got}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.restored == (r.text or "")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.fill_in_middle(df)).count() == 0


@pytest.mark.parametrize("text", ["word " * 400_000, " " * 2_000_000, "x" * 2_000_000, "a\n" * 1_000_000])
def test_long_texts_take_linear_time(text):
    start = time.time()
    ends = fim.token_ends(text)
    assert ends[-1] == len(text) and time.time() - start < 10


def test_rates_and_seed():
    forms = [fim.rearrange("some words to cut here", str(i), seed=7, rate=30, spm=20)[1] for i in range(3000)]
    assert abs(forms.count("plain") / 3000 - 0.7) < 0.05 and abs(forms.count("spm") / 3000 - 0.06) < 0.03
