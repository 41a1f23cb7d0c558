import hashlib
import random
import re
import time

import numpy as np
import pytest

from leadlens.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (2 if i % 2 else 1)
        total += v // 10 + v % 10
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in s.split("."))
                    or kind == "card" and 16 <= len(d) <= 19 and plain_luhn(d) or kind == "phone" and 8 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choice("ab.@@..-+%1234567890123 ()é🙂") for _ in range(rnd.randint(0, 60)))
        assert P.base_spans(text) == plain_spans(text), text
    for text in ("4111 1111 1111 1111", "x4111-1111-1111-1111.", "1.2.3.4.5.6.7.8", "001.002.003.4", "+1 (743) 555-3824 a",
                 "und.34@mail7.example.com gei", "a@b@c.de", "@x.y", "a@x..y", "256.1.1.1", "+12((((", "a@b.c@d.e"):
        assert P.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "@" * 200_000, "a@" * 100_000, "1." * 100_000,
                                  "1 " * 100_000, "+1" * 100_000, "+1(" + "(" * 200_000, "a.b-" * 50_000 + "(at)"])
def test_long_runs_take_linear_time(text):
    began = time.time()
    base = P.base_spans(text)
    P.proposed_spans(text, base)
    assert time.time() - began < 10


def test_many_spans_in_one_text():
    text = "".join(f"me{i}@host{i}.org, token: 04dbebab91ab85687d33{i:06d} and " for i in range(25_000))
    began = time.time()
    base = P.base_spans(text)
    more = P.proposed_spans(text, base)
    assert len(base) >= 25_000 and len(base) + len(more) >= 50_000
    assert time.time() - began < 20


def test_proposed_spans_touch_no_base_span():
    rnd = random.Random(5)
    parts = ["me@host.org ", "128.212.154.77 ", "token: 04dbebab91ab85687d33eeaa ", "4111 1111 1111 1111 ", "+1 743 555 3824 ",
             "743 555 3824 ", "123-45-6789 ", "me (at) host.org ", "account 12345678901234 ", "Mr John Smith ", "x"]
    for _ in range(500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        base = P.base_spans(text)
        free = P.proposed_spans(text, [])
        wanted = [s for s in free if all(s[2] <= a or s[1] >= b for _, a, b in base)]
        assert P.proposed_spans(text, base) == wanted


def test_accepted_codes_equal_the_weights_decision():
    rnd = np.random.default_rng(3)
    model = P.SpanModel(rnd.normal(size=sum(P.SIZES.values())))
    for code in rnd.integers(0, int(np.prod(list(P.SIZES.values()))), 200):
        assert model.accepts(int(code)) == (float((P._design(np.array([code])) @ model.weights)[0]) > 0)
    assert not P.SpanModel(None).accepts(3)


def test_em_finds_the_reliable_labelers():
    rnd = np.random.default_rng(2)
    truth = rnd.random(5000) < 0.3
    right = [0.95, 0.9, 0.8, 0.5]
    votes = np.array([[2 if (t if rnd.random() < r else not t) else 0 for r in right] for t in truth])
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table, _ = P.reliabilities(rows, counts.astype(float))
    assert abs(prior - 0.3) < 0.05
    found = table[1, :, 2]
    assert found[0] > found[1] > found[2] > found[3]
    assert abs(found[0] - 0.95) < 0.04


ROWS = [
    (1, "und.34@mail7.example.com geiever 128.212.154.77 and"), (2, None), (3, ""), (4, "no data in here at all"),
    (5, 'x\ntoken = "04dbebab91ab85687d33eeaaf9ac699e1188"\ny'), (6, "card 4111 1111 1111 1111, call +1 (743) 555-3824"),
    (6, "card 4111 1111 1111 1111, call +1 (743) 555-3824"), (None, "é🙂 a@b.de"),
] + [(100 + i, f"text here\napi key: \"{hashlib.md5(str(i).encode()).hexdigest()}\" and mail me{i}@host{i}.org now") for i in range(30)]


def test_documents(spark):
    df = spark.createDataFrame([(i, t, "z", 5) for i, t in ROWS], "doc_id long, text string, spans string, n_ip int")
    model = P.fit(df)
    got = sorted(P.annotate(df, model).collect(), key=lambda r: (str(r.doc_id), str(r.text)))
    assert set(got[0].asDict()) == {"doc_id", "text", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"}
    for r, (i, t) in zip(got, sorted(ROWS, key=lambda r: (str(r[0]), str(r[1])))):
        base = plain_spans(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in P.BASE]
        assert r.base_sha256 == hashlib.sha256(P.joined(base).encode()).hexdigest()
        assert r.spans.startswith(P.joined(base))
        if t is None:
            assert r.redacted is None and r.spans == ""
    by = {r.doc_id: r for r in got}
    assert "secret" in by[5].spans and by[5].redacted == 'x\ntoken = "<SECRET>"\ny'
    assert by[4].redacted == ROWS[3][1]
    assert by[6].redacted == "card <CARD>, call <PHONE>"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = P.fit(df)
    assert P.annotate(df, model).count() == 0
    assert P.all_spans('token = "04dbebab91ab85687d33eeaaf9ac699e1188"', model) == ([], [])


def test_redaction_of_overlaps():
    assert P.redacted("abcdefghij", [("ip", 1, 4), ("card", 3, 6), ("phone", 8, 9)]) == "a<IP>gh<PHONE>j"
