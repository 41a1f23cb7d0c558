import hashlib
import random
import re
import string
import time

import pytest

from leadlens.llm import secret_scan as scan
from leadlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"     # the smaller table holds no secret
PLAIN = {
    "assign": r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def plain_spans(text):
    """The base patterns as stated, each match tested afterwards."""
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            if {"assign": lambda: len(m.group(2)) >= 6, "access": lambda: len(m.group()) >= 20,
                    "hex": lambda: len(m.group()) >= 24}[kind]():
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_secret_scan"](spark, SF).collect()}
    assert len(got) == len(docs)
    seen = 0
    for i, text in docs:
        want, r = plain_spans(text), got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for x, *_ in want) for k in scan.BASE)
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("novel")] == (joined(want).split(",") if want else [])
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)
        seen += len(want)
    assert seen


def test_base_spans_on_made_texts():
    rng = random.Random(2)
    parts = ["token", "ToKen", "SECRET", "api_key", "apikey", "passwd", "password", " ", "  ", ":", "=", "==", '"', "'", "abc", "abcdef",
             "ſecret", "toKen", "é", "AKIA", "A" * 15, "A" * 16, "0f" * 11, "0f" * 12, "-", "\n", "a1/"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert scan.base_spans(text) == plain_spans(text)


PROSE = ("The service reads its settings once when the worker starts and keeps them until the next release. Every "
         "request has a header that names the client, and the handler writes an entry for each of them. ")


def planted(rng, kind):
    alphabet = {"base64": string.ascii_letters + string.digits, "hex": "0123456789ABCDEF"}[kind]
    while True:
        s = "".join(rng.choice(alphabet) for _ in range(rng.choice([20, 24, 32, 40])))
        if sum(any(c in k for c in s) for k in (string.ascii_lowercase, string.ascii_uppercase, string.digits)) >= 2:
            return s


def test_random_strings_in_sensitive_context_are_found_and_names_are_not():
    rng, compressor = random.Random(4), scan.primed(["widget", "invoice", "customer"])
    hits = wrong = away = 0
    names = ["getUserAccountById", "customerInvoiceTable", "requestHandlerTimeout2", "SessionStorageManager",
             "config/service/default.json", "loadClientConfiguration", "access_control_policy_v2"]
    for k in range(300):
        s = planted(rng, ("base64", "hex")[k % 2])
        text = f"{PROSE}The private key is {s} as of today. {PROSE}"
        at = text.index(s)
        hits += [x[:3] for x in scan.novel_spans(text, [], compressor)] == [("novel", at, at + len(s))]
        away += bool(scan.novel_spans(f"{PROSE}The build {s} is the last. {PROSE}", [], compressor))
    for name in names:
        wrong += bool(scan.novel_spans(f"{PROSE}The secret is read by {name} at the start. {PROSE}", [], compressor))
    assert hits >= 0.98 * 300 and wrong == 0 and away == 0


def test_a_key_given_twice_stays_new_and_known_pieces_do_not():
    s, compressor = "qZ83hfKd02mXv7Tq9LrW", scan.primed([])
    text = f"{PROSE}credential {s} and again the credential {s} of it."
    assert len(scan.novel_spans(text, [], compressor)) == 2
    odd = "vroblexQuantigorPlimsatorx1"
    text = f"{PROSE}The token holder {odd} of it."
    assert scan.novel_spans(text, [], compressor)
    assert not scan.novel_spans(text, [], scan.primed(["vroble", "quantigor", "uantigor", "limsatorx"]))


def test_pieces_count_over_all_documents(spark):
    rows = [(i, f"see the moduleZyxwvut{i % 3}Qrstuv here") for i in range(25)] + [(99, "onceOnlyIdentifier7"), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert scan.fit(df) == ["module", "rstuv", "yxwvut"]
    assert scan.fit(df.limit(0)) == []


def test_defined_cases(spark):
    secret = "pw: token = abcdef1 and AKIA" + "Z" * 16 + " key kR7pQ2zV9xLm4TbW8s " + "0f" * 12
    rows = [(1, None, 1), (2, "", 1), (3, secret, 1), (3, secret, 1), (None, secret, 1), (4, "é" * 10 + "\U0001F600 " + secret, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Findings int")
    out = scan.annotate(df, [])
    assert out.columns == ["doc_id", "text", "findings"]
    got = [(r.doc_id, [(f.kind, f.start, f.end) for f in r.findings]) for r in out.collect()]
    found = dict(got)
    assert found[1] == found[2] == []
    assert [k for k, _, _ in found[3]] == ["assign", "access", "novel", "hex"] and found[3] == found[None]
    assert [(k, a - 12, b - 12) for k, a, b in found[4]] == found[3] and len(got) == len(rows)
    assert scan.annotate(df.limit(0), []).count() == 0


@pytest.mark.parametrize("text", ["token = abcdef1, " * 50_000, "token" + " " * 500_000, "a1" * 500_000, "key aB3" * 100_000,
                                  " ".join(f"key{k}Ab{k * 7919}" for k in range(20_000))])
def test_long_texts(text):
    start = time.time()
    base = scan.base_spans(text)
    scan.novel_spans(text, base, scan.primed([]))
    assert time.time() - start < 30
