"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. Spans.  Four base kinds (e-mail, IP address, card, phone) are matched and verified.
   Wider patterns propose further spans: secrets, phones without country code, national
   ids, spelt-out e-mail addresses, titled names, long plain numbers.
2. Votes.  Six labelers (strict pattern, gazetteer, keyword before, assignment or quotes,
   boundary, variety of characters) say yes, no or nothing about each span.
3. EM.  A two-class latent model estimates from all votes of the corpus how reliable each
   labeler is.  What leaves the tasks is one count for each different pair of feature code
   and vote code, both from fixed small sets, whatever the size of the corpus.
4. Classifier.  A logistic regression on span features is trained on the EM's posteriors of
   all spans.  It decides on the proposed spans; base spans always stay.

The text is read twice, for the counts and for the result; nothing is sampled and no text is
shuffled.  Positions are code points, the end is exclusive.

Defined cases: a null text counts as empty and has no spans; a text without spans has the
empty string and zeros; repeated rows get equal results; on an empty table the classifier
accepts nothing.  Input columns named like new ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.arrow_map import append_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_spelt", "phone_local", "national_id", "secret", "person", "account")

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive and anchored to the start of a digit run: the same matches, without rescanning long runs.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

PROPOSED = {
    "phone_local": re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{16,}={0,2}"),
    "email_spelt": re.compile(r"[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,63}"
                              r"(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,63})+"),
    "account": re.compile(r"(?<![\w+.-])[0-9]{6,34}(?![\w.-])"),
    "person": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?"),
}

# Gazetteers and keywords.
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at"}
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46",
                 "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "81", "82",
                 "86", "90", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "22", "23", "24", "25", "26", "27")
SECRET_STARTS = ("ghp_", "sk-", "sk_", "AKIA", "xox", "eyJ", "glpat-")
GIVEN_NAMES = {"anna", "maria", "john", "james", "mary", "peter", "paul", "hans", "karl", "jean", "pierre", "marie",
               "carlos", "juan", "ana", "jose", "michael", "thomas", "david", "laura", "sophie", "klaus"}
KEYWORDS = {
    "email": ("mail", "contact", "write to", "kontakt", "correo"), "email_spelt": ("mail", "contact", "kontakt"),
    "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile"), "phone_local": ("tel", "phone", "call", "fax", "mobile"),
    "national_id": ("ssn", "social", "security", "id"), "person": ("dear", "sign", "from"),
    "account": ("account", "iban", "konto", "compte", "cuenta"),
    "secret": ("token", "secret", "passw", "api", "key", "auth", "credential"),
}
BEFORE = 40  # characters before a span in which keywords are looked for

LABELERS = 6
SIZES = {"kind": len(KINDS), "length": 4, "digits": 4, "left": 4, "right": 4, "keyword": 2}


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, @ and domain; work follows the length however the @ are placed."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL_PART))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The base kinds' spans, by kind as listed, then by start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = _digits(m.group())
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(_digits(m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


def proposed_spans(text: str | None, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further spans worth a vote; those that touch a base span are left out."""
    if not text:
        return []
    digit, out = DIGIT.search(text) is not None, []
    held = sorted((a, b) for _, a, b in taken)
    starts, ends = [a for a, _ in held], list(accumulate((b for _, b in held), max))
    for kind in KINDS[len(BASE):]:
        if (kind in ("phone_local", "national_id", "secret", "account") and not digit
                or kind == "email_spelt" and "(at)" not in text and "[at]" not in text):
            continue
        for m in PROPOSED[kind].finditer(text):
            a, b = m.span()
            if kind == "secret" and (not DIGIT.search(m.group()) or _digits(m.group()) == m.group()):
                continue
            before = bisect_left(starts, b)     # base spans that start before this one ends
            if not before or ends[before - 1] <= a:
                out.append((kind, a, b))
    return out


def _strict(kind: str, s: str) -> int:
    d = _digits(s)
    good = {
        "email": lambda: s.rpartition(".")[2].isalpha() and ".." not in s,
        "ip": lambda: all(p == "0" or not p.startswith("0") for p in s.split(".")),
        "card": lambda: len({c for c in s if not c.isdigit()}) <= 1,
        "phone": lambda: s.count("(") == s.count(")") and len(d) >= 9,
        "email_spelt": lambda: s.rstrip()[-2:].isalpha(),
        "phone_local": lambda: d[0] not in "01" and s.count("(") == s.count(")"),
        "national_id": lambda: d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000",
        "secret": lambda: len(s) >= 20 and len(d) >= 3 and len(d) < len(s) - 2,
        "person": lambda: s.count(" ") >= 2,
        "account": lambda: 10 <= len(d) <= 24 and luhn(d),
    }[kind]()
    return 1 if good else -1


def _gazetteer(kind: str, s: str) -> int:
    d = _digits(s)
    if kind == "email":
        return int(s.rpartition(".")[2].lower() in TOP_DOMAINS)
    if kind == "ip":
        return 1 if 0 < int(s.split(".")[0].lstrip("0") or 0) < 224 else -1
    if kind == "card":
        return int(d.startswith(ISSUERS))
    if kind == "phone":
        return 1 if d.startswith(COUNTRY_CODES) else -1
    if kind == "secret":
        return int(s.startswith(SECRET_STARTS))
    if kind == "account":
        return -1  # no known issuer: a plain number as far as lists can tell
    if kind == "person":
        return int(any(w.lower() in GIVEN_NAMES for w in s.split(" ")))
    return 0


def _side(ch: str) -> int:
    """0: edge of the text, 1: white space or a sign, 2: quotes or an assignment, 3: letter or digit."""
    if not ch:
        return 0
    return 3 if ch.isalnum() else 2 if ch in "\"'=:`<>" else 1


def span_codes(text: str, kind: str, a: int, b: int) -> tuple[int, int]:
    """Vote code (base 3, a digit for each labeler: 0 no, 1 nothing, 2 yes) and feature code."""
    s, before = text[a:b], text[max(0, a - BEFORE):a].lower()
    left, right = _side(text[a - 1:a]), _side(text[b:b + 1])
    keyword = any(k in before for k in KEYWORDS[kind])
    body = [c for c in s if c.isalnum()]
    votes = (_strict(kind, s), _gazetteer(kind, s), int(keyword),
             1 if left == 2 and right == 2 else 0,
             1 if left < 3 and right < 3 else -1 if left == 3 and right == 3 else 0,
             1 if len(set(body)) >= min(5, 1 + len(body) // 3) else -1)
    vote = 0
    for v in votes:
        vote = vote * 3 + v + 1
    share = len(_digits(s)) / max(1, len(body))
    values = (KINDS.index(kind), min(3, len(s) // 12), min(3, int(share * 4)), left, right, int(keyword))
    feature = 0
    for v, n in zip(values, SIZES.values()):
        feature = feature * n + v
    return vote, feature


def _unfold(codes: np.ndarray, sizes: list[int]) -> np.ndarray:
    out, left = [], codes.copy()
    for n in reversed(sizes):
        out.append(left % n)
        left = left // n
    return np.array(out[::-1]).T


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns (rows x labelers of 0, 1, 2) with their counts.

    Returns the share of true spans, P(vote | class) as [class, labeler, vote], and each
    pattern's posterior.  It starts from the majority of the votes.
    """
    post = 1 / (1 + np.exp(-(votes - 1).sum(axis=1).astype(float)))
    table, prior = np.zeros((2, votes.shape[1], 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        for o in range(3):
            table[:, :, o] = weight @ (votes == o) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        ll = [np.log(table[z, np.arange(votes.shape[1]), votes]).sum(axis=1) for z in (0, 1)]
        gap = np.clip(ll[0] - ll[1] + np.log((1 - prior) / prior), -500, 500)
        post = 1 / (1 + np.exp(gap))
    return prior, table, post


@dataclass
class SpanModel:
    """P(personal | feature code) for the codes seen, by the logistic regression ``weights``."""
    weights: np.ndarray | None
    prior: float = 0.0
    votes: np.ndarray | None = None

    def __post_init__(self):
        codes = np.arange(int(np.prod(list(SIZES.values()))))
        self.accepted = None if self.weights is None else _design(codes) @ self.weights > 0

    def accepts(self, feature: int) -> bool:
        return self.accepted is not None and bool(self.accepted[feature])


def _design(codes: np.ndarray) -> np.ndarray:
    sizes = list(SIZES.values())
    return np.concatenate([np.eye(n)[v] for n, v in zip(sizes, _unfold(codes, sizes).T)], axis=1)


def train(features: np.ndarray, votes: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> SpanModel:
    """EM on the votes, then logistic regression (Newton steps) of the posteriors on the features."""
    if not len(counts):
        return SpanModel(None)
    prior, table, post = reliabilities(_unfold(votes, [3] * LABELERS), counts)
    x, w = _design(features), np.zeros(sum(SIZES.values()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (counts * (post - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return SpanModel(w, prior, table)


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """The model of all spans of all documents; the driver gets one count for each code pair."""
    found = T.ArrayType(T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("vote", T.IntegerType())]))

    def make():
        def each(part: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for t in part.column(text).to_pylist():
                base = base_spans(t)
                codes = [span_codes(t, *s) for s in base + proposed_spans(t, base)]
                out.append([{"feature": f, "vote": v} for v, f in codes])
            return [pa.array(out, pa.list_(pa.struct([("feature", pa.int32()), ("vote", pa.int32())])))]
        return each

    spans = append_columns(docs.select(text), [T.StructField("codes", found)], make, keep=[]).select(F.inline("codes"))
    rows = spans.groupBy("feature", "vote").agg(F.count("*").alias("n")).collect()
    rows.sort()
    take = lambda k: np.array([r[k] for r in rows], dtype=np.int64)
    return train(take("feature"), take("vote"), take("n").astype(float))


def all_spans(text: str | None, model: SpanModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base spans with the accepted proposed ones, by kind, then start."""
    base = base_spans(text)
    more = [s for s in proposed_spans(text, base) if model.accepts(span_codes(text, *s)[1])]
    return base, base + more


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each span replaced by its kind; of overlapping spans the first names the whole."""
    if not text or not spans:
        return text
    out, end, kind, at = [], 0, None, 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if kind is not None and a < end:
            end = max(end, b)
            continue
        if kind is not None:
            out.append(f"<{kind.upper()}>")
            at = end
        out.append(text[at:a])
        kind, end = k, b
    out.append(f"<{kind.upper()}>")
    return "".join(out) + text[end:]


def annotate(docs: DataFrame, model: SpanModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256``, ``spans`` and
    ``redacted`` (the text without the spans)."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [
        T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", "redacted")]

    def make():
        def each(part: pa.RecordBatch) -> list[pa.Array]:
            texts = part.column(text).to_pylist()
            both = [all_spans(t, model) for t in texts]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in BASE]
            digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both]
            return counts + [pa.array(x, pa.string()) for x in (
                digest, [joined(s) for _, s in both], [redacted(t, s) for t, (_, s) in zip(texts, both)])]
        return each

    return append_columns(docs, fields, make, keep=keep)
