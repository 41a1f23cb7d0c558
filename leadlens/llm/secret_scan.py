"""Secrets by dictionary-primed compression.

1. Base spans.  Assignments to a sensitive name, access key ids and long hexadecimal strings
   are matched as stated by their patterns; they always stay.
2. Candidates.  Other strings of 12 or more key characters, of two classes out of lower case,
   upper case and digits, that touch no base span and have a sensitive word in the 48
   characters before them.
3. Novelty.  A zstandard compressor is primed with a dictionary of identifier pieces.  A
   candidate's marginal bytes are the compressed size of the surrounding text with it less
   that without it; other copies of the candidate are taken out of the surroundings, so that
   a key given twice stays new.  At 0.7 bytes a character or more it is reported: names made
   of known pieces, or of what stands around, cost about 0.4, random strings 0.8 and more.

The identifier dictionary has a fixed list of common code words, and the pieces (runs of 4 or
more lower-case letters) of all candidate-like strings of all documents, by the number of
documents that hold them: those of ``min_docs`` and more, ``MAX_PIECES`` at most, which
bounds the compressor's dictionary.  Only its pieces leave the tasks, added up before the
shuffle; texts are not shuffled.

Positions are code points, the end is exclusive.  Defined cases: a null text counts as empty
and has no findings; repeated rows get equal results; on an empty table the dictionary has
the fixed words only.  Input columns named like the new ones are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.arrow_map import append_columns

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")   # the first match in a run of these characters is its longest
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

STRING = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{12,}")
EDGES = ".-/+"
PIECE = re.compile(r"[a-z]{4,}")
CLASSES = [re.compile(c) for c in ("[a-z]", "[A-Z]", "[0-9]")]
SENSITIVE = re.compile(r"passw|passphrase|secret|token|credential|private|bearer|authori[sz]ation|signature"
                       r"|(?<![a-z])(?:api|access|auth|encryption|signing)?[_ -]?keys?(?![a-z])|(?<![a-z])(?:pwd|auth)(?![a-z])",
                       re.IGNORECASE | re.ASCII)
BEFORE = 48         # characters before a candidate in which a sensitive word must stand
AROUND = 256        # characters on either side that count as its surroundings
NOVEL = 0.7         # marginal bytes a character from which a candidate is reported
LEVEL = 19
MAX_PIECES = 4096

CODE_WORDS = """
access account action address admin array async auth authorization base bearer boolean bucket buffer build byte
cache callback certificate class client cloud cluster code column config configuration connection const container
content context controller cookie credential data database date debug default delete description development domain
element email enable encoding endpoint environment error event exception export false field file filter float format
function global group handler hash header host https identifier image import index input instance integer interface
internal json label language length library list local location logger login manager master message method model
module name network null number object option output package parameter parent password path pattern permission
platform plugin policy port prefix private process production project property protocol provider public query queue
random record region register release remote request resource response result return role route schema script secret
security select server service session setting signature size source staging start state static status storage
stream string subscription suffix table target template test thread time timeout token true type update upload user
username value variable version virtual webhook window worker write
""".split()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' spans, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def free_of(spans: list[tuple[str, int, int]]):
    """A test whether a stretch touches none of ``spans``."""
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k == 0 or merged[k - 1][1] <= a
    return free


def strings(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Strings of key characters of two classes or more that touch no span of ``taken``."""
    out, free = [], free_of(taken)
    for m in STRING.finditer(text):
        s = m.group()
        a, b = m.end() - len(s.lstrip(EDGES)), m.start() + len(s.rstrip(EDGES))
        if b - a >= 12 and sum(c.search(text, a, b) is not None for c in CLASSES) >= 2 and free(a, b):
            out.append((a, b))
    return out


def primed(pieces: list[str]) -> zstandard.ZstdCompressor:
    """A compressor that knows the code words and ``pieces``, the most frequent last, where they cost least."""
    words = [*CODE_WORDS, *reversed(pieces)]
    known = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False,
                                    write_dict_id=False)


def marginal_bytes(compressor: zstandard.ZstdCompressor, text: str, a: int, b: int) -> int:
    """Compressed bytes that ``text[a:b]`` adds to its surroundings."""
    s = text[a:b]
    before, after = (part.replace(s, " ") for part in (text[max(0, a - AROUND):a], text[b:b + AROUND]))
    size = lambda t: len(compressor.compress(t.encode()))
    return size(before + s + after) - size(before + after)


def novel_spans(text: str, taken: list[tuple[str, int, int]],
                compressor: zstandard.ZstdCompressor) -> list[tuple[str, int, int, int]]:
    """Candidates that are new to the compressor, with their marginal bytes."""
    out = []
    if SENSITIVE.search(text):
        for a, b in strings(text, taken):
            if SENSITIVE.search(text, max(0, a - BEFORE), a):
                n = marginal_bytes(compressor, text, a, b)
                if n >= NOVEL * (b - a):
                    out.append(("novel", a, b, n))
    return out


def fit(docs: DataFrame, text: str = "text", min_docs: int = 20) -> list[str]:
    """The identifier pieces of all documents, the most frequent first."""
    def make():
        def each(part: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for t in part.column(text):
                t = t.as_py() or ""
                out.append(sorted({p for a, b in strings(t, base_spans(t)) for p in PIECE.findall(t, a, b)}))
            return [pa.array(out, pa.list_(pa.string()))]
        return each

    fields = [T.StructField("pieces", T.ArrayType(T.StringType()))]
    pieces = append_columns(docs.select(text), fields, make, keep=[]).select(F.explode("pieces").alias("piece"))
    counted = pieces.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return [r.piece for r in counted.orderBy(F.desc("n"), "piece").limit(MAX_PIECES).collect()]


def annotate(docs: DataFrame, pieces: list[str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``findings``: kind, start, end and marginal bytes (novel ones only), by start, then kind."""
    kept = list(docs.columns if keep is None else keep)
    entry = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                          T.StructField("end", T.LongType()), T.StructField("bytes", T.LongType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.int64())]))

    def make():
        compressor = primed(pieces)

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for t in part.column(text):
                t = t.as_py() or ""
                base = base_spans(t)
                novel = novel_spans(t, base, compressor)
                size = {s[:3]: s[3] for s in novel}
                out.append([{"kind": k, "start": a, "end": b, "bytes": size.get((k, a, b))}
                            for k, a, b in in_order(base + [*size])])
            return [pa.array(out, arrow)]
        return each

    needed = list(dict.fromkeys([*kept, text]))
    return append_columns(docs.select(*[f"`{c}`" for c in needed]), [T.StructField("findings", T.ArrayType(entry))],
                          make, keep=kept)
