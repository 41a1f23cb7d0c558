"""Fill-in-the-middle texts by repeated-capture matching.

One ``fullmatch`` of ``(unit)*`` cuts a whole text: the library keeps every repetition of the
group, so the ends of its captures are the token ends, and their number is ``n``.  A unit is
white space with the word behind it, or white space at the end.  All quantifiers are
possessive, which changes no match here (a unit never needs a shorter one before it) and
keeps the matcher from storing ways back.

A document's cuts and form follow from SHA-256 of ``seed:key`` alone, so they do not depend
on partitions or order.  The text is read once and nothing is shuffled.  ``restore`` rebuilds
the text from output and form with built-in functions only.

Defined cases: a null text counts as empty; an empty text, or one that holds a marker, stays
plain; a null key hashes as the empty string after the seed; repeated rows get equal
results.  Input columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.arrow_map import append_columns, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
FIELDS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
          T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
          T.StructField("output", T.StringType())]


def token_ends(text: str) -> list[int]:
    """The end of each token of ``text``, in order."""
    return UNITS.fullmatch(text).ends(1)


def draws(key: str, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def rearrange(text: str, key: str, seed: int = 42, rate: int = 50,
              spm: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, form, lengths of prefix and middle, and the text in that form.

    ``rate`` of 100 texts are rearranged, ``spm`` of 100 of those with the suffix first."""
    ends = token_ends(text)
    n, (h1, h2, h3, h4) = len(ends), draws(key, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None,
                   seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    id_ = "_fim_key"
    while id_.lower() in {c.lower() for c in docs.columns}:
        id_ += "_"
    kept = docs.columns if keep is None else keep
    needed = [F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]
    rows = docs.select(*needed, F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias(id_))

    def make():
        def each(part: pa.RecordBatch) -> list[pa.Array]:
            out = [rearrange(t or "", k, seed, rate, spm)
                   for t, k in zip(part.column(text).to_pylist(), part.column(id_).to_pylist())]
            columns = list(zip(*out)) or [()] * len(FIELDS)
            return [pa.array(c, pa.int64() if f.dataType == T.LongType() else pa.string())
                    for c, f in zip(columns, FIELDS)]
        return each

    return append_columns(rows, FIELDS, make, keep=list(kept))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.  Only a plain text can hold a marker of its own."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])) \
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))


def restore(df: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """``df`` with the texts rebuilt from ``output`` and ``form`` as column ``name``."""
    return without(df, [name]).withColumn(name, restored(F.col(output), F.col(form)))
