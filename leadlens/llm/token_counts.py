"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A text is cut into pre-tokens (byte-level BPE's words, and the strings of the vocabulary's added
tokens, which come first), whose ids never cross their borders.
Runs of ``LEAF`` pre-tokens are the leaves of a tree; each node holds the sums of characters
and of tokens below it.  The root's sum is the document's count.

An edit (start, removed, inserted) descends by characters to the leaf that ends at least
``CONTEXT`` characters before it, since no pre-token looks further ahead.  From there the
edited text is cut anew until a border falls on an old leaf's border behind the edit: from
there on both texts agree, so the old leaves hold.  The region's first leaf takes all of its
new pre-tokens, its other leaves become empty, and the sums above them are updated.  Only that
region is encoded.  A leaf that has grown past ``GROWN`` pre-tokens makes the tree be cut again
from its leaves' text, without other work.

Edits of one document apply in order, each to the result of the one before; positions are
code points and are held to the text's length.

Defined cases: a null text counts as empty with no token; a null list of edits is empty; null
fields of an edit count as 0 and ""; repeated rows are treated alike; an empty table gives no
rows.  Input columns named like new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.arrow_map import append_columns
from leadlens.llm.bpe import added_tokens, encoder

LEAF = 32
GROWN = 8 * LEAF
CONTEXT = 20   # a word looks 4 characters ahead at most; added tokens are up to 16 long
REMEMBERED = 500_000  # pre-tokens whose counts a task keeps


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex
    return regex.compile(public_tokenizers.PATTERN)


def words_from(text: str, first: int = 0) -> Iterator[tuple[str, int]]:
    """The pre-tokens of ``text`` from ``first`` on, with their ends; between added tokens words are cut alone."""
    at = first
    for m in added_tokens().finditer(text, first):
        for w in _pattern().finditer(text, at, m.start()):
            yield w.group(), w.end()
        yield m.group(), m.end()
        at = m.end()
    for w in _pattern().finditer(text, at):
        yield w.group(), w.end()


def words_of(text: str) -> list[str]:
    """All pre-tokens of ``text``."""
    out, at = [], 0
    for m in added_tokens().finditer(text):
        out += _pattern().findall(text, at, m.start())
        out.append(m.group())
        at = m.end()
    return out + _pattern().findall(text, at) if at else _pattern().findall(text)


class Counter:
    """Token count of a pre-token, remembered up to a bound."""

    def __init__(self):
        self.encode, self.known = encoder(), {}

    def __call__(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = len(self.encode(word))
            if len(word) <= 40:
                self.known[word] = n
        return n


class PreTokenTree:
    """The tree of one text: ``chars`` and ``tokens`` in heap order, leaves last."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.width = len(chars) // 2

    @classmethod
    def over(cls, leaf_chars: list[int], leaf_tokens: list[int]) -> PreTokenTree:
        width = 1
        while width < len(leaf_chars):
            width *= 2
        both = []
        for values in (leaf_chars, leaf_tokens):
            heap = np.zeros(2 * width, dtype=np.int64)
            heap[width:width + len(values)] = values
            level = width
            while level > 1:
                heap[level // 2:level] = heap[level:2 * level:2] + heap[level + 1:2 * level:2]
                level //= 2
            both.append(heap)
        return cls(*both)

    @classmethod
    def of(cls, text: str, count: Counter) -> PreTokenTree:
        words = words_of(text)
        runs = [words[a:a + LEAF] for a in range(0, len(words), LEAF)]
        return cls.over([sum(map(len, r)) for r in runs], [sum(map(count, r)) for r in runs])

    def total(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character ``pos`` (the last one if there is none) and its first character."""
        node, first = 1, 0
        while node < self.width:
            node *= 2
            if pos >= first + self.chars[node]:
                first += int(self.chars[node])
                node += 1
        return node - self.width, first

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """Set a leaf's sums and those of the nodes above it."""
        node = leaf + self.width
        more_chars, more_tokens = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node and (more_chars or more_tokens):
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, text: str, start: int, removed: int, inserted: str, count: Counter) -> tuple[str, int, PreTokenTree]:
        """The edited text, the number of characters cut anew, and the tree (a new one if it was cut again)."""
        start = min(max(start, 0), len(text))
        removed = min(max(removed, 0), len(text) - start)
        new = text[:start] + inserted + text[start + removed:]
        if new == text:
            return new, 0, self
        leaf, first = self.leaf_at(max(0, start - CONTEXT))
        shift, after = len(inserted) - removed, start + removed
        last, border = leaf, first + int(self.chars[leaf + self.width])  # old leaves leaf..last are replaced
        at, tokens, words = first, 0, 0
        for word, at in words_from(new, first):
            tokens, words = tokens + count(word), words + 1
            while last + 1 < self.width and (border < after or border + shift < at):
                last += 1
                border += int(self.chars[last + self.width])
            if border >= after and border + shift == at:
                break
        else:
            last = self.width - 1
        for other in range(leaf + 1, last + 1):
            self.put(other, 0, 0)
        self.put(leaf, at - first, tokens)
        if words > GROWN:
            return new, at - first, self.recut(new, leaf, first, at, count)
        return new, at - first, self

    def recut(self, text: str, leaf: int, first: int, end: int, count: Counter) -> PreTokenTree:
        """A tree in which the leaf over text[first:end] is split into leaves of ``LEAF`` pre-tokens."""
        words = [w for w, _ in takewhile(lambda w: w[1] <= end, words_from(text, first))]
        runs = [words[a:a + LEAF] for a in range(0, len(words), LEAF)]
        chars, tokens = self.chars[self.width:].tolist(), self.tokens[self.width:].tolist()
        own_chars = chars[:leaf] + [sum(map(len, r)) for r in runs] + chars[leaf + 1:]
        own_tokens = tokens[:leaf] + [sum(map(count, r)) for r in runs] + tokens[leaf + 1:]
        held = [i for i, n in enumerate(own_chars) if n]
        return PreTokenTree.over([own_chars[i] for i in held], [own_tokens[i] for i in held])


TREE = T.StructType([T.StructField("chars", T.ArrayType(T.LongType())), T.StructField("tokens", T.ArrayType(T.LongType()))])
_TREE_ARROW = pa.struct([("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])


def with_trees(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``tree`` and its root's sum ``n_tokens``."""
    def make():
        count = Counter()

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            trees = [PreTokenTree.of(t or "", count) for t in part.column(text).to_pylist()]
            return [pa.array([{"chars": t.chars, "tokens": t.tokens} for t in trees], _TREE_ARROW),
                    pa.array([t.total() for t in trees], pa.int64())]
        return each

    return append_columns(docs, [T.StructField("tree", TREE), T.StructField("n_tokens", T.LongType())], make)


def apply_edits(trees: DataFrame, edits: str = "edits", text: str = "text") -> DataFrame:
    """``trees`` after the column ``edits``: array<struct<start, removed, inserted>>.

    Text, tree and ``n_tokens`` are those after the edits; ``recut_chars`` is the number of
    characters that were cut and encoded anew.
    """
    def make():
        count = Counter()

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            texts, out, done = [], [], []
            for t, tree, todo in zip(part.column(text).to_pylist(), part.column("tree").to_pylist(), part.column(edits).to_pylist()):
                t, recut = t or "", 0
                tree = PreTokenTree(np.array(tree["chars"], dtype=np.int64), np.array(tree["tokens"], dtype=np.int64))
                for e in todo or []:
                    if e:
                        t, n, tree = tree.edit(t, e["start"] or 0, e["removed"] or 0, e["inserted"] or "", count)
                        recut += n
                texts.append(t)
                out.append(tree)
                done.append(recut)
            return [pa.array(texts, pa.string()), pa.array([{"chars": t.chars, "tokens": t.tokens} for t in out], _TREE_ARROW),
                    pa.array([t.total() for t in out], pa.int64()), pa.array(done, pa.int64())]
        return each

    return append_columns(trees, [T.StructField(text, T.StringType()), T.StructField("tree", TREE),
                                  T.StructField("n_tokens", T.LongType()), T.StructField("recut_chars", T.LongType())], make)


def sample_edits(text: Column) -> Column:
    """Three edits for any text: repeat its start at a third, drop 15 characters at the half, close with a full stop."""
    n = F.length(text)
    edit = lambda start, removed, inserted: F.struct(
        start.cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    return F.array(edit(F.floor(n / 3), 0, F.substring(text, 1, 20)), edit(F.floor(n / 2), 15, F.lit("")),
                   edit(n + 5, 0, F.lit(" end.")))
