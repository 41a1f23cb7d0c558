"""SentencePiece BPE as a weighted finite-state transducer.

The transducer is compiled from a model file in three parts:

* the normaliser: a dummy prefix, spaces written as the mark U+2581, optional removal of
  repeated spaces (character rewriting tables are refused, not ignored);
* the pieces: a trie over their characters, each path an arc that emits the piece's id;
* byte fallback: a character without a piece is an arc that emits the ids of its bytes.

Composed with an input it is a lattice from character to character.  Arc weights depend on
the piece before: 0 if the two pieces, written together, are cut into just these two by the
model's merges, else infinity.  All cuts of a text into pieces whose neighbours agree in this
way are the merges' own result: the first merge across a boundary of the cut would also
happen between the two neighbours alone.  So each position has one state of finite distance,
the tropical shortest path runs from left to right with one state a position, and its output
is what the merge procedure gives, without simulating it on the text.

No piece spans a place between two characters that no piece has side by side, so the lattice
falls apart there, as it does before each run of marks.  The paths of short parts are
remembered within a task, up to a bounded number, those used of late for longest.

Defined cases: null text gives null ids, an empty text none; a text of any length is read
whole; decoding gives the text back, with U+2581 read as a space.  Invalid byte runs decode
to U+FFFD.  Input columns named like new ones are replaced.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leadlens.llm.arrow_map import append_columns

MARK = "▁"
REMEMBERED = 800_000  # paths, and pair weights, that a task keeps at most
SHORT = 48            # parts of up to so many characters are remembered
END = ""              # key of a trie node's piece


class Transducer:
    """Encoder and decoder compiled from a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with an identity normaliser and marks in front is needed")
        self.dummy_prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text_of = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.text_of[i]: sp.get_score(i) for i in plain}
        self.byte_id = {int(self.text_of[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}  # "<0x0A>"
        self.unknown = sp.unk_id()
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece has the space mark behind its front")
        self.trie: dict = {}
        for i in plain:
            node = self.trie
            for ch in self.text_of[i]:
                node = node.setdefault(ch, {})
            node[END] = i
        self.pairs = {a + b for p in self.score for a, b in zip(p, p[1:])}
        self.older: dict[str, bytes] = {}
        self.high = {i for b, i in self.byte_id.items() if b >= 0x80}
        self.plain = ["" if i in self.silent else " ⁇ " if i == self.unknown else
                      chr(self.byte_of[i]) if i in self.byte_of else t.replace(MARK, " ") for i, t in enumerate(self.text_of)]
        self.paths: dict[str, bytes] = {}
        self.weights: dict[int, bool] = {}

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself, for short texts: the best pair first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, left: int, right: int) -> bool:
        """Whether the weight of ``right`` after ``left`` is 0, not infinity (-1: fallback or the start)."""
        if left < 0 or right < 0:
            return right < 0 or self.stable(right)
        key = left << 32 | right
        known = self.weights.get(key)
        if known is None:
            if len(self.weights) >= REMEMBERED:
                self.weights.clear()
            a, b = self.text_of[left], self.text_of[right]
            known = self.weights[key] = self.merged(a + b) == [a, b]
        return known

    def stable(self, piece: int) -> bool:
        key = -1 - piece
        known = self.weights.get(key)
        if known is None:
            known = self.weights[key] = self.merged(self.text_of[piece]) == [self.text_of[piece]]
        return known

    def shortest_path(self, text: str) -> bytes:
        """Ids (unsigned 32-bit) on the path of weight 0 through the lattice of a normalised text."""
        n = len(text)
        last: list[int | None] = [None] * (n + 1)  # the piece that ends here on the path; -1: fallback or start
        start = [0] * (n + 1)
        last[0] = -1
        for i in range(n):
            before = last[i]
            if before is None:
                continue
            node, j = self.trie, i
            if text[i] not in node:
                last[i + 1], start[i + 1] = -1, i
                continue
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                piece = node.get(END)
                if piece is not None and last[j] is None and self.agree(before, piece):
                    last[j], start[j] = piece, i
        out, at = [], n
        while at > 0:
            piece = last[at]
            if piece >= 0:
                out.append(piece)
            else:
                data = text[start[at]:at].encode("utf-8", "surrogatepass")
                out += [self.byte_id[b] for b in reversed(data)] if self.byte_id else [self.unknown]
            at = start[at]
        return array("I", reversed(out)).tobytes()

    def encode(self, text: str) -> bytes:
        out = []
        for part in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", self.normalise(text)):
            path = self.paths.get(part)
            out.append(self.path_of(part) if path is None else path)
        return b"".join(out)

    def path_of(self, part: str) -> bytes:
        path = self.older.get(part)
        if path is None:
            cuts = [i for i in range(1, len(part)) if part[i - 1:i + 1] not in self.pairs]
            if cuts:
                spans = zip([0, *cuts], [*cuts, len(part)])
                path = b"".join([self.paths.get(part[a:b]) or self.path_of(part[a:b]) for a, b in spans])
            else:
                path = self.shortest_path(part)
        if len(part) <= SHORT:
            if len(self.paths) >= REMEMBERED // 2:
                self.older, self.paths = self.paths, {}
            self.paths[part] = path
        return path

    def decode(self, ids: list[int]) -> str:
        """The inverse transducer: pieces to text, byte runs to characters, marks to spaces."""
        first = next((i for i in ids if i not in self.silent), None)
        drop = int(self.dummy_prefix and first is not None and self.text_of[first].startswith(MARK))
        if self.high.isdisjoint(ids):
            return "".join(map(self.plain.__getitem__, ids))[drop:]
        out, run = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(_characters(run))
                run = bytearray()
            out.append(self.plain[i])
        if run:
            out.append(_characters(run))
        return "".join(out)[drop:]


def _characters(run: bytearray) -> str:
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):  # each byte that starts no character stands alone
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at:at + n].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    n = 0
            else:
                out.append("�")
            at += max(1, n)
        return "".join(out)


def _ids(path: bytes) -> list[int]:
    out = array("I")
    out.frombytes(path)
    return out.tolist()


@lru_cache(maxsize=2)
def transducer(model: str) -> Transducer:
    return Transducer(model)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``pieces``, the ids of the text."""
    def make():
        t = transducer(model_path(model))

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            rows = [None if x is None else t.encode(x) for x in part.column(text).to_pylist()]
            ends = np.cumsum([0] + [len(r or b"") // 4 for r in rows])
            values = np.frombuffer(b"".join(r or b"" for r in rows), dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values),
                                             mask=pa.array([r is None for r in rows], pa.bool_()))]
        return each

    return append_columns(docs, [T.StructField("pieces", T.ArrayType(T.IntegerType()))], make, keep=keep)


def decode(docs: DataFrame, model: str = "piece_bpe_32k.model", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``decoded``, the text of ``pieces``."""
    def make():
        t = transducer(model_path(model))

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            column = part.column("pieces")
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            rows = [t.decode(values[a:b].tolist()) if ok else None
                    for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist())]
            return [pa.array(rows, pa.string())]
        return each

    return append_columns(docs, [T.StructField("decoded", T.StringType())], make, keep=keep)
