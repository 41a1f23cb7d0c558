"""Sum-of-squares online packing of documents into windows of ``size`` tokens.

A document's ids, with the end id, are cut into full windows and a remainder.  Remainders
are packed online: the level array ``counts[h]`` holds how many open windows are filled to
h.  Each remainder goes to the level (or a new window) for which the sum of the squared
counts becomes smallest; ties go to the fuller window.  Full windows leave at once.

At the end of a task the windows still open are topped up: the emptiest are taken apart to
fill the fullest, cutting where needed, and the single window that stays partial is cut at
powers of two, which need no padding.  So a task pads nothing, whatever its documents.

Each input partition is packed by itself, in its row order, so tasks need no shuffle and a
repeated task gives the same windows.  ``sequence_id`` is the partition's number times 2**33
plus a running number.  A task holds the remainders of its open windows, no whole partition.

Defined cases: a null or empty text is the end id alone; a text of any length is cut as
needed; repeated rows are packed each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leadlens.llm.arrow_map import for_workers
from leadlens.llm.bpe import encoder

END_ID = 1


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    total: int


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    fill: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece.ids)


class Packer:
    """Packs pieces online; ``add`` returns the windows that became full, ``finish`` the rest."""

    def __init__(self, size: int = 2048):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)  # by level; 0 (a new window) and size (full) stay 0
        self.open: list[list[Window]] = [[] for _ in range(size)]

    def level_for(self, n: int) -> int:
        """The level whose choice for a piece of n ids makes the sum of squares smallest."""
        counts = self.counts
        last = self.size - n
        change = 2 * counts[n:self.size + 1] + 1
        change[-1] = 0  # a full window leaves
        change[1:] -= 2 * counts[1:last + 1] - 1
        change[1:][counts[1:last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(change[::-1].argmin())

    def add(self, doc: object, ids: np.ndarray) -> list[Window]:
        full, total = [], len(ids)
        whole = total - total % self.size
        for at in range(0, whole, self.size):
            full.append(Window([Piece(doc, at, ids[at:at + self.size], total)], self.size))
        if whole < total:
            level = self.level_for(total - whole)
            window = self.open[level].pop() if level else Window()
            self.counts[level] -= level > 0
            window.add(Piece(doc, whole, ids[whole:].copy(), total))
            if window.fill == self.size:
                full.append(window)
            else:
                self.counts[window.fill] += 1
                self.open[window.fill].append(window)
        return full

    def finish(self) -> list[Window]:
        rest = [w for level in reversed(self.open) for w in level]
        out, low = [], len(rest) - 1
        for high, window in enumerate(rest):
            while window.fill < self.size and high < low:
                window.add(_cut(rest[low], self.size - window.fill))
                low -= rest[low].fill == 0
            if window.fill == self.size:
                out.append(window)
            else:
                while window.fill:
                    part = Window()
                    room = 1 << (window.fill.bit_length() - 1)
                    while room:
                        piece = _cut(window, room)
                        part.add(piece)
                        room -= len(piece.ids)
                    out.append(part)
            if high >= low:
                break
        return out


def _cut(window: Window, most: int) -> Piece:
    """Take the last piece, or the last ``most`` ids of it, out of ``window``."""
    piece = window.pieces.pop()
    if len(piece.ids) > most:
        keep = len(piece.ids) - most
        window.pieces.append(Piece(piece.doc, piece.start, piece.ids[:keep], piece.total))
        piece = Piece(piece.doc, piece.start + keep, piece.ids[keep:], piece.total)
    window.fill -= len(piece.ids)
    return piece


def pack(docs: DataFrame, size: int = 2048, text: str = "text", key: str = "doc_id", rows_out: int = 8192) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id and offset in the sequence."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(c, T.LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows = encoder(), Packer(size), []
        number = TaskContext.get().partitionId() << 33
        types = None

        def emit(windows: list[Window]) -> None:
            nonlocal number
            for w in windows:
                offset = 0
                for p in w.pieces:
                    rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, number, offset))
                    offset += len(p.ids)
                number += 1

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        for b in batches:
            types = [b.schema.field(key).type] + [pa.int64()] * 6
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, t in zip(part.column(key).to_pylist(), part.column(text).to_pylist()):
                    emit(packer.add(doc, np.append(encode(t) if t else np.empty(0, "<u4"), np.array(END_ID, "<u4"))))
                if len(rows) >= rows_out:
                    yield batch()
        emit(packer.finish())
        if rows:
            yield batch()

    return for_workers(docs).select(key, text).mapInArrow(run, schema)
