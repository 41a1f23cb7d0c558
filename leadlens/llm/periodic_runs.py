"""Periodic runs of words, by recursive frequency splitting.

A run is a stretch of words whose smallest period is q, of max(12, 2q) words or more, that
no neighbouring word extends.  Each of its words occurs at least twice in it.  So a word that
occurs once in a segment is part of no run there and splits the segment; segments of under 12
words are dropped; what is left is counted again, segment by segment, until nothing changes.
In ordinary prose nothing is left after a few rounds.

A lag scan finds the runs of the surviving segments.  With lag q, a run is a stretch of
equalities ``word[i] == word[i + q]`` of max(12 - q, q) or more, so it covers one of the
positions q-1, 2q-1, 3q-1, ...: only these are tried, m ln m pairs over all lags of a segment
of m words.  Pairs that agree are extended both ways by binary lifting on the ranks of blocks
of 1, 2, 4, ... words (exact, no hashing).  A stretch's smallest period is the smallest lag that
gives the same start and end: a multiple of a run's period gives the same stretch, and another
lag cannot (Fine and Wilf).  So all runs are found, in m log^2 m steps for m words.

``collapse`` drops a word that some run holds after the run's first q words.

Work is done per document inside Arrow batches; nothing is shuffled.  Memory follows one
document.  Defined cases: a null or empty text has no words, no runs and an empty collapsed
text; repeated rows get equal results.  Input columns named like the new ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leadlens.llm.arrow_map import append_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 12          # words of a run at least
PAIRS = 1 << 20     # position pairs handled at once in a lag scan


def codes_of(words: list[str]) -> np.ndarray:
    """Equal numbers for equal words, from 0."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def surviving_segments(codes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) in which every word occurs twice or more, the only places of runs."""
    at, segment = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    while len(at) >= LEAST:
        _, group, times = np.unique(segment * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        stay = times[group] > 1
        left, old = at[stay], segment[stay]
        breaks = np.ones(len(left), bool)
        breaks[1:] = (np.diff(left) > 1) | (np.diff(old) > 0)
        new = np.cumsum(breaks) - 1
        long_enough = (np.bincount(new) >= LEAST)[new] if len(new) else np.zeros(0, bool)
        if stay.all() and long_enough.all():
            first = np.flatnonzero(breaks)
            return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(first, [*first[1:], len(at)])]
        at, segment = left[long_enough], new[long_enough]
    return []


def block_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """For each power of two, a number for the block of so many words at each position."""
    ranks, width = [np.unique(codes, return_inverse=True)[1]], 1
    while 2 * width <= len(codes):
        low, high = ranks[-1][:-width], ranks[-1][width:]
        ranks.append(np.unique(low.astype(np.int64) * len(codes) + high, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return ranks


def _agree(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """Words by which the texts at a < b agree, ahead from these positions or back from before them."""
    done = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        width, rank = 1 << k, ranks[k]
        x, y = (a - done - width, b - done - width) if back else (a + done, b + done)
        fits = (x >= 0) if back else (y < len(rank))
        same = np.zeros(len(a), bool)
        same[fits] = rank[x[fits]] == rank[y[fits]]
        done += same * width
    return done


def segment_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one segment."""
    m, ranks, best = len(codes), block_ranks(codes), {}
    lags = np.arange(1, m // 2 + 1)
    tries = m // lags - 1          # positions q-1, 2q-1, ... with a partner q further on
    ends = np.cumsum(tries)
    lo = 0
    while lo < len(lags):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS)))
        q, n = lags[lo:hi], tries[lo:hi]
        lag = np.repeat(q, n)
        nth = np.arange(len(lag)) - np.repeat(np.cumsum(n) - n, n) + 1
        at = nth * lag - 1
        hit = codes[at] == codes[at + lag]
        at, lag = at[hit], lag[hit]
        start = at - _agree(ranks, at, at + lag, back=True)
        length = at - start + _agree(ranks, at, at + lag, back=False) + lag
        good = length >= np.maximum(LEAST, 2 * lag)
        found = np.unique(np.stack([start, length, lag])[:, good], axis=1)
        for s, n_, q_ in found.T.tolist():
            if best.get((s, n_), m) > q_:
                best[s, n_] = q_
        lo = hi
    return [(s, n, q) for (s, n), q in best.items()]


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period), by start, then period."""
    out = [(a + s, n, q) for a, b in surviving_segments(codes) for s, n, q in segment_runs(codes[a:b])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those in no run, or only in the first period of one."""
    step = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    return np.cumsum(step[:-1]) == 0


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
              prepare: Callable[[dict, list[str]], list[str]] | None = None,
              reads: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period by start, then period) and ``collapsed``, the
    kept words joined by a space.

    ``prepare`` may change a document's words before the search; it gets the row's columns ``reads`` as well.
    """
    kept = list(docs.columns if keep is None else keep)
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)),
              T.StructField("collapsed", T.StringType())]
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def make():
        def each(part: pa.RecordBatch) -> list[pa.Array]:
            counts, found, texts = [], [], []
            given = part.select(list(reads)).to_pylist() if reads else [{}] * part.num_rows
            for t, row in zip(part.column(text), given):
                words = WORD.findall(t.as_py() or "")
                if prepare is not None:
                    words = prepare(row, words)
                runs = runs_of(codes_of(words))
                if runs:
                    stay = kept_words(len(words), runs)
                    texts.append(" ".join([w for w, s in zip(words, stay) if s]))
                else:
                    texts.append(" ".join(words))
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            return [pa.array(counts, pa.int64()), pa.array(found, arrow), pa.array(texts, pa.string())]
        return each

    needed = list(dict.fromkeys([*kept, text, *reads]))
    return append_columns(docs.select(*[f"`{c}`" for c in needed]), fields, make, keep=kept)
