"""Sums of products over a table in one pass: normal equations and masked co-moments.

Each task adds up its rows in matrix products and returns one small row for each block of
the matrix; these meet by block.  What is shuffled grows with the number of tasks and the
square of the number of columns, not with the rows.

Means and co-moments are kept centred and merged by the parallel update (Chan, Golub and
LeVeque), so large values far from zero lose no digits and a constant column has a spread of
exactly zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import lists, map_batches

BLOCK_ROWS = 64    # rows of a matrix that travel together
DIRECT_BYTES = 64 << 20   # tasks' results up to this size go straight to the driver


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int],
           n_tasks: int | None = None) -> np.ndarray:
    """The sum of the matrices ``part(batch)`` over all batches of ``df``.

    The tasks' matrices are added up on the driver if all of them together are small, else in a
    shuffle by block, from which one matrix comes.  ``n_tasks`` is the number of partitions of a
    materialised ``df`` (see ``tasks``); unknown, the sums are shuffled."""
    starts = range(0, shape[0], BLOCK_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        for k, a in enumerate(starts):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), lists(total[a:a + BLOCK_ROWS].reshape(1, -1))],
                                             names=["block", "v"])

    out = np.zeros(shape)
    parts = map_batches(df, "block int, v array<double>", run)
    if n_tasks is not None and n_tasks * shape[0] * shape[1] * 8 <= DIRECT_BYTES:
        table = parts.toArrow()
        found = zip(table["block"].to_pylist(), _vectors(table["v"]))
    else:
        rows = parts.groupBy("block").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()   # one row a block
        found = ((r["block"], r["v"].toArray()) for r in rows)
    for block, v in found:
        out[block * BLOCK_ROWS:(block + 1) * BLOCK_ROWS] += v.reshape(-1, shape[1])
    return out


def _vectors(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in column.chunks:
        for k in range(len(chunk)):
            yield chunk[k].values.to_numpy()


def tasks(df: DataFrame) -> int:
    """Partitions of a materialised table."""
    return df.rdd.getNumPartitions()


def _batch_moments(values: np.ndarray, valid: np.ndarray) -> list[np.ndarray]:
    """Count, mean of i, spread of i and co-moment of i and j, over the rows where i and j are present."""
    some = valid.any(axis=0)
    shift = np.where(some, values[valid.argmax(axis=0), np.arange(values.shape[1])], 0.0)   # the first value present
    shift = np.where(np.isfinite(shift), shift, 0.0)
    x, m = np.where(valid, values - shift, 0.0), valid.astype(float)
    n = m.T @ m
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, (x.T @ m) / n, 0.0)
    spread = (x * x).T @ m - n * mean * mean
    together = x.T @ x - n * mean * mean.T
    return [n, mean + shift[:, None], np.maximum(spread, 0.0), together]


def _merged(a: list[np.ndarray] | None, b: list[np.ndarray]) -> list[np.ndarray]:
    if a is None:
        return b
    n = a[0] + b[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(n > 0, b[0] / n, 0.0)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + gap * share, b[1])
    return [n, mean, a[2] + b[2] + gap * gap * a[0] * share, a[3] + b[3] + gap * gap.T * a[0] * share]


def pair_moments(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """One row for each pair (i, j) of column numbers: ``n``, spreads ``si``, ``sj`` and co-moment ``sij`` over the
    rows where both columns are present.  One pass over ``df``."""
    names = [f"c{k}" for k in range(len(columns))]
    src = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)])
    at = np.array(pairs, dtype=int).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                valid = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
                total = _merged(total, _batch_moments(values, valid))
        if total is not None:
            n, mean, spread, both = total
            i, j = at[:, 0], at[:, 1]
            parts = [n[i, j], mean[i, j], mean[j, i], spread[i, j], spread[j, i], both[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, parts)],
                                             names=["i", "j", "n", "mi", "mj", "si", "sj", "sij"])

    parts = map_batches(src, "i int, j int, n double, mi double, mj double, si double, sj double, sij double", run)
    pair = Window.partitionBy("i", "j")   # a row for each task
    # tasks' means relative to one of them: exactly 0 for a constant column
    off = lambda m: F.col(m) - F.min(F.when(F.col("n") > 0, F.col(m))).over(pair)
    gaps = parts.select("*", off("mi").alias("di"), off("mj").alias("dj")).where("n > 0")
    total = lambda *c: F.sum(F.expr(" * ".join(("n", *c))))
    merged = lambda own, a, b: F.sum(own) + total(a, b) - total(a) * total(b) / F.sum("n")
    return gaps.groupBy("i", "j").agg(F.sum("n").alias("n"), merged("si", "di", "di").alias("si"),
                                      merged("sj", "dj", "dj").alias("sj"), merged("sij", "di", "dj").alias("sij"))
