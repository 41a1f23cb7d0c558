"""Numeric work in Arrow batches: what each task returns is a few rows, whatever it reads."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def for_workers(df: DataFrame) -> DataFrame:
    """``df``, with this package on the import path of the Python workers started for it.

    A driver that only changed its own ``sys.path`` would else leave them without it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return df


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An array<double> column as rows of ``width`` numbers; a null number is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), width)


def map_batches(df: DataFrame, schema: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    return for_workers(df).mapInArrow(run, schema)


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as an array<double> column."""
    offsets = np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)[:rows.shape[0] + 1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(rows, dtype=float).ravel()))
