"""Small helpers shared by the operators whose row work runs in Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Rows handled at once inside a task.  Only a slice of an Arrow batch is turned
# into Python objects at a time, so memory follows the slice, not the batch.
SLICE_ROWS = 256


def for_workers(df: DataFrame) -> DataFrame:
    """``df``, with this package on the import path of the Python workers started for it.

    A driver that only changed its own ``sys.path`` would else leave them without it; where
    the package is installed or shipped with the job, the entry does no harm."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without its columns named like ``names`` (any letter case), so new ones cannot clash."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def append_columns(df: DataFrame, fields: list[T.StructField],
                   make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
                   slice_rows: int = SLICE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """Append the columns ``fields`` to the columns ``keep`` (default: all) of ``df``.

    ``make()`` runs once in each task and returns a function from a slice of a record
    batch to the new arrays.  Input columns with the names of new ones are replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep)
            if c.lower() not in {f.name.lower() for f in fields}]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                new = each(part)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new,
                                                 names=kept + [f.name for f in fields])

    return for_workers(df).mapInArrow(run, schema)
