"""Shards as runs of a Hilbert curve over document metadata.

Several columns are quantised to ``bits`` bits each at approximate quantiles, strings by the
six bytes after their common beginning, so cells keep the order of the values.  The cell's index on a Hilbert curve is the sort key.  Ties are broken by
the text's checksum and the key, so equal texts of one cell stay together.  The sorted rows are cut
into ``shards`` runs, of equal row counts (law ``rows``) or of equal bytes (law ``bytes``).  A
run covers a compact region in all dimensions, so a file's ranges exclude it for most filters.

The sort is a range repartition on (index, checksum, key); a cell of very many rows is
divided by the later keys.  Each part numbers its rows; the parts' sums, one row each, are
all that the driver gets.

Defined cases: a null text has 8 bytes and checksum 0; nulls of any dimension form a cell of
their own at 0; rows that repeat are separate rows; with fewer rows than shards some shards
are empty; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.arrow_map import append_columns
from leadlens.llm.tables import fresh, written

OVERHEAD = 8  # bytes a row takes besides its text
PREFIX = 1000  # characters in which a common beginning of a column's strings is looked for


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``cells`` (rows x dimensions, values below 2**bits)."""
    x = [cells[:, d].astype(np.int64).copy() for d in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):  # undo the turns and flips of each level
        low = (1 << b) - 1
        for d in range(len(x)):
            turned = (x[d] >> b) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, len(x)):  # Gray code
        x[d] ^= x[d - 1]
    flip = np.zeros(len(cells), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    out = np.zeros(len(cells), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | (((v ^ flip) >> b) & 1)
    return out


def _common_prefix(low: str, high: str) -> int:
    """Length in bytes of what all strings from ``low`` to ``high`` begin with."""
    a, b = low.encode(), high.encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _ordinal(c: str, skip: int) -> Column:
    """The six bytes after the first ``skip`` as a number; strings that share those bytes keep their order."""
    part = F.hex(F.substring(F.encode(F.col(c), "utf-8"), skip + 1, 6))
    return F.when(F.col(c).isNotNull(), F.conv(F.rpad(part, 12, "0"), 16, 10).cast("double"))


def _cells(docs: DataFrame, numbers: list[str], strings: list[str], bits: int) -> list[Column]:
    """A cell from 1 for each value, 0 for null, in the order of the values.

    Cells are cut at quantiles and spread over the whole range, so that a column of few values
    decides the first turns of the curve, not only the last."""
    top = (1 << bits) - 1
    head = [F.substring(F.col(c), 1, PREFIX) for c in strings]
    ends = docs.agg(*[f(h).alias(f"e{i}{n}") for i, h in enumerate(head) for n, f in (("a", F.min), ("b", F.max))]).first() if strings else ()
    skips = [_common_prefix(ends[2 * i] or "", ends[2 * i + 1] or "") for i in range(len(strings))]
    values = [F.col(c).cast("double") for c in numbers] + [_ordinal(c, n) for c, n in zip(strings, skips)]
    steps = [i / top for i in range(1, top + 1)]
    cuts = docs.agg(*[F.percentile_approx(v, steps, 10_000).alias(f"q{i}") for i, v in enumerate(values)]).first() if values else ()
    out = []
    for v, at in zip(values, cuts):
        at = sorted(set(at or []))[:-1]     # nothing lies beyond the largest
        cell = F.lit(1)
        for i, cut in enumerate(at):
            cell = F.when(v > cut, 1 + (i + 1) * top // (len(at) + 1)).otherwise(cell)
        out.append(F.when(v.isNull(), 0).otherwise(cell))
    return out


def assign(docs: DataFrame, shards: int = 24, law: str = "rows", numbers: tuple[str, ...] = ("doc_id", "n_chars"),
           strings: tuple[str, ...] = ("lang", "source"), bits: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, hilbert, shard and slot (from 0 in each shard) of every row."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(whole).alias("text_crc32"),
                       F.array(*[c.cast("long") for c in _cells(docs, list(numbers), list(strings), bits)]).alias("cells"))

    def make():
        def each(part: pa.RecordBatch) -> list[pa.Array]:
            cells = part.column("cells").flatten().to_numpy().reshape(part.num_rows, -1)
            return [pa.array(hilbert_index(cells, bits))]
        return each

    indexed = append_columns(rows, [T.StructField("hilbert", T.LongType())], make, slice_rows=8192,
                             keep=["k", "size", "text_crc32"])
    order = ["hilbert", "text_crc32", "k"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, done = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sums = np.cumsum(b.column("size").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(pos + np.arange(b.num_rows)),
                 pa.array(done + sums - b.column("size").to_numpy())],
                names=[*b.schema.names, "part", "pos", "before"])
            pos, done = pos + b.num_rows, done + (int(sums[-1]) if len(sums) else 0)

    longs = [T.StructField(c, T.LongType()) for c in ("part", "pos", "before")]
    numbered = written(indexed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                       .mapInArrow(number, T.StructType(indexed.schema.fields + longs)), "shards")
    sums = numbered.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("part").collect()
    n, total = sum(r["n"] for r in sums), sum(r["bytes"] for r in sums)
    starts, row, size = [], 0, 0
    for r in sums:  # one row a partition
        starts.append((r["part"], row, size))
        row, size = row + r["n"], size + r["bytes"]
    spark = docs.sparkSession
    at = F.broadcast(spark.createDataFrame(starts, "part long, first_row long, first_byte long"))
    ranked = numbered.join(at, "part").withColumn("rank", F.col("first_row") + F.col("pos"))
    cut = F.expr(f"rank * {shards} div {max(n, 1)}") if law == "rows" else F.least(
        F.expr(f"(2 * (first_byte + before) + size) * {shards} div {2 * max(total, 1)}"), F.lit(shards - 1))
    ranked = ranked.withColumn("shard", cut.cast("int"))
    first = F.broadcast(ranked.groupBy("shard").agg(F.min("rank").alias("first")))  # one row a shard
    return ranked.join(first, "shard").select(F.col("k").alias(key), "size", "text_crc32", "hilbert", "shard",
                                              (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, law: str = "rows", key: str = "doc_id", **options) -> DataFrame:
    """Write ``docs`` as one folder a shard and return the manifest: each shard's rows, bytes and column ranges.

    Rows of equal key go to the same shard: that of the first of them on the curve.  Every column of
    ``docs`` is written; where one is called ``shard``, the folders' column is ``shard_``.
    """
    part, slot = fresh(docs, "shard", "_slot")
    placed = assign(docs, shards, law, key=key, **options).groupBy(key).agg(
        F.min_by(F.struct("shard", "slot"), F.struct("shard", "slot")).alias("p"))
    out = docs.alias("d").join(placed.alias("a"), F.col(f"d.{key}").eqNullSafe(F.col(f"a.{key}"))) \
        .select("d.*", F.col("a.p.shard").alias(part), F.col("a.p.slot").alias(slot))
    out.repartition(part, F.floor(F.col(slot) / 100_000)).sortWithinPartitions(part, slot).drop(slot) \
        .write.partitionBy(part).parquet(path)
    written_rows = docs.sparkSession.read.parquet(path)
    ranged = [c for c, t in written_rows.dtypes if c != part and t in ("string", "bigint", "int", "double", "date", "timestamp")
              and c != options.get("text", "text")]
    return written_rows.groupBy(F.col(part).alias("_part")).agg(
        F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in ranged for n, f in (("min", F.min), ("max", F.max))]) \
        .withColumnRenamed("_part", "shard")


def prune(manifest: DataFrame, **ranges: tuple) -> DataFrame:
    """Shards of a manifest whose ranges meet all the given (low, high) ranges."""
    for c, (low, high) in ranges.items():
        manifest = manifest.where((F.col(f"max_{c}") >= F.lit(low)) & (F.col(f"min_{c}") <= F.lit(high)))
    return manifest.select("shard")
