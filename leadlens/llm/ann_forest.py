"""Approximate nearest neighbours by a forest of random-projection trees.

Fit.  A bounded sample (about ``sample_rows`` vectors, chosen by a hash of the id) is all that
reaches the driver.  A node parts its points by the direction between two random points,
moved to their nearest points' means a few times, at the median.  The search budget is
calibrated there: it is the amount of rows a search must visit for ``target`` of the true
neighbours of sample vectors within the sample.  Larger tables have nearer neighbours, so
their recall is above that.

Index.  Every row is put into a leaf of every tree.  Each tree's leaves form a few units of
work; a unit of too many rows (or a frequent vector) is dealt out over several blocks.

Search.  A query walks all trees through one shared priority queue ordered by the margin to
the splits passed, until its budget of rows is used up.  It is sent to the units of its
leaves; there, inner products with the rows of its leaves are taken, the best of a unit's
are summed anew in a fixed order, and its ``k`` best go on to be merged by query.

Nearness is the inner product in double precision.  Vectors of unequal length are given one
more component, sqrt(max_norm^2 - norm^2), for the trees only, which makes the largest inner
product the nearest vector.

Defined cases: null and zero vectors, and those with null or non-finite components or not of
the most frequent dimension, take no part.  Rows of equal id count as one candidate with its
best score; a query id that repeats uses its smallest vector in array order.  Ties go to the
smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.arrow_map import append_columns
from leadlens.llm.tables import written

TREE_UNITS = 4        # units of work into which each tree's leaves fall
BLOCK_ROWS = 16_384   # rows of a unit that one task searches at once
QUERY_ROWS = 256      # queries compared with a block at once


def lengthened(x: np.ndarray, max_norm: float) -> np.ndarray:
    """``x`` with the component that makes all rows as long as the longest one."""
    rest = np.maximum(max_norm ** 2 - (x ** 2).sum(axis=1), 0)
    return np.column_stack([x, np.sqrt(rest)])


@dataclass
class RandomForest:
    depth: int
    normals: np.ndarray    # trees x nodes x dimensions + 1
    offsets: np.ndarray    # trees x nodes
    shares: np.ndarray     # trees x leaves, of all rows
    max_norm: float
    budget: float = 0.0    # rows to visit, as a multiple of all rows

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of ``x`` in each tree."""
        x = lengthened(x, self.max_norm)
        out = np.zeros((len(x), len(self.normals)), dtype=np.int64)
        for t, (w, b) in enumerate(zip(self.normals, self.offsets)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, w[node]) > b[node])
            out[:, t] = node - (1 << self.depth) + 1
        return out

    def visits(self, q: np.ndarray, budget: float, least: float = 0.0) -> Iterator[tuple[int, int]]:
        """Leaves (tree, leaf) for the query ``q``, nearest first, through one queue for all trees."""
        q = np.append(q, 0.0)
        margins = (self.normals @ q - self.offsets).tolist()
        first, seen = (1 << self.depth) - 1, 0.0
        queue = [(-np.inf, t, 0) for t in range(len(margins))]
        while queue and seen < max(budget, least):
            worst, t, node = heapq.heappop(queue)
            if node >= first:
                seen += self.shares[t, node - first]
                yield t, node - first
            else:
                m = margins[t][node]
                heapq.heappush(queue, (max(worst, -m), t, 2 * node + 2))
                heapq.heappush(queue, (max(worst, m), t, 2 * node + 1))


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    i, j = rng.choice(len(x), 2, replace=False)
    p, q = x[i], x[j]
    for _ in range(4):
        near = x @ (p - q) > (p + q) @ (p - q) / 2
        if near.all() or not near.any():
            break
        p, q = x[near].mean(axis=0), x[~near].mean(axis=0)
    size = np.linalg.norm(p - q)
    if not size:
        return np.zeros(x.shape[1]), 1.0  # equal points: all go to one side
    w = (p - q) / size
    return w, float(np.median(x @ w))


def build(sample: np.ndarray, total: int, max_norm: float, trees: int = 8, leaf_rows: int = 64, k: int = 20,
          target: float = 0.95, trials: int = 128, seed: int = 1) -> RandomForest:
    """A forest on the sample for a table of ``total`` rows, with its search budget."""
    rng = np.random.default_rng(seed)
    leaves = min(total / leaf_rows, len(sample) / 8)
    depth = max(0, int(np.ceil(np.log2(leaves)))) if leaves > 1 else 0
    x, nodes = lengthened(sample, max_norm), (1 << depth) - 1
    w, b = np.zeros((trees, nodes, x.shape[1])), np.zeros((trees, nodes))
    for t in range(trees):
        held = {0: np.arange(len(x))}
        for node in range(nodes):
            own = held.pop(node)
            w[t, node], b[t, node] = _split(x[own], rng) if len(own) > 1 else (w[t, node], 1.0)
            right = x[own] @ w[t, node] > b[t, node]
            held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
    forest = RandomForest(depth, w, b, np.zeros((trees, nodes + 1)), max_norm)
    leaf = forest.leaves_of(sample)
    for t in range(trees):
        forest.shares[t] = np.bincount(leaf[:, t], minlength=nodes + 1) / max(1, len(sample))
    needed = []
    for i in rng.permutation(len(sample))[:trials]:
        scores = sample @ sample[i]
        scores[i] = -np.inf
        true = np.argsort(-scores, kind="stable")[:min(k, len(sample) - 1)]
        reached, seen = np.full(forest.shares.shape, np.inf), 0.0
        for t, at in forest.visits(sample[i], np.inf):
            seen += forest.shares[t, at]
            reached[t, at] = seen
        needed += reached[np.arange(trees), leaf[true]].min(axis=1).tolist()
    forest.budget = float(np.quantile(needed, target)) if needed else float(trees)
    return forest


def usable(vec: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda c: c != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def best_of(q: np.ndarray, mask: np.ndarray, ids: np.ndarray, x: np.ndarray, starts: np.ndarray,
            rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows for each query: query number, row id, score.

    ``rows`` are the queries' own ids; ``mask`` (queries x leaves) tells which leaves a query
    visits; the rows of leaf i are those from ``starts[i]`` to ``starts[i + 1]``.
    """
    s = np.full((len(q), len(x)), -np.inf)
    for leaf in range(len(starts) - 1):
        a, b = starts[leaf], starts[leaf + 1]
        asks = np.flatnonzero(mask[:, leaf]) if a < b else ()
        if len(asks):
            s[asks, a:b] = q[asks] @ x[a:b].T
    s[rows[:, None] == ids[None, :]] = -np.inf
    low = np.partition(s, -k, axis=1)[:, -k] if len(x) > k else np.full(len(s), -np.inf)
    slack = 1e-9 * np.sqrt((q ** 2).sum(axis=1) * (x ** 2).sum(axis=1).max())  # more than rounding can move a score
    i, j = np.nonzero((s >= (low - slack)[:, None]) & (s > -np.inf))
    score = (q[i] * x[j]).sum(axis=1)  # the same order of summation for every pair
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.empty(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    keep = rank < k
    return i[keep], ids[j[keep]], score[keep]


def _search(batches: Iterator[pa.RecordBatch], dim: int, k: int, leaves: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tree, unit, block), each block's index rows before the queries sent to it."""
    key, index, x = None, [], None
    for b in batches:
        keys = np.column_stack([b.column(c).to_numpy() for c in ("tree", "unit", "block")])
        query = b.column("query").to_numpy(zero_copy_only=False).astype(bool)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1) | (query[1:] != query[:-1])]))
        for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows]):
            part = b.slice(at, end - at)
            if tuple(keys[at]) != key:
                key, index, x = tuple(keys[at]), [], None
            ids, vectors = part.column("vec_id").to_numpy(), _matrix(part.column("vec"), dim)
            if not query[at]:
                index.append((ids, part.column("leaf").to_numpy(zero_copy_only=False).astype(np.int64), vectors))
            elif index:
                if x is None:
                    own, leaf, x = (np.concatenate(c) for c in zip(*index))
                    by_leaf = np.argsort(leaf, kind="stable")
                    own, x, starts = own[by_leaf], x[by_leaf], np.searchsorted(leaf[by_leaf], np.arange(leaves + 1))
                visits = np.array([np.frombuffer(v, np.uint8) for v in part.column("visits").to_pylist()])
                mask = np.unpackbits(visits, axis=1, count=leaves).astype(bool)
                for a in range(0, len(ids), QUERY_ROWS):
                    s = slice(a, a + QUERY_ROWS)
                    i, vec_id, score = best_of(vectors[s], mask[s], own, x, starts, ids[s], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s][i]), pa.array(vec_id), pa.array(score)],
                                                     names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding",
            trees: int = 8, leaf_rows: int = 64, sample_rows: int = 8192, target: float = 0.95) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k nearest found for each query."""
    spark = vectors.sparkSession
    held = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"),
                          F.coalesce(is_query, F.lit(False)).alias("query")).where(usable(F.col("vec")) & F.col("vec_id").isNotNull())
    sizes = held.groupBy(F.size("vec").alias("d")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c)).alias("m")) \
        .orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, total = sizes["d"], sizes["n"]
    held = held.where(F.size("vec") == dim)
    unit = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = held.where(unit < sample_rows / total).select("vec_id", "vec").collect()
    sample.sort(key=lambda r: (r["vec_id"], r["vec"]))
    forest = build(np.array([r["vec"] for r in sample]).reshape(-1, dim), total, float(np.sqrt(sizes["m"])),
                   trees, leaf_rows, k, target)
    leaves = max(1, (1 << forest.depth) // TREE_UNITS)   # of a unit
    shared = spark.sparkContext.broadcast(forest)  # trees x leaves x dim numbers, bounded by the sample

    def place():
        def each(part: pa.RecordBatch) -> list[pa.Array]:
            leaf = shared.value.leaves_of(_matrix(part.column("vec"), dim))
            return [pa.array(leaf.tolist(), pa.list_(pa.int64()))]
        return each

    def walk():
        f = shared.value

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for q in _matrix(part.column("vec"), dim):
                visited: dict[tuple[int, int], list[int]] = {}
                for t, at in f.visits(q, f.budget, 10 * k / total):
                    visited.setdefault((t, at // leaves), []).append(at % leaves)
                row = []
                for (t, u), found in visited.items():
                    mask = np.zeros(leaves, dtype=bool)
                    mask[found] = True
                    row.append({"tree": t, "unit": u, "visits": np.packbits(mask).tobytes()})
                out.append(row)
            return [pa.array(out, pa.list_(pa.struct([("tree", pa.int64()), ("unit", pa.int64()), ("visits", pa.binary())])))]
        return each

    to = T.StructType([T.StructField("tree", T.LongType()), T.StructField("unit", T.LongType()), T.StructField("visits", T.BinaryType())])
    placed = written(append_columns(held, [T.StructField("leaf", T.ArrayType(T.LongType()))], place,
                                    slice_rows=4096, keep=["vec_id", "vec"])
                     .select("vec_id", "vec", F.posexplode("leaf").alias("tree", "leaf")), "ann-index")
    index = placed.select("vec_id", "vec", F.col("tree").cast("long").alias("tree"),
                          F.floor(F.col("leaf") / leaves).alias("unit"), (F.col("leaf") % leaves).alias("leaf"))
    blocks = F.broadcast(index.groupBy("tree", "unit").agg(  # at most trees x leaves rows
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
    rows = index.join(blocks, ["tree", "unit"]).select(
        "tree", "unit", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).alias("block"),
        F.lit(False).alias("query"), "vec_id", "leaf", F.lit(None).cast("binary").alias("visits"), "vec")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but long work for each row
    asked = held.where("query").groupBy("vec_id").agg(F.min("vec").alias("vec")) \
        .repartition(parts, F.xxhash64("vec_id"))  # by vec_id alone, it would fold into the aggregate's exchange and be coalesced
    sent = append_columns(asked, [T.StructField("to", T.ArrayType(to))], walk) \
        .select("vec_id", "vec", F.inline("to")).join(blocks, ["tree", "unit"]) \
        .select("tree", "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))).alias("block"),
                F.lit(True).alias("query"), "vec_id", F.lit(None).cast("long").alias("leaf"), "visits", "vec")
    found = rows.unionByName(sent).repartition("tree", "unit", "block") \
        .sortWithinPartitions("tree", "unit", "block", "query") \
        .mapInArrow(lambda batches: _search(batches, dim, k, leaves), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
