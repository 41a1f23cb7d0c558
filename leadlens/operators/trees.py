"""Ensembles of decision trees as one node table: scores and exact attributions.

A ``TreeEnsemble`` holds all nodes of all trees as arrays.  A row goes left where its value is
at most the node's threshold, else right (an unknown value too).  The score is
``link(base + sum of the leaves reached)``.  The table goes to the tasks as a broadcast after
a check of its size.  The nodes of a larger ensemble (``StoredTrees``) stay in a table of the shared
folder; whole trees are read and sent out in parts of at most that size, one part after the other.

Attribution is the exact interventional Shapley value of the sum before the link, against a
bounded background: mean over the background rows b of the game in which a feature comes
from the row x or from b.  For a leaf only the features on its path matter.  Let A be those
whose value in x satisfies the path while b's does not, and B the reverse.  If some feature
fits neither way the leaf is out of reach; else it is reached by exactly the coalitions that
hold all of A and none of B, so with a = |A|, b = |B| and leaf value v each feature of A gets
``v (a-1)! b! / (a+b)!`` and each of B gets ``-v a! (b-1)! / (a+b)!``.  Each leaf is so
visited once for all pairs of a batch: rows and background rows with the same pattern along
the path share one evaluation.  A row's impacts sum to its score (before the link) less the
background's mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow import lists, map_batches, matrix

MAX_NODES = 4_000_000   # about 150 MB as arrays
PART_NODES = 500_000    # of a stored ensemble, in memory at a time; the driver holds them several times while it sends them
MAX_PATH = 62           # different features on one path


@dataclass
class TreeEnsemble:
    names: list[str]            # features by number
    root: np.ndarray            # first node of each tree
    feature: np.ndarray         # -1 at a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray           # what a leaf adds
    base: float = 0.0
    link: str = "identity"      # or "logit"

    def __post_init__(self):
        if len(self.feature) > MAX_NODES:
            raise ValueError(f"{len(self.feature)} nodes, more than {MAX_NODES} to broadcast")

    @classmethod
    def of(cls, names: list[str], trees: list, base: float = 0.0, link: str = "identity") -> "TreeEnsemble":
        """From nested tuples: (feature name, threshold, left, right) or a leaf's value."""
        columns = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

        def add(node) -> int:
            at = len(columns["feature"])
            inner = isinstance(node, tuple)
            for k, v in zip(columns, (names.index(node[0]) if inner else -1, float(node[1]) if inner else 0.0, -1, -1,
                                      0.0 if inner else float(node))):
                columns[k].append(v)
            if inner:
                columns["left"][at] = add(node[2])
                columns["right"][at] = add(node[3])
            return at

        roots = [add(t) for t in trees]
        kinds = {"threshold": float, "value": float}
        return cls(names, np.array(roots, dtype=int), *[np.array(v, dtype=kinds.get(k, int)) for k, v in columns.items()],
                   base=base, link=link)

    # ------------------------------------------------------------- as a table
    def to_frame(self, spark) -> DataFrame:
        """One row a node, with the ensemble's names, base and link on each; roots have ``tree`` set."""
        tree = {int(r): k for k, r in enumerate(self.root)}
        rows = [(k, tree.get(k), int(self.feature[k]), float(self.threshold[k]), int(self.left[k]), int(self.right[k]),
                 float(self.value[k]), self.names, float(self.base), self.link) for k in range(len(self.feature))]
        return spark.createDataFrame(rows, "node int, tree int, feature int, threshold double, left int, right int, "
                                           "value double, names array<string>, base double, link string")

    @classmethod
    def from_frame(cls, df: DataFrame) -> "TreeEnsemble":
        rows = df.orderBy("node").collect()   # the nodes, bounded by MAX_NODES
        if not rows:
            raise ValueError("no nodes")
        roots = sorted((r["tree"], r["node"]) for r in rows if r["tree"] is not None)
        column = lambda c: np.array([r[c] for r in rows])
        return cls(list(rows[0]["names"]), np.array([n for _, n in roots], dtype=int), column("feature"), column("threshold"),
                   column("left"), column("right"), column("value"), rows[0]["base"], rows[0]["link"])

    # ------------------------------------------------------------- scores
    def sums(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Base and leaves of each row of ``x``, added to ``start``."""
        out = np.full(len(x), self.base) if start is None else start + self.base
        rows = np.arange(len(x))
        leaf = np.empty(len(x), dtype=int)
        for r in self.root:
            going, at = rows, np.full(len(x), r)      # rows not at a leaf yet, few after most levels of a deep tree
            while len(going):
                f = self.feature[at]
                inner = f >= 0
                if not inner.all():
                    leaf[going[~inner]] = at[~inner]
                    going, at, f = going[inner], at[inner], f[inner]
                with np.errstate(invalid="ignore"):
                    low = x[going, f] <= self.threshold[at]
                at = np.where(low, self.left[at], self.right[at])
            out += self.value[leaf]
        return out

    # ------------------------------------------------------------- paths
    @cached_property
    def paths(self) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """For each leaf: value, features on its path, and for these the bounds (low, high] of the path."""
        out = []
        for r in self.root:
            todo = [(int(r), {})]
            while todo:
                at, bounds = todo.pop()
                f = int(self.feature[at])
                if f < 0:
                    if self.value[at] != 0.0 and bounds:
                        keys = sorted(bounds)
                        out.append((float(self.value[at]), np.array(keys), np.array([bounds[k][0] for k in keys]),
                                    np.array([bounds[k][1] for k in keys])))
                    continue
                low, high = bounds.get(f, (-np.inf, np.inf))
                t = float(self.threshold[at])
                todo.append((int(self.left[at]), {**bounds, f: (low, min(high, t))}))
                todo.append((int(self.right[at]), {**bounds, f: (max(low, t), high)}))
        if any(len(p[1]) > MAX_PATH for p in out):
            raise ValueError(f"a path with more than {MAX_PATH} different features")
        return out

    def impacts(self, x: np.ndarray, background: np.ndarray) -> np.ndarray:
        """Shapley values of ``sums`` for each row of ``x`` against the rows of ``background``."""
        out = np.zeros(x.shape)
        for value, f, low, high in self.paths:
            bit = 1 << np.arange(len(f), dtype=np.int64)
            with np.errstate(invalid="ignore"):   # an unknown value fails "at most" and so goes right
                fits = [~(v[:, f] <= low) & ((v[:, f] <= high) | np.isinf(high)) for v in (x, background)]
            (kinds, of), (others, times) = (np.unique(fits[0] @ bit, return_inverse=True),
                                            np.unique(fits[1] @ bit, return_counts=True))
            sx, sb = ((codes[:, None] & bit) > 0 for codes in (kinds, others))
            mine, theirs = sx[:, None] & ~sb[None], ~sx[:, None] & sb[None]
            reached = (sx[:, None] | sb[None]).all(axis=2)
            a, b = mine.sum(axis=2), theirs.sum(axis=2)
            gain, loss = _weights(len(f))
            w = value * times / len(background) * reached
            shares = mine * (w * gain[a, b])[:, :, None] - theirs * (w * loss[a, b])[:, :, None]
            out[:, f] += shares.sum(axis=1)[of]
        return out


NODE = ["feature", "threshold", "left", "right", "value"]


@dataclass
class StoredTrees:
    """An ensemble as a materialised table (tree, node, feature, threshold, left, right, value).

    Nodes are numbered within their tree, from the root at 0; ``sizes`` are the trees' nodes."""
    names: list[str]
    table: DataFrame
    sizes: list[int]
    base: float = 0.0
    link: str = "identity"

    def ranges(self) -> list[tuple[int, int]]:
        """Trees from a to before b of each part."""
        out, a, n = [], 0, 0
        for t, size in enumerate(self.sizes):
            if n + size > min(MAX_NODES, PART_NODES) and t > a:
                out.append((a, t))
                a, n = t, 0
            n += size
        return [*out, (a, len(self.sizes))]

    def trees(self, a: int, b: int, base: float = 0.0) -> TreeEnsemble:
        """Some of the trees in memory."""
        n = sum(self.sizes[a:b])
        if n > MAX_NODES:
            raise ValueError(f"{n} nodes, more than {MAX_NODES} for one node table")
        got = self.table.where(F.col("tree").between(a, b - 1)).select("tree", "node", *NODE).toArrow()
        tree, node, *columns = (got[c].to_numpy() for c in got.column_names)
        order = np.lexsort((node, tree))
        first = np.cumsum([0, *self.sizes[a:b]])[:-1]
        shift = first[tree[order] - a]
        feature, threshold, left, right, value = (c[order] for c in columns)
        left, right = (np.where(c >= 0, c + shift, -1) for c in (left, right))
        return TreeEnsemble(self.names, first.astype(int), feature.astype(int), threshold, left, right, value, base, self.link)

    def parts(self) -> Iterator[TreeEnsemble]:
        """All trees, whole ones, at most ``PART_NODES`` nodes or one tree at a time; their bases are zero."""
        return (self.trees(a, b) for a, b in self.ranges())

    def loaded(self) -> "TreeEnsemble | StoredTrees":
        """The ensemble in memory if it is small enough."""
        return self.trees(0, len(self.sizes), self.base) if sum(self.sizes) <= min(MAX_NODES, PART_NODES) else self

    # ------------------------------------------------------------- as a table
    def to_frame(self, spark) -> DataFrame:
        """As ``TreeEnsemble.to_frame``."""
        first = spark.createDataFrame([(t, int(n)) for t, n in enumerate(np.cumsum([0, *self.sizes])[:-1])], "tree int, _first int")
        child = lambda c: F.when(F.col(c) >= 0, F.col(c) + F.col("_first")).otherwise(-1).cast("int").alias(c)
        return self.table.join(F.broadcast(first), "tree").select(
            (F.col("node") + F.col("_first")).cast("int").alias("node"), F.when(F.col("node") == 0, F.col("tree")).alias("tree"),
            "feature", "threshold", child("left"), child("right"), "value", F.array(*[F.lit(n) for n in self.names]).alias("names"),
            F.lit(float(self.base)).alias("base"), F.lit(self.link).alias("link"))

    @classmethod
    def from_frame(cls, df: DataFrame) -> "StoredTrees":
        spark = df.sparkSession
        roots = [(r["tree"], r["node"]) for r in df.where("tree IS NOT NULL").select("tree", "node").orderBy("node").collect()]
        one = df.select("names", "base", "link").first()
        first = [n for _, n in roots]
        sizes = np.diff([*first, df.count()]).tolist()
        spans = spark.createDataFrame([(t, n, n + k) for (t, n), k in zip(roots, sizes)], "_t int, _first int, _end int")
        child = lambda c: F.when(F.col(c) >= 0, F.col(c) - F.col("_first")).otherwise(-1).cast("int").alias(c)
        table = df.drop("tree").join(F.broadcast(spans), (F.col("node") >= F.col("_first")) & (F.col("node") < F.col("_end"))).select(
            F.col("_t").alias("tree"), (F.col("node") - F.col("_first")).cast("int").alias("node"),
            "feature", "threshold", child("left"), child("right"), "value")
        return cls(list(one["names"]), cut_lineage(table), sizes, one["base"], one["link"])


def _weights(k: int) -> tuple[np.ndarray, np.ndarray]:
    """(a-1)! b! / (a+b)! and a! (b-1)! / (a+b)! for a + b <= k; 0 where a or b is 0."""
    gain, loss = np.zeros((k + 1, k + 1)), np.zeros((k + 1, k + 1))
    for a in range(k + 1):
        for b in range(k + 1 - a):
            if a:
                gain[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                loss[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b)
    return gain, loss


def _rowwise(df: DataFrame, ensemble: TreeEnsemble, features: Column, keep: list[str], name: str, kind: str, make,
             width: int | None = None, shared: Broadcast | None = None) -> DataFrame:
    """``keep`` of ``df`` and the column ``name`` computed from the rows' feature values (``width`` numbers a row)."""
    shared = shared or df.sparkSession.sparkContext.broadcast(ensemble)
    src = df.select(*keep, features.alias("_x"))
    width = width or len(ensemble.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], compute(matrix(part.column("_x"), width))],
                                                 names=[*keep, name])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(src, f"{fields}, `{name}` {kind}", run)


def features_of(ensemble: TreeEnsemble) -> Column:
    """The named feature columns as one array."""
    return F.array(*[F.col(f"`{n}`").cast("double") for n in ensemble.names])


def _linked(link: str):
    return (lambda z: 1.0 / (1.0 + np.exp(-z))) if link == "logit" else (lambda z: z)


def score_trees(df: DataFrame, ensemble: TreeEnsemble | StoredTrees, features: Column, keep: list[str],
                name: str = "score") -> DataFrame:
    """``keep`` and the ensemble's score."""
    def make(e: TreeEnsemble):
        link = _linked(e.link)
        return lambda x: pa.array(link(e.sums(x)))
    if isinstance(ensemble, StoredTrees):
        return _scored_in_parts(df, ensemble, features, keep, name)
    return _rowwise(df, ensemble, features, keep, name, "double", make)


def _scored_in_parts(df: DataFrame, stored: StoredTrees, features: Column, keep: list[str], name: str) -> DataFrame:
    """Each part adds its trees to the rows' sums, in the order of the trees as for an ensemble in memory."""
    def make(e: TreeEnsemble):
        return lambda v: lists(np.column_stack([v[:, :-1], e.sums(v[:, :-1], v[:, -1])]))
    values = df.select(*keep, F.concat(features, F.array(F.lit(float(stored.base)))).alias("_v"))
    values = _through_parts(values, stored, keep, make, len(stored.names) + 1)
    z = F.element_at("_v", -1)
    return values.select(*keep, (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) if stored.link == "logit" else z).alias(name))


def tree_impacts(df: DataFrame, ensemble: TreeEnsemble | StoredTrees, background: DataFrame, features: Column, keep: list[str],
                 name: str = "impacts") -> DataFrame:
    """``keep`` and the impacts (array<double> in the order of ``ensemble.names``) against ``background``, a bounded
    sample of rows with the same columns."""
    rows = background.select(features.alias("x")).collect()
    if not rows:
        raise ValueError("empty background")
    other = np.array([[np.nan if v is None else v for v in r["x"]] for r in rows], dtype=float)
    if isinstance(ensemble, StoredTrees):
        return _impacts_in_parts(df, ensemble, other, features, keep, name)
    return _rowwise(df, ensemble, features, keep, name, "array<double>", lambda e: lambda x: lists(e.impacts(x, other)))


def _through_parts(values: DataFrame, stored: StoredTrees, keep: list[str], make, width: int) -> DataFrame:
    """The column ``_v`` after each part in turn; a part is let go once its rows are written."""
    for part in stored.parts():
        shared = values.sparkSession.sparkContext.broadcast(part)
        values = cut_lineage(_rowwise(values, part, F.col("_v"), keep, "_sums", "array<double>", make, width, shared)
                             .withColumnRenamed("_sums", "_v"))
        shared.unpersist()
    return values


def _impacts_in_parts(df: DataFrame, stored: StoredTrees, other: np.ndarray, features: Column, keep: list[str], name: str) -> DataFrame:
    """A row's impacts are the sum of those of the parts."""
    d = len(stored.names)

    def make(e: TreeEnsemble):
        return lambda v: lists(np.column_stack([v[:, :d], v[:, d:] + e.impacts(v[:, :d], other)]))
    values = df.select(*keep, F.concat(features, F.array_repeat(F.lit(0.0), d)).alias("_v"))
    values = _through_parts(values, stored, keep, make, 2 * d)
    return values.select(*keep, F.slice("_v", d + 1, d).alias(name))


def top_impacts(impacts: Column, names: list[str], k: int = 3) -> Column:
    """The k (feature, impact) entries of largest magnitude; equal to 9 places, the earlier feature first."""
    listed = F.transform(impacts, lambda v, i: F.struct((-F.abs(F.round(v, 9))).alias("k"), i.alias("slot"), v.alias("impact")))
    labels = F.array(*[F.lit(n) for n in names])
    return F.transform(F.slice(F.array_sort(listed), 1, k), lambda t: F.struct(
        F.element_at(labels, t["slot"] + 1).alias("feature"), t["impact"].alias("impact")))


def from_spark_model(spark, model, names: list[str]) -> TreeEnsemble:
    """The node table of a fitted Spark ML forest, boosted ensemble or single tree, read from its saved form.

    A forest gives the probability of class 1, a boosted ensemble the log-odds under the logit link."""
    from ..session import scratch_path
    path = scratch_path(spark, "tree-model")
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select("treeID", "nodeData.*")
    else:
        saved = saved.withColumn("treeID", F.lit(0))
    rows = saved.orderBy("treeID", "id").collect()   # the nodes, bounded by MAX_NODES
    kind = type(model).__name__
    boosted = kind.startswith("GBT")
    weights = list(getattr(model, "treeWeights", [1.0]))
    first, at = {}, 0
    for r in rows:
        first.setdefault(r["treeID"], at)
        at += 1
    total = 1.0 if boosted else float(len(first))
    n = len(rows)
    e = {k: np.full(n, -1, dtype=int) for k in ("feature", "left", "right")}
    threshold, value = np.zeros(n), np.zeros(n)
    for k, r in enumerate(rows):
        start = first[r["treeID"]]
        if r["leftChild"] >= 0:
            s = r["split"]
            cut, swap = s["leftCategoriesOrThreshold"], False
            if s["numCategories"] >= 0:   # a 0/1 slot: its left side is {0} or {1}
                if s["numCategories"] != 2 or len(cut) != 1:
                    raise ValueError("categorical splits of more than two values are not supported")
                swap, cut = cut[0] == 1.0, [0.5]
            e["feature"][k], threshold[k] = s["featureIndex"], cut[0]
            sides = (r["leftChild"] + start, r["rightChild"] + start)
            e["left"][k], e["right"][k] = sides[::-1] if swap else sides
        elif boosted:
            value[k] = 2.0 * weights[r["treeID"]] * r["prediction"]
        else:
            stats = r["impurityStats"]
            value[k] = stats[1] / sum(stats) / total
    roots = np.array([first[t] for t in sorted(first)], dtype=int)
    return TreeEnsemble(list(names), roots, e["feature"], threshold, e["left"], e["right"], value,
                        link="logit" if boosted else "identity")
