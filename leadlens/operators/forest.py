"""Random forests without a depth limit.

Large nodes are split by passes over the whole table: for each (tree, node) of more than
``local_rows`` rows the class weights by (feature, bin) are added up in the tasks, as for
boosting, and the split of largest Gini decrease is taken.  A pass handles a bounded number of
nodes.  Once a node has at most ``local_rows`` rows, its rows go to one task, which grows the
whole subtree below it on the values themselves, down to pure leaves, whatever the depth.  A
large node that is pure, or whose rows agree in every bin, is a leaf and goes nowhere.  A task
grows a group of subtrees side by side (see ``subtrees``), of at most ``group_rows`` rows all
together, or one of up to ``local_rows``; a row that is in several of them comes once.  So no
task holds more than that, and no pass grows with the depth of the subtrees.

Rows are drawn with replacement by a Poisson(1) count from a hash of row key and tree, and
features at a node by a generator seeded with tree and node, so a fit does not depend on
partitioning.  ``max_features`` features that are not constant in the node are tried.  Rows at
most a threshold go left; thresholds of subtrees lie half-way between values, those of large
nodes on quantiles.  A leaf's value is the weighted share of class 1.  Equal gains go to the
feature tried first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow import map_batches, matrix
from .moments import summed, tasks
from .subtrees import Member, Rows, grow
from .subtrees import order as _order
from .trees import StoredTrees, TreeEnsemble

POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(12)])   # up to 11 copies
TOGETHER = 2_000    # rows of a node up to which its features are cut in one go


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def copies(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    with np.errstate(over="ignore"):
        h = _mixed(keys.astype(np.uint64) + _mixed(np.full(1, seed * 1_000_003 + tree + 1, dtype=np.uint64)))
    return np.searchsorted(POISSON, (h >> np.uint64(11)).astype(float) / (1 << 53), side="right")


def _gini(one: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Weight times impurity of nodes with class-1 weight ``one`` of ``all_``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(all_ > 0, 2 * one * (all_ - one) / all_, 0.0)


def _ranked(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each value's rank among its feature's values, and those values; equal values share a rank."""
    values, ranks = zip(*(np.unique(v, return_inverse=True) for v in x.T))
    small = max(map(len, values)) <= 1 << 16      # which numpy orders by radix
    return np.column_stack(ranks).astype(np.uint16 if small else np.int64), list(values)


def _cheapest(v: np.ndarray, y: np.ndarray, w: np.ndarray, one: float, all_: float) -> tuple[np.ndarray, ...]:
    """For each column of ``v``: the least cost of a cut, the value below it and the one above.

    No column is constant.  The sums run down the ordered rows of a column, one after the other."""
    order = np.argsort(v, axis=0, kind="stable")
    column = np.arange(v.shape[1])
    v, wo = v[order, column], w[order]
    la, lo = np.cumsum(wo, axis=0)[:-1], np.cumsum(wo * y[order], axis=0)[:-1]
    ra, ro = all_ - la, one - lo
    cost = 2 * lo * (la - lo) / la + np.where(ra > 0, 2 * ro * (ra - ro) / ra, 0.0)
    cost[v[1:] <= v[:-1]] = np.inf
    k = cost.argmin(axis=0)
    return cost[k, column], v[k, column], v[k + 1, column]


def subtree(x: np.ndarray, y: np.ndarray, w: np.ndarray, tried: int, seed: int, tree: int, node: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, value) of the tree over these rows, its root first.

    All features to try at a small node are cut together, as most nodes hold a few rows; a large
    one takes them one by one."""
    out: list[tuple] = []
    if not len(y):
        return out
    d = x.shape[1]
    ranks, values = _ranked(x)
    todo = [(np.arange(len(y)), -1, 0)]      # rows, parent, which side
    with np.errstate(divide="ignore", invalid="ignore"):
        while todo:
            rows, parent, side = todo.pop()
            at = len(out)
            wr, yr = w[rows], y[rows]
            one, all_ = float(wr @ yr), float(wr.sum())
            out.append((-1, 0.0, -1, -1, one / all_))
            if parent >= 0:
                f, t, low, high, v = out[parent]
                out[parent] = (f, t, at, high, v) if side == 0 else (f, t, low, at, v)
            if one <= 0 or one >= all_ or len(rows) < 2:
                continue
            mine = ranks[rows]
            vary = (mine != mine[0]).any(axis=0)
            order = _order(d, seed, tree, node * 1_000_003 + at)
            order = order[vary[order]][:tried]
            if not len(order):
                continue
            step = len(order) if len(rows) <= TOGETHER else 1
            best = None
            for a in range(0, len(order), step):
                for f, cost, below, above in zip(order[a:a + step], *_cheapest(mine[:, order[a:a + step]], yr, wr, one, all_)):
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, int(f), int(below), int(above))
            _, f, below, above = best
            below, above = float(values[f][below]), float(values[f][above])
            t = below + (above - below) / 2
            if not (t < np.inf and values[f][mine[:, f].max()] > t):      # half-way may round up to the next value
                t = below
            out[at] = (f, t, -1, -1, one / all_)
            low = values[f][mine[:, f]] <= t
            todo += [(rows[~low], at, 1), (rows[low], at, 0)]
    return out


NODE_ROWS = "tree int, node int, local int, feature int, threshold double, left int, right int, value double"
NODE_COLUMNS = [c.split()[0] for c in NODE_ROWS.split(", ")]
DEALT = ["k", "y", "w", "codes", "sizes", "vals", "counts", "drawn", "times"]    # what is dealt to a group of some rows
DEALT_ROWS = 1 << 15


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The parts of each group, which come one group after the other."""
    group, parts = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            g = batch.column(0)[k].as_py()
            if parts and g != group:
                ended, parts = [parts], []
                yield group, ended.pop()      # not held here any longer
            group = g
            parts.append({c: batch.column(j + 1)[k].as_buffer() for j, c in enumerate(DEALT)})
        batch = None
    if parts:
        ended, parts = [parts], []
        yield group, ended.pop()


def _gathered(parts: list[dict], group: list[tuple[int, int]], d: int) -> tuple[Rows, np.ndarray, list[Member]]:
    """The rows dealt to a group, in the order of key, label and weight on any partitioning, their labels, and its subtrees."""
    column = lambda c, kind: [np.frombuffer(p[c], dtype=kind) for p in parts]
    k, y, w = (np.concatenate(column(c, t)) for c, t in (("k", np.int64), ("y", float), ("w", float)))
    order = np.lexsort((w, y, k))
    place = np.empty(len(k), dtype=np.int32)
    place[order] = np.arange(len(k), dtype=np.int32)
    first = np.cumsum([0, *(len(v) for v in column("k", np.int64))])
    codes = [v.reshape(d, -1) for v in column("codes", np.uint16)]
    ends = [np.cumsum([0, *v]) for v in column("sizes", np.int32)]
    own = [[v[e[f]:e[f + 1]] for f in range(d)] for v, e in zip(column("vals", float), ends)]
    values = [np.unique(np.concatenate([v[f] for v in own])) for f in range(d)]
    ranks = (np.concatenate([np.searchsorted(values[f], v[f])[c[f]] for v, c in zip(own, codes)])[order] for f in range(d))
    data = Rows.of(ranks, values, len(k))
    counts = np.array(column("counts", np.int32))
    ends = [np.cumsum([0, *c]) for c in counts]
    drawn, times = column("drawn", np.int32), column("times", np.uint8)
    members = []
    for m, (t, node) in enumerate(group):
        rows = np.concatenate([place[a + v[e[m]:e[m + 1]]] for a, v, e in zip(first, drawn, ends)])
        copied = np.concatenate([v[e[m]:e[m + 1]] for v, e in zip(times, ends)])
        by = np.argsort(rows)
        rows = rows[by]
        members.append(Member(t, node, rows, w[order[rows]] * copied[by]))
    return data, y[order], members


def _alone(data: Rows, label: np.ndarray, m: Member, tried: int, seed: int) -> pa.RecordBatch:
    x = np.column_stack([data.values[a + data.columns[f, m.rows]] for f, a in enumerate(data.first)])
    nodes = subtree(x, label[m.rows], m.weight, tried, seed, m.tree, m.node)
    kinds = (np.int32, float, np.int32, np.int32, float)
    columns = [np.array(c, dtype=kind) for c, kind in zip(zip(*nodes), kinds)]
    fixed = [np.full(len(nodes), v, dtype=np.int32) for v in (m.tree, m.node)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (*fixed, np.arange(len(nodes), dtype=np.int32), *columns)], names=NODE_COLUMNS)


@dataclass
class DeepForest:
    """The estimator.  ``fit`` reads a vector (or array) column, a 0/1 label, a weight and a whole-number row key.

    Unknown feature values are refused; the preprocessing leaves none."""
    trees: int = 200
    seed: int = 42
    features: str = "features"
    label: str = "converteu"
    weight: str = "weight"
    key: str = "lead_id"
    max_features: int | None = None     # None: the square root of their number
    bootstrap: bool = True
    local_rows: int = 200_000
    group_rows: int = 4_000_000         # rows of the subtrees that are grown in one task
    spare: int = 0                      # slots left to other jobs, where the subtrees do not need them
    pass_nodes: int = 128               # large nodes handled in one pass
    bins: int = 64
    names: list[str] | None = None
    _tasks: int | None = None

    def fit(self, df: DataFrame) -> TreeEnsemble | StoredTrees:
        kind = df.schema[self.features].dataType.simpleString()
        x = F.col(self.features) if kind == "array<double>" else vector_to_array(self.features)
        rows = cut_lineage(df.select(x.alias("x"), F.col(self.label).cast("double").alias("y"),
                                     F.col(self.weight).cast("double").alias("w"), F.col(self.key).cast("long").alias("k")))
        self._tasks = tasks(rows)
        shape = rows.agg(F.max(F.size("x")), F.count("*"), F.max(F.exists("x", lambda v: v.isNull() | F.isnan(v)))).first()
        if not shape[1]:
            raise ValueError("no rows to fit")
        if shape[2]:
            raise ValueError("unknown feature values: impute them first")
        d = shape[0]
        tried = self.max_features or max(1, int(np.sqrt(d)))
        top, closed = self.large_nodes(rows, d, shape[1], tried)
        nodes = self.local_nodes(rows, top, closed, d, tried)
        return self.ensemble(top, closed, nodes, d)

    # ------------------------------------------------------- nodes split by passes
    def large_nodes(self, rows: DataFrame, d: int, n: int, tried: int) -> tuple[list[list[list]], list[dict]]:
        """For each tree its nodes [feature, threshold, left, right], and the values of those that are leaves for good;
        the other leaves of this part are grown in tasks."""
        top: list[list[list]] = [[[-1, 0.0, -1, -1]] for _ in range(self.trees)]
        closed: list[dict] = [{} for _ in range(self.trees)]
        # a tree's draw is n rows give or take a few roots of n
        open_ = [(t, 0) for t in range(self.trees)] if n + 6 * np.sqrt(n) > self.local_rows else []
        if not open_:
            return top, closed
        probs = [k / self.bins for k in range(1, self.bins)]
        points = rows.agg(*[F.percentile_approx(F.col("x")[k], probs, 10_000).alias(f"q{k}") for k in range(d)]).first()
        cuts = [np.unique(np.array(p, dtype=float)) for p in points]
        while open_:
            now, open_ = open_[:self.pass_nodes], open_[self.pass_nodes:]
            for (t, node), hist in self.histograms(rows, top, now, cuts).items():
                counts, all_, one = hist
                if counts[0].sum() <= self.local_rows:
                    continue
                best, seen, pure = None, 0, not 0 < one[0].sum() < all_[0].sum()
                for f in [] if pure else _order(d, self.seed, t, node):
                    c = len(cuts[f])
                    la, lo = np.cumsum(all_[f])[:c], np.cumsum(one[f])[:c]
                    real = (np.cumsum(counts[f])[:c] > 0) & (np.cumsum(counts[f])[:c] < counts[f].sum())
                    if not real.any():
                        continue
                    cost = np.where(real, _gini(lo, la) + _gini(one[f].sum() - lo, all_[f].sum() - la), np.inf)
                    k = int(cost.argmin())
                    if best is None or cost[k] < best[0] - 1e-9:
                        best = (cost[k], int(f), float(cuts[f][k]))
                    seen += 1
                    if seen >= tried:
                        break
                if best is None:
                    closed[t][node] = float(one[0].sum() / all_[0].sum())
                    continue
                left = len(top[t])
                top[t][node] = [best[1], best[2], left, left + 1]
                top[t] += [[-1, 0.0, -1, -1], [-1, 0.0, -1, -1]]
                open_ += [(t, left), (t, left + 1)]
        return top, closed

    def histograms(self, rows: DataFrame, top: list, now: list[tuple[int, int]], cuts: list[np.ndarray]) -> dict:
        """{(tree, node): [rows, weight, class-1 weight] by feature and bin}."""
        d, width = len(cuts), max(map(len, cuts)) + 1
        draw, locate = self._draw(), _locate
        wanted = {t: [node for s, node in now if s == t] for t, _ in now}

        def part(batch: pa.RecordBatch) -> np.ndarray:
            x = matrix(batch.column("x"), d)
            y, w, keys = (batch.column(c).to_numpy() for c in ("y", "w", "k"))
            codes = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
            out = np.zeros((len(now), 3, d, width))
            for t, nodes in wanted.items():
                times, at = draw(keys, t), locate(top[t], x)
                for node in nodes:
                    mine = np.flatnonzero((at == node) & (times > 0))
                    slot, c = now.index((t, node)), times[mine].astype(float)
                    weights = c, c * w[mine], c * (w * y)[mine]
                    for f in range(d):
                        code = codes[f][mine]
                        for k, v in enumerate(weights):
                            out[slot, k, f] = np.bincount(code, weights=v, minlength=width)
            return out.reshape(len(now) * 3, d * width)

        total = summed(rows, part, (len(now) * 3, d * width), self._tasks).reshape(len(now), 3, d, width)
        return dict(zip(now, total))

    def _draw(self):
        seed, bootstrap = self.seed, self.bootstrap
        return lambda keys, t: copies(keys, t, seed) if bootstrap else np.ones(len(keys), dtype=int)

    # ------------------------------------------------------- subtrees grown in tasks
    def groups(self, rows: DataFrame, top: list, closed: list, d: int) -> list[list[tuple[int, int]]]:
        """The (tree, node) with rows whose subtrees one task grows, for each task: about as many rows each,
        a task a slot or more."""
        nodes = [(t, k) for t, upper in enumerate(top) for k, u in enumerate(upper) if u[0] < 0 and k not in closed[t]]
        if not nodes:
            return []
        draw, at, trees = self._draw(), {v: k for k, v in enumerate(nodes)}, self.trees

        def part(batch: pa.RecordBatch) -> np.ndarray:
            x, keys = matrix(batch.column("x"), d), batch.column("k").to_numpy()
            out = np.zeros((len(nodes), 1))
            for t in range(trees):
                held = np.bincount(_locate(top[t], x)[draw(keys, t) > 0], minlength=len(top[t]))
                for k in np.flatnonzero(held).tolist():
                    if (t, k) in at:
                        out[at[t, k]] += held[k]
            return out

        found = summed(rows, part, (len(nodes), 1), self._tasks)[:, 0]
        slots, n = rows.sparkSession.sparkContext.defaultParallelism, int(np.ceil(found.sum() / self.group_rows))
        n = max(1, slots - self.spare) if n <= slots - self.spare else -(-n // slots) * slots
        out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        lightest = [(0.0, g) for g in range(n)]
        for k in np.argsort(-found, kind="stable").tolist():       # the largest first, each to the lightest group
            if found[k]:
                held, g = heapq.heappop(lightest)
                out[g].append(nodes[k])
                heapq.heappush(lightest, (held + found[k], g))
        return [sorted(g) for g in out if g]

    def local_nodes(self, rows: DataFrame, top: list, closed: list, d: int, tried: int) -> DataFrame:
        """(tree, node, local, feature, threshold, left, right, value) of the subtrees below the large nodes."""
        draw, seed, trees, groups = self._draw(), self.seed, self.trees, self.groups(rows, top, closed, d)
        if not groups:
            return rows.sparkSession.createDataFrame([], NODE_ROWS)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, DEALT_ROWS):
                    batch = whole.slice(a, DEALT_ROWS)
                    x, keys = matrix(batch.column("x"), d), batch.column("k").to_numpy()
                    y, w = (batch.column(c).to_numpy() for c in ("y", "w"))
                    values, codes = zip(*(np.unique(v, return_inverse=True) for v in x.T))
                    codes, sizes = np.array(codes, dtype=np.uint16), np.array([len(v) for v in values], dtype=np.int32)
                    held = {}       # (tree, node): its rows and how often they are drawn
                    for t in range(trees):
                        copied, at = draw(keys, t), _locate(top[t], x)
                        mine = np.flatnonzero(copied).astype(np.int32)
                        mine = mine[np.argsort(at[mine], kind="stable")]
                        nodes, starts = np.unique(at[mine], return_index=True)
                        held |= {(t, k): (v, copied[v].astype(np.uint8)) for k, v in zip(nodes.tolist(), np.split(mine, starts[1:]))}
                    none = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint8)
                    for g, group in enumerate(groups):
                        drawn, times = zip(*(held.get(v, none) for v in group))
                        some = np.unique(np.concatenate(drawn))
                        if len(some):
                            counts = np.array([len(v) for v in drawn], dtype=np.int32)
                            drawn = np.searchsorted(some, np.concatenate(drawn)).astype(np.int32)
                            parts = (keys[some], y[some], w[some], codes[:, some], sizes, np.concatenate(values), counts, drawn,
                                     np.concatenate(times))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([g], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
                                names=["group", *DEALT])

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, parts in _by_group(batches):
                data, label, members = _gathered(parts, groups[g], d)
                parts = None
                if len(members) == 1:
                    yield _alone(data, label, members[0], tried, seed)
                    continue
                t, node = np.array(groups[g], dtype=np.int32).T
                member, *nodes = grow(data, label, members, tried, seed)
                t, node = t[member], node[member]
                for a in range(0, len(member), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a:a + (1 << 16)]) for c in (t, node, *nodes)], names=NODE_COLUMNS)

        spread = map_batches(rows, "group int, " + ", ".join(f"{c} binary" for c in DEALT), dealt)
        # a group a partition; each takes long, so they must not be put together
        return map_batches(spread.repartitionById(len(groups), F.col("group")).sortWithinPartitions("group"), NODE_ROWS, grown)

    def ensemble(self, top: list, closed: list, nodes: DataFrame, d: int) -> TreeEnsemble | StoredTrees:
        """One numbering for each tree: its large nodes, then the other nodes of the subtrees below them; a subtree's
        root takes the large node's own place.  The nodes stay in a table, only the sizes of subtrees are collected."""
        table = cut_lineage(nodes)
        spark = table.sparkSession
        found = sorted(table.groupBy("tree", "node").count().collect())   # one row a subtree
        sizes, starts, grown = [len(upper) for upper in top], [], set()
        for t, node, n in found:
            starts.append((t, node, sizes[t]))
            grown.add((t, node))
            sizes[t] += n - 1
        own = [(t, k, u[0], float(u[1]), u[2], u[3], 0.0 if u[0] >= 0 else float(closed[t].get(k, 0.0)) / self.trees)
               for t, upper in enumerate(top) for k, u in enumerate(upper) if (t, k) not in grown]
        place = lambda local: F.when(F.col(local) == 0, F.col("node")).when(
            F.col(local) > 0, F.col("_start") + F.col(local) - 1).otherwise(-1).cast("int")
        below = table.join(F.broadcast(spark.createDataFrame(starts, "tree int, node int, _start int")), ["tree", "node"]).select(
            "tree", place("local").alias("node"), "feature", "threshold", place("left").alias("left"), place("right").alias("right"),
            F.when(F.col("feature") < 0, F.col("value") / F.lit(float(self.trees))).otherwise(0.0).alias("value"))
        if own:
            below = below.unionByName(spark.createDataFrame(
                own, "tree int, node int, feature int, threshold double, left int, right int, value double"))
        return StoredTrees(self.names or [f"x{k}" for k in range(d)], cut_lineage(below), sizes).loaded()


def _locate(nodes: list[list], x: np.ndarray) -> np.ndarray:
    """The node of the upper part that each row reaches."""
    at = np.zeros(len(x), dtype=int)
    if nodes[0][0] < 0:
        return at
    feature, threshold, left, right = (np.array(c) for c in zip(*nodes))
    rows = np.arange(len(x))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        low = x[rows, np.where(inner, f, 0)] <= threshold[at]
        at = np.where(inner, np.where(low, left[at], right[at]), at)
