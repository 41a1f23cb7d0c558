"""Second-order boosting of trees on binned features, for the logistic loss.

Features are binned once, at approximate quantiles or at given cuts; the table of bins, labels
and weights is written to the shared folder in blocks of rows and then held by the executors,
with each row's gradient and Hessian.  A tree grows level by level.  One pass over the blocks adds
up, for each (node, feature, bin), the gradients and the Hessians of the rows there, in the tasks
first; what is collected is that histogram, whose size does not depend on the rows.  Only the
smaller child of each split is added up, its sibling is the parent less that child.

A node with gradient sum G and Hessian sum H is worth ``G^2 / (H + lambda)``; the split chosen
adds most to the worth of its two sides, among those that leave ``min_child_weight`` of H on
either side.  Gains equal to 6 places go to the earlier feature, then the lower cut.  A leaf
adds ``-rate * G / (H + lambda)``.  Rows on a cut go left, unknown values right.

The first pass of a round adds the tree before to the margins and holds the blocks anew (in memory,
or on the executors' disks where that is full).  Every ``refresh`` rounds they are written to the
shared folder, so that a lost block is computed again from there.  A pass is one small job over
held blocks: no plan is made for it and no table is read.

Such a job takes 0.1 s whatever its rows, and a fit has a thousand.  So blocks of few rows are put into one
partition, and all rounds but the first, whose passes hold the blocks, are grown in one task (``_Held``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow import map_batches, matrix
from .moments import DIRECT_BYTES, tasks
from .trees import TreeEnsemble


HELD = StorageLevel.MEMORY_AND_DISK
TASK_ROWS = 1 << 18     # at least so many rows a task of a pass
ONE_TASK = 4            # up to so many such tasks' rows go to one task


@dataclass
class _Tree:
    """A tree over bins, as it grows: a row goes left where its bin is at most ``cut``."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        for side in (self.left, self.right):
            side[node] = len(self.feature)
            for column, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                column.append(v)
        return self.left[node], self.right[node]

    def added_to(self, block: "_Block") -> "_Block":
        return block.after(self)

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(bins), dtype=int), np.arange(len(bins))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            low = bins[rows, np.where(inner, f, 0)] <= cut[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)


class _Block(NamedTuple):
    """Some rows: their bins, labels, weights and margins, and the gradients and Hessians at these."""
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    margin: np.ndarray
    g: np.ndarray
    h: np.ndarray

    @classmethod
    def of(cls, bins: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> "_Block":
        p = 1.0 / (1.0 + np.exp(-margin))
        return cls(bins, y, w, margin, w * (p - y), w * p * (1.0 - p))

    @classmethod
    def read(cls, row: Row, width: int) -> "_Block":
        y, w = np.frombuffer(row["y"]), np.frombuffer(row["w"])
        return cls.of(np.frombuffer(row["bins"], dtype=np.uint8).reshape(len(y), width), y, w, np.zeros(len(y)))

    def after(self, tree: _Tree) -> "_Block":
        return self.of(self.bins, self.y, self.w, self.margin + np.array(tree.value)[tree.node_of(self.bins)])


class _Held:
    """All rows in one task: their bins, gradients and Hessians, and the nodes they are at.

    Features with rows in two bins only are kept eight to a number, whose sums are then shared out."""

    def __init__(self, blocks: Iterator[_Block], cuts: list[np.ndarray]):
        held = list(blocks)
        whole = lambda c: np.concatenate([getattr(b, c) for b in held])
        self.bins, self.y, self.w, self.margin, self.g, self.h = map(whole, _Block._fields)
        self.width = max(map(len, cuts)) + 1
        self.at = np.zeros(len(self.y), dtype=np.int64)
        self.step = np.arange(len(self.y)) * self.bins.shape[1]
        two = np.flatnonzero(self.bins.max(axis=0, initial=0) <= 1)     # rows in bins 0 and 1 only
        self.apart = [(f, np.ascontiguousarray(self.bins[:, f])) for f in range(len(cuts)) if f not in two]
        self.together = [(some, np.packbits(self.bins[:, some], axis=1, bitorder="little")[:, 0])
                         for some in (two[a:a + 8] for a in range(0, len(two), 8))]

    def move(self, tree: _Tree) -> None:
        """Rows of nodes that are split go on to the children."""
        feature, cut, left, right = map(np.array, (tree.feature, tree.cut, tree.left, tree.right))
        if (feature >= 0).any():
            f = feature[self.at]
            low = self.bins.ravel()[self.step + np.maximum(f, 0)] <= cut[self.at]
            self.at = np.where(f >= 0, np.where(low, left[self.at], right[self.at]), self.at)

    def histograms(self, tree: _Tree, nodes: list[int]) -> dict:
        """As ``BoostedTrees.histograms``; each level is asked for once."""
        self.move(tree)
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes)) * 256
        slot = slot[self.at]
        mine = np.flatnonzero(slot >= 0)
        slot, weights, out = slot[mine], (self.g[mine], self.h[mine]), np.zeros((len(nodes), 2, self.bins.shape[1], self.width))
        sums = lambda codes, v: np.bincount(slot + codes[mine], weights=v, minlength=len(nodes) * 256).reshape(-1, 256)
        for f, codes in self.apart:
            for k, v in enumerate(weights):
                out[:, k, f] = sums(codes, v)[:, :self.width]
        for some, codes in self.together:
            bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :len(some)].astype(float)
            for k, v in enumerate(weights):
                by = sums(codes, v)
                out[:, k, some, 0] = by @ (1 - bits)
                if self.width > 1:
                    out[:, k, some, 1] = by @ bits
        return dict(zip(nodes, out))

    def add(self, tree: _Tree) -> None:
        self.move(tree)
        self.margin = self.margin + np.array(tree.value)[self.at]
        *_, self.g, self.h = _Block.of(self.bins, self.y, self.w, self.margin)
        self.at[:] = 0


@dataclass
class BoostedTrees:
    """The estimator.  ``fit`` reads a vector (or array) column of features, a 0/1 label and a weight."""
    rounds: int = 200
    rate: float = 0.1
    depth: int = 5
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    min_gain: float = 1e-6
    bins: int = 64
    features: str = "features"
    label: str = "converteu"
    weight: str = "pos_weight"
    cuts: list[list[float]] | None = None    # for each feature; else quantiles of the rows
    names: list[str] | None = None
    refresh: int = 20

    def fit(self, df: DataFrame) -> TreeEnsemble:
        kind = df.schema[self.features].dataType.simpleString()
        x = F.col(self.features) if kind == "array<double>" else vector_to_array(self.features)
        rows = df.select(x.alias("x"), F.col(self.label).cast("double").alias("y"), F.col(self.weight).cast("double").alias("w"))
        cuts = [np.array(c, dtype=float) for c in (self.cuts or self.quantile_cuts(rows))]
        if not cuts or max(map(len, cuts)) > 255:
            raise ValueError("between 1 and 255 cuts a feature are needed, for at least one feature")
        width = len(cuts)
        table = cut_lineage(self.binned(rows, cuts))
        n = table.agg(F.sum("n")).first()[0] or 0
        parts = math.ceil(n / TASK_ROWS)    # a task costs more than a pass over few rows
        parts = 1 if parts <= ONE_TASK else min(tasks(table), parts)
        blocks = table.rdd.coalesce(parts).map(lambda r: _Block.read(r, width)).persist(HELD)
        trees: list[_Tree] = []
        held = [blocks]
        try:
            for r in range(self.rounds):
                if r and n and parts == 1:
                    trees += blocks.mapPartitions(partial(self.rounds_in_task, self.rounds - r, cuts)).collect()
                    break
                tree = self.grow(lambda tree, nodes: self.histograms(blocks, tree, nodes, cuts), cuts)
                while len(held) > 1:      # the blocks of the round before are not read again
                    held.pop(0).unpersist()
                trees.append(tree)
                blocks = blocks.map(tree.added_to).persist(HELD)
                held.append(blocks)
                if len(trees) % self.refresh == 0:
                    blocks.checkpoint()
        finally:
            for b in held:
                b.unpersist()
        return self.ensemble(trees, cuts)

    def quantile_cuts(self, rows: DataFrame) -> list[list[float]]:
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to fit")
        probs = [k / self.bins for k in range(self.bins)]
        points = rows.agg(*[F.percentile_approx(F.col("x")[k], probs, 10_000).alias(f"q{k}") for k in range(first[0])]).first()
        return [sorted(set(p or [0.0])) for p in points]

    def binned(self, rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
        """A row for each batch of rows: their number, labels, weights and bins, row after row."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("x"), len(cuts))
                    codes = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)]).astype(np.uint8)
                    y, w = (batch.column(c).to_numpy() for c in ("y", "w"))
                    yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()),
                                                      *[pa.array([v.tobytes()], pa.binary()) for v in (y, w, codes)]],
                                                     names=["n", "y", "w", "bins"])
        return map_batches(rows, "n long, y binary, w binary, bins binary", run)

    def rounds_in_task(self, rounds: int, cuts: list[np.ndarray], blocks: Iterator[_Block]) -> Iterator[_Tree]:
        held = _Held(blocks, cuts)
        for _ in range(rounds):
            tree = self.grow(held.histograms, cuts)
            held.add(tree)
            yield tree

    # ------------------------------------------------------------ one tree
    def grow(self, histograms: Callable[[_Tree, list[int]], dict], cuts: list[np.ndarray]) -> _Tree:
        tree, sums = _Tree(), {}
        open_, build, known = [0], [0], {}
        for level in range(self.depth):
            built = histograms(tree, build)
            for parent, small, large in known.values():
                built[large] = parent - built[small]
            splits = {k: self.best_split(built[k], cuts) for k in open_}
            open_, build, known = [], [], {}
            for k, s in splits.items():
                sums.setdefault(k, built[k][:, 0].sum(axis=1))
                if s is None:
                    continue
                f, cut, low, high = s
                left, right = tree.split(k, f, cut)
                sums[left], sums[right] = low, high
                small, large = (left, right) if low[1] <= high[1] else (right, left)
                open_ += [left, right]
                build.append(small)
                known[k] = (built[k], small, large)
            if not open_:
                break
        for k, (g, h) in sums.items():
            if tree.feature[k] < 0:
                tree.value[k] = -self.rate * g / (h + self.reg_lambda)
        return tree

    def histograms(self, blocks: RDD, tree: _Tree, nodes: list[int], cuts: list[np.ndarray]) -> dict:
        """{node: array [2, feature, bin]} of gradient and Hessian sums."""
        d, width = len(cuts), max(map(len, cuts)) + 1
        shape = (len(nodes), 2, d, width)
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes))

        def part(rows: Iterator[_Block]) -> Iterator[np.ndarray]:
            out = np.zeros(shape)
            for block in rows:
                at = slot[tree.node_of(block.bins)]
                mine = np.flatnonzero(at >= 0)
                at, bins, g, h = at[mine] * width, block.bins[mine], block.g[mine], block.h[mine]
                for f in range(d):
                    where = at + bins[:, f]
                    for k, v in enumerate((g, h)):
                        out[:, k, f] += np.bincount(where, weights=v, minlength=len(nodes) * width).reshape(len(nodes), width)
            yield out

        parts = blocks.mapPartitions(part)
        # added up on the driver if all of them together are small, else in tasks first
        if blocks.getNumPartitions() * np.prod(shape) * 8 <= DIRECT_BYTES:
            total = sum(parts.collect(), np.zeros(shape))
        else:
            total = parts.treeReduce(np.add)
        return dict(zip(nodes, total))

    def best_split(self, hist: np.ndarray, cuts: list[np.ndarray]):
        """(feature, cut, (G, H) of the low side, (G, H) of the high side), or None."""
        low = np.cumsum(hist, axis=2)[:, :, :-1]
        whole = hist.sum(axis=2, keepdims=True)
        high = whole - low
        worth = lambda s: s[0] ** 2 / (s[1] + self.reg_lambda)
        gain = np.round(worth(low) + worth(high) - worth(whole), 6)
        real = np.arange(low.shape[2])[None] < np.array([len(c) for c in cuts])[:, None]
        gain[~real | (low[1] < self.min_child_weight) | (high[1] < self.min_child_weight)] = -np.inf
        f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[f, cut] > self.min_gain:
            return None
        return int(f), int(cut), low[:, f, cut], high[:, f, cut]

    def ensemble(self, trees: list[_Tree], cuts: list[np.ndarray]) -> TreeEnsemble:
        first = np.cumsum([0, *[len(t.feature) for t in trees]])[:-1]
        all_ = lambda name, shift: np.concatenate([
            np.where(np.array(getattr(t, name)) >= 0, np.array(getattr(t, name)) + (a if shift else 0), -1)
            for t, a in zip(trees, first)]) if trees else np.zeros(0, dtype=int)
        feature = all_("feature", False)
        cut = np.concatenate([t.cut for t in trees]) if trees else np.zeros(0, dtype=int)
        threshold = np.array([cuts[f][c] if f >= 0 else 0.0 for f, c in zip(feature, cut)])
        return TreeEnsemble(self.names or [f"x{k}" for k in range(len(cuts))], first.astype(int), feature, threshold,
                            all_("left", True), all_("right", True), np.concatenate([[], *[t.value for t in trees]]), link="logit")
