"""Many subtrees of a random forest grown side by side in numpy.

A node costs far more calls than work, as most nodes hold a few rows.  So a task grows many subtrees
at the same time: each is a lane that stands at one node of its own, nodes of all lanes that hold
about as many rows are split in one go, as rows of a matrix, and each lane moves on.  A lane takes
its nodes in the order of ``forest.subtree`` (left before right), so the numbers of the nodes, and
with them the features tried, are the same; so are all sums, to the last bit: sums of a node's rows
run in the order of that version, which decides between cuts that cost the same.

Values are kept as ranks among a feature's values; a node's rows are a stretch of its lane, which a
split puts in order.  Lanes may share their rows' ranks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

WORK = 1 << 16      # values cut in one go
SIZES = np.array([32, 256, 1 << 62])    # nodes of up to so many rows are split together
MANY = 64           # rows from which on features of two values are cut without putting rows in order
CHUNK = 512         # orders of features made ahead for a lane
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


def order(d: int, seed: int, tree: int, node: int) -> np.ndarray:
    words = [seed, tree, node]
    if max(words) < 1 << 32:    # the same numbers, sooner
        words = np.array(words, dtype=np.uint32)
    return np.random.Generator(np.random.PCG64(words)).permutation(d)


def orders(d: int, seed: int, trees: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """``order`` for many nodes: numpy's seeding, PCG64 and shuffle, on columns of numbers.

    A shuffle draws again where a number is out of range, so nodes need different numbers of draws;
    each draw is made for all, and the few nodes that need many are left to ``order``."""
    n = len(nodes)
    if d > 256 or not 0 <= seed < 1 << 32 or (n and max(trees.max(), nodes.max()) >= 1 << 32):
        return np.array([order(d, seed, int(t), int(k)) for t, k in zip(trees, nodes)], dtype=int).reshape(n, d)
    u = np.uint32
    factor, words = 0x43B0D7E5, [np.full(n, seed, u), trees.astype(u), nodes.astype(u), np.zeros(n, u)]

    def hashed(v: np.ndarray, by: int) -> np.ndarray:
        nonlocal factor
        v = v ^ u(factor)
        factor = factor * by & 0xFFFFFFFF
        v = v * u(factor)
        return v ^ (v >> u(16))

    with np.errstate(over="ignore"):
        words = [hashed(v, 0x931E8875) for v in words]
        for a in range(4):
            for b in range(4):
                if a != b:
                    v = u(0xCA01F9DD) * words[b] - u(0x4973F715) * hashed(words[a], 0x931E8875)
                    words[b] = v ^ (v >> u(16))
        factor = 0x8B51F9DD
        state = [hashed(words[k % 4], 0x58F38DED).astype(np.uint64) for k in range(8)]
        start_high, start_low, inc_high, inc_low = (state[2 * k] | (state[2 * k + 1] << HALF) for k in range(4))
        inc_high, inc_low = (inc_high << np.uint64(1)) | (inc_low >> np.uint64(63)), (inc_low << np.uint64(1)) | np.uint64(1)
        low = inc_low + start_low
        high = inc_high + start_high + (low < start_low)
        high, low = _stepped(high, low, inc_high, inc_low)
        out = np.tile(np.arange(d, dtype=np.uint8), n)
        left, base, held = np.full(n, d - 1), np.arange(n) * d, None
        mask = np.array([(1 << k.bit_length()) - 1 for k in range(d)])
        live = np.arange(n)
        for draw in range(1 << 20):
            going = left > 0
            kept = int(going.sum())
            if kept * 64 <= n:
                live = live[going]
                break
            if draw % 2 == 0 and kept * 4 <= 3 * len(live):
                live, base, left, high, low, inc_high, inc_low = (v[going] for v in (live, base, left, high, low, inc_high, inc_low))
            if held is None:
                high, low = _stepped(high, low, inc_high, inc_low)
                turn, bits = high >> np.uint64(58), high ^ low
                bits = (bits >> turn) | (bits << ((np.uint64(64) - turn) & np.uint64(63)))
                now, held = bits & LOW, bits >> HALF
            else:
                now, held = held, None
            other = now.astype(np.int64) & mask[left]
            fits = (other <= left) & (left > 0)
            a, b = base + left, base + np.where(fits, other, left)
            va, vb = out[a], out[b]
            out[a], out[b] = vb, va
            left = left - fits
    out = out.reshape(n, d)
    for k in live.tolist():
        out[k] = order(d, seed, int(trees[k]), int(nodes[k]))
    return out


def _stepped(high: np.ndarray, low: np.ndarray, inc_high: np.ndarray, inc_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of PCG64's state, 128 bits as two numbers."""
    by_high, by_low = np.uint64(0x2360ED051FC65DA4), np.uint64(0x4385DF649FCCF645)
    a0, a1, x0, x1 = by_low & LOW, by_low >> HALF, low & LOW, low >> HALF
    p00, p01, p10 = x0 * a0, x0 * a1, x1 * a0
    middle = (p00 >> HALF) + (p01 & LOW) + (p10 & LOW)
    carried = x1 * a1 + (p01 >> HALF) + (p10 >> HALF) + (middle >> HALF)
    new = low * by_low + inc_low
    return carried + high * by_low + low * by_high + inc_high + (new < inc_low), new


@dataclass
class Rows:
    """Rows that lanes share: the rank of each value among its feature's values, and those values."""
    ranks: np.ndarray            # rows x features, the number of features rounded up to a multiple of four
    columns: np.ndarray          # the same, a feature after the other
    values: np.ndarray           # of all features, one after the other
    first: np.ndarray            # where a feature's values begin
    two: np.ndarray              # whether it has two
    d: int

    @classmethod
    def of(cls, ranks: Iterable[np.ndarray], values: list[np.ndarray], n: int) -> "Rows":
        """From each feature's ranks in ``n`` rows and its values in ascending order."""
        d = len(values)
        kind = np.uint16 if max(map(len, values), default=0) < 1 << 16 else np.uint32
        columns = np.zeros((d, n), dtype=kind)
        for f, r in enumerate(ranks):
            columns[f] = r
        by_row = np.zeros((n, -(-d // 4) * 4), dtype=kind)
        by_row[:, :d] = columns.T
        return cls(by_row, columns, np.concatenate([np.zeros(0), *values]), np.cumsum([0, *map(len, values)])[:-1],
                   np.array([len(v) == 2 for v in values]), d)


@dataclass
class Member:
    """A subtree to grow: its tree and node, the rows of it in their order, and their weights."""
    tree: int
    node: int
    rows: np.ndarray
    weight: np.ndarray


# what is known of a node
START, N, ONE, ALL, PARENT, SIDE = range(6)     # its first place, rows, weight of class 1 and of all, parent, and whether it is on the right


class _Lanes:
    """The lanes, the nodes they stand at, and those still to come."""

    def __init__(self, data: Rows, label: np.ndarray, members: list[Member], tried: int, seed: int):
        self.data, self.tried, self.seed, self.count = data, tried, seed, len(members)
        m, sizes = len(members), np.array([len(v.rows) for v in members])
        self.row = np.concatenate([v.rows for v in members]).astype(np.int32)
        self.weight = np.concatenate([v.weight for v in members]).astype(float)
        self.label = label[self.row].astype(float)
        self.tree = np.array([v.tree for v in members], dtype=np.int64)
        self.offset = np.array([v.node for v in members], dtype=np.int64) * 1_000_003
        members.clear()
        self.here = np.zeros((m, 6))
        self.here[:, START], self.here[:, N], self.here[:, PARENT] = np.cumsum([0, *sizes])[:-1], sizes, -1
        ends = sizes.cumsum().tolist()
        self.here[:, ONE], self.here[:, ALL] = ([*map(f, [0, *ends[:-1]], ends)] for f in (self.one_of, self.all_of))
        self.at = np.zeros(m, dtype=np.int64)         # the node's number
        self.later, self.depth = np.zeros((m, 64, 6)), np.zeros(m, dtype=np.int64)      # a stack for each lane
        self.size = (1 + SIZES.searchsorted(np.arange(sizes.max() + 1))).astype(np.int8)
        self.kind = self.kinds(self.here)
        self.ahead = np.zeros((m, CHUNK, data.d), dtype=np.uint8 if data.d <= 256 else np.int64)
        self.ahead_to = np.zeros(m, dtype=np.int64)
        self.place = np.arange(sizes.max())
        self.log, self.logged = np.zeros((max(1024, int(sizes.sum()) // 4), 7)), 0

    def one_of(self, a: int, b: int) -> float:
        return self.weight[a:b].dot(self.label[a:b])

    def all_of(self, a: int, b: int) -> float:
        return np.add.reduce(self.weight[a:b])

    def kinds(self, node: np.ndarray) -> np.ndarray:
        """0 for a leaf, else 1 and the number of the size."""
        one, n = node[:, ONE], node[:, N].astype(np.int64)
        return self.size[n] * ((one > 0) & (one < node[:, ALL]) & (n > 1))

    # ------------------------------------------------------------ moving on
    def leaves(self, lanes: np.ndarray) -> None:
        """These lanes' nodes stay leaves: each lane goes to its next node, or has ended."""
        self.note(lanes, self.here[lanes], -1, 0.0)
        top = self.depth[lanes] - 1
        if top.min() < 0:
            self.kind[lanes[top < 0]] = -1
            lanes, top = lanes[top >= 0], top[top >= 0]
        self.here[lanes] = node = self.later[lanes, top]
        self.depth[lanes] = top
        self.at[lanes] += 1
        self.kind[lanes] = self.kinds(node)

    def note(self, lanes: np.ndarray, node: np.ndarray, feature: np.ndarray | int, threshold: np.ndarray | float) -> None:
        a, b = self.logged, self.logged + len(lanes)
        if b > len(self.log):
            self.log = np.concatenate([self.log, np.zeros((len(self.log) // 2 + len(lanes), 7))])
        to, self.logged = self.log[a:b], b
        to[:, 0], to[:, 1], to[:, 2], to[:, 3] = lanes, self.at[lanes], feature, threshold
        to[:, 4] = node[:, ONE] / node[:, ALL]
        to[:, 5:] = node[:, PARENT:]

    def order_of(self, lanes: np.ndarray) -> np.ndarray:
        """The order in which each lane's node tries features."""
        left = self.ahead_to[lanes] - self.at[lanes]
        if left.min() <= 0:     # those that soon need some get theirs too, as many cost little more than a few
            late = ((self.ahead_to - self.at <= CHUNK // 4) & (self.kind >= 0)).nonzero()[0]
            nodes = (self.offset[late] + self.at[late])[:, None] + self.place_ahead
            self.ahead[late] = orders(self.data.d, self.seed, np.repeat(self.tree[late], CHUNK), nodes.ravel()).reshape(
                len(late), CHUNK, self.data.d)
            self.ahead_to[late] = self.at[late] + CHUNK
            left = self.ahead_to[lanes] - self.at[lanes]
        return self.ahead[lanes, CHUNK - left]

    place_ahead = np.arange(CHUNK)

    # ------------------------------------------------------------ splitting
    def split(self, lanes: np.ndarray) -> None:
        """Split the nodes that these lanes stand at; each then stands at its left child."""
        data, d, node = self.data, self.data.d, self.here[lanes]
        start, n = node[:, START].astype(np.int64), node[:, N].astype(np.int64)
        b, s = len(lanes), int(n.max())
        every, place = np.arange(b), self.place[:s]
        valid = place < n[:, None]
        # a short node's row is filled up with its first row, which changes nothing but sums: its weight is 0 there
        at = place * valid
        at += start[:, None]
        rows = self.row[at]
        mine = data.ranks[rows[:, :MANY]]                         # node, row, feature
        words = mine.view(np.uint64)
        vary = np.bitwise_or.reduce(words ^ words[:, :1], axis=1).view(mine.dtype) != 0
        tried = self.order_of(lanes)
        ordered = vary[every[:, None], tried]
        turn = ordered.cumsum(axis=1)
        if s > MANY:    # features that do not vary in the first rows, and would be tried if they vary in others
            unsure = (~ordered & (turn < self.tried)).ravel().nonzero()[0]
            for a in range(0, len(unsure), max(1, WORK // s)):
                some = unsure[a:a + max(1, WORK // s)]
                v = data.columns.ravel()[tried.ravel()[some].astype(np.int64)[:, None] * len(data.ranks) + rows[some // d]]
                ordered.ravel()[some] = (v != v[:, :1]).any(axis=1)
            turn = ordered.cumsum(axis=1)
        found = turn[:, -1]
        if not found.all():
            self.leaves(lanes[found == 0])
            if found.any():
                self.split(lanes[found > 0])
            return
        pairs = (ordered & (turn <= self.tried)).ravel().nonzero()[0]     # of a node and a feature
        of, feature = pairs // d, tried.ravel()[pairs].astype(np.int64)
        w, y = self.weight[at], self.label[at]
        both = np.empty((b, s), dtype=complex)        # weight and weight of class 1, added up together
        both.real, both.imag = w * valid, w * valid * y
        if s <= MANY:
            v = mine[of, :, feature]
        else:
            v = data.columns.ravel()[feature[:, None] * len(data.ranks) + rows[of]]
        cost, low, high, top = self.cuts(v, both, of, feature, n, node)
        costs, pair = np.full((self.tried, b), np.inf), np.zeros((self.tried, b), dtype=np.int64)
        turn = turn.ravel()[pairs] - 1
        costs[turn, of], pair[turn, of] = cost, np.arange(len(of))
        best, pick = costs[0], np.zeros(b, dtype=np.int64)
        for j in range(1, self.tried):
            better = costs[j] < best - 1e-12
            best, pick = np.where(better, costs[j], best), np.where(better, j, pick)
        pick = pair[pick, every]
        f, low, high, top = feature[pick], low[pick], high[pick], top[pick]
        first = data.first[f]
        small, large = data.values[first + low], data.values[first + high]
        t = small + (large - small) / 2
        t = np.where((t < np.inf) & (data.values[first + top] > t), t, small)     # half-way may round up to the next value
        goes = v[pick] <= np.where(large <= t, high, low)[:, None]      # up to the largest rank that goes left
        goes &= valid
        self.note(lanes, node, f, t)
        # the rows that go left, in their order, then the others
        count = goes.cumsum(axis=1)
        left = count[:, -1]
        to = np.where(goes, count - 1, place - count + left[:, None])
        to += start[:, None]
        to = to[valid]
        self.row[to], self.weight[to], self.label[to] = rows[valid], w[valid], y[valid]
        mine = np.empty((2, b, 6))
        mine[0, :, START], mine[1, :, START] = start, start + left
        mine[0, :, N], mine[1, :, N] = left, n - left
        mine[:, :, PARENT], mine[0, :, SIDE], mine[1, :, SIDE] = self.at[lanes], 0, 1
        part = np.empty((2, b, s), dtype=complex)
        np.multiply(both, goes, out=part[0])
        np.subtract(both, part[0], out=part[1])
        part = part.cumsum(axis=2)[:, :, -1]
        mine[:, :, ONE], mine[:, :, ALL] = part.imag, part.real
        children = mine.reshape(2 * b, 6)
        for least, column, total in ((8, ALL, self.all_of), (16, ONE, self.one_of)):
            if s > least:       # sums of so many rows do not run one after the other
                many = (children[:, N] >= least).nonzero()[0]
                stretch = children[many, :2].astype(np.int64)
                children[many, column] = [*map(total, stretch[:, 0].tolist(), stretch.sum(axis=1).tolist())]
        depth = self.depth[lanes]
        if depth.max() >= self.later.shape[1]:
            self.later = np.concatenate([self.later, np.zeros_like(self.later)], axis=1)
        self.later[lanes, depth] = mine[1]
        self.depth[lanes] = depth + 1
        self.here[lanes] = mine[0]
        self.at[lanes] += 1
        self.kind[lanes] = self.kinds(mine[0])

    def cuts(self, v: np.ndarray, both: np.ndarray, of: np.ndarray, feature: np.ndarray, n: np.ndarray,
             node: np.ndarray) -> list[np.ndarray]:
        """``_cuts`` of all pairs, some at a time; larger nodes need not be put in order by features of two values."""
        s = v.shape[1]
        step = max(1, WORK // s)
        if s <= MANY and len(of) <= step:
            return _cuts(v, both, of, n, node)
        out = [np.zeros(len(of)), *(np.zeros(len(of), dtype=np.int64) for _ in range(3))]
        two = self.data.two[feature] if s > MANY else np.zeros(len(of), dtype=bool)
        for cut, some in ((_cut_of_two, two.nonzero()[0]), (_cuts, (~two).nonzero()[0])):
            for a in range(0, len(some), step):
                part = some[a:a + step]
                for to, c in zip(out, cut(v[part], both, of[part], n, node)):
                    to[part] = c
        return out

    # ------------------------------------------------------------ all of them
    def run(self) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            while True:
                while len(lanes := (self.kind == 0).nonzero()[0]):
                    self.leaves(lanes)
                counts = np.bincount(self.kind[self.kind > 0])
                if not len(counts):
                    return
                lanes = (self.kind == counts.argmax()).nonzero()[0]
                most = max(1, 4 * WORK // (int(self.here[lanes, N].max()) * self.tried))
                self.split(lanes if len(lanes) <= most else lanes[self.at[lanes].argsort()[:most]])    # those furthest behind

    def nodes(self) -> list[np.ndarray]:
        """Number of the member, local number, feature, threshold, left, right and value, by member and local number."""
        log = self.log[:self.logged]
        lane, at, parent = (log[:, k].astype(np.int32) for k in (0, 1, 5))
        first = np.concatenate([[0], np.bincount(lane, minlength=self.count).cumsum()[:-1]])
        right, second = np.full(len(lane), -1, dtype=np.int32), log[:, 6] == 1
        right[first[lane[second]] + parent[second]] = at[second]
        where = np.empty(len(lane), dtype=np.int64)
        where[first[lane] + at] = np.arange(len(lane))
        feature = log[where, 2].astype(np.int32)
        at = at[where]
        return [lane[where], at, feature, log[where, 3], np.where(feature >= 0, at + 1, -1).astype(np.int32), right, log[where, 4]]


def _cuts(v: np.ndarray, both: np.ndarray, of: np.ndarray, n: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each row of ``v``, the ranks of a node's rows by a feature: the least cost of a cut, the rank below it,
    the one above and the largest.  Only the first ``n`` entries count."""
    s = v.shape[1]
    bits = max(1, (s - 1).bit_length())
    kind = np.uint32 if v.dtype == np.uint16 and bits <= 16 else np.uint64
    place, n = np.arange(s, dtype=kind), n[of]
    beyond = place >= n[:, None]
    key = v.astype(kind)
    key <<= kind(bits)
    key |= place            # equal ranks stay in the order of the rows
    key[beyond] = np.iinfo(kind).max      # behind all others
    key.sort(axis=1)
    order = (key & kind((1 << bits) - 1)).astype(np.intp)
    order[beyond] = 0
    order += (of * s)[:, None]
    key >>= kind(bits)
    sums = both.ravel()[order].cumsum(axis=1)[:, :-1]
    la, lo = sums.real, sums.imag
    one, all_ = node[of, ONE, None], node[of, ALL, None]
    ra, ro = all_ - la, one - lo
    cost = _cost(la, lo, ra, ro)
    cost[(key[:, 1:] <= key[:, :-1]) | beyond[:, 1:]] = np.inf
    k, every = cost.argmin(axis=1), np.arange(len(of))
    return cost[every, k], key[every, k].astype(np.int64), key[every, k + 1].astype(np.int64), key[every, n - 1].astype(np.int64)


def _cost(la: np.ndarray, lo: np.ndarray, ra: np.ndarray, ro: np.ndarray) -> np.ndarray:
    return 2 * lo * (la - lo) / la + np.where(ra > 0, 2 * ro * (ra - ro) / ra, 0.0)


def _cut_of_two(v: np.ndarray, both: np.ndarray, of: np.ndarray, n: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_cuts`` for ranks 0 and 1 that both occur: the one cut there is."""
    sums = (both[of] * (v == 0)).cumsum(axis=1)[:, -1]
    la, lo = sums.real, sums.imag
    rank = np.zeros(len(of), dtype=np.int64)
    return _cost(la, lo, node[of, ALL] - la, node[of, ONE] - lo), rank, rank + 1, rank + 1


def grow(data: Rows, label: np.ndarray, members: list[Member], tried: int, seed: int) -> list[np.ndarray]:
    """The nodes of all members' subtrees, each member with at least one row; see ``_Lanes.nodes``.

    ``members`` is emptied, as their rows are held in another form."""
    lanes = _Lanes(data, label, members, tried, seed)
    lanes.run()
    return lanes.nodes()
