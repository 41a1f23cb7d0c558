"""SimHash near-duplicate detection by a self-join of binary tries.

Fingerprint.  A-Z are lower-cased, words are runs of anything but ASCII white space, and
every run of ``width`` words (a shorter text: all its words) is hashed with XXH64, seed 42.
Repeated shingles count again.  A bit of the 64-bit fingerprint is 1 if it is set in over
half of the hashes; a text without words has fingerprint zero.

Self-join.  Different fingerprints form a binary trie, held as a sorted array in which a
node is a range.  Pairs of nodes are traversed together: a child pair on different bits
costs one error, and a pair over the budget is pruned.  To spread this over tasks, the trie
is built in ``max_bits + 1`` rotations.  Two fingerprints within the budget agree in one
whole segment, so in the rotation that starts with this segment their node pair reaches the
segment's end with no error.  Hence the top levels of a rotation only keep pairs (a, a),
and each bucket of equal leading segments is one independent subtree.  A bucket of over
``bucket_rows`` fingerprints is unrolled by ``SPLIT_BITS`` more levels into node pairs, each
a unit of work of its own, and these again until none is larger; so what a task takes is
bounded, however many different fingerprints share a segment.

A task keeps the forest of what it has linked, skips node pairs whose leaves already hang
together, and reports each linked fingerprint with the first one of its group; so a large
group of near copies costs neither all its pairs nor their output, and no link is lost.

Defined cases: null and empty texts have fingerprint zero and are linked like any other.
Rows with the same ``doc_id`` count as separate rows of equal id.  A null ``doc_id`` is
ignored for the smallest id; a component of such rows alone has a null id.  An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.arrow_map import append_columns, for_workers
from leadlens.llm.tables import connected_components, fresh, written

SEED = 42
PART = 1 << 16        # shingles whose bits are counted at once
PAIRS = 1 << 16       # node pairs expanded at once
LEAF_PRODUCT = 64     # node pairs of at most so many leaf pairs are compared leaf by leaf
SPLIT_BITS = 6
TASK_ROWS = 250_000   # fingerprints a task takes, on average


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules for both
    if not words:
        return 0
    ones, total = np.zeros(64, dtype=np.int64), max(1, len(words) - width + 1)
    for at in range(0, total, PART):
        part = words[at:at + PART + width - 1]
        shingles = zip(*(part[k:] for k in range(width))) if len(words) >= width else [words]
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the column ``simhash`` (long, the fingerprint's 64 bits)."""
    def make():
        def each(part: pa.RecordBatch) -> list[pa.Array]:
            values = np.array([fingerprint(t, width) for t in part.column(text).to_pylist()], dtype=np.uint64)
            return [pa.array(values.view(np.int64))]
        return each

    return append_columns(docs, [T.StructField("simhash", T.LongType())], make, keep=keep)


class Forest:
    """Labels of what has been linked so far, for rows 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.label = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        open_ = self.label[a] != self.label[b]
        for i, j in zip(a[open_].tolist(), b[open_].tolist()):
            p, q = self.root(i), self.root(j)
            self.parent[max(p, q)] = min(p, q)
        if open_.any():
            p = np.array(self.parent)
            while not np.array_equal(p, p[p]):
                p = p[p]
            self.label, self.parent = p, p.tolist()


def trie_links(keys: np.ndarray, roots: tuple[np.ndarray, ...], depth: int, max_bits: int,
               forest: Forest) -> None:
    """Link the leaves of sorted ``keys`` below the node pairs ``roots`` (lo, hi, lo, hi, errors)."""
    ones: dict[int, np.ndarray] = {}

    def middle(lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        if d not in ones:
            bit = (keys >> np.uint64(63 - d)) & np.uint64(1)
            ones[d] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        return hi - (ones[d][hi] - ones[d][lo])

    stack = [(depth, roots)]
    while stack:
        d, pairs = stack.pop()
        if len(pairs[0]) > PAIRS:
            stack.append((d, tuple(x[PAIRS:] for x in pairs)))
            pairs = tuple(x[:PAIRS] for x in pairs)
        turns = np.concatenate([[0], np.cumsum(forest.label[1:] != forest.label[:-1])])
        alo, ahi, blo, bhi, err = pairs
        done = ((turns[ahi - 1] == turns[alo]) & (turns[bhi - 1] == turns[blo])
                & (forest.label[alo] == forest.label[blo]))
        alo, ahi, blo, bhi, err = (x[~done] for x in pairs)
        na, nb = ahi - alo, bhi - blo
        few = na * nb <= LEAF_PRODUCT
        if d >= 64:
            few[:] = True
        if few.any():
            a, b, n = alo[few], blo[few], (na * nb)[few]
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = a[which] + k // nb[few][which], b[which] + k % nb[few][which]
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= max_bits)
            forest.link(i[near], j[near])
        alo, ahi, blo, bhi, err = (x[~few] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        am, bm = middle(alo, ahi, d), middle(blo, bhi, d)
        own = alo == blo
        rest = ~own
        kids = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1),
                tuple(x[rest] for x in (am, ahi, blo, bm, err + 1))]  # a pair (a, a) has its mixed children once
        joined = tuple(np.concatenate([k[c] for k in kids]) for c in range(5))
        good = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= max_bits)
        stack.append((d + 1, tuple(x[good] for x in joined)))


def links_of(rotation: np.ndarray, depth: np.ndarray, low: np.ndarray, delta: np.ndarray, keys: np.ndarray, lead: int,
             max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What hangs together among the rows of one task: each linked fingerprint with its group's first one.

    A unit is the pair of nodes ``low`` and ``low ^ delta`` at ``depth`` (the same node where
    ``delta`` is 0); its rows are the leaves of both.
    """
    order = np.lexsort((keys, delta, low, depth, rotation))
    rotation, depth, low, delta, keys = (x[order] for x in (rotation, depth, low, delta, keys))
    forest = Forest(len(keys))
    new = np.zeros(len(keys), dtype=bool)
    new[:1] = True
    for x in (rotation, depth, low, delta):
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(keys))
    other = np.concatenate([[0], np.cumsum((keys >> (64 - depth).astype(np.uint64)).astype(np.int64) != low)])
    mid = ends - (other[ends] - other[starts])   # the rows of the other node come last
    own, err = delta[starts] == 0, np.bitwise_count(delta[starts].astype(np.uint64)).astype(np.int64)
    alo, ahi, blo, bhi = starts, np.where(own, ends, mid), np.where(own, starts, mid), ends
    some = np.where(own, ends - starts > 1, (alo < ahi) & (blo < bhi))
    for d in np.unique(depth[starts]):
        now = some & (depth[starts] == d)
        trie_links(keys, tuple(x[now] for x in (alo, ahi, blo, bhi, err)), int(d), max_bits, forest)
    i = np.flatnonzero(forest.label != np.arange(len(keys)))
    j = forest.label[i]
    turn = rotation[i].astype(np.uint64) * np.uint64(lead)
    back = lambda v: (v >> turn) | np.where(turn > 0, v << ((np.uint64(64) - turn) % np.uint64(64)), np.uint64(0))
    return back(keys[i]), back(keys[j])


def _rotated(value: Column, turn: Column, lead: int, turns: int) -> Column:
    """``value`` with its bits turned left by ``turn`` segments."""
    out = value
    for r in range(1, turns):
        out = F.when(turn == r, F.shiftleft(value, r * lead).bitwiseOR(F.shiftrightunsigned(value, 64 - r * lead))) \
            .otherwise(out)
    return out


def _unrolled(rows: DataFrame, depth: int, max_bits: int) -> DataFrame:
    """The rows of node pairs at ``depth`` dealt to the pairs ``SPLIT_BITS`` below that the error budget allows."""
    child = F.shiftrightunsigned("k", 64 - depth - SPLIT_BITS)
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << SPLIT_BITS) if m.bit_count() <= max_bits])
    below = F.transform(masks, lambda m: F.shiftleft(F.col("delta"), SPLIT_BITS).bitwiseOR(m))
    return rows.select("r", "k", child.alias("child"), F.explode(below).alias("delta")).where(F.bit_count("delta") <= max_bits) \
        .select("r", "k", F.least("child", F.col("child").bitwiseXOR(F.col("delta"))).alias("low"), "delta")


def units(rows: DataFrame, lead: int, max_bits: int, bucket_rows: int) -> tuple[DataFrame, int]:
    """Rows (r, k, low, delta, depth) of units of at most ``bucket_rows`` rows, and about how many rows there are.

    A larger unit is unrolled again and again, each time into the node pairs below it that are
    within the error budget; pairs of which one node is empty go.  Six bits above the leaves a
    pair has 128 leaves at most, so this ends."""
    key, depth, done, total, open_ = ["r", "low", "delta"], lead, [], 0, rows
    while True:
        side = F.shiftrightunsigned("k", 64 - depth) == F.col("low")
        sizes = written(open_.groupBy(*key).agg(F.count("*").alias("n"), F.bool_or(side).alias("a"), F.bool_or(~side).alias("b"))
                        .where("n > 1 and (delta = 0 or (a and b))"), "units")
        large = sizes.where((F.col("n") > bucket_rows) & F.lit(depth + SPLIT_BITS <= 64 - SPLIT_BITS)).select(*key)
        n, n_large = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], large.count()
        total += n
        if depth > lead:
            open_ = open_.join(sizes.select(*key), key, "left_semi")
        if not n_large:
            done.append(open_.withColumn("depth", F.lit(depth)))
            break
        done.append(open_.join(large, key, "left_anti").withColumn("depth", F.lit(depth)))
        open_ = written(_unrolled(open_.join(large, key, "left_semi"), depth, max_bits), "unrolled")
        depth += SPLIT_BITS
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, total


def near_links(prints: DataFrame, max_bits: int = 3, bucket_rows: int = 200_000) -> DataFrame:
    """Rows (u, v) that connect all of ``prints`` (simhash: long, different) that links of at most ``max_bits`` connect."""
    lead, turns = 64 // (max_bits + 1), max_bits + 1
    rows = prints.select(F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("r"), "simhash") \
        .select(F.col("r").cast("long").alias("r"), _rotated(F.col("simhash"), F.col("r"), lead, turns).alias("k")) \
        .select("r", "k", F.shiftrightunsigned("k", 64 - lead).alias("low"), F.lit(0).cast("long").alias("delta"))
    dealt, total = units(rows, lead, max_bits, bucket_rows)
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if held:
            r, depth, low, delta, k = (np.concatenate(x) for x in zip(*held))
            u, v = links_of(r, depth.astype(np.int64), low, delta, k.view(np.uint64), lead, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return for_workers(dealt).repartition(parts, "r", "depth", "low", "delta") \
        .select("r", "depth", "low", "delta", "k").mapInArrow(run, "u long, v long")


def grouped(docs: DataFrame, width: int = 3, max_bits: int = 3, text: str = "text", key: str = "doc_id",
            bucket_rows: int = 200_000) -> DataFrame:
    """One row for each document: key, ``text_hash``, ``simhash``, ``group`` (a fingerprint) and ``component_id``."""
    source = docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("text_hash"))
    marked = written(fingerprints(source, width, text, keep=[key, "text_hash"]), "simhash")
    prints = written(marked.groupBy("simhash").agg(F.min(key).alias("first_id")), "prints")
    roots = connected_components(near_links(prints.select("simhash"), max_bits, bucket_rows))
    linked = prints.join(roots, prints.simhash == roots.node).select("simhash", "first_id", "root")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = linked.join(smallest, "root").select("simhash", "root", F.col("component_id").alias("joined_id"))
    ids = written(prints.join(members, "simhash", "left").select(  # written, so that a frequent fingerprint's rows
        "simhash", F.coalesce("root", "simhash").alias("group"),     # can be split in the join below
        F.coalesce("joined_id", "first_id").alias("component_id")), "groups")
    return marked.join(ids, "simhash").select(key, "text_hash", "simhash", "group", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row for each document: key, ``simhash`` (long) and ``component_id``, its group's smallest key."""
    return grouped(docs, key=key, **options).select(key, "simhash", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one of smallest key (null last, then by text hash), once."""
    own_id, own_hash = fresh(docs, "id_hash", "text_hash")
    first = grouped(docs, text=text, key=key, **options).groupBy("group").agg(
        F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), "text_hash")).alias("w")) \
        .select(F.xxhash64(F.lit(7), "w.k").alias(own_id), F.col("w.text_hash").alias(own_hash))  # never null, as a key may be
    kept = docs.withColumns({own_id: F.xxhash64(F.lit(7), key), own_hash: F.xxhash64(text)})
    stay = kept.join(first, [own_id, own_hash], "left_semi")
    return stay.dropDuplicates([own_id, own_hash]).select(*docs.columns)
