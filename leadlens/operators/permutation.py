"""Permutation-sampled Shapley attribution for any model (tree ensembles,
boosted trees, non-additive scores), as one distributed Spark job.

For a row x, a feature ordering pi and a background row b, the hybrids
h_0 = b, h_j = h_{j-1} with feature pi_j taken from x, give the marginal
gain f(h_j) - f(h_{j-1}) of feature pi_j.  Averaged over the orderings and
the background rows this estimates the interventional Shapley value;
summed over features it is exactly f(x) - mean_b f(b) (the differences
telescope).

Plan: every input row is expanded in place (``explode`` of a sequence) into
P x |B| x (d+1) hybrids whose feature values are picked from literal arrays
(the background is a bounded sample, the orderings are P fixed
permutations), the model scores the hybrids in batch, the scores are summed
per (id, ordering, step) over the background rows, and each step adds +f to
the feature switched in at that step and -f to the feature switched in at
the next one.  A ``groupBy(id, feature)`` sum then yields the attributions:
no window, no join, no all-pairs product.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .arrow import map_batches

LINK_ROWS = 1024    # rows whose links are computed together


def permutation_attribution(df: DataFrame, predict: Callable[[DataFrame], DataFrame], features: list[str],
                            background: DataFrame, n_permutations: int = 2, seed: int = 42,
                            id_col: str = S.ID_COL, score_col: str = "score") -> DataFrame:
    """(id, feature, impact) in the model's output units.

    predict     DataFrame -> DataFrame adding ``score_col``; receives hybrid
                rows carrying every column of ``df`` with the feature columns
                replaced
    background  the caller's bounded sample of rows (collected: |B| x d values)
    """
    d = len(features)
    bg = background.select(*features).collect()
    nb = len(bg)
    if nb == 0 or d == 0:
        raise ValueError("empty background or feature list")
    rng = np.random.default_rng(seed)
    perms = [list(rng.permutation(d)) for _ in range(n_permutations)]
    pos = [[p.index(i) for i in range(d)] for p in perms]          # pos[p][i]: step index of feature i
    per_block = d + 1
    total = n_permutations * nb * per_block
    idx = F.col("_k")
    p = F.floor(idx / F.lit(nb * per_block)).cast("int")
    rem = idx % F.lit(nb * per_block)
    b = F.floor(rem / F.lit(per_block)).cast("int")
    j = (rem % F.lit(per_block)).cast("int")
    types = dict(df.select(*features).dtypes)
    hyb = {}
    for i, f in enumerate(features):
        pos_i = F.element_at(F.array(*[F.lit(pos[q][i]) for q in range(n_permutations)]), p + 1)
        bg_i = F.element_at(F.array(*[F.lit(r[f]).cast(types[f]) for r in bg]), b + 1)
        hyb[f] = F.when(pos_i < j, F.col(f)).otherwise(bg_i)
    ex = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    ex = ex.withColumns({**hyb, "_p": p, "_j": j}).drop("_k")
    scored = predict(ex)
    # sum over the background rows first: (id, ordering, step) keys, partial
    # aggregation on the map side shrinks the data |B|-fold before any shuffle
    step = scored.groupBy(id_col, "_p", "_j").agg(F.sum(F.col(score_col).cast("double")).alias("_s"))
    names = F.array(*[F.array(*[F.lit(features[i]) for i in perm]) for perm in perms])
    order = F.element_at(names, F.col("_p") + 1)                     # features in switch order
    s, jj = F.col("_s"), F.col("_j")
    gains = F.array(
        F.when(jj >= 1, F.struct(F.element_at(order, jj).alias("feature"), s.alias("v"))),
        F.when(jj < d, F.struct(F.element_at(order, jj + 1).alias("feature"), (-s).alias("v"))))
    long = step.select(id_col, F.explode(F.filter(gains, lambda g: g.isNotNull())).alias("g"))
    return (long.groupBy(id_col, F.col("g.feature").alias("feature"))
                .agg((F.sum("g.v") / F.lit(float(n_permutations * nb))).alias("impact")))


def exact_attribution(df: DataFrame, terms: dict[str, Column], background: DataFrame, link: Callable[[np.ndarray], np.ndarray],
                      intercept: float = 0.0, id_col: str = S.ID_COL) -> DataFrame:
    """(id, feature, impact): exact Shapley values of ``link(intercept + sum of terms)``.

    A coalition's value is the mean over the background of the score with the other features
    taken from there; of those only the sum of terms matters, one number for each background
    row (equal ones counted once).  The rows are spread evenly over tasks, as each takes 2^d
    times the background's size of links; a task computes them for a batch of rows at a time, so
    ``link`` is a function of numpy arrays, applied to each element.  An unknown term makes the
    lead's values null.
    """
    names, d = list(terms), len(terms)
    columns = [t.cast("double").alias(f"t{j}") for j, t in enumerate(terms.values())]
    rows = background.select(*columns).collect()
    if not rows:
        raise ValueError("empty background")
    others = []     # of each coalition: the background's sums of the other terms, and their shares
    for mask in range(1 << d):
        rest = Counter(sum((r[j] for j in range(d) if not mask >> j & 1), intercept) for r in rows
                       if all(r[j] is not None for j in range(d) if not mask >> j & 1))
        n = sum(rest.values())
        others.append((np.array(sorted(rest)), np.array([rest[c] / n for c in sorted(rest)])))
    weight = [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]

    def impacts(t: np.ndarray) -> np.ndarray:
        values = np.empty((1 << d, len(t)))
        for mask, (c, w) in enumerate(others):
            own = sum((t[:, j] for j in range(d) if mask >> j & 1), np.zeros(len(t)))
            values[mask] = link(own[:, None] + c) @ w if len(c) else np.nan
        out = np.zeros((len(t), d))
        for j in range(d):
            for m in range(1 << d):
                if not m >> j & 1:
                    out[:, j] += weight[m.bit_count()] * (values[m | 1 << j] - values[m])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LINK_ROWS):
                part = batch.slice(at, LINK_ROWS)
                given = [part.column(f"t{j}") for j in range(d)]
                known = np.all([v.is_valid().to_numpy(zero_copy_only=False) for v in given], axis=0)
                if not all(len(c) for c, _ in others):    # a coalition that no background row can complete
                    known[:] = False
                found = impacts(np.column_stack([v.to_numpy(zero_copy_only=False).astype(float) for v in given]))
                yield pa.RecordBatch.from_arrays([part.column(id_col), *[pa.array(v, mask=~known) for v in found.T]],
                                                 names=[id_col, *[f"i{j}" for j in range(d)]])

    spark = df.sparkSession
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    spread = df.select(id_col, *columns).repartition(n_tasks)    # a given number: small in bytes, but long to compute
    kind = df.schema[id_col].dataType.simpleString()
    out = map_batches(spread, f"`{id_col}` {kind}, " + ", ".join(f"i{j} double" for j in range(d)), run)
    return out.select(id_col, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"i{j}").alias("impact"))
                                                 for j, n in enumerate(names)])))
