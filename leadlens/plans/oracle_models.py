"""SQL twins of fitted models: Newton steps, boosting rounds and tree attributions, written out."""

from __future__ import annotations

import math

from .sql import band_right_sql, d, q, sigmoid_sql, with_ctes


# ---------------------------------------------------------------- trees
def tree_sql(node, value) -> str:
    """A tree of nested tuples as CASE; ``value(feature)`` is the SQL of a feature; unknown goes right."""
    if not isinstance(node, tuple):
        return d(node)
    f, t, low, high = node
    return f"CASE WHEN {value(f)} <= {d(t)} THEN {tree_sql(low, value)} ELSE {tree_sql(high, value)} END"


def forest_sql(trees, base: float, value) -> str:
    return " + ".join([d(base), *[f"({tree_sql(t, value)})" for t in trees]])


def tree_shap_ctes(trees, base: float, features: list[str]) -> list[str]:
    """att_long: impacts by all coalitions, a feature outside the coalition taken from the background row."""
    n = len(features)
    weight = [math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n) for s in range(n)]
    of = lambda m: lambda f: f"{'x' if m >> features.index(f) & 1 else 'b'}.{f}"
    cols = ", ".join(features)
    means = ", ".join(f"AVG({forest_sql(trees, base, of(m))}) AS v{m}" for m in range(1 << n))
    impact = lambda j: " + ".join(f"{d(weight[m.bit_count()])} * (v{m | 1 << j} - v{m})"
                                  for m in range(1 << n) if not m >> j & 1)
    return [f"b AS (SELECT {cols} FROM feat ORDER BY lead_id LIMIT 100)",
            f"x AS (SELECT DISTINCT {cols} FROM feat)",   # equal leads have equal impacts
            f"v AS MATERIALIZED (SELECT {', '.join('x.' + f for f in features)}, {means} FROM x CROSS JOIN b GROUP BY ALL)",
            "vl AS (SELECT f.lead_id, v.* FROM feat f JOIN v ON "
            + " AND ".join(f"f.{c} IS NOT DISTINCT FROM v.{c}" for c in features) + ")",
            "att_long AS (" + " UNION ALL ".join(
                f"SELECT lead_id, {j} AS slot, {q(f)} AS feature, {impact(j)} AS impact FROM vl" for j, f in enumerate(features)) + ")",
            "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lead_id ORDER BY abs(round(impact, 9)) DESC NULLS LAST, slot) AS rn "
            "FROM att_long)"]


# ---------------------------------------------------------------- boosting
def boosting_sql(cuts: dict[str, list[float]], rounds: int, depth: int, rate: float) -> str:
    names = list(cuts)
    code = lambda c: "CASE " + " ".join(f"WHEN {c} <= {d(t)} THEN {k}" for k, t in enumerate(cuts[c])) + f" ELSE {len(cuts[c])} END"
    sides = lambda g, h: f"({g} * {g} / ({h} + 1e0))"
    out = ["ratio AS (SELECT COUNT(*) FILTER (WHERE converteu = 0) / COUNT(*) FILTER (WHERE converteu = 1) AS spw FROM feat)",
           "m0 AS MATERIALIZED (SELECT lead_id, CAST(converteu AS DOUBLE) AS y, CASE WHEN converteu = 1 THEN spw ELSE 1e0 END AS w, 0e0 AS z, "
           + ", ".join(f"{code(c)} AS f{k}" for k, c in enumerate(names)) + " FROM feat, ratio)"]
    fs = ", ".join(f"f{k}" for k in range(len(names)))
    for r in range(rounds):
        out.append(f"t{r}_0 AS MATERIALIZED (SELECT lead_id, y, w, z, {fs}, w * (p - y) AS g, w * p * (1e0 - p) AS h, 1 AS node, 0 AS done "
                   f"FROM (SELECT *, {sigmoid_sql('z')} AS p FROM m{r}) a)")
        for k in range(depth):
            t = f"t{r}_{k}"
            long = " UNION ALL ".join(f"SELECT node, {j} AS f, f{j} AS bin, g, h FROM {t} WHERE done = 0" for j in range(len(names)))
            last = "CASE f " + " ".join(f"WHEN {j} THEN {len(cuts[c])}" for j, c in enumerate(names)) + " END"
            out += [
                f"h{r}_{k} AS (SELECT node, f, bin, SUM(g) AS g, SUM(h) AS h FROM ({long}) a GROUP BY node, f, bin)",
                f"c{r}_{k} AS (SELECT node, f, bin, SUM(g) OVER up AS gl, SUM(h) OVER up AS hl, SUM(g) OVER whole AS gt, SUM(h) OVER whole AS ht "
                f"FROM h{r}_{k} WINDOW up AS (PARTITION BY node, f ORDER BY bin), whole AS (PARTITION BY node, f))",
                f"s{r}_{k} AS MATERIALIZED (SELECT * FROM (SELECT node, f, bin, ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) AS rk FROM "
                f"(SELECT node, f, bin, round({sides('gl', 'hl')} + {sides('(gt - gl)', '(ht - hl)')} - {sides('gt', 'ht')}, 6) AS gain "
                f"FROM c{r}_{k} WHERE bin < {last} AND hl >= 1e0 AND ht - hl >= 1e0) b WHERE gain > 1e-6) e WHERE rk = 1)",
                f"t{r}_{k + 1} AS MATERIALIZED (SELECT t.lead_id, y, w, z, {fs}, g, h, CASE WHEN s.node IS NULL THEN t.node ELSE 2 * t.node + "
                f"CASE WHEN CASE s.f " + " ".join(f"WHEN {j} THEN f{j}" for j in range(len(names)))
                + f" END <= s.bin THEN 0 ELSE 1 END END AS node, CASE WHEN s.node IS NULL THEN 1 ELSE 0 END AS done "
                f"FROM {t} t LEFT JOIN s{r}_{k} s ON t.node = s.node AND t.done = 0)"]
        end = f"t{r}_{depth}"
        out += [f"l{r} AS (SELECT node, -{d(rate)} * SUM(g) / (SUM(h) + 1e0) AS v FROM {end} GROUP BY node)",
                f"m{r + 1} AS MATERIALIZED (SELECT lead_id, y, w, z + v AS z, {fs} FROM {end} t JOIN l{r} l ON t.node = l.node)"]
    s = sigmoid_sql("z")
    return with_ctes(f"SELECT lead_id, round({s}, 6) AS score, {band_right_sql(s)} AS classificacao FROM m{rounds}", out)


# ---------------------------------------------------------------- Newton steps of the logistic regression
def newton_ctes(slots: int, steps: int, penalty: float = 1.0) -> list[str]:
    """beta: the coefficients (list, the intercept last) after ``steps`` steps from zero over the CTE ``slots``."""
    n = slots + 1
    x = "[" + ", ".join([f"s{i}" for i in range(slots)] + ["1e0"]) + "]"
    out = ["wts AS (SELECT converteu AS label, SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*)) AS w FROM slots "
           "WHERE split = 'train' GROUP BY converteu)",
           f"xs AS MATERIALIZED (SELECT {x} AS x, CAST(converteu AS DOUBLE) AS y, w FROM slots JOIN wts ON converteu = label WHERE split = 'train')",
           f"n0 AS MATERIALIZED (SELECT list_transform(range({n}), lambda i: 0e0) AS beta)"]
    ridge = f"CASE WHEN i = j AND i < {n} THEN {d(penalty)} ELSE 0e0 END"
    for k in range(steps):
        out += [
            f"p{k} AS MATERIALIZED (SELECT x, w * p * (1e0 - p) AS a, w * (y - p) AS r FROM "
            f"(SELECT x, y, w, {sigmoid_sql('list_inner_product(x, beta)')} AS p FROM xs, n{k}) t)",
            f"h{k} AS (SELECT i, j, SUM(a * x[i] * x[j]) + {ridge} AS v FROM p{k}, range(1, {n + 1}) a(i), range(1, {n + 1}) b(j) GROUP BY i, j)",
            f"g{k} AS (SELECT i, {n + 1} AS j, SUM(r * x[i]) - CASE WHEN i < {n} THEN {d(penalty)} * ANY_VALUE(beta[i]) ELSE 0e0 END AS v "
            f"FROM p{k}, n{k}, range(1, {n + 1}) a(i) GROUP BY i)",
            f"w{k} AS MATERIALIZED (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS row FROM "
            f"(SELECT * FROM h{k} UNION ALL SELECT * FROM g{k}) t GROUP BY i) u)",
            # Gauss-Jordan: row c is scaled, the others lose their part in column c
            f"e{k} AS (SELECT 1 AS c, m FROM w{k} UNION ALL SELECT c + 1, list_transform(m, lambda row, i: CASE WHEN i = c THEN "
            f"list_transform(row, lambda v: v / m[c][c]) ELSE list_transform(row, lambda v, j: v - row[c] * m[c][j] / m[c][c]) END) "
            f"FROM e{k} WHERE c <= {n})",
            f"n{k + 1} AS MATERIALIZED (SELECT list_transform(beta, lambda v, i: v + m[i][{n + 1}]) AS beta FROM n{k}, e{k} WHERE c = {n + 1})"]
    return [*out, f"beta AS MATERIALIZED (SELECT beta FROM n{steps})",
            f"newton AS (SELECT lead_id, converteu, split, list_inner_product({x}, beta) AS z FROM slots, beta)"]
