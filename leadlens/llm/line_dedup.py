"""Cross-site boilerplate lines by distinct-site spread.

Each different line (text between newlines; empty lines take no part) gets a HyperLogLog
sketch of the sites it appears on.  Sketches merge map-side and after the shuffle, so a
line on every page costs one sketch a task.  An estimate outside the band ``1 -/+ BAND`` around
``min_sites`` decides at once (the band is six standard errors wide on either side); lines
inside it get an exact distinct count.  A line spread over ``min_sites`` sites or more is
boilerplate: it goes from every document but its first (the smallest ``doc_id``).

A document of which no line would stay but empty ones stays as it is: it is a copy as a whole,
which is for document-level duplicate removal to decide, not for line removal.

Lines are known by two 64-bit hashes, documents by a hash of id and text, so that repeated
rows are treated alike.

Defined cases: null text stays null with no lines; an empty text has one empty line, which
stays; a null site counts for no site; a line whose documents all have null ids keeps all
those; an empty table gives no rows.  Input columns named ``n_lines`` or ``n_removed`` are replaced, all
others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.arrow_map import without
from leadlens.llm.tables import fresh, let, written

LG_K = 12     # 4096 registers: a standard error of 1.6 %
BAND = 0.1


def _row_keys(doc: str, text: str, a: str, b: str) -> list[Column]:
    return [F.xxhash64(doc, text).alias(a), F.xxhash64(F.lit(7), doc, text).alias(b)]


def _lines(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    # what belongs to the document is computed before its lines are, not again for each of them
    rows = docs.select(*columns, F.col(text).alias("whole"))
    split = rows.select(*[c for c in rows.columns if c != "whole"],
                        F.posexplode(F.split("whole", "\n", -1)).alias("pos", "line")).where("line <> ''")
    return split.select(*[c for c in split.columns if c != "line"], F.xxhash64("line").alias("line_a"),
                        F.xxhash64(F.lit(7), "line").alias("line_b"), F.length("line").alias("n"))


def spread_lines(docs: DataFrame, min_sites: int, text: str = "text", site: str = "source",
                 key: str = "doc_id") -> DataFrame:
    """Boilerplate lines: ``line_a``, ``line_b`` and ``first_id``, their first document."""
    lines = _lines(docs, text, F.col(key).alias("id"), F.col(site).alias("site"))
    sketches = lines.groupBy("line_a", "line_b").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min("id").alias("first_id"))
    open_ = written(sketches.where(F.col("sites") >= min_sites * (1 - BAND)), "line-sketches")
    sure = open_.where(F.col("sites") > min_sites * (1 + BAND))
    near = open_.where(F.col("sites") <= min_sites * (1 + BAND))
    exact = lines.join(near.select("line_a", "line_b"), ["line_a", "line_b"], "left_semi") \
        .select("line_a", "line_b", "site").distinct().groupBy("line_a", "line_b").agg(F.count("site").alias("exact")) \
        .where(F.col("exact") >= min_sites)
    # written, so that the rows of a frequent line can be split where lines meet this table
    return written(sure.select("line_a", "line_b", "first_id").unionByName(
        near.join(exact, ["line_a", "line_b"]).select("line_a", "line_b", "first_id")), "boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, text: str = "text", site: str = "source",
                       key: str = "doc_id") -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and the columns ``n_lines`` and ``n_removed``."""
    docs = without(docs, ["n_lines", "n_removed"])
    row_a, row_b, removed = fresh(docs, "row_a", "row_b", "removed")
    boiler = spread_lines(docs, min_sites, text, site, key)
    own = F.length(F.translate(text, "\n", ""))   # of all lines but the empty ones
    lines = _lines(docs, text, F.col(key).alias("id"), own.alias("size"), *_row_keys(key, text, "row_a", "row_b"))
    gone = lines.join(boiler, ["line_a", "line_b"]).where(~F.col("id").eqNullSafe(F.col("first_id"))) \
        .groupBy("row_a", "row_b", "pos").agg(F.first("n").alias("n"), F.first("size").alias("size")) \
        .groupBy("row_a", "row_b").agg(F.collect_list("pos").alias(removed), F.sum("n").alias("lost"),
                                       F.first("size").alias("size")) \
        .where("lost < size").select(F.col("row_a").alias(row_a), F.col("row_b").alias(row_b), removed)
    marked = docs.select("*", *_row_keys(key, text, row_a, row_b)).join(gone, [row_a, row_b], "left")
    # the text is split once a row: each line kept is then looked up in the same array
    kept = let(F.split(text, "\n", -1), lambda parts: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(1), F.size(parts)), F.transform(removed, lambda i: i + 1)),
        lambda i: F.element_at(parts, i)), "\n"))
    cleaned = F.when(F.col(removed).isNull(), F.col(text)).otherwise(kept)
    return marked.select(*[cleaned.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns],
                         F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).alias("n_lines"),
                         F.coalesce(F.size(removed), F.lit(0)).alias("n_removed"))


#: DuckDB twin over a table ``documents`` for ``remove_boilerplate(...)`` as doc_id, text, n_lines, n_removed.
SQL = """
WITH lines AS (
  SELECT d.doc_id, d.source, d.text, t.line, t.pos
  FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line,
                                    generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) t),
boiler AS (
  SELECT line, min(doc_id) AS first_id FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (
  SELECT l.*, b.line IS NOT NULL AND l.doc_id IS DISTINCT FROM b.first_id AS gone
  FROM lines l LEFT JOIN boiler b ON l.line = b.line),
sized AS (
  SELECT *, sum(CASE WHEN gone THEN length(line) ELSE 0 END) OVER (PARTITION BY doc_id)
            < sum(length(line)) OVER (PARTITION BY doc_id) AS apply
  FROM marked)
SELECT doc_id,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (gone AND apply)), '') AS text,
       CAST(count(*) AS INTEGER) AS n_lines,
       CAST(sum(CASE WHEN gone AND apply THEN 1 ELSE 0 END) AS INTEGER) AS n_removed
FROM sized GROUP BY doc_id
"""
