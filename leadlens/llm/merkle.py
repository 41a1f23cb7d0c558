"""Merkle fingerprints of documents, in native expressions only.

Tree.  A paragraph is a line; its node is the SHA-256 of its text.  A section is a run of
paragraphs that ends where a paragraph's digest ends in 0 or 8 (one in eight), or with the text.
Boundaries therefore follow the content, and an inserted paragraph changes one section, not
all later ones.  A section's node is the SHA-256 of its paragraphs' digests, the root that
of its sections'.  Equal roots mean equal texts.  Where roots differ, the first differing
section leads to the first differing paragraph.

Below the paragraphs, leaves are sentences (pieces of one line between ``.!?``, of at most
160 characters), known by 8 hex digits.  The likeness of two trees is the Dice coefficient
of their different leaves, of their different paragraphs if neither has a leaf: 1 for equal texts,
0 with none in common.

The next document by id comes without a sort of the whole table: ids are cut into buckets
at approximate quantiles, one cut a bucket, so clumped ids spread as even ones; a bucket's rows meet in one window, and the first row of each bucket
is copied to the bucket before it.  So each text is shuffled once.  The copied rows' ids, one
a bucket, are all that is broadcast.

Defined cases: a null text counts as empty: one empty paragraph, no leaf.  Null ids come
first.  Rows of equal id are ordered by text, all of them in one bucket.  A single row follows itself.  An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.operators.common import attach_one_row
from leadlens.operators.ordered import count_below

LEAF_CHARS = 160
LEAF = rf"[^.!?\n]{{1,{LEAF_CHARS}}}"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` refers to it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def paragraphs(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))


def sections(par: Column) -> Column:
    """Sections as (first, digest): the index of the first paragraph, from 0, and the node."""
    ends = F.filter(F.sequence(F.lit(1), F.size(par)),
                    lambda i: (i == F.size(par)) | F.substring(F.element_at(par, i), 64, 1).isin("0", "8"))
    return _let(ends, lambda e: F.transform(
        F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)).alias("a"), e.alias("b")),
        lambda s: F.struct(s["a"].alias("first"), F.sha2(F.array_join(
            F.slice(par, s["a"] + 1, s["b"] - s["a"]), ""), 256).alias("digest"))))


def leaves(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), lambda x: F.substring(F.sha2(x, 256), 1, 8))


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>par``, ``<prefix>sec`` and ``<prefix>leaf`` for the (non-null) text."""
    return df.withColumn(f"{prefix}par", paragraphs(F.col(text))) \
        .withColumns({f"{prefix}sec": sections(F.col(f"{prefix}par")), f"{prefix}leaf": leaves(F.col(text))})


def root(sec: Column) -> Column:
    return F.sha2(F.array_join(sec["digest"], ""), 256)


def fingerprint(sec: Column, leaf: Column) -> Column:
    """Root, sections (16 digits each) and leaves as one string."""
    return F.concat_ws("/", root(sec), F.array_join(F.transform(sec, lambda s: F.substring(s["digest"], 1, 16)), ""),
                       F.array_join(leaf, ""))


def likeness(a: Column, b: Column, par_a: Column, par_b: Column) -> Column:
    """Dice coefficient of two trees' leaves, or of their paragraphs (there always is one) if neither has a leaf."""
    def dice(x: Column, y: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)))
    return F.when(F.size(a) + F.size(b) == 0, dice(par_a, par_b)).otherwise(dice(a, b))


def _first_difference(a: Column, b: Column) -> Column:
    def search(v: Column) -> Column:
        n = F.greatest(F.size(v["a"]), F.size(v["b"]))
        return F.get(F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.get(v["a"], i).eqNullSafe(F.get(v["b"], i))),
                     F.lit(0))
    return _let(F.struct(a.alias("a"), b.alias("b")), search)


def first_edit(par_a: Column, sec_a: Column, par_b: Column, sec_b: Column) -> Column:
    """Index of the first differing paragraph, from 0: found in the first section that differs."""
    skip = _let(_first_difference(sec_a["digest"], sec_b["digest"]),
                lambda at: F.coalesce(F.get(sec_a["first"], at), F.get(sec_b["first"], at)))
    return _let(skip, lambda s: F.when(s.isNull(), F.size(par_a)).otherwise(
        s + _first_difference(F.slice(par_a, s + 1, F.size(par_a)), F.slice(par_b, s + 1, F.size(par_b)))))


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` with ``_bucket``, which rises with ``_at``: one cut at each quantile, so that buckets hold about equal numbers
    of rows whatever the values.  Rows of one value share a bucket."""
    probs = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    cuts = docs.agg(F.expr(f"percentile_approx(_at, array({probs}), {max(10_000, 20 * buckets)})").alias("_cuts"))
    return attach_one_row(docs, cuts).withColumn("_bucket", count_below(F.col("_cuts"), F.col("_at"), buckets)).drop("_cuts")


def with_next(docs: DataFrame, columns: list[str], make=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``next_<c>`` for each of ``columns``: those of the next row by (key, text), after the last the first.

    ``make``, if given, adds columns after the shuffle and before the rows meet.
    """
    docs = docs.withColumn("_at", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
    docs = bucketed(docs, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    firsts = docs.groupBy("_bucket").agg(F.min("_at").alias("_at"))
    order = Window.orderBy("_bucket")
    copied = F.broadcast(firsts.select(  # one row a bucket, so of bounded size
        "_at", F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(Window.partitionBy())).alias("_before")))
    both = docs.join(copied, "_at", "left").select(
        *docs.columns, F.explode(F.when(F.col("_before").isNull(), F.array(F.lit(-1)))
                                 .otherwise(F.array(F.lit(-1), F.col("_before")))).alias("_to"))
    dealt = both.select(*[c for c in docs.columns if c != "_bucket"],
                        F.when(F.col("_to") >= 0, F.col("_to")).otherwise(F.col("_bucket")).alias("_bucket"),
                        (F.col("_to") >= 0).alias("_copy")).repartition("_bucket")
    if make:
        dealt = make(dealt)
    window = Window.partitionBy("_bucket").orderBy("_copy", "_at", text)
    led = dealt.withColumn("_next", F.lead(F.struct(*columns)).over(window)).where("not _copy")
    return led.select("*", *[F.col("_next")[c].alias(f"next_{c}") for c in columns]) \
        .drop("_next", "_at", "_bucket", "_copy")


def compare_with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the second half taken from the next document's start."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    led = with_next(rows, ["text", "par", "leaf"], lambda d: with_tree(d, "text", ""), key)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = led.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                                               F.substring(F.col("next_text"), F.lit(1), half)))
    both = with_tree(edited, "edited", "e_")
    return both.select(
        key, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sec"), F.col("leaf")).alias("fingerprint"),
        fingerprint(F.col("e_sec"), F.col("e_leaf")).alias("edited_fingerprint"),
        likeness(F.col("leaf"), F.col("e_leaf"), F.col("par"), F.col("e_par")).alias("near_edited"),
        likeness(F.col("leaf"), F.col("next_leaf"), F.col("par"), F.col("next_par")).alias("near_next"),
        first_edit(F.col("par"), F.col("sec"), F.col("e_par"), F.col("e_sec")).cast("long").alias("edit_paragraph"))


_TREE = """
  list_transform(string_split({t}, chr(10)), lambda p: sha256(p)) AS {p}par,
  list_transform(regexp_extract_all({t}, '[^.!?\\n]{{1,160}}'), lambda x: substr(sha256(x), 1, 8)) AS {p}leaf"""

_SECTIONS = """
  list_filter(range(1, len({p}par) + 1), lambda i: i = len({p}par) OR {p}par[i][64] IN ('0', '8')) AS {p}ends"""

_DIGESTS = """
  list_transform({p}ends, lambda e, j: sha256(array_to_string(
    {p}par[(CASE WHEN j = 1 THEN 0 ELSE {p}ends[j - 1] END) + 1 : e], ''))) AS {p}sec"""

_PRINT = """concat_ws('/', sha256(array_to_string({p}sec, '')),
  array_to_string(list_transform({p}sec, lambda s: substr(s, 1, 16)), ''), array_to_string({p}leaf, ''))"""

_DICE = """2.0::DOUBLE * len(list_intersect(list_distinct({a}), list_distinct({b})))
       / (len(list_distinct({a})) + len(list_distinct({b})))"""

_LIKE = "CASE WHEN len({a}leaf) + len({b}leaf) = 0 THEN " + _DICE.format(a="{a}par", b="{b}par") + " ELSE " + \
    _DICE.format(a="{a}leaf", b="{b}leaf") + " END"

#: DuckDB twin of ``compare_with_edited`` over a table ``documents`` with different ids.
SQL = f"""
WITH led AS (
  SELECT doc_id, coalesce(text, '') AS t,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nt
  FROM documents),
edited AS (
  SELECT doc_id, t, nt, concat(substr(t, 1, length(t) - length(t) // 2), substr(nt, 1, length(t) // 2)) AS e FROM led),
trees AS (
  SELECT doc_id, t, e, {_TREE.format(t='t', p='a_')}, {_TREE.format(t='e', p='e_')}, {_TREE.format(t='nt', p='n_')} FROM edited),
ended AS (SELECT *, {_SECTIONS.format(p='a_')}, {_SECTIONS.format(p='e_')} FROM trees),
hashed AS (SELECT *, {_DIGESTS.format(p='a_')}, {_DIGESTS.format(p='e_')} FROM ended)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(e) AS edited_sha256,
       {_PRINT.format(p='a_')} AS fingerprint, {_PRINT.format(p='e_')} AS edited_fingerprint,
       {_LIKE.format(a='a_', b='e_')} AS near_edited, {_LIKE.format(a='a_', b='n_')} AS near_next,
       CAST(list_filter(range(0, greatest(len(a_par), len(e_par)) + 1),
         lambda i: i = greatest(len(a_par), len(e_par)) OR a_par[i + 1] IS DISTINCT FROM e_par[i + 1])[1] AS BIGINT) AS edit_paragraph
FROM hashed
"""
