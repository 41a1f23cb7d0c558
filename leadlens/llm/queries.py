"""Registered queries of the operators of this subpackage.

Each one applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm import (ann_forest, fill_in_middle, hilbert_shards, langid, line_dedup, merkle, packing,
                          periodic_runs, pii, secret_scan, sentencepiece_fst, simhash_dedup, token_counts)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = langid.annotate(docs, langid.fit(docs), keep=["doc_id"])
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return pii.annotate(docs, pii.fit(docs), keep=["doc_id"]).drop("redacted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text before and after three edits, with the characters that had to be cut anew."""
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trees = token_counts.with_trees(docs).withColumn("n_tokens_before", F.col("n_tokens")) \
        .withColumn("edits", token_counts.sample_edits(F.col("text")))
    return token_counts.apply_edits(trees).select(
        "doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"),
        F.length("text").cast("long").alias("n_chars_edited"), "recut_chars")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(_documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    both = sentencepiece_fst.decode(sentencepiece_fst.encode(docs, keep=["doc_id", "text"]))
    return both.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"),
                       F.col("decoded").eqNullSafe(F.translate("text", sentencepiece_fst.MARK, " ")).alias("round_trip"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_edited(_documents(spark, sf_dir))


def op9_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards.assign(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def looped_tail(row: dict, words: list[str]) -> list[str]:
    """The words of every tenth document with a periodic tail, as the contract of op11 asks."""
    h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
    if row["doc_id"] is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of every document's words, every tenth document with a loop put in."""
    out = periodic_runs.find_runs(_documents(spark, sf_dir), keep=["doc_id"], prepare=looped_tail, reads=("doc_id",))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                      F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256")) \
        .select("doc_id", "n_runs", (-F.col("best.before")).alias("start"), "best.length",
                (-F.col("best.shorter")).alias("period"),
                F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = secret_scan.annotate(docs, secret_scan.fit(docs), keep=["doc_id"])

    def number(kind: str):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(findings):
        return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("findings", lambda s: s["kind"].isin(*secret_scan.BASE))
    return out.select("doc_id", *[number(k) for k in secret_scan.BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                      joined(F.col("findings")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.restore(fill_in_middle.fill_in_middle(_documents(spark, sf_dir), keep=["doc_id"]))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_merkle": op8_merkle,
    "op9_ann_forest": op9_ann_forest,
    "op10_hilbert": op10_hilbert,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secret_scan": op12_secret_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": line_dedup.SQL,
    "op8_merkle": merkle.SQL,
}
