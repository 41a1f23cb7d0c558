"""The corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm import langid, line_dedup, packing, pii, simhash_dedup
from leadlens.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fills a missing language with the predicted one and drops the documents that have no determinable language.

    These are texts without a letter, and texts without a label that share no n-gram with any
    landmark.  A label counts as the language, and without any label to learn from none is missed."""
    out = langid.annotate(docs, langid.fit(docs), ground="ground")
    known = F.coalesce("lang", F.nullif("lang_pred", F.lit(langid.UNDETERMINED)))
    return out.where((F.col("ground") != langid.NO_LETTER) & (F.col("lang").isNotNull() | (F.col("ground") != langid.NO_KERNEL))) \
        .withColumn("lang", known).select(*COLUMNS)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many sites share out of all documents but their first; keeps every document.

    A document of such lines alone is a copy as a whole and stays for the next stage to decide."""
    out = line_dedup.remove_boilerplate(docs)
    return out.withColumn("n_chars", F.when(out.n_removed > 0, F.length("text").cast("long")).otherwise(out.n_chars)) \
        .select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash_dedup.one_of_each(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each piece of personal data; keeps every document."""
    out = pii.annotate(docs, pii.fit(docs))
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source",
                      F.when(out.spans != "", F.length("redacted").cast("long")).otherwise(out.n_chars).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left into training windows; a row for each piece."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("line dedup", boilerplate_lines), ("SimHash near-dedup", near_duplicates),
          ("PII", personal_data), ("packing", pack)]

# The stages hold fitted models and fingerprints, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
