"""Outreach messages for many leads at once (set-based, no per-lead calls).

The message source is the rule-based text; an external text-generation
service is out of scope, so ``fonte`` is always 'fallback' here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from . import explain as H
from .select import lookup_ids


def message_context(df: DataFrame, top_col: str = "top_features") -> Column:
    """The six lead fields and the top explanation entries, as one struct."""
    return F.struct(F.col("nome_ficticio"), F.col("curso_interesse"), F.col("canal_captacao"),
                    F.col("dias_sem_contato").cast("int").alias("dias_sem_contato"),
                    F.col("n_tentativas").cast("int").alias("n_tentativas"),
                    F.col("score").cast("double").alias("score"), F.col(top_col).alias("shap_top_features"))


def with_explanations(scored: DataFrame, terms: dict, means: dict, k: int = 3) -> DataFrame:
    """Scored leads with ``top_features`` (top-k attribution entries) and
    ``shap_text`` attached."""
    out = scored.withColumn("top_features", H.top_features_column(terms, means, k))
    return out.withColumn("shap_text", TX.explanation_text("top_features", k))


def add_messages(df: DataFrame) -> DataFrame:
    """``prompt`` (filled template), ``script`` (rule-based text) and ``fonte``."""
    return df.withColumns({"prompt": TX.prompt(), "script": TX.fallback_script(),
                           "fonte": F.lit(TX.SOURCE_FALLBACK)})


def script_table(scored_explained: DataFrame, requests: DataFrame, score_digits: int | None = 4) -> DataFrame:
    """Script for every requested id: lead_id, found, nome, score, script,
    fonte (unknown ids keep found = 0 and null fields)."""
    hit = lookup_ids(scored_explained, requests)
    s = F.col("score") if score_digits is None else F.round("score", score_digits)
    return hit.select("lead_id", "found", F.col("nome_ficticio").alias("nome"), s.alias("score"),
                      F.when(F.col("found") == 1, TX.fallback_script()).alias("script"),
                      F.when(F.col("found") == 1, F.lit(TX.SOURCE_FALLBACK)).alias("fonte"))
