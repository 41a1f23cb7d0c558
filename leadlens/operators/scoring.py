"""Scoring, ranking and listing of leads.

The scored table is computed once per job (native expressions, no UDF) and
is the input of the list, lookup, management and message operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.bands import band
from ..functions.features import add_features
from ..functions.scorecard import log_odds, safe_terms
from ..functions.common import sigmoid
from ..sources.leads import leads_view

LIST_COLS = ["lead_id", "nome_ficticio", "canal_captacao", "curso_interesse", "dias_sem_contato",
             "n_tentativas", "respondeu_contato", "score", "classificacao"]


def score_with_scorecard(df: DataFrame, score_col: str = "score", bands: str = "right") -> DataFrame:
    """Add the scorecard probability and its class (needs the raw lead columns)."""
    out = df.withColumn("log_odds", log_odds())
    out = out.withColumn(score_col, sigmoid(F.col("log_odds")))
    return out.withColumn("classificacao", band(score_col, bands))


def scored_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leads -> derived features -> scorecard score -> right-closed class."""
    return score_with_scorecard(add_features(leads_view(spark, sf_dir)))


def default_score(df: DataFrame, value: float = 0.5, label: str = S.CLASS_MID) -> DataFrame:
    """Explicit degraded scoring: every lead gets the same score and class.

    Only used when the caller asks for it; scoring errors are never swallowed."""
    return df.withColumns({"score": F.lit(float(value)), "classificacao": F.lit(label)})


def score_or_default(df: DataFrame, value: float = 0.5, label: str = S.CLASS_MID,
                     observation: Observation | None = None) -> DataFrame:
    """Scorecard score row by row: a row that cannot be scored falls back alone.

    ``status`` is ``rejected`` (a value outside its domain: no score), ``degraded`` (an input is
    missing, or its term fails: the default score and class, with the reasons in ``error``) or
    ``scored``.  ``observation`` gets the numbers of each status in the same pass."""
    from .select import validation_rules
    outside = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in validation_rules() if not name.startswith("missing_")])
    terms = safe_terms()
    failed = F.concat_ws(",", *[F.when(t.isNull(), F.when(F.col(c).isNull(), F.lit(f"missing_{c}")).otherwise(F.lit(f"failed_{c}")))
                                for c, t in terms.items()])
    z = ((((F.lit(S.SCORECARD_INTERCEPT) + terms["canal_captacao"]) + terms["respondeu_contato"])
          + terms["dias_sem_contato"]) + terms["n_tentativas"]) + terms["curso_interesse"]
    known = df.withColumns({"_outside": outside, "_failed": failed, "_z": z})
    status = F.when(F.col("_outside") != "", "rejected").when(F.col("_failed") != "", "degraded").otherwise("scored")
    out = known.withColumn("status", status).withColumns({
        "error": F.when(F.col("status") == "rejected", F.col("_outside")).when(F.col("status") == "degraded", F.col("_failed")),
        "score": F.when(F.col("status") == "scored", sigmoid(F.col("_z"))).when(F.col("status") == "degraded", F.lit(float(value)))})
    out = out.withColumn("classificacao", F.when(F.col("status") == "degraded", F.lit(label)).otherwise(band("score", "right"))) \
        .drop("_outside", "_failed", "_z")
    if observation is None:
        return out
    return out.observe(observation, *[F.count_if(F.col("status") == s).alias(s) for s in ("scored", "degraded", "rejected")])


def _is_set(v) -> bool:
    return v is not None and v != "" and v != S.ALL_OPTION


def filter_leads(df: DataFrame, canal: str | None = None, curso: str | None = None,
                 score_min: float = 0.0, score_max: float = 1.0) -> DataFrame:
    """Optional equality filters (None, '' or 'Todos' mean no filter) and an
    inclusive score range.  The whole range 0..1 is no filter either: leads without a
    score stay, and the list shows them last."""
    if _is_set(canal):
        df = df.filter(F.col("canal_captacao") == F.lit(canal))
    if _is_set(curso):
        df = df.filter(F.col("curso_interesse") == F.lit(curso))
    if score_min <= 0 and score_max >= 1:
        return df
    return df.filter(F.col("score").between(F.lit(float(score_min)), F.lit(float(score_max))))


def list_leads(scored: DataFrame, canal: str | None = None, curso: str | None = None,
               score_min: float = 0.0, score_max: float = 1.0, score_digits: int | None = 4,
               limit: int | None = None) -> DataFrame:
    """Filtered lead list ordered by score (desc), ties by lead_id; typed record
    of nine fields.  ``limit`` turns the full sort into a top-k."""
    out = filter_leads(scored, canal, curso, score_min, score_max)
    s = F.col("score") if score_digits is None else F.round("score", score_digits)
    out = out.orderBy(F.desc("score"), F.asc("lead_id"))
    if limit:
        out = out.limit(limit)
    return out.select(
        F.col("lead_id").cast("long").alias("lead_id"),
        F.col("nome_ficticio").cast("string").alias("nome_ficticio"),
        F.col("canal_captacao").cast("string").alias("canal_captacao"),
        F.col("curso_interesse").cast("string").alias("curso_interesse"),
        F.col("dias_sem_contato").cast("int").alias("dias_sem_contato"),
        F.col("n_tentativas").cast("int").alias("n_tentativas"),
        F.col("respondeu_contato").cast("int").alias("respondeu_contato"),
        s.alias("score"),
        F.col("classificacao"),
    )


def score_leads(new: DataFrame, terms: dict, means: dict, score=None, k: int = 3,
                score_digits: int | None = 4) -> DataFrame:
    """Score new lead payloads set-based: validation (``is_valid``,
    ``reasons``), derived features, score (scorecard by default, or any
    native score column), left-closed class and the top-k explanation
    entries (null when ``terms`` is empty).  Invalid rows keep their reasons
    and get no score."""
    from . import explain as H
    from .select import default_name, validate
    v = validate(default_name(new))
    feat = add_features(v)
    s = score if score is not None else sigmoid(log_odds())
    ok = F.col("is_valid") == 1
    out = feat.withColumn("score", F.when(ok, s))
    out = out.withColumn("classificacao", F.when(ok, band("score", "left")))
    if terms:
        out = out.withColumn("top_features", F.when(ok, H.top_features_column(terms, means, k)))
    else:  # no additive terms (non-linear model): explanations come from permutation_attribution
        out = out.withColumn("top_features", F.lit(None).cast("array<struct<feature:string,impact:double>>"))
    if score_digits is not None:
        out = out.withColumn("score", F.round("score", score_digits))
    return out


def list_leads_explained(scored_explained: DataFrame, **kw) -> DataFrame:
    """The ranked list with the top explanation entries of each lead (the
    ``top_features`` column of the explained table) kept on every row."""
    out = filter_leads(scored_explained, kw.get("canal"), kw.get("curso"), kw.get("score_min", 0.0),
                       kw.get("score_max", 1.0))
    digits = kw.get("score_digits", 4)
    s = F.col("score") if digits is None else F.round("score", digits)
    out = out.orderBy(F.desc("score"), F.asc("lead_id"))
    if kw.get("limit"):
        out = out.limit(kw["limit"])
    return out.select(*[c for c in LIST_COLS if c != "score"], s.alias("score"), "top_features") \
              .select(*LIST_COLS, "top_features")
