"""Projections, filters, lookups and input validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.features import add_features


def prepare(df: DataFrame) -> tuple[DataFrame, str, list[str]]:
    """Model input: derived features added, the 16 model columns selected.

    Returns (X with lead_id kept as key when present, label column, feature names)."""
    feat = add_features(df)
    keep = [c for c in (S.ID_COL, S.LABEL_COL) if c in feat.columns]
    return feat.select(*keep, *S.MODEL_INPUT_COLS), S.LABEL_COL, list(S.MODEL_INPUT_COLS)


def drop_non_features(df: DataFrame) -> DataFrame:
    """Drop id / label / name / town / score columns if present (missing ones are ignored)."""
    return df.drop("converteu", "lead_id", "nome_ficticio", "municipio", "score", "classificacao")


def drop_nulls(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(subset=subset)


DISPLAY_LABELS = {"lead_id": "ID", "nome_ficticio": "Nome", "canal_captacao": "Canal",
                  "curso_interesse": "Curso", "dias_sem_contato": "Dias s/ Contato",
                  "n_tentativas": "Tentativas", "respondeu_contato": "Respondeu",
                  "score": "Score", "classificacao": "Classificação"}


def display_relabel(df: DataFrame) -> DataFrame:
    """The nine list columns under their display names."""
    return df.select(*[F.col(c).alias(lbl) for c, lbl in DISPLAY_LABELS.items()])


def default_name(df: DataFrame, col: str = S.NAME_COL) -> DataFrame:
    if col not in df.columns:
        return df.withColumn(col, F.lit(S.DEFAULT_NAME))
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(S.DEFAULT_NAME)))


def option_lists(df: DataFrame) -> DataFrame:
    """Distinct channel and course values (filter option lists) as (field, value)."""
    both = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))
                     for c in ("canal_captacao", "curso_interesse")])
    # one pass over the table: both fields unpivoted, then one distinct
    return (df.select(F.inline(both)).where(F.col("value").isNotNull()).distinct()
              .orderBy("field", "value"))


def lookup_ids(scored: DataFrame, requests: DataFrame, id_col: str = "lead_id") -> DataFrame:
    """Batch lookup: every requested id with a ``found`` flag and the lead's
    fields when it exists (a left join; the request side is deduplicated so a
    lead id matches at most one lead row: ids are unique in the lead table)."""
    req = requests.select(F.col(id_col).alias("lead_id")).distinct()
    hit = scored.withColumn("_hit", F.lit(1))
    return (req.join(hit, "lead_id", "left")
            .withColumn("found", F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit"))


def lookup_one(scored: DataFrame, lead_id: int) -> DataFrame:
    """First row with this id (empty frame = not found)."""
    return scored.filter(F.col("lead_id") == F.lit(lead_id)).limit(1)


# Validation rules of a lead payload: (reason, failing condition).
def validation_rules():
    req = ["canal_captacao", "curso_interesse", "dias_sem_contato", "n_tentativas", "respondeu_contato"]
    rules = [(f"missing_{c}", F.col(c).isNull()) for c in req]
    rules += [
        ("negative_dias_sem_contato", F.col("dias_sem_contato") < 0),
        ("negative_n_tentativas", F.col("n_tentativas") < 0),
        ("respondeu_contato_out_of_range", ~F.col("respondeu_contato").between(0, 1)),
    ]
    return rules


def validate(df: DataFrame) -> DataFrame:
    """Adds ``is_valid`` (0/1) and ``reasons`` (comma-joined rule names, '' when valid)."""
    rules = validation_rules()
    reasons = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in rules])
    return (df.withColumn("reasons", reasons)
              .withColumn("is_valid", F.when(F.col("reasons") == "", 1).otherwise(0)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = validate(df)
    return v.filter("is_valid = 1").drop("is_valid", "reasons"), v.filter("is_valid = 0")
