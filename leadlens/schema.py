"""Explicit schemas, column roles and fixed domain values.

Nothing here is inferred from data: readers always pass these schemas.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Raw lead table (one row per lead)
# ---------------------------------------------------------------------------
LEADS_SCHEMA = T.StructType([
    T.StructField("lead_id", T.LongType(), False),
    T.StructField("nome_ficticio", T.StringType(), True),
    T.StructField("municipio", T.StringType(), True),
    T.StructField("canal_captacao", T.StringType(), True),
    T.StructField("curso_interesse", T.StringType(), True),
    T.StructField("faixa_etaria", T.StringType(), True),
    T.StructField("turno_preferencia", T.StringType(), True),
    T.StructField("dias_sem_contato", T.IntegerType(), True),
    T.StructField("n_tentativas", T.IntegerType(), True),
    T.StructField("respondeu_contato", T.IntegerType(), True),
    T.StructField("renda_estimada", T.DoubleType(), True),
    T.StructField("converteu", T.IntegerType(), True),
])

# Payload of a new lead to validate and score (no id, no label).
NEW_LEAD_SCHEMA = T.StructType([
    T.StructField("canal_captacao", T.StringType(), True),
    T.StructField("curso_interesse", T.StringType(), True),
    T.StructField("faixa_etaria", T.StringType(), True),
    T.StructField("turno_preferencia", T.StringType(), True),
    T.StructField("dias_sem_contato", T.IntegerType(), True),
    T.StructField("n_tentativas", T.IntegerType(), True),
    T.StructField("respondeu_contato", T.IntegerType(), True),
    T.StructField("renda_estimada", T.DoubleType(), True),
    T.StructField("nome_ficticio", T.StringType(), True),
])

ID_COL = "lead_id"
LABEL_COL = "converteu"
NAME_COL = "nome_ficticio"

# ---------------------------------------------------------------------------
# These must equal the source system's values for identical
# results (category spellings, model column roles, scorecard weights,
# derived-column names, band labels).
# ---------------------------------------------------------------------------
CHANNELS = ["Indicação", "Instagram", "Google Ads", "Facebook Ads", "Tráfego Orgânico",
            "Evento Presencial"]
COURSES = ["Inglês Básico", "Inglês Intermediário", "Inglês Adulto", "Inglês Teens", "Espanhol",
           "Francês"]
AGE_BANDS = ["18-24", "25-34", "35-44", "45-54", "55+"]
SHIFTS = ["Manhã", "Tarde", "Noite"]

CHANNEL_REFERRAL = "Indicação"
CHANNEL_EVENT = "Evento Presencial"
SHIFT_EVENING = "Noite"
COURSE_ADULT = "Inglês Adulto"

# Scorecard (label rule of the lead generator, deterministic part).
SCORECARD_INTERCEPT = -3.2
SCORECARD_CHANNEL = {"Indicação": 1.5, "Evento Presencial": 1.2, "Tráfego Orgânico": 0.5,
                     "Google Ads": 0.0, "Instagram": -0.5, "Facebook Ads": -0.8}
SCORECARD_RESPONDED = 0.7
SCORECARD_DAYS = 0.04
SCORECARD_ATTEMPTS_CURVE = -0.15
SCORECARD_ATTEMPTS_PEAK = 2
SCORECARD_ATTEMPTS_BONUS = 0.3
SCORECARD_COURSE = {"Inglês Adulto": 0.3, "Inglês Intermediário": 0.1, "Inglês Básico": 0.0,
                    "Inglês Teens": -0.1, "Espanhol": -0.1, "Francês": -0.2}

# Model input roles, in transform order (numeric -> categorical -> binary).
NUMERIC_COLS = ["dias_sem_contato", "n_tentativas", "renda_estimada", "score_engajamento",
                "urgencia_estimada"]
CATEGORICAL_COLS = ["canal_captacao", "curso_interesse", "faixa_etaria", "turno_preferencia"]
BINARY_COLS = ["respondeu_contato", "is_indicacao", "is_evento", "contato_rapido",
               "tentativas_ideal", "turno_noite", "curso_adulto"]
MODEL_INPUT_COLS = NUMERIC_COLS + CATEGORICAL_COLS + BINARY_COLS
DERIVED_COLS = ["score_engajamento", "is_indicacao", "is_evento", "urgencia_estimada",
                "contato_rapido", "tentativas_ideal", "turno_noite", "curso_adulto"]

# Score classes.
CLASS_LOW, CLASS_MID, CLASS_HIGH = "Baixo", "Médio", "Alto"
BAND_EDGES = (0.3, 0.6)

# Days-without-contact bands of the profile: (0,3],(3,7],(7,14],(14,30],(30,60].
DAYS_BAND_EDGES = [0, 3, 7, 14, 30, 60]
DAYS_BAND_LABELS = ["0-3d", "4-7d", "8-14d", "15-30d", "31-60d"]

# Filter value meaning "no filter" in the management view.
ALL_OPTION = "Todos"
DEFAULT_NAME = "Lead"


# Prefixes of the transformed slot names.
SLOT_NUMERIC = "numericas__"
SLOT_CATEGORICAL = "categoricas__"
SLOT_BINARY = "binarias__"

# raw inputs of the model, from which the other features are derived
RAW_INPUT_COLS = ("canal_captacao", "curso_interesse", "faixa_etaria", "turno_preferencia", "dias_sem_contato",
                  "n_tentativas", "respondeu_contato", "renda_estimada")


def numeric_and_categorical() -> tuple[list[str], list[str]]:
    """Schema accessor: (numeric columns, categorical columns) of the model input."""
    return list(NUMERIC_COLS), list(CATEGORICAL_COLS)
