import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from leadlens.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=4, app_name="leadlens-tests",
                    extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def new_leads(spark):
    """Hand-written payloads covering the validation and feature boundaries."""
    from leadlens import schema as S
    rows = [
        # canal, curso, faixa, turno, dias, tentativas, respondeu, renda, nome
        ("Indicação", "Inglês Adulto", "25-34", "Noite", 0, 0, 1, 3500.0, "Ana Maria Souza"),
        ("Instagram", "Espanhol", None, None, 2, 1, 0, None, None),
        ("Google Ads", "Francês", "55+", "Manhã", 3, 3, 1, 1200.0, ""),
        ("Facebook Ads", "Inglês Teens", "18-24", "Tarde", 60, 4, 0, 8000.0, "  João  Silva"),
        ("Evento Presencial", "Inglês Básico", "35-44", "Noite", 61, 5, 1, 2500.0, "Bia"),
        ("Canal Novo", "Curso Novo", "45-54", "Noite", 10, 9, 0, 4000.0, "Caio"),
        ("Tráfego Orgânico", "Inglês Intermediário", "25-34", "Manhã", -1, 2, 1, 3000.0, "Duda"),
        ("Instagram", "Espanhol", "25-34", "Manhã", 5, 2, 2, 3000.0, "Eva"),
        (None, "Espanhol", "25-34", "Manhã", 5, 2, 1, 3000.0, "Fábio"),
    ]
    df = spark.createDataFrame(rows, S.NEW_LEAD_SCHEMA)
    return df
