"""The lead table as a deterministic view over orders, customer and nation.

One lead per order (k = o_orderkey, c = o_custkey).  Every column is integer
arithmetic on the keys except the income (1000 + |c_acctbal|) and the label,
which draws u in (0, 1) from the keys and converts when u < sigmoid(L + 1.5),
L being the scorecard log-odds.  The same definition is written in SQL in
``leadlens.plans.sql`` so an independent engine can rebuild identical rows.

Scale: orders is the fact table; customer joins nation first (nation is tiny
and broadcast by the planner's size check), then orders joins that result on
the customer key with a sort-merge join.  Adaptive skew-join splitting covers a
customer that owns a large share of all orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.common import sigmoid
from ..functions.scorecard import log_odds
from .tables import read_table

# Fixed values of the view: bucket cut-offs (cumulative, out of 20 or 100) that
# give the category shares of the lead generator.
CHANNEL_CUTS = [(3, "Indicação"), (8, "Instagram"), (12, "Google Ads"), (15, "Facebook Ads"),
                (18, "Tráfego Orgânico"), (20, "Evento Presencial")]
COURSE_CUTS = [(6, "Inglês Básico"), (10, "Inglês Intermediário"), (14, "Inglês Adulto"),
               (17, "Inglês Teens"), (19, "Espanhol"), (20, "Francês")]
AGE_CUTS = [(20, "18-24"), (55, "25-34"), (80, "35-44"), (93, "45-54"), (100, "55+")]
SHIFT_CUTS = [(5, "Manhã"), (11, "Tarde"), (20, "Noite")]


# every how many leads a column is null in the view with nulls
NULL_EVERY = {"canal_captacao": 83, "dias_sem_contato": 61, "n_tentativas": 71, "respondeu_contato": 53}


def _cuts(b: Column, cuts) -> Column:
    out = None
    for hi, label in cuts[:-1]:
        out = F.when(b < F.lit(hi), F.lit(label)) if out is None else out.when(b < F.lit(hi), F.lit(label))
    return out.otherwise(F.lit(cuts[-1][1]))


def base_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    cn = c.join(n, c.c_nationkey == n.n_nationkey)
    return o.join(cn, o.o_custkey == cn.c_custkey)


def leads_view(spark: SparkSession, sf_dir: str, dirty: bool = False, nulls: bool = False) -> DataFrame:
    """Lead table (schema ``LEADS_SCHEMA``).  ``dirty=True`` injects faults for the
    validation operator: days = -1 where k % 97 = 0, responded = 2 where
    k % 89 = 0, channel null where k % 83 = 0 (the label is drawn before).  ``nulls=True``
    takes values away: channel where k % 83 = 0, days where k % 61 = 0, attempts where
    k % 71 = 0, response where k % 53 = 0."""
    j = base_join(spark, sf_dir)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cols = {
        "lead_id": k + F.lit(1),
        "nome_ficticio": F.concat_ws(" ", F.col("c_name"), F.col("n_name")),
        "municipio": F.col("n_name"),
        "canal_captacao": _cuts((F.lit(7) * k + F.lit(13) * c) % 20, CHANNEL_CUTS),
        "curso_interesse": _cuts((F.lit(11) * k + F.lit(3) * c) % 20, COURSE_CUTS),
        "faixa_etaria": F.when(k % 10 == 7, F.lit(None).cast("string"))
                         .otherwise(_cuts((F.lit(17) * c + F.lit(5)) % 100, AGE_CUTS)),
        "turno_preferencia": F.when((k % 25).isin(4, 5), F.lit(None).cast("string"))
                              .otherwise(_cuts((F.lit(29) * c + k) % 20, SHIFT_CUTS)),
        "dias_sem_contato": ((F.floor(F.col("o_totalprice")) % 22)
                             + F.when(c % 25 == 0, F.lit(35)).otherwise(F.lit(0))).cast("int"),
        "n_tentativas": ((F.lit(5) * k + c) % 9).cast("int"),
        "respondeu_contato": F.when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(0)),
        "renda_estimada": F.when(k % 25 < 3, F.lit(None).cast("double"))
                           .otherwise(F.lit(1000.0) + F.abs(F.col("c_acctbal"))),
    }
    df = j.select(k.alias("_k"), c.alias("_c"), *[v.alias(n) for n, v in cols.items()])
    u = ((F.lit(7919) * F.col("_k") + F.lit(104729) * F.col("_c")) % 10007 + F.lit(0.5)) / F.lit(10007.0)
    df = df.withColumn("converteu", F.when(u < sigmoid(log_odds() + F.lit(1.5)), F.lit(1)).otherwise(F.lit(0)))
    if dirty:
        kk = F.col("_k")
        df = df.withColumns({
            "dias_sem_contato": F.when(kk % 97 == 0, F.lit(-1)).otherwise(F.col("dias_sem_contato")),
            "respondeu_contato": F.when(kk % 89 == 0, F.lit(2)).otherwise(F.col("respondeu_contato")),
            "canal_captacao": F.when(kk % 83 == 0, F.lit(None).cast("string")).otherwise(F.col("canal_captacao")),
        })
    if nulls:
        kk = F.col("_k")
        df = df.withColumns({c: F.when(kk % m != 0, F.col(c)) for c, m in NULL_EVERY.items()})
    return df.select(*[f.name for f in S.LEADS_SCHEMA.fields])


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """Register ``leads`` and ``scored_leads`` (scorecard score and class) as
    temporary views, so the lead table can also be queried with spark.sql."""
    from ..operators.scoring import scored_leads
    leads_view(spark, sf_dir).createOrReplaceTempView(f"{prefix}leads")
    scored_leads(spark, sf_dir).createOrReplaceTempView(f"{prefix}scored_leads")
    return [f"{prefix}leads", f"{prefix}scored_leads"]


def materialize_leads(spark: SparkSession, sf_dir: str, path: str, partitions: int | None = None) -> DataFrame:
    """Compute the lead view once (the orders/customer join) and store it as a
    Parquet table, range-partitioned on lead_id so id lookups and ranges touch
    few files; returns the table read back with the explicit schema.  Services
    and repeated analyses read this table instead of re-joining."""
    df = leads_view(spark, sf_dir)
    if partitions:
        df = df.repartitionByRange(partitions, "lead_id")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(S.LEADS_SCHEMA).parquet(path)
