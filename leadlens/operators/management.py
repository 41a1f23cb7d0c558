"""Management view over a scored lead table: KPIs, group means, class mix,
focus impact, best channel / course, selector labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import cut_lineage
from .common import attach_one_row


def kpis(scored: DataFrame) -> DataFrame:
    """total, mean score, high-class count, high share in % (0 when empty)."""
    hi = F.col("classificacao") == S.CLASS_HIGH
    one = scored.agg(F.count(F.lit(1)).alias("total_leads"), F.avg("score").alias("media_score"),
                     F.count_if(hi).alias("leads_alto"))
    return one.withColumn("pct_alto", F.when(F.col("total_leads") > 0,
                                             F.col("leads_alto") / F.col("total_leads") * 100).otherwise(F.lit(0.0)))


def score_histogram(scored: DataFrame, width: float = 0.05) -> DataFrame:
    """Counts per fixed-width score bin (bin = floor(score / width); a score
    of exactly 1 joins the last bin)."""
    nbins = int(round(1 / width))
    b = F.least(F.floor(F.col("score") / F.lit(width)).cast("int"), F.lit(nbins - 1))
    return (scored.where(F.col("score").isNotNull()).groupBy(b.alias("bin"))
                  .agg(F.count(F.lit(1)).alias("count"))
                  .select("bin", (F.col("bin") * width).alias("bin_lo"), "count"))


def mean_score_by(scored: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Mean score and count per key, ordered by the mean; a null key is no group."""
    out = scored.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg("score").alias("score_medio"), F.count("score").alias("quantidade"))
    return out.orderBy(F.col("score_medio").asc() if ascending else F.col("score_medio").desc(), key)


def class_counts(scored: DataFrame) -> DataFrame:
    """Leads per class and share of all classified leads (unclassified dropped)."""
    c = cut_lineage(scored.where(F.col("classificacao").isNotNull()).groupBy("classificacao")
                    .agg(F.count(F.lit(1)).alias("count")))            # one row per class
    tot = c.agg(F.sum("count").alias("_tot"))
    return attach_one_row(c, tot).select("classificacao", "count", (F.col("count") / F.col("_tot")).alias("share"))


def focus_impact(scored: DataFrame) -> DataFrame:
    """Leads in focus (high class), their share, effort saved (100 - share)
    and their mean score (null when there is none)."""
    hi = F.col("classificacao") == S.CLASS_HIGH
    one = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(hi).alias("leads_foco"),
                     F.avg(F.when(hi, F.col("score"))).alias("score_medio_foco"))
    pct = F.when(F.col("n") > 0, F.col("leads_foco") / F.col("n") * 100).otherwise(F.lit(0.0))
    return one.select("leads_foco", pct.alias("pct_foco"), (F.lit(100.0) - pct).alias("esforco_poupado"),
                      "score_medio_foco")


def best_by(scored: DataFrame, key: str) -> DataFrame:
    """The key value with the highest mean score (ties: first label); null is no key."""
    m = scored.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg("score").alias("score_medio"))
    return m.orderBy(F.desc("score_medio"), F.asc(key)).limit(1)


def response_rate(scored: DataFrame) -> DataFrame:
    """Share of all leads that responded, in %: an unknown response counts as none.  Null on an empty table."""
    one = scored.agg(F.coalesce(F.sum("respondeu_contato"), F.lit(0)).alias("s"), F.count("*").alias("n"))
    return one.select(F.when(F.col("n") > 0, F.col("s") / F.col("n") * 100).alias("pct_resposta"))


def percent_text(x, digits: int = 1):
    """Display percent of a fraction, e.g. 0.1234 -> '12.3%' (half-even on the
    binary value, no grouping separators)."""
    return F.concat(F.regexp_replace(F.format_number(x * 100, digits), ",", ""), F.lit("%"))


def yes_no(x):
    return F.when(x == 1, F.lit("✅")).otherwise(F.lit("❌"))


def display_table(scored: DataFrame) -> DataFrame:
    """List columns under display names, score as percent text, yes/no mark."""
    from .select import DISPLAY_LABELS
    cols = []
    for c, lbl in DISPLAY_LABELS.items():
        v = F.col(c)
        if c == "score":
            v = percent_text(v, 1)
        elif c == "respondeu_contato":
            v = yes_no(v)
        cols.append(v.alias(lbl))
    return scored.orderBy(F.desc("score"), F.asc("lead_id")).select(*cols)


def selector_label(name="nome_ficticio", score="score", cls="classificacao"):
    """'<name> — Score: <whole percent>% (<class>)'."""
    pct = F.regexp_replace(F.format_number(F.col(score) * 100, 0), ",", "")
    return F.concat(F.col(name), F.lit(" — Score: "), pct, F.lit("% ("), F.coalesce(F.col(cls), F.lit("nan")), F.lit(")"))


def selector_options(scored: DataFrame) -> DataFrame:
    """Label -> lead id.  Leads are taken in descending score order and a
    repeated label keeps the last one: the lowest score, then the highest
    id.  min_by aggregates partially, so a label shared by many leads is
    never gathered in one place."""
    lab = scored.withColumn("label", selector_label())
    order_key = F.struct(F.col("score"), (-F.col("lead_id")).alias("neg_id"))
    return lab.groupBy("label").agg(F.min_by("lead_id", order_key).alias("lead_id"))
