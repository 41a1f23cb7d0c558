"""Lead payloads as lines of JSON, read so that a broken one can be told from an empty one.

Each line keeps its raw text.  Fields with an unexpected name are rescued as JSON, a field
whose value has the wrong type is unknown and named in the errors, and a line that is no JSON
object has no fields at all.  ``checked`` adds the rules of a lead; ``divided`` parts the lines
into payloads to score and rejects with their reasons, so no line is lost.  The same
functions serve a stream (``run_payload_stream``).

Defined cases: a null or blank line is ``empty``; JSON that is no object, or cut short, is
``malformed``; a field given as JSON null is a missing value, not a wrong type; of a field given twice
the parser's choice holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.select import validation_rules
from ..session import scratch_path

FIELDS = [f.name for f in S.NEW_LEAD_SCHEMA.fields]


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` without ``value``, with the payload's fields, ``raw``, ``rescued`` and ``parse_errors``.

    Columns of ``lines`` named like these are replaced."""
    new = {*FIELDS, "raw", "rescued", "parse_errors", value}
    kept = [c for c in lines.columns if c not in new]
    text = F.col(value)
    each = lines.select(*kept, text.alias("raw"), F.from_json(text, "map<string,string>").alias("_all"),
                        F.from_json(text, S.NEW_LEAD_SCHEMA).alias("_typed"))
    entries, typed = F.col("_all"), F.col("_typed")
    blank = F.coalesce(F.trim("raw"), F.lit("")) == ""
    broken = entries.isNull()
    wrong = [F.when(~broken & entries[c].isNotNull() & typed[c].isNull(), F.lit(f"bad_type_{c}")) for c in FIELDS]
    other = F.map_filter(entries, lambda k, _: ~k.isin(FIELDS))
    errors = F.array_compact(F.array(F.when(blank, "empty").when(broken, "malformed"), *wrong))
    one = F.struct(*[F.when(~broken, typed[c]).alias(c) for c in FIELDS], "raw",
                   F.when(F.size(other) > 0, F.to_json(other)).alias("rescued"), errors.alias("parse_errors"))
    return each.select(*kept, F.inline(F.array(one)))   # a filter on the result is not pushed below the parsing


def reasons() -> Column:
    """Parse errors, then the rules of a lead; a line without fields has its parse error alone."""
    rules = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in validation_rules()])
    whole = F.array_contains("parse_errors", "empty") | F.array_contains("parse_errors", "malformed")
    return F.concat_ws(",", F.nullif(F.array_join("parse_errors", ","), F.lit("")), F.when(~whole, F.nullif(rules, F.lit(""))))


def checked(lines: DataFrame, value: str = "value") -> DataFrame:
    """``parsed`` with ``reasons`` ('' if there are none) and ``is_valid``."""
    return parsed(lines, value).withColumn("reasons", reasons()) \
        .withColumn("is_valid", F.when(F.col("reasons") == "", 1).otherwise(0))


def divided(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(payloads to score, rejects with ``raw`` and ``reasons``)."""
    both = checked(lines, value)
    kept = [c for c in both.columns if c not in (*FIELDS, "rescued", "parse_errors", "is_valid", "reasons", "raw")]
    return both.where("is_valid = 1"), both.where("is_valid = 0").select(*kept, "raw", "reasons")


def read_payload_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files under ``path`` with the file they came from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))


def run_payload_stream(spark: SparkSession, source: str, accepted: str, rejected: str, terms: dict, means: dict,
                       checkpoint: str | None = None, available_now: bool = True):
    """Payload files as they arrive: scored and explained payloads to ``accepted``, the rest to ``rejected``.

    A batch writes a folder of its own in each sink and replaces it when it is run again after a
    failure, so no line is written twice."""
    from ..operators.scoring import score_leads
    lines = spark.readStream.text(source).select("value", F.col("_metadata.file_path").alias("source_file"))

    def write(batch: DataFrame, number: int) -> None:
        good, bad = divided(batch)
        scored = score_leads(good, terms, means).select("source_file", "raw", "rescued", "score", "classificacao", "top_features")
        scored.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    w = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or scratch_path(spark, "payload-ckpt"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
