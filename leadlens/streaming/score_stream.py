"""Score leads as they arrive.

Scoring is stateless (features, then a native score expression, then the
class), so the batch functions run unchanged on micro-batches: no watermark
and no state store are needed.  Output goes to a file sink with a checkpoint
in the shared folder, which makes the query restartable after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.bands import band
from ..functions.common import sigmoid
from ..functions.features import add_features
from ..functions.scorecard import log_odds
from ..operators.select import validate
from ..session import scratch_path


def score_frame(df: DataFrame, score: Column | None = None, bands: str = "left") -> DataFrame:
    """Features -> score (default: the scorecard) -> class."""
    feat = add_features(df)
    s = score if score is not None else sigmoid(log_odds())
    return feat.withColumn("score", s).withColumn("classificacao", band("score", bands))


def lead_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(S.LEADS_SCHEMA).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def run_scoring_stream(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None,
                       columns: list[str] | None = None, score: Column | None = None,
                       available_now: bool = True):
    """Start the scoring stream; with ``available_now`` it processes what is
    there and stops.  Returns the StreamingQuery.  Rows are validated first: an
    invalid one keeps its ``reasons`` (a column to ask for) and gets neither score nor class."""
    cols = columns or [S.ID_COL, "score", "classificacao"]
    s = F.when(F.col("is_valid") == 1, score if score is not None else sigmoid(log_odds()))
    out = score_frame(validate(lead_stream(spark, source)), s).select(*cols)
    w = (out.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt")).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_new_lead_stream(spark: SparkSession, source: str, sink: str, terms: dict, means: dict,
                        checkpoint: str | None = None, fmt: str = "json", available_now: bool = True):
    """New lead payloads (nine fields, no id) arriving as files: validated,
    scored with left-closed classes and explained (top 3), written with their
    arrival file and a content-hash id.  Stateless, so no watermark."""
    from ..operators.scoring import score_leads
    payload = spark.readStream.schema(S.NEW_LEAD_SCHEMA).format(fmt).load(source)
    payload = payload.withColumn("source_file", F.col("_metadata.file_path"))
    # payload id: content hash of the fields and the arrival file
    payload = payload.withColumn("lead_id", F.xxhash64(*[F.col(f.name) for f in S.NEW_LEAD_SCHEMA.fields],
                                                       F.col("source_file")))
    out = score_leads(payload, terms, means).select(
        "source_file", "lead_id", "is_valid", "reasons", "score", "classificacao", "top_features")
    w = (out.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "new-lead-ckpt")).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
