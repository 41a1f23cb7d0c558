"""A scored lead list and its cards, kept current while leads and corrections arrive.

Events are lead rows with an ``event_time``.  A lead's newest event counts (equal times: the
larger content hash, so the order of arrival never matters), also when it arrives late.  The
stream drops repeats by keyed state whose watermark follows the arrival time: the state holds
one arrival window, and no correction is ever too late to be taken.  Repeats from before the
window are harmless, since the list compares versions.

Every micro-batch is one versioned step in the shared folder:

``log/batch=B``              the batch itself with its verdict; faulty rows stay here
``data/batch=B/bucket=K``    the id ranges that the batch touched, written anew
``cards/batch=B``            sums by channel, course, class and score bin
``commits/batch=B``          for each id range the batch that holds it; written last

A reader takes the newest commit, so it sees a batch whole or not at all.  A batch that is run
again after a failure overwrites its own uncommitted folders, or is passed over if committed.
Cards change by retraction: a replaced lead's old contribution is taken off and its new one
added, in decimals, so the sums stay exact and no other lead is read for them.  An id range
holds at most ``width`` leads, which bounds every task and the part of the list that is rewritten.

An event without id or time, or with a value outside its domain, is rejected with its reasons
and replaces nothing.  Empty batches commit an unchanged list.  Superseded folders stay for
readers of older commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.bands import band
from ..functions.common import sigmoid
from ..functions.scorecard import log_odds
from ..operators.common import attach_one_row
from ..operators.select import validate
from ..session import scratch_path

EVENT_SCHEMA = T.StructType(S.LEADS_SCHEMA.fields + [T.StructField("event_time", T.TimestampType(), True)])
EVENT_COLS = [f.name for f in EVENT_SCHEMA.fields]
CARD_KEYS = ["canal_captacao", "curso_interesse", "classificacao", "bin"]
CARD_SCHEMA = ("canal_captacao string, curso_interesse string, classificacao string, bin int, "
               "leads long, responded long, score_sum decimal(38,17)")
MANIFEST_SCHEMA = "bucket long, version long"
BINS = 20               # score bins of width 0.05


def _contribution() -> Column:
    """What one kept lead adds to the cards."""
    return F.struct("canal_captacao", "curso_interesse", "classificacao",
                    F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"),
                    F.col("respondeu_contato").cast("long").alias("responded"),
                    F.col("score").cast("decimal(18,17)").alias("score"))


def judged(events: DataFrame, score: Column | None = None, bands: str = "right") -> DataFrame:
    """Events with ``is_valid``, ``reasons``, content hash, score and class (null where rejected)."""
    v = validate(events.select(*EVENT_COLS))
    lost = F.concat_ws(",", F.when(F.col("lead_id").isNull(), F.lit("missing_lead_id")),
                       F.when(F.col("event_time").isNull(), F.lit("missing_event_time")))
    v = v.withColumn("reasons", F.concat_ws(",", *[F.when(c != "", c) for c in (F.col("reasons"), lost)]))
    v = v.withColumn("is_valid", F.when(F.col("reasons") == "", 1).otherwise(0))
    s = F.when(F.col("is_valid") == 1, score if score is not None else sigmoid(log_odds()))
    return v.withColumns({"content": F.xxhash64(*EVENT_COLS), "score": s}) \
        .withColumn("classificacao", band("score", bands))


class KeptList:
    """The versioned list under ``root``; ``width`` is the number of ids a range."""

    def __init__(self, spark: SparkSession, root: str, width: int = 1_000_000):
        self.spark, self.root, self.width = spark, root.rstrip("/"), width
        # an empty first commit, so that there always is a newest one; kept if it exists
        none = spark.createDataFrame([], CARD_SCHEMA)
        none.coalesce(1).write.mode("ignore").parquet(f"{self.root}/cards/batch=-1")
        self._manifest_frame([]).write.mode("ignore").parquet(f"{self.root}/commits/batch=-1")

    def _manifest_frame(self, rows) -> DataFrame:
        # a row without a bucket marks the commit, also of an empty list
        return self.spark.createDataFrame([(None, None), *rows], MANIFEST_SCHEMA).coalesce(1)

    def last_commit(self) -> int:
        return self.spark.read.schema(MANIFEST_SCHEMA + ", batch long").parquet(f"{self.root}/commits") \
            .agg(F.max("batch")).first()[0]

    def manifest(self, batch: int) -> dict[int, int]:
        """{id range: batch that wrote it}: one entry a range, so ids / width entries."""
        rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.root}/commits/batch={batch}")
        return {r["bucket"]: r["version"] for r in rows.where(F.col("bucket").isNotNull()).collect()}

    def bucket(self) -> Column:
        return F.floor(F.col("lead_id") / F.lit(self.width)).cast("long")

    def _ranges(self, held: dict[int, int]) -> DataFrame | None:
        if not held:
            return None
        paths = [f"{self.root}/data/batch={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*paths).drop("batch", "bucket")

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        last = self.last_commit()
        if batch_id <= last:
            return
        log, data = f"{self.root}/log/batch={batch_id}", f"{self.root}/data/batch={batch_id}"
        batch.write.mode("overwrite").parquet(log)
        arrived = self.spark.read.schema(batch.schema).parquet(log).where("is_valid = 1")
        version = F.struct("event_time", "content", -F.col("changed_in"))   # a repeat loses to the kept row
        cols = [*EVENT_COLS, "content", "score", "classificacao"]
        # the batch's own winner first, with partial sums: a lead may hold any share of the events
        one = arrived.withColumn("changed_in", F.lit(batch_id).cast("long")).groupBy("lead_id") \
            .agg(F.max_by(F.struct(*cols, "changed_in"), version).alias("r")).select("r.*")
        held = self.manifest(last)
        touched = {r["b"] for r in one.select(self.bucket().alias("b")).distinct().collect()}
        kept = self._ranges({b: v for b, v in held.items() if b in touched})
        both = one.withColumn("old", F.when(F.lit(False), _contribution()))
        if kept is not None:
            both = both.unionByName(kept.select(*cols, "changed_in", _contribution().alias("old")))
        merged = both.withColumn("bucket", self.bucket()).repartition("bucket").groupBy("bucket", "lead_id").agg(
            F.max_by(F.struct(*[c for c in [*cols, "changed_in"] if c != "lead_id"]), version).alias("r"),
            F.max("old").alias("old"))
        merged = merged.select("bucket", "lead_id", "r.*", F.when(F.col("r.changed_in") == batch_id, F.col("old")).alias("replaced"))
        if touched:
            merged.sortWithinPartitions("bucket", "lead_id").write.mode("overwrite").partitionBy("bucket").parquet(data)
        self._cards(batch_id, last, touched)
        held.update({b: batch_id for b in touched})
        self._manifest_frame(sorted(held.items())).write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch_id}")

    def _cards(self, batch_id: int, last: int, touched: set) -> None:
        sums = self.spark.read.schema(CARD_SCHEMA).parquet(f"{self.root}/cards/batch={last}")
        if touched:
            changed = self._ranges({b: batch_id for b in touched}).where(F.col("changed_in") == batch_id)
            moves = changed.select(F.explode(F.array(
                F.struct(F.lit(1).alias("sign"), _contribution().alias("c")),
                F.struct(F.lit(-1).alias("sign"), F.col("replaced").alias("c")))).alias("m")).where("m.c is not null")
            sums = sums.unionByName(moves.select(
                "m.c.canal_captacao", "m.c.curso_interesse", "m.c.classificacao", "m.c.bin",
                F.col("m.sign").cast("long").alias("leads"), (F.col("m.sign") * F.col("m.c.responded")).alias("responded"),
                (F.col("m.sign") * F.col("m.c.score")).cast("decimal(38,17)").alias("score_sum")))
        out = sums.groupBy(*CARD_KEYS).agg(*[F.sum(c).alias(c) for c in ("leads", "responded", "score_sum")])
        out.where("leads <> 0").select(*CARD_KEYS, "leads", "responded", F.col("score_sum").cast("decimal(38,17)").alias("score_sum")) \
            .coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cards/batch={batch_id}")

    def run(self, events: DataFrame, checkpoint: str, arrival_window: str = "1 hour", score: Column | None = None):
        """Start the stream over ``events`` (columns of EVENT_SCHEMA); takes what is there and stops."""
        seen = judged(events, score).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", arrival_window) \
            .dropDuplicatesWithinWatermark(["lead_id", "event_time", "content"]).drop("arrived")
        return seen.writeStream.foreachBatch(self._apply).option("checkpointLocation", checkpoint) \
            .outputMode("append").trigger(availableNow=True).start()

    def leads(self) -> DataFrame:
        """The list at the newest commit (event columns, score, class)."""
        held = self._ranges(self.manifest(self.last_commit()))
        cols = [*EVENT_COLS, "score", "classificacao"]
        if held is None:
            return self.spark.createDataFrame([], T.StructType(
                [*EVENT_SCHEMA.fields, T.StructField("score", T.DoubleType()), T.StructField("classificacao", T.StringType())]))
        return held.select(*cols)

    def sums(self) -> DataFrame:
        """The maintained sums at the newest commit (CARD_SCHEMA)."""
        return self.spark.read.schema(CARD_SCHEMA).parquet(f"{self.root}/cards/batch={self.last_commit()}")

    def rejects(self) -> DataFrame:
        """Rejected events of every committed batch with their reasons."""
        log = self.spark.read.option("basePath", f"{self.root}/log").parquet(f"{self.root}/log")
        return log.where((F.col("is_valid") == 0) & (F.col("batch") <= self.last_commit()))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100)


def cards(sums: DataFrame) -> DataFrame:
    """(card, key, leads, value) of the management view from the maintained sums alone: total,
    focus share (0 when empty), response rate, mean scores by channel and course, class shares, score bins."""
    hi = F.col("classificacao") == S.CLASS_HIGH
    n, total = F.sum("leads"), F.col("_n")
    mean = F.sum("score_sum").cast("double") / n
    key = F.lit(None).cast("string")
    one = sums.agg(F.coalesce(n, F.lit(0)).alias("_n"), mean.alias("_mean"), F.coalesce(F.sum(F.when(hi, F.col("leads"))), F.lit(0)).alias("_hi"),
                   (F.sum(F.when(hi, F.col("score_sum"))).cast("double") / F.sum(F.when(hi, F.col("leads")))).alias("_focus"),
                   F.sum("responded").alias("_resp"))
    share = F.coalesce(_rate(F.col("_hi"), total), F.lit(0.0))
    head = one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("card"), key.alias("key"), cnt.alias("leads"), val.cast("double").alias("value"))
        for name, cnt, val in (("mean_score", total, F.col("_mean")), ("focus_share", F.col("_hi"), share),
                               ("effort_saved", total - F.col("_hi"), F.lit(100.0) - share),
                               ("focus_mean_score", F.col("_hi"), F.col("_focus")),
                               ("response_rate", total, _rate(F.col("_resp"), total)))])))
    for card, col in (("by_channel", "canal_captacao"), ("by_course", "curso_interesse")):
        part = sums.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("key")).agg(n.alias("leads"), mean.alias("value"))
        head = head.unionByName(part.withColumn("card", F.lit(card)))
        best = part.orderBy(F.desc("value"), "key").limit(1)
        head = head.unionByName(best.withColumn("card", F.lit(card.replace("by_", "best_"))))
    for card, k in (("class", F.col("classificacao")), ("score_bin", F.col("bin").cast("string"))):
        part = sums.where(k.isNotNull()).groupBy(k.alias("key")).agg(n.alias("leads"))
        classed = sums.where(k.isNotNull()).agg(n.alias("_n"))
        head = head.unionByName(attach_one_row(part, classed).select(
            F.lit(card).alias("card"), "key", "leads", (F.col("leads") / F.col("_n")).alias("value")))
    return head


def event_feeds(leads: DataFrame) -> list[DataFrame]:
    """Three feeds over a lead table.  First: all leads but every 13th.  Second, two days later:
    those, every 5th corrected (one attempt more, response turned), every 7th repeated as it was.
    Third: every 11th corrected (two attempts more) with a time between the two, so it loses to a
    correction of the second feed; every 17th with a faulty response; every 5th correction again."""
    i = F.col("lead_id")
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    first = leads.withColumn("event_time", at(1))
    turned = leads.withColumns({"n_tentativas": F.col("n_tentativas") + 1, "respondeu_contato": 1 - F.col("respondeu_contato"),
                                "event_time": at(3)}).where(i % 5 == 0)
    late = leads.withColumns({"n_tentativas": F.col("n_tentativas") + 2, "event_time": at(2)}).where(i % 11 == 0)
    faulty = leads.withColumns({"respondeu_contato": F.lit(2), "event_time": at(4)}).where(i % 17 == 0)
    return [first.where(i % 13 != 0),
            first.where((i % 13 == 0) | (i % 7 == 0)).unionByName(turned),
            late.unionByName(faulty).unionByName(turned)]


def run_feeds(spark: SparkSession, feeds: list[DataFrame], root: str | None = None, width: int = 1_000_000) -> KeptList:
    """Write each feed as files, then let the stream, restarted from its checkpoint, take them."""
    root = root or scratch_path(spark, "kept-list")
    kept = KeptList(spark, f"{root}/list", width)
    for feed in feeds:
        feed.select(*EVENT_COLS).write.mode("append").parquet(f"{root}/events")
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(f"{root}/events")
        kept.run(stream, f"{root}/checkpoint").awaitTermination()
    return kept
