"""The kept list against the batch result, restarts, late corrections and exact retraction."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.sources.leads import leads_view
from leadlens.streaming import kept_list as kl

from conftest import SF_SMALL


def day(d):
    return dt.datetime(2024, 1, d)


def event(i, d, attempts=1, answered=1, channel="Instagram", days=3):
    row = {f.name: None for f in kl.EVENT_SCHEMA.fields}
    row.update(lead_id=i, canal_captacao=channel, curso_interesse="Espanhol", dias_sem_contato=days, n_tentativas=attempts,
               respondeu_contato=answered, event_time=day(d) if d else None)
    return tuple(row.values())


def feed(spark, rows):
    return spark.createDataFrame(rows, kl.EVENT_SCHEMA)


def state(kept):
    return {r["lead_id"]: (r["n_tentativas"], r["event_time"].day) for r in kept.leads().collect()}


def sums(kept):
    return sorted(map(tuple, kept.sums().collect()), key=str)


def recomputed(spark, kept):
    """The sums of the list as it stands, from scratch."""
    one = kept.leads().select(kl._contribution().alias("c"))
    return sorted(map(tuple, one.groupBy(*[F.col(f"c.{k}").alias(k) for k in kl.CARD_KEYS]).agg(
        F.count("*"), F.sum("c.responded"), F.sum("c.score")).collect()), key=str)


@pytest.fixture()
def root():
    return tempfile.mkdtemp(prefix="leadlens-kept-")


def test_repeats_late_corrections_and_rejects(spark, root):
    kept = kl.run_feeds(spark, [
        feed(spark, [event(1, 1), event(2, 5, 4), event(-3, 1), event(1, 1), event(9, 1, days=-2)]),
        feed(spark, [event(1, 3, 2), event(2, 4, 8), event(4, 1), event(-3, 1)]),     # 2: older than what is kept
        feed(spark, [event(1, 2, 7), event(4, 9, channel=None), event(5, None), event(4, 2, 6)]),
    ], root, width=2)
    assert state(kept) == {1: (2, 3), 2: (4, 5), -3: (1, 1), 4: (6, 2)}
    assert sums(kept) == recomputed(spark, kept)
    rejected = {(r["lead_id"], r["reasons"]) for r in kept.rejects().collect()}
    assert rejected == {(9, "negative_dias_sem_contato"), (4, "missing_canal_captacao"), (5, "missing_event_time")}


def test_order_of_arrival_does_not_matter(spark, root):
    rows = [event(i % 4, 1 + i % 3, attempts=i) for i in range(24)]
    a = kl.run_feeds(spark, [feed(spark, rows)], f"{root}/a")
    b = kl.run_feeds(spark, [feed(spark, rows[::-1][k::3]) for k in range(3)], f"{root}/b", width=3)
    assert state(a) == state(b) and len(state(a)) == 4
    assert sums(a) == sums(b)


def test_uncommitted_batch_is_written_anew_and_a_committed_one_passed_over(spark, root):
    kept = kl.KeptList(spark, f"{root}/list", width=2)
    first, second = kl.judged(feed(spark, [event(1, 1), event(2, 1)])), kl.judged(feed(spark, [event(1, 2, 5)]))
    kept._apply(first, 0)
    real = kept._cards
    kept._cards = lambda *a: (_ for _ in ()).throw(RuntimeError("stopped"))
    with pytest.raises(RuntimeError):
        kept._apply(second, 1)
    kept._cards = real
    assert state(kept) == {1: (1, 1), 2: (1, 1)}           # the stopped batch is not seen
    kept._apply(second, 1)
    assert state(kept) == {1: (5, 2), 2: (1, 1)}
    before = sums(kept)
    kept._apply(second, 1)                                 # run again after its commit
    kl.KeptList(spark, f"{root}/list", width=2)            # opening again keeps everything
    assert sums(kept) == before == recomputed(spark, kept)


def test_only_touched_ranges_are_written(spark, root):
    kept = kl.KeptList(spark, f"{root}/list", width=10)
    kept._apply(kl.judged(feed(spark, [event(i, 1) for i in range(40)])), 0)
    kept._apply(kl.judged(feed(spark, [event(5, 2), event(38, 2)])), 1)
    assert kept.manifest(1) == {0: 1, 1: 0, 2: 0, 3: 1}
    assert len(state(kept)) == 40


def test_empty_feeds_and_empty_list(spark, root):
    kept = kl.run_feeds(spark, [feed(spark, [])], root)
    assert state(kept) == {} and sums(kept) == []
    head = {r["card"]: r["value"] for r in kl.cards(kept.sums()).collect()}
    assert head == {"mean_score": None, "focus_share": 0.0, "effort_saved": 100.0, "focus_mean_score": None, "response_rate": None}


def test_one_lead_with_most_of_the_events(spark, root):
    hot = spark.range(20_000).select(F.lit(7).alias("lead_id"), (F.col("id") % 9).cast("int").alias("n_tentativas"),
                                     F.timestamp_seconds(F.col("id") * 60).alias("event_time"))
    blank = {f.name: F.lit(None).cast(f.dataType) for f in S.LEADS_SCHEMA.fields if f.name not in ("lead_id", "n_tentativas")}
    blank.update(canal_captacao=F.lit("Instagram"), curso_interesse=F.lit("Espanhol"), dias_sem_contato=F.lit(1), respondeu_contato=F.lit(0))
    kept = kl.run_feeds(spark, [hot.withColumns(blank)], root)
    assert [r["n_tentativas"] for r in kept.leads().collect()] == [19_999 % 9]


def test_cards_equal_the_batch_operators(spark, root):
    from leadlens.operators import management as J
    kept = kl.run_feeds(spark, kl.event_feeds(leads_view(spark, SF_SMALL)), root, width=500)
    scored = kept.leads().cache()
    got = {(r["card"], r["key"]): (r["leads"], r["value"]) for r in kl.cards(kept.sums()).collect()}
    k = J.kpis(scored).first()
    assert got["mean_score", None] == (k["total_leads"], pytest.approx(k["media_score"]))
    assert got["focus_share", None] == (k["leads_alto"], pytest.approx(k["pct_alto"]))
    for r in J.mean_score_by(scored, "canal_captacao").collect():
        assert got["by_channel", r[0]] == (r["quantidade"], pytest.approx(r["score_medio"]))
    for r in J.class_counts(scored).collect():
        assert got["class", r[0]] == (r["count"], pytest.approx(r["share"]))
    best = J.best_by(scored, "curso_interesse").first()
    assert got["best_course", best[0]][1] == pytest.approx(best[1])
    assert got["response_rate", None][1] == pytest.approx(J.response_rate(scored).first()[0])
    scored.unpersist()
