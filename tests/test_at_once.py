import threading
import time

import pytest

from leadlens import schema as S
from leadlens.operators import preprocess
from leadlens.operators.preprocess import Preprocessor
from leadlens.functions.features import add_features
from leadlens.plans.at_once import run_at_once
from leadlens.plans.training import TrainConfig, train_all
from leadlens.sources.leads import leads_view

from conftest import SF_SMALL


def test_jobs_meet_and_keep_their_order(spark):
    """Each job waits for the other, so a sequence would not end."""
    meet, pools = threading.Barrier(2, timeout=60), {}

    def job(name, n):
        def run():
            meet.wait()
            pools[name] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
            return spark.range(n).count()
        return run

    got = run_at_once(spark, {"b": job("b", 5), "a": job("a", 7)})
    assert list(got.items()) == [("b", 5), ("a", 7)] and pools == {"a": "a", "b": "b"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert run_at_once(spark, {}) == {}


def test_a_failure_cancels_the_rest(spark):
    started = threading.Event()

    def slow(batches):
        time.sleep(120)
        yield from batches

    def long_fit():
        for _ in range(3):   # passes, as of a fit
            started.set()
            spark.range(4).mapInPandas(slow, "id long").count()

    def broken():
        started.wait(60)
        time.sleep(2)
        raise ValueError("no such column")

    begin = time.time()
    with pytest.raises(ValueError, match="no such column"):
        run_at_once(spark, {"long": long_fit, "broken": broken})
    assert time.time() - begin < 60
    assert spark.range(3).count() == 3


def test_models_equal_those_of_the_sequence(spark):
    leads = leads_view(spark, SF_SMALL)
    made = [train_all(spark, leads, TrainConfig(rf_trees=2, gbt_iter=2, gbt_depth=2, rf_max_depth=3, at_once=how)) for how in (True, False)]
    both, sequence = ({r["model"]: (round(r["auc_roc"], 9), round(r["avg_precision"], 9), r["best"]) for r in m.comparison.collect()} for m in made)
    assert both == sequence and len(both) == 3
    assert made[0].best == made[1].best and list(made[0].models) == list(made[1].models)


def test_too_many_categories_are_refused(spark, monkeypatch):
    monkeypatch.setattr(preprocess, "MAX_CATEGORIES", 5)
    with pytest.raises(ValueError, match="different values"):
        Preprocessor().fit(add_features(leads_view(spark, SF_SMALL)).where(f"{S.LABEL_COL} is not null"))
