"""Independent jobs run at the same time on one session.

Each job gets a driver thread and a scheduler pool of its own.  With ``spark.scheduler.mode``
FAIR (the session default here) the pools share the executors evenly; with FIFO a later job
takes the slots that the earlier ones leave idle, as between the short passes of a fit.  All
Spark jobs that a thread starts carry one tag; if a job fails, those of the others are
cancelled, and the first error is raised once all have ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")
CANCEL_EVERY = 0.2   # seconds between cancellations, as a cancelled job's thread may start another one first


def run_at_once(spark: SparkSession, jobs: dict[str, Callable[[], Result]]) -> dict[str, Result]:
    """The results of ``jobs`` by name, in their order."""
    sc, tag = spark.sparkContext, f"at-once-{uuid.uuid4().hex[:12]}"

    def within(name: str, job: Callable[[], Result]) -> Callable[[], Result]:
        def run() -> Result:
            sc.setLocalProperty("spark.scheduler.pool", name)
            sc.addJobTag(tag)
            return job()
        return inheritable_thread_target(spark)(run)

    if not jobs:
        return {}
    with ThreadPoolExecutor(len(jobs)) as threads:
        running = {name: threads.submit(within(name, job)) for name, job in jobs.items()}
        done, rest = wait(running.values(), return_when=FIRST_EXCEPTION)
        failed = next((f.exception() for f in running.values() if f in done and f.exception()), None)
        while rest:   # only after a failure
            sc.cancelJobsWithTag(tag)
            rest = wait(rest, timeout=CANCEL_EVERY).not_done
    if failed:
        raise failed
    return {name: f.result() for name, f in running.items()}
