"""Spark sessions for the engine, and queries that end in time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from .schema import RequestError

Result = TypeVar("Result")


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings, with _ for . or as they are, come on top.

    Jobs are scheduled fairly, so that queries don't wait for ingest.
    """
    builder = SparkSession.builder.appName("logmill")
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.scheduler.mode": "FAIR"}.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key if "." in key else key.replace("_", "."), value)
    return builder.getOrCreate()


def within(spark: SparkSession, seconds: float, run: Callable[[], Result], pool: str = "query") -> Result:
    """What run() returns; its jobs, in a scheduler pool of their own, are cancelled after `seconds`, which is an error 503."""
    group, late = f"logmill-{uuid.uuid4().hex}", threading.Event()
    sc = spark.sparkContext

    def cancel() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, cancel)
    sc.setLocalProperty("spark.scheduler.pool", pool)
    sc.setJobGroup(group, f"query of at most {seconds} s", interruptOnCancel=True)
    timer.start()
    try:
        return run()
    except Exception:
        if late.is_set():
            raise RequestError(503, "query took too long") from None
        raise
    finally:
        timer.cancel()
        for key in ("spark.scheduler.pool", "spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(key, None)
