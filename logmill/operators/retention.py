"""Retention by day partitions."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jsonlog import logger

log = logger("retention")


def cutoff_day(now: datetime, days: int) -> date:
    """The first day that is kept."""
    return now.astimezone(UTC).date() - timedelta(days=days)


def day_folders(spark: SparkSession, path: str) -> dict[date, object]:
    """The table's folders by day, whatever batches are in them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("day=") and name[4:5].isdigit():
            out[date.fromisoformat(name[4:])] = status.getPath()
    return out


def retain(spark: SparkSession, path: str, days: int, now: datetime) -> dict:
    """Drop the day folders before the cutoff; the cutoff's own day stays."""
    began, cutoff = time.monotonic(), cutoff_day(now, days)
    dropped = []
    for day, folder in sorted(day_folders(spark, path).items()):
        if day < cutoff:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            dropped.append(day.isoformat())
    return {"dropped": dropped, "cutoff": cutoff.isoformat(), "durationMs": round((time.monotonic() - began) * 1000)}


class Janitor:
    """Sweeps a table now and then, one sweep at a time."""

    def __init__(self, sweep: Callable[[], dict], seconds: float = 300.0) -> None:
        self.sweep, self.seconds = sweep, seconds
        self.last: dict | None = None
        self._busy, self._end = threading.Lock(), threading.Event()
        self._thread: threading.Thread | None = None

    def run(self) -> dict | None:
        """Sweep and tell what was dropped; while another sweep is at work, what the one before it told."""
        if not self._busy.acquire(blocking=False):
            return self.last
        try:
            self.last = self.sweep()
            log.info("swept", extra=self.last)
            return self.last
        finally:
            self._busy.release()

    def start(self) -> None:
        def work() -> None:
            while not self._end.wait(self.seconds):
                try:
                    self.run()
                except Exception:  # the next sweep tries again
                    log.exception("sweep failed")

        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._end.set()
        if self._thread:
            self._thread.join()


def survivors(logs: DataFrame, days: int, now: datetime) -> DataFrame:
    """The rows that retention keeps; with a day column, only their folders are read."""
    cutoff = F.lit(cutoff_day(now, days))
    rows = logs.where(F.col("ts") >= cutoff.cast("timestamp"))
    return rows.where(F.col("day") >= cutoff) if "day" in logs.columns else rows
