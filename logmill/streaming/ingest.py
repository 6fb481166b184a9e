"""Streaming ingest: micro-batches of raw bodies, without a watermark, so late rows are kept."""

from __future__ import annotations

import hashlib
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..jsonlog import logger
from ..schema import BUCKETS
from ..sources import ingest

log = logger("stream")


def write_batch(bodies: DataFrame, batch: int, logs_path: str, rejected_path: str, stream: str = "stream", now: datetime | None = None) -> None:
    """Write one micro-batch of bodies (path, value).

    It is acknowledged only after both tables have it.  A replay finds the first
    id and the clock of its first attempt and overwrites its own files and no others.
    """
    ingest.write(bodies.sparkSession, bodies, logs_path, rejected_path, f"{stream}-{batch:012d}", now)
    log.info("batch written", extra={"batch": batch, "stream": stream})


def ingest_stream(spark: SparkSession, source: str, logs_path: str, rejected_path: str, checkpoint: str, *, files: int = 100, bytes_: int | None = None, every: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Ingest files of bodies as they arrive in source.

    A micro-batch takes `files` files at most, or about `bytes_` bytes of them, which
    bounds what is in flight.  It runs what is there and ends, or, not
    available_now, goes on `every` so long (such as "2 seconds"; at once by default).
    """
    reader = spark.readStream.option("maxBytesPerTrigger", bytes_) if bytes_ else spark.readStream.option("maxFilesPerTrigger", files)
    bodies = reader.text(source, wholetext=True).select(F.input_file_name().alias("path"), "value")
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    writer = bodies.writeStream.foreachBatch(lambda df, n: write_batch(df, n, logs_path, rejected_path, stream)).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return (writer.trigger(processingTime=every) if every else writer).start()


def stalled(query: StreamingQuery, seconds: float, clock=time.time) -> bool:
    """Whether the query is at work on one batch for longer than that, or has failed."""
    if query.exception() is not None:
        return True
    last = query.lastProgress
    if not query.isActive or not query.status["isTriggerActive"] or last is None:
        return False
    began = datetime.fromisoformat(last["timestamp"].replace("Z", "+00:00")).timestamp() + last["durationMs"].get("triggerExecution", 0) / 1000
    return clock() - began > seconds


def drain(query: StreamingQuery, timeout: float = 10.0) -> bool:
    """Let the query work off what has arrived and stop it; False if it had to be stopped before."""
    ends = time.monotonic() + timeout
    while query.isActive and time.monotonic() < ends:
        if query.status["isTriggerActive"] or query.status["isDataAvailable"]:
            time.sleep(0.1)
        else:
            query.stop()
            return True
    active = query.isActive
    if active:
        query.stop()
    return not active


def stream_counts(logs: DataFrame, bucket: str, late: str = "10 minutes") -> DataFrame:
    """Bucketed counts of a stream of logs, by service; state ends `late` after a bucket."""
    rows = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", BUCKETS[bucket][0]).start.alias("start"), "service").agg(F.count("*").alias("count"))
