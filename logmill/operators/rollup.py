"""Counts answered from a rollup by minute, and from raw rows where it has none yet."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BUCKETS


def rollup(logs: DataFrame) -> DataFrame:
    """bucket, service, level_code, n: counts by minute, what closed buckets are answered from."""
    return logs.groupBy(F.window("ts", "1 minute").start.alias("bucket"), "service", "level_code").agg(F.count("*").alias("n"))


def closed(logs: DataFrame, until: datetime) -> DataFrame:
    """The rollup of all minutes before `until`, which is a whole minute."""
    return rollup(logs.where(F.col("ts") < F.lit(until)))


def counts(rolled: DataFrame, logs: DataFrame, until: datetime, bucket: str, group_by: str | None = None) -> DataFrame:
    """start, key, count as aggregate.counts() gives them, from the rollup before `until` and from raw rows after it."""
    minutes = rolled.where(F.col("bucket") < F.lit(until)).unionByName(rollup(logs.where(F.col("ts") >= F.lit(until))))
    key = {"service": F.col("service"), "level": F.col("level_code")}.get(group_by)
    start = F.window("bucket", BUCKETS[bucket][0]).start.alias("start")
    grouped = minutes.groupBy(start, *([] if key is None else [key.alias("key")])).agg(F.sum("n").alias("count"))
    return grouped if key is not None else grouped.select("start", F.lit(None).cast("string").alias("key"), "count")
