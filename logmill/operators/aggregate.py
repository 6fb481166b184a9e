"""Counts by time bucket, optionally by service or level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_name
from ..functions.timeparse import format_bucket
from ..schema import BUCKETS, MAX_BUCKETS, bad
from .filters import LogFilters, Params, first

GROUPS = (None, "service", "level")


@dataclass(frozen=True)
class AggregateQuery:
    filters: LogFilters
    bucket: str
    group_by: str | None = None

    @classmethod
    def parse(cls, params: Params) -> AggregateQuery:
        filters = LogFilters.parse(params)
        bucket, group = first(params, "bucket"), first(params, "group_by")
        if filters.since is None or filters.until is None:
            raise bad("since and until are required")
        if bucket not in BUCKETS:
            raise bad(f"bucket must be one of {', '.join(BUCKETS)}")
        if group is not None and group not in GROUPS:
            raise bad("group_by must be service or level")
        if -(-(filters.until - filters.since) // BUCKETS[bucket][1]) > MAX_BUCKETS:
            raise bad(f"the range holds more than {MAX_BUCKETS} buckets")
        return cls(filters, bucket, group)


def counts(logs: DataFrame, bucket: str, group_by: str | None = None) -> DataFrame:
    """start, key, count: rows by epoch-aligned UTC bucket; empty buckets have no row.

    The aggregate runs on the bare bucket and the stored key; names and texts
    are made of its few rows afterwards.
    """
    key = {"service": F.col("service"), "level": F.col("level_code")}.get(group_by)
    start = F.window("ts", BUCKETS[bucket][0]).start.alias("start")
    grouped = logs.groupBy(start, key.alias("key")).agg(F.count("*").alias("count")) if key is not None else logs.groupBy(start).agg(F.count("*").alias("count")).withColumn("key", F.lit(None).cast("string"))
    return grouped.select("start", "key", "count")


def aggregate(logs: DataFrame, params: Params | AggregateQuery) -> DataFrame:
    """start (text), group, count, by start and then by group, null first, levels by code."""
    query = params if isinstance(params, AggregateQuery) else AggregateQuery.parse(params)
    got = counts(query.filters.apply(logs), query.bucket, query.group_by).orderBy(F.asc("start"), F.asc_nulls_first("key"))
    group = level_name(F.col("key")) if query.group_by == "level" else F.col("key")
    return got.select(format_bucket(F.col("start")).alias("start"), group.alias("group"), "count")
