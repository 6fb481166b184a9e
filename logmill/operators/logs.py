"""Newest-first retrieval with keyset pagination."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_name
from ..functions.timeparse import format_ms, to_us
from ..schema import DEFAULT_LIMIT, LEVELS, MAX_LIMIT, bad
from .cursor import Cursor
from .filters import LogFilters, Params, first


@dataclass(frozen=True)
class LogQuery:
    filters: LogFilters = LogFilters()
    limit: int = DEFAULT_LIMIT
    cursor: Cursor | None = None

    @classmethod
    def parse(cls, params: Params) -> LogQuery:
        limit, cursor = first(params, "limit"), first(params, "cursor")
        if limit is not None and not (limit.isascii() and limit.isdigit() and 1 <= int(limit) <= MAX_LIMIT):
            raise bad(f"limit must be an integer from 1 to {MAX_LIMIT}")
        return cls(LogFilters.parse(params), DEFAULT_LIMIT if limit is None else int(limit), Cursor.decode(cursor) if cursor else None)


def newest(logs: DataFrame, query: LogQuery, more: int = 0) -> DataFrame:
    """The query's newest rows and `more` beyond its limit, as stored.

    The keyset bound is written so that its first half reaches the scan.
    """
    rows = query.filters.apply(logs)
    if query.cursor:
        at = F.timestamp_micros(F.lit(query.cursor.us))
        rows = rows.where((F.col("ts") <= at) & ((F.col("ts") < at) | (F.col("id") < F.lit(query.cursor.id))))
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(query.limit + more)


def records(rows: DataFrame) -> DataFrame:
    """Rows as they are returned: id as text, timestamp in milliseconds, level by name."""
    return rows.select(F.col("id").cast("string").alias("id"), format_ms(F.col("ts")).alias("timestamp"), level_name(F.col("level_code")).alias("level"), "service", "message", "attributes")


def json_rows(rows: DataFrame) -> DataFrame:
    """id and json, the record as it is returned, of each row: attributes is an object, as it was stored."""
    name = F.to_json(F.struct(F.col("id").cast("string").alias("id"), format_ms(F.col("ts")).alias("timestamp"), level_name(F.col("level_code")).alias("level"), "service", "message", F.parse_json("attributes").alias("attributes")))
    return rows.select("id", name.alias("json"))


def page(logs: DataFrame, params: Params | LogQuery) -> dict:
    """{"logs": [...], "next_cursor": text or None}; next_cursor is set if there are more rows."""
    query = params if isinstance(params, LogQuery) else LogQuery.parse(params)
    rows = newest(logs, query, more=1).select("id", to_us(F.col("ts")).alias("us"), "level_code", "service", "message", "attributes")
    got = rows.collect()  # at most MAX_LIMIT + 1
    out = [{"id": str(r.id), "timestamp": iso_ms(r.us), "level": LEVELS[r.level_code], "service": r.service, "message": r.message, "attributes": json.loads(r.attributes)} for r in got[: query.limit]]
    last = got[query.limit - 1] if len(got) > query.limit else None
    return {"logs": out, "next_cursor": Cursor(last.us, last.id).encode() if last else None}


def iso_ms(us: int) -> str:
    at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=us // 1000)
    return f"{at:%Y-%m-%dT%H:%M:%S}.{us // 1000 % 1000:03d}Z"
