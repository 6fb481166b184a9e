"""The log table, its limits and the error that a bad request raises."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Levels by code, and the limits of the contract.
LEVELS = ("debug", "info", "warn", "error")
MAX_SERVICE = 255
MAX_MESSAGE = 65_536
MAX_ATTRIBUTES = 128
MAX_KEY = 255
MAX_VALUE = 8192
MAX_ENTRIES = 100_000
MAX_BODY = 32 << 20
MAX_FUTURE_US = 5 * 60 * 1_000_000
MAX_FILTERS = 16
MAX_Q = 1024
MAX_BUCKETS = 100_000
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
BUCKETS = {"1m": ("1 minute", 60_000_000), "5m": ("5 minutes", 300_000_000), "1h": ("1 hour", 3_600_000_000), "1d": ("1 day", 86_400_000_000)}

LOGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("level_code", T.IntegerType(), False),
    T.StructField("service", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("attributes", T.StringType(), False),
    T.StructField("day", T.DateType(), False),
])

#: What was not accepted: entries, and whole bodies (index null) with their text.
REJECTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("reason", T.StringType()), T.StructField("body", T.StringType())])


@dataclass
class RequestError(Exception):
    """A request that can't be served: an HTTP-like status and what is wrong."""

    status: int
    message: str

    def __str__(self) -> str:
        return self.message


def bad(message: str) -> RequestError:
    return RequestError(400, message)
