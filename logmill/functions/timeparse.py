"""ISO 8601 instants: parsing, formatting and microseconds."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, T, t or space, minutes, optional seconds with 1 to 9 digits, optional zone of at most 23:59; nothing after it.
ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[Tt ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,9}))?)?(?:[Zz]|([+-](?:[01][0-9]|2[0-3])):?([0-5][0-9]))?\z"
_ZONE = r"[+-]([0-9]{2}):?([0-9]{2})\z"
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def parse_ts(text: Column) -> Column:
    """The timestamp of an ISO instant, null if it is none.

    Without a zone it is UTC; digits past microseconds are cut; hours from 24
    and days that the calendar lacks are no instants.
    """
    # the gate fixes where date, hours, minutes and seconds are; only the fraction and the zone are searched for
    seconds = F.when(F.substring(text, 17, 1) == ":", F.substring(text, 18, 2)).otherwise("00")
    plain = F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 5), F.lit(":"), seconds, F.lit("+00:00"))
    whole = F.unix_seconds(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    micros = F.when(F.substring(text, 20, 1) == ".", F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]+)", 1), 1, 6), 6, "0").cast("long")).otherwise(0)
    tail = F.substring(text, 17, 32)
    minutes = F.when(tail.rlike(r"[+-]"), F.regexp_extract(tail, _ZONE, 1).cast("int") * 60 + F.regexp_extract(tail, _ZONE, 2).cast("int")).otherwise(0)
    east = F.when(F.contains(tail, F.lit("-")), -minutes).otherwise(minutes)
    return F.when(text.rlike(ISO), F.timestamp_micros((whole - east * 60) * 1_000_000 + micros))


def parse_us(text: str) -> int | None:
    """Microseconds since 1970 of one ISO instant, by the same rules."""
    m = re.match(ISO.replace(r"\z", r"\Z"), text)
    if not m:
        return None
    try:
        at = datetime(*(int(m[i] or 0) for i in range(1, 7)), tzinfo=UTC)
    except ValueError:
        return None
    east = timedelta(hours=int((m[8] or "+00")[1:]), minutes=int(m[9] or 0)) * (-1 if (m[8] or "+").startswith("-") else 1)
    return (at - _EPOCH - east) // timedelta(microseconds=1) + int((m[7] or "0")[:6].ljust(6, "0"))


def to_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def format_ms(ts: Column) -> Column:
    """YYYY-MM-DDTHH:mm:ss.sssZ, cut to milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
