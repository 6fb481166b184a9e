"""Filters of log queries: parsing of parameters and predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeparse import parse_us
from ..schema import LEVELS, MAX_FILTERS, MAX_Q, bad

Params = Mapping[str, str] | Iterable[tuple[str, str]]


def pairs(params: Params) -> list[tuple[str, str]]:
    return list(params.items()) if isinstance(params, Mapping) else list(params)


def first(params: Params, name: str) -> str | None:
    return next((v for k, v in pairs(params) if k == name), None)


def escape_like(text: str) -> str:
    """text as a literal inside a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def _day(us: int) -> Column:
    """The day of an instant, as far as there are days in the calendar."""
    first, last = (int((d - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000 for d in (datetime.min.replace(tzinfo=UTC), datetime(9999, 12, 31, tzinfo=UTC)))
    return F.lit((datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=min(max(us, first), last))).date().isoformat()).cast("date")


@dataclass(frozen=True)
class LogFilters:
    """Conditions that all hold: since <= ts < until, service, level, attributes as text, q in the message."""

    since: int | None = None
    until: int | None = None
    service: str | None = None
    level: int | None = None
    attributes: tuple[tuple[str, str], ...] = field(default=())
    q: str | None = None

    @classmethod
    def parse(cls, params: Params) -> LogFilters:
        params = pairs(params)
        at: dict[str, int | None] = {}
        for name in ("since", "until"):
            raw = first(params, name)
            at[name] = None if raw is None else parse_us(raw)
            if raw is not None and at[name] is None:
                raise bad(f"invalid {name}: not a valid ISO 8601 instant")
        if at["since"] is not None and at["until"] is not None and at["until"] < at["since"]:
            raise bad("until must not be earlier than since")
        service, level, q = (first(params, n) for n in ("service", "level", "q"))
        if service == "":
            raise bad("service must not be empty")
        if level is not None and level not in LEVELS:
            raise bad(f"invalid level: must be one of {', '.join(LEVELS)}")
        if q is not None and len(q) > MAX_Q:
            raise bad(f"q exceeds {MAX_Q} characters")
        attributes = tuple((k[5:], v) for k, v in params if k.startswith("attr."))
        if any(not k for k, _ in attributes):
            raise bad("attribute filters need a key: attr.<key>=<value>")
        if len(attributes) > MAX_FILTERS:
            raise bad(f"at most {MAX_FILTERS} attribute filters")
        return cls(at["since"], at["until"], service, None if level is None else LEVELS.index(level), attributes, q or None)

    def conditions(self, columns: Iterable[str] = ()) -> list[Column]:
        """One predicate each; with a day column, bounds also prune partitions."""
        out = []
        days = "day" in columns
        if self.since is not None:
            out.append(F.col("ts") >= F.timestamp_micros(F.lit(self.since)))
            if days:
                out.append(F.col("day") >= _day(self.since))
        if self.until is not None:
            out.append(F.col("ts") < F.timestamp_micros(F.lit(self.until)))
            if days:
                out.append(F.col("day") <= _day(self.until - 1))
        if self.service is not None:
            out.append(F.col("service") == F.lit(self.service))
        if self.level is not None:
            out.append(F.col("level_code") == F.lit(self.level))
        if self.attributes:
            held = F.from_json("attributes", "map<string,string>")
            out += [held[F.lit(k)] == F.lit(v) for k, v in self.attributes]
        if self.q is not None:
            out.append(F.col("message").ilike(f"%{escape_like(self.q)}%"))
        return out

    def apply(self, logs: DataFrame) -> DataFrame:
        conditions = self.conditions(logs.columns)
        return logs.where(reduce(and_, conditions)) if conditions else logs
