"""Validation of raw entries: accepted rows and rejections with reasons.

JSON is held as VARIANT, so that a number and its text stay apart.  Keys of an
object come in alphabetical order here, which decides only which of several bad
attributes is named.  A batch in which an object repeats a key is malformed.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_code
from ..functions.timeparse import parse_ts, to_us
from ..schema import LEVELS, MAX_ATTRIBUTES, MAX_BODY, MAX_ENTRIES, MAX_FUTURE_US, MAX_KEY, MAX_MESSAGE, MAX_SERVICE, MAX_VALUE

_INTEGRAL = 1e21  # smaller whole numbers are written as integers


def _kind(v: Column) -> Column:
    """VOID, STRING, BOOLEAN, OBJECT, ARRAY, or a kind of number; null if v is absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once, however often later expressions name them.

    They pass through a generator of one row, behind which the optimiser can't copy them.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def envelopes(bodies: DataFrame, column: str = "value") -> DataFrame:
    """batch columns plus entries (array of variants) and error: why the whole body is refused, or null."""
    body = F.col(column)
    own = [f"`{c}`" for c in bodies.columns]
    parsed = once(bodies, _body=F.try_parse_json(body))
    taken = once(parsed, _list=F.try_variant_get("_body", "$.logs", "array<variant>"))
    error = (
        F.when(F.octet_length(body) > MAX_BODY, "request body too large")
        .when(F.coalesce(F.length(F.trim(body)), F.lit(0)) == 0, "request body is empty")
        .when(F.col("_body").isNull(), "request body is not valid JSON")
        .when(F.col("_list").isNull(), "body must be an object with a logs array")
        .when(F.size("_list") == 0, "logs must not be empty")
        .when(F.size("_list") > MAX_ENTRIES, f"logs exceeds {MAX_ENTRIES} entries")
    )
    told = once(taken, error=error)
    return told.select(*own, F.when(F.col("error").isNull(), F.col("_list")).alias("entries"), "error")


def _attribute_reason(key: Column, value: Column) -> Column:
    kind = _kind(value)
    name = F.concat(F.lit("attribute '"), key, F.lit("'"))
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(F.length(key) == 0, "attribute keys must be non-empty")
        .when(F.length(key) > MAX_KEY, F.concat(F.lit("attribute key '"), F.substring(key, 1, 32), F.lit(f"...' exceeds {MAX_KEY} characters")))
        .when(kind == "STRING", F.when(F.length(F.try_variant_get(value, "$", "string")) > MAX_VALUE, F.concat(name, F.lit(f" exceeds {MAX_VALUE} characters"))))
        .when(_is_number(kind), F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.concat(name, F.lit(" must be a finite number"))))
        .when(kind == "BOOLEAN", F.lit(None))
        .otherwise(F.concat(name, F.lit(" must be a string, number, or boolean (nested objects and arrays are not allowed)")))
    )


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def canonical_attributes(attributes: Column) -> Column:
    """A map of variants as JSON text; whole numbers below 1e21 without fraction or exponent."""

    def value(v: Column) -> Column:
        kind, number = _kind(v), F.try_variant_get(v, "$", "double")
        whole = _is_number(kind) & (number == F.floor(number)) & (F.abs(number) < _INTEGRAL)
        return F.when(whole, F.try_variant_get(v, "$", "decimal(38,0)").cast("string")).otherwise(F.to_json(v))

    parts = F.transform(F.map_entries(attributes), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), value(e["value"])))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(parts, ","), F.lit("")), F.lit("}"))


_FIELDS = ("timestamp", "level", "service", "message", "attributes")


def validate(entries: DataFrame, now: datetime, column: str = "entry") -> DataFrame:
    """entries plus reason (of the first rule that fails, or null), ts, level_code, service, message, attributes.

    Rules go by field: timestamp, level, service, message, attributes.  `now` is
    one reading of the clock for all rows.
    """
    now = now if now.tzinfo else now.replace(tzinfo=UTC)
    latest = int(now.timestamp() * 1_000_000) + MAX_FUTURE_US
    e = F.col(column)
    own = [f"`{c}`" for c in entries.columns]
    # each entry is taken apart once, then its fields are
    parts = once(entries, _whole=_kind(e), **{f"_{name}": F.try_variant_get(e, f"$.{name}", "variant") for name in _FIELDS})
    kinds = {f"_k_{name}": F.coalesce(_kind(F.col(f"_{name}")), F.lit("VOID")) for name in _FIELDS}
    texts = {f"_t_{name}": F.try_variant_get(F.col(f"_{name}"), "$", "string") for name in _FIELDS[:4]}
    fields = once(parts, **kinds, **texts, _map=F.try_variant_get(F.col("_attributes"), "$", "map<string,variant>"))
    reasons = F.filter(F.transform(F.map_entries("_map"), lambda x: _attribute_reason(x["key"], x["value"])), lambda r: r.isNotNull())
    read = once(fields, _ts=parse_ts(F.col("_t_timestamp")), _reasons=F.when(F.size("_map") <= MAX_ATTRIBUTES, reasons))
    kind, text, ts = {n: F.col(f"_k_{n}") for n in _FIELDS}, {n: F.col(f"_t_{n}") for n in _FIELDS[:4]}, F.col("_ts")

    def plain(name: str, most: int) -> list[tuple[Column, Column | str]]:
        return [(kind[name] == "VOID", f"{name} is required"), ((kind[name] != "STRING") | (text[name] == ""), f"{name} must be a non-empty string"), (F.length(text[name]) > most, f"{name} exceeds {most} characters")]

    rules: list[tuple[Column, Column | str]] = [
        (F.coalesce("_whole", F.lit("VOID")) != "OBJECT", "entry must be a JSON object"),
        (kind["timestamp"] == "VOID", "timestamp is required"),
        (kind["timestamp"] != "STRING", "timestamp must be an ISO 8601 string"),
        (ts.isNull(), F.concat(F.lit("invalid timestamp: "), _quoted(text["timestamp"]), F.lit(" is not a valid ISO 8601 instant"))),
        (to_us(ts) > latest, "timestamp is more than five minutes in the future"),
        (kind["level"] == "VOID", "level is required"),
        (kind["level"] != "STRING", f"level must be one of: {', '.join(LEVELS)}"),
        (~text["level"].isin(*LEVELS), F.concat(F.lit("invalid level: '"), text["level"], F.lit("'"))),
        *plain("service", MAX_SERVICE),
        *plain("message", MAX_MESSAGE),
        ((kind["attributes"] != "VOID") & (kind["attributes"] != "OBJECT"), "attributes must be a flat object"),
        (F.size("_map") > MAX_ATTRIBUTES, f"attributes exceeds {MAX_ATTRIBUTES} keys"),
        (F.size("_reasons") > 0, F.get("_reasons", F.lit(0))),
    ]
    reason = F.lit(None).cast("string")
    for condition, why in reversed(rules):
        reason = F.when(condition, why).otherwise(reason)
    # a scalar entry has no fields, a nested attribute no canonical text
    return read.select(*own, reason.alias("reason"), ts.alias("ts"), level_code(text["level"]).alias("level_code"), text["service"].alias("service"), text["message"].alias("message"), canonical_attributes(F.col("_map")).alias("attributes"))


def report(results: list[dict]) -> tuple[int, dict]:
    """Status and body of a batch's reply from its rows' {index, reason}."""
    rejected = sorted(({"index": r["index"], "reason": r["reason"]} for r in results if r["reason"]), key=lambda r: r["index"])
    accepted = len(results) - len(rejected)
    return (200 if accepted else 400), {"accepted": accepted, "rejected": rejected}
