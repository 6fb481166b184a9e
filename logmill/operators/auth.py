"""API keys: a table of hashes with scopes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RequestError
from .services import upsert

SCOPES = ("ingest", "query", "admin")
KEYS = "key_hash string, name string, scopes array<string>, created_at timestamp"


def key_hash(key: Column) -> Column:
    """SHA-256 in hex; keys themselves are never stored."""
    return F.sha2(key, 256)


def new_keys(spark: SparkSession, keys: list[tuple[str, str, list[str] | None]]) -> DataFrame:
    """Rows of (key, name, scopes) in the table's form; scopes are ingest and query by default, created_at is now."""
    rows = spark.createDataFrame([(k, n, s or ["ingest", "query"]) for k, n, s in keys], "key string, name string, scopes array<string>")
    return rows.select(key_hash(F.col("key")).alias("key_hash"), "name", "scopes", F.current_timestamp().alias("created_at"))


def register(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new keys; a key that is there gets the new name and scopes and keeps its created_at."""
    old = table.select("key_hash", F.col("created_at").alias("since"))
    kept = new.join(old, "key_hash", "left").select("key_hash", "name", "scopes", F.coalesce("since", "created_at").alias("created_at"))
    return upsert(table, kept, "key_hash")


def allowed(requests: DataFrame, keys: DataFrame, scope: str) -> DataFrame:
    """requests (with a column key) and status: 200, 401 for an unknown key, 403 for one without the scope."""
    known = F.broadcast(keys.select(F.col("key_hash"), F.array_contains("scopes", scope).alias("granted")))  # some rows an API client
    out = requests.join(known, key_hash(F.col("key")) == F.col("key_hash"), "left")
    return out.withColumn("status", F.when(F.col("key_hash").isNull(), 401).when(F.col("granted"), 200).otherwise(403)).drop("key_hash", "granted")


def presented(headers: Mapping[str, str]) -> str | None:
    """The key of a request: Authorization: Bearer <key>, or X-API-Key."""
    lower = {k.lower(): v for k, v in headers.items()}
    kind, _, key = lower.get("authorization", "").partition(" ")
    return key.strip() or None if kind.lower() == "bearer" else lower.get("x-api-key") or None


def authorise(spark: SparkSession, keys: DataFrame, headers: Mapping[str, str], scope: str, enabled: bool = True) -> None:
    """Raise 401 or 403 where a request may not do what needs the scope; nothing if authorisation is off."""
    if not enabled:
        return
    key = presented(headers)
    status = 401 if key is None else allowed(spark.createDataFrame([(key,)], "key string"), keys, scope).head().status
    if status != 200:
        raise RequestError(status, "missing or unknown API key" if status == 401 else f"the key lacks the scope {scope}")
