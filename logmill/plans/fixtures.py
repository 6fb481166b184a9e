"""The driver's tables as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def logs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the shape of logs, without the partition column."""
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    code = F.when(F.col("event_type") == "click", 0).when(F.col("event_type").isin("view", "signup"), 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return e.select(
        F.col("event_id").alias("id"), "ts", code.alias("level_code"), F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("service"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("message"), F.col("props").alias("attributes"), F.col("value"),
    )


LOGS_SQL = """(select event_id as id, ts, case event_type when 'click' then 0 when 'view' then 1 when 'signup' then 1 when 'purchase' then 2 else 3 end as level_code,
  'svc-' || cast(user_id % 8 as varchar) as service, event_type || ' by user ' || cast(user_id as varchar) as message, props as attributes, value from events) logs"""


def dictionary(spark: SparkSession) -> DataFrame:
    """A dictionary that lacks svc-7."""
    return spark.range(7).select(F.col("id").cast("int").alias("service_id"), F.concat(F.lit("svc-"), F.col("id").cast("string")).alias("name"))


DICTIONARY_SQL = "(select cast(i as integer) as service_id, 'svc-' || cast(i as varchar) as name from range(7) t(i)) dict"
