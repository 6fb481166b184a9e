"""Synthetic logs for benches and tests, made where they are needed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import level_name
from ..functions.timeparse import format_ms

#: Eight services, and the share of each level in percent, by code.
SERVICES = ("gateway", "accounts", "catalogue", "orders", "billing", "search", "mailer", "reports")
SHARES = (20, 60, 15, 5)


def generate(spark: SparkSession, rows: int, first: datetime, days: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """`rows` logs spread evenly over `days` from `first` on, the same for the same arguments: id, ts, level_code, service, message, attributes."""
    n = spark.range(1, rows + 1, 1, partitions or spark.sparkContext.defaultParallelism)
    draw = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(most))
    step = days * 86_400_000_000 // max(1, rows)
    level, at = F.lit(len(SHARES) - 1), draw(1, 100)
    for code in reversed(range(len(SHARES) - 1)):
        level = F.when(at < sum(SHARES[: code + 1]), code).otherwise(level)
    ts = F.timestamp_micros(F.lit(int(first.timestamp() * 1_000_000)) + (F.col("id") - 1) * step + draw(2, max(1, step)))
    names = F.array(*map(F.lit, SERVICES))
    message = F.concat_ws(" ", F.lit("request"), F.hex(draw(4, 1 << 32)), F.lit("handled in"), draw(5, 900).cast("string"), F.lit("ms"))
    attributes = F.to_json(F.struct(draw(6, 5000).cast("string").alias("user"), draw(7, 600).alias("status"), (draw(8, 10) == 0).alias("retried"), draw(9, 4).alias("zone"), F.hex(draw(10, 1 << 40)).alias("trace")))
    return n.select("id", ts.alias("ts"), level.cast("int").alias("level_code"), F.element_at(names, (draw(3, len(SERVICES)) + 1).cast("int")).alias("service"), message.alias("message"), attributes.alias("attributes"))


def bodies(logs: DataFrame, size: int = 500) -> DataFrame:
    """value: JSON bodies of `size` entries each, as clients send them."""
    entry = F.struct(format_ms(F.col("ts")).alias("timestamp"), level_name(F.col("level_code")).alias("level"), "service", "message", F.from_json("attributes", "map<string,string>").alias("attributes"))
    batch = F.floor((F.col("id") - 1) / size)
    return logs.groupBy(batch.alias("batch")).agg(F.to_json(F.struct(F.collect_list(entry).alias("logs"))).alias("value")).select("value")
