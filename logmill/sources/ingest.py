"""Batch ingest: raw bodies to Parquet by day."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import envelopes, report, validate
from ..schema import LOGS, REJECTED, RequestError
from . import sequence


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """path and value of each file below path, one JSON body each; gzip and deflate by extension."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def entries(bodies: DataFrame) -> DataFrame:
    """index and entry of every body that is accepted as a whole, with the body's other columns."""
    return unnested(envelopes(bodies).drop("value"))


def unnested(opened: DataFrame) -> DataFrame:
    """index and entry of bodies that envelopes() has opened, with their other columns."""
    return opened.where("error is null").select(*opened.drop("entries", "error").columns, F.posexplode("entries").alias("index", "entry"))


def offsets(opened: DataFrame) -> DataFrame:
    """path, and how many entries bodies of a lesser path have, of each body that envelopes() has opened; and its own number, size."""
    sizes = opened.groupBy("path").agg(F.sum(F.coalesce(F.size("entries"), F.lit(0))).alias("size"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a short row a body
    return sizes.select("path", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), "size")


def to_logs(valid: DataFrame, first_id: int = 0) -> DataFrame:
    """Valid rows in the table's form; ids are first_id, the entries of bodies `before` and the entry's index."""
    before = F.col("before") if "before" in valid.columns else F.lit(0)
    rows = valid.withColumns({"id": F.lit(first_id) + before + F.col("index"), "day": F.to_date("ts")})
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in LOGS))


def append(logs: DataFrame, path: str, batch: str | None = None) -> None:
    """Add rows to the table: a folder for each day and batch, files sorted for pruning by service, time and id.

    A batch that is written again replaces its own files.  Rows are dealt by day;
    adaptive execution cuts a day of many rows into several files of its own.
    """
    batch = batch or uuid.uuid4().hex
    rows = logs.withColumn("batch", F.lit(batch)).hint("rebalance", F.col("day")).sortWithinPartitions("day", "service", "ts", "id")
    # bloom filters on service let a reader skip row groups of other services
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#service", "true").option("parquet.bloom.filter.expected.ndv#service", "10000").partitionBy("day", "batch").parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows; none if it has none yet."""
    schema = T.StructType([*LOGS.fields, T.StructField("batch", T.StringType())])
    return spark.read.schema(schema).parquet(path).select(*LOGS.names)


def compact(spark: SparkSession, path: str, day: str) -> int:
    """Write a closed day's batches anew as one, and tell how many there were.

    The new files are complete before the old ones go; a reader that listed the day
    in between sees both, so days are compacted that nobody reads or writes.
    """
    old = [n for n in sequence.names(spark, f"{path}/day={day}") if n.startswith("batch=")]
    if len(old) < 2:
        return len(old)
    append(read_logs(spark, path).where(F.col("day") == F.lit(day).cast("date")), path, f"compact-{uuid.uuid4().hex}")
    for n in old:
        sequence.remove(spark, f"{path}/day={day}/{n}")
    return len(old)


def rejections(checked: DataFrame, opened: DataFrame) -> DataFrame:
    """What was not accepted: path, index (null for a whole body), reason, body (null for an entry)."""
    one = checked.where("reason is not null").select("path", "index", "reason", F.lit(None).cast("string").alias("body"))
    refused = opened.where("error is not null").select("path", F.lit(None).cast("int").alias("index"), F.col("error").alias("reason"), F.col("value").alias("body"))
    return one.unionByName(refused).select(*(F.col(f.name).cast(f.dataType) for f in REJECTED))


def ingest(spark: SparkSession, body: str, path: str, now: datetime | None = None) -> tuple[int, dict]:
    """Validate one body, append its accepted entries and tell the status and the reply."""
    now = now or datetime.now(UTC)
    bodies = spark.createDataFrame([(body,)], "value string")
    error = envelopes(bodies).select("error").head()[0]
    if error:
        raise RequestError(413 if error == "request body too large" else 400, error)
    checked = validate(entries(bodies), now).drop("entry").cache()
    try:
        results = [r.asDict() for r in checked.select("index", "reason").collect()]  # bounded by the body's entries
        if any(r["reason"] is None for r in results):
            append(to_logs(checked.where("reason is null"), sequence.reserve(spark, path, len(results))), path)
    finally:
        checked.unpersist()
    return report(results)


def ingest_folder(spark: SparkSession, source: str, path: str, rejected: str, now: datetime | None = None) -> dict:
    """Ingest every body below source in one batch; refused bodies and entries go to the table of rejections."""
    batch = uuid.uuid4().hex
    write(spark, read_bodies(spark, source), path, rejected, batch, now)
    rows = spark.read.schema(T.StructType([*REJECTED.fields, T.StructField("batch", T.StringType())])).parquet(rejected).where(F.col("batch") == batch)
    return {"batch": batch, "rejected": rows.count()}


def write(spark: SparkSession, bodies: DataFrame, path: str, rejected: str, batch: str, now: datetime | None = None) -> None:
    """Write one batch of bodies (path, value); written again, it has the same ids and clock and replaces its own files."""
    opened = envelopes(bodies.select("path", "value")).cache()  # each body is parsed once
    before = offsets(opened).cache()
    total = before.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    first, now = sequence.once(spark, path, batch, total, now)
    checked = validate(unnested(opened.drop("value")).join(before.select("path", "before"), "path"), now).drop("entry").cache()
    try:
        append(to_logs(checked.where("reason is null"), first), path, batch)
        rejections(checked, opened).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rejected)
    finally:
        for df in (checked, before, opened):
            df.unpersist()
