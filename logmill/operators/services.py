"""The service dictionary: look-ups, registration and semi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a dictionary up to which it is broadcast.
MOST_BROADCAST = 64 << 20


def _side(dictionary: DataFrame) -> DataFrame:
    """The dictionary, broadcast if its rows and names are small; a join that adaptive execution plans else."""
    rows, size = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("name").cast("long")), F.lit(0))).head()
    return F.broadcast(dictionary) if size + 32 * rows <= MOST_BROADCAST else dictionary


def with_names(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows with `service` of their service_id; unknown ids become unknown-<id>."""
    d = _side(dictionary.select("service_id", "name"))
    return rows.join(d, "service_id", "left").withColumn("service", F.coalesce("name", F.concat(F.lit("unknown-"), F.col("service_id").cast("string")))).drop("name")


def with_ids(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows with their service's service_id; a service that the dictionary lacks is an error."""
    d = _side(dictionary.select("service_id", "name"))
    missing = F.raise_error(F.concat(F.lit("unregistered service: "), F.coalesce("service", F.lit("null")))).cast("int")
    return rows.join(d, rows["service"] == F.col("name"), "left").withColumn("service_id", F.coalesce("service_id", missing)).drop("name")


def unregistered(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct services of rows that the dictionary lacks."""
    return rows.select("service").distinct().join(dictionary.select(F.col("name").alias("service")), "service", "left_anti")


def register(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The dictionary with new services added, numbered on by name."""
    last = dictionary.agg(F.coalesce(F.max("service_id"), F.lit(0))).head()[0]
    new = unregistered(rows, dictionary).select((F.row_number().over(Window.orderBy("service")) + last).alias("service_id"), F.col("service").alias("name"))
    return dictionary.select("service_id", "name").unionByName(new)


def of_services(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows whose service is among names."""
    return rows.join(names.select(F.col("name").alias("service")), "service", "left_semi")


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new, which replace those of equal key."""
    return table.join(new, key, "left_anti").unionByName(new)
