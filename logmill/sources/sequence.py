"""Blocks of ids, and what a batch must find again when it is replayed.

Both lie in hidden folders of the table, which readers of its rows pass over, and
are made by creating a file that must not exist, so that writers exclude each other.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def create(spark: SparkSession, path: str, text: str = "") -> bool:
    """Write a file that is not there yet; False if it is."""
    fs, where = _fs(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError:
        if fs.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read(spark: SparkSession, path: str) -> str | None:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def reserve(spark: SparkSession, table: str, count: int) -> int:
    """The first of `count` ids that nobody else gets; ids begin at 1."""
    folder = f"{table}/_sequence"
    while True:
        taken = sorted(int(n) for n in names(spark, folder) if n.isdigit())
        last = taken[-1] if taken else 0
        if create(spark, f"{folder}/{last + count:019d}"):
            for old in taken[:-1]:
                remove(spark, f"{folder}/{old:019d}")
            return last + 1


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def once(spark: SparkSession, table: str, batch: str, count: int, now: datetime | None = None) -> tuple[int, datetime]:
    """The first id and the clock of a batch: the same at every replay of it.

    count is taken as ids at the first call only.
    """
    path = f"{table}/_batches/{batch}"
    if (known := read(spark, path)) is None:
        first = {"first": reserve(spark, table, max(1, count)), "now": (now or datetime.now(UTC)).isoformat()}
        if create(spark, path, json.dumps(first)):
            known = json.dumps(first)
        else:
            known = read(spark, path)
    got = json.loads(known)
    return got["first"], datetime.fromisoformat(got["now"])
