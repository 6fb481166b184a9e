"""What the operators share: the work folder, written stages and Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes an operator broadcasts; larger sides go through a shuffle.
BROADCAST_BYTES = 64 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local master gets a folder of its own; on a
    cluster that would be a machine-local folder, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="logmill-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a fresh folder in the work folder, removed when Python ends."""
    path = f"{work_dir(spark)}/logmill-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of df as a table in the work folder, partitioned by `by`: later reads recompute nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the folder of a written() table that no later plan reads."""
    remove(df.sparkSession, df.folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def plain(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The columns `names` of df (all), called c0, c1, ..., which no operator calls its own columns."""
    names = df.columns if names is None else names
    return df.select(*(F.col(quoted(name)).alias(f"c{i}") for i, name in enumerate(names)))


def named(names: list[str]) -> list[Column]:
    """The columns of plain() by the names that they had."""
    return [F.col(f"c{i}").alias(name) for i, name in enumerate(names)]


def kinds(df: DataFrame, more: str) -> T.StructType:
    """The schema of df and of further columns after it, all nullable."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema] + T.StructType.fromDDL(more).fields)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow of a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = out = None
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None and out.num_rows:
                yield out
        del batch, out
        give_back()

    return df.mapInArrow(each, schema)


def give_back() -> None:
    """Return this worker's freed memory to the system: allocators keep it, and reused workers would hold it through all later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a partition sorted by them, one at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        columns = list(zip(*(table[k].to_pylist() for k in keys), strict=True))
        start = 0
        for i, key in enumerate(columns):
            if key != last:
                if i > start:
                    held.append(table.slice(start, i - start))
                if held:
                    yield pa.concat_tables(held)
                held, start, last = [], i, key
        held.append(table.slice(start))
    if held:
        yield pa.concat_tables(held)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def one_thread() -> None:
    """Keep native libraries to the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["OMP_NUM_THREADS"] = "1"
