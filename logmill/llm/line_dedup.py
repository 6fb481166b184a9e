"""Line dedup with levelled sorted runs of line hashes (operator 6).

A run is a table of (h1, h2, docs), sorted by hash: how many documents of the
batches it covers hold a line of that hash.  A new batch is merged against the
runs (lines that are already known to be common are anti-joined away) and adds
a run of its own at level 0.  FANOUT runs of one level are compacted into one
run of the next, so each hash is rewritten once a level and a corpus of n
batches has O(log n) runs.

A line's key is the line without white space `[\\x20\\x09-\\x0D]` at both ends and
with A-Z lower-cased; keys are held as 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_DOCS = 10
MIN_CHARS = 1
FANOUT = 4
#: Distinct hashes that a task counts before it passes them on.
HELD = 200_000
#: Common hashes that are sent to all workers at most; beyond, they are joined.
BROADCAST_HASHES = 1_000_000
_BLANK = b" \t\n\v\f\r"
_PAIR = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def line_hashes(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """A 16-byte hash of each line's key, None for keys that are too short to count."""
    digest = xxhash.xxh3_128_digest
    keys = [k.strip(_BLANK) for k in (text or "").encode().lower().split(b"\n")]
    if min_chars <= 1:
        return [digest(k) if len(k) >= min_chars else None for k in keys]
    return [digest(k) if len(k.decode()) >= min_chars else None for k in keys]


def _rows(counts: list[dict[bytes, int]]) -> pa.RecordBatch:
    pairs = np.frombuffer(b"".join(h for c in counts for h in c), _PAIR)
    columns = [np.repeat(np.arange(len(counts), dtype=np.int32), [len(c) for c in counts]), np.ascontiguousarray(pairs["h1"]), np.ascontiguousarray(pairs["h2"])]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([n for c in counts for n in c.values()], pa.int64())], names=["batch", "h1", "h2", "docs"])


def count_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = 1) -> DataFrame:
    """In how many rows of docs each line hash lies: batch, h1, h2, docs.

    Rows are dealt to batches by a hash of their text.
    """

    def each(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[dict[bytes, int]] = [{} for _ in range(batches)]
        for batch in arrived:
            for text in batch.column(0):
                text = text.as_py() or ""
                own = counts[xxhash.xxh3_64_intdigest(text.encode()) % batches if batches > 1 else 0]
                for h in set(line_hashes(text, min_chars)):
                    if h is not None:
                        own[h] = own.get(h, 0) + 1
                if sum(map(len, counts)) > HELD:
                    yield _rows(counts)
                    counts = [{} for _ in range(batches)]
        if any(counts):
            yield _rows(counts)

    return docs.select("text").mapInArrow(each, "batch int, h1 long, h2 long, docs long").groupBy("batch", "h1", "h2").agg(F.sum("docs").alias("docs"))


class Runs:
    """Levelled sorted runs in the work folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def _write(self, counts: DataFrame) -> DataFrame:
        return common.written(counts.sortWithinPartitions("h1", "h2"), "run")

    def merged(self, runs: list[DataFrame] | None = None) -> DataFrame:
        """The counts of all runs, or of those given, summed by hash."""
        runs = [r for level in self.levels for r in level] if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long")
        if len(runs) == 1:
            return runs[0]
        all_rows = runs[0]
        for r in runs[1:]:
            all_rows = all_rows.unionByName(r)
        return all_rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))

    def add(self, counts: DataFrame) -> None:
        """Add a batch's run (h1, h2, docs) and compact each level that is full.

        Lines that the runs know to be common stay so; the batch's run is merged
        against them and keeps the others.
        """
        counts = counts.select("h1", "h2", "docs")
        if any(self.levels):
            counts = counts.join(self.common(), ["h1", "h2"], "left_anti")
        run, level = self._write(counts), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            run = self._write(self.merged(full))
            for old in full:
                common.forget(old)
            level += 1

    def common(self) -> DataFrame:
        """Hashes of lines in at least min_docs documents so far."""
        return self.merged().where(F.col("docs") >= self.min_docs).select("h1", "h2")


def drop_lines(docs: DataFrame, hashes: DataFrame, *, min_chars: int = MIN_CHARS, keep: list[str] | None = None, most: int = BROADCAST_HASHES) -> DataFrame:
    """docs without their lines of the given hashes: the columns in keep, text, n_lines, n_dropped.

    Up to `most` hashes are sent to the workers; more are joined with the
    documents' lines, dealt by hash.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    schema = ", ".join([*kinds, "text string, n_lines long, n_dropped long"])

    def dropped(batch: pa.RecordBatch, sets) -> pa.RecordBatch:
        texts, lines, gone = [], [], []
        for text, bad in zip(batch.column("text"), sets, strict=True):
            text = text.as_py() or ""
            own = text.split("\n")
            left = [x for x, h in zip(own, line_hashes(text, min_chars), strict=True) if h is None or h not in bad]
            texts.append("\n".join(left))
            lines.append(len(own))
            gone.append(len(own) - len(left))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*keep, "text", "n_lines", "n_dropped"])

    hashes = common.written(hashes, "lines")
    if hashes.count() <= most:
        table = hashes.toArrow()
        pairs = np.empty(table.num_rows, _PAIR)
        pairs["h1"], pairs["h2"] = table["h1"].to_numpy(), table["h2"].to_numpy()
        shared = spark.sparkContext.broadcast(pairs.tobytes())
        cached: list[frozenset] = []

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not cached:
                data = shared.value
                cached.append(frozenset(data[i : i + 16] for i in range(0, len(data), 16)))
            return dropped(batch, cached * batch.num_rows)

        return common.arrow_map(docs.select(*keep, "text"), each, schema)

    def own_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [sorted(set(line_hashes(t.as_py(), min_chars)) - {None}) for t in batch.column("text")]
        pairs = np.frombuffer(b"".join(h for x in own for h in x), _PAIR)
        at = np.repeat(np.arange(len(own)), [len(x) for x in own])
        return pa.RecordBatch.from_arrays([batch.column("th").take(pa.array(at)), batch.column("tl").take(pa.array(at)), pa.array(np.ascontiguousarray(pairs["h1"])), pa.array(np.ascontiguousarray(pairs["h2"]))], names=["th", "tl", "h1", "h2"])

    def by_join(batch: pa.RecordBatch) -> pa.RecordBatch:
        return dropped(batch, [{b"".join(int(x).to_bytes(8, "little", signed=True) for x in (p["h1"], p["h2"])) for p in (bad or [])} for bad in batch.column("bad").to_pylist()])

    # equal texts lose equal lines, so a text's hash stands for its rows
    marked = docs.select(*keep, "text").withColumns({"th": F.xxhash64("text"), "tl": F.xxhash64(F.lit(1), "text")})
    lines = common.arrow_map(marked.select("th", "tl", "text"), own_lines, "th long, tl long, h1 long, h2 long").distinct()
    bad = lines.join(hashes, ["h1", "h2"], "left_semi").groupBy("th", "tl").agg(F.collect_list(F.struct("h1", "h2")).alias("bad"))
    both = marked.alias("d").join(bad.alias("b"), (F.col("d.th") == F.col("b.th")) & (F.col("d.tl") == F.col("b.tl")), "left")
    return common.arrow_map(both.select(*(F.col(f"d.`{c}`") for c in keep), "d.text", "b.bad"), by_join, schema)


def dedup_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = 4, fanout: int = FANOUT, keep: list[str] | None = None, most: int = BROADCAST_HASHES) -> DataFrame:
    """docs without the lines whose key lies in at least min_docs documents.

    The documents enter the runs in `batches` batches, by a hash of their text.
    Each row of docs counts as a document, repeated rows too; a null or empty
    text is one empty line; lines whose key has fewer than min_chars code points
    always stay.  Returns the columns in keep (doc_id), text (what stays),
    n_lines (before dropping) and n_dropped; no rows give no rows.  Other
    columns of docs are ignored, whatever their names.
    """
    runs = Runs(docs.sparkSession, min_docs, fanout)
    counts = common.written(count_lines(docs, min_chars, batches), "counts", by=("batch",))
    for b in range(batches):
        runs.add(counts.where(F.col("batch") == b))
    common.forget(counts)
    return drop_lines(docs, runs.common(), min_chars=min_chars, keep=keep, most=most)


def filter_new(runs: Runs, batch: DataFrame, *, min_chars: int = MIN_CHARS, keep: list[str] | None = None) -> DataFrame:
    """A new batch without the lines that are common in it and the runs; the batch then belongs to the runs.

    The rows are as from dedup_lines().
    """
    runs.add(count_lines(batch, min_chars))
    return drop_lines(batch, runs.common(), min_chars=min_chars, keep=keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.read(spark, sf_dir, "documents"), batches=4)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
with numbered as (select row_number() over () as row, doc_id, text from documents), lines as (
  select row, doc_id, u.i, u.line,
         trim(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPACE}) as key
  from numbered d, lateral (select unnest(string_split(coalesce(text, ''), chr(10))) as line,
                                    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i) u),
bad as (select key from lines where length(key) >= {MIN_CHARS} group by key having count(distinct row) >= {MIN_DOCS}),
marked as (select l.*, b.key is not null as gone from lines l left join bad b on l.key = b.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by row, doc_id"""
