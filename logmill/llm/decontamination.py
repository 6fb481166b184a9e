"""Benchmark decontamination with one Aho-Corasick automaton (operator 9).

Texts are normalised to their words, A-Z lower-cased, with one space around
each.  The automaton's patterns are anchors: ANCHOR words, one anchor every
WINDOW - ANCHOR + 1 words of each benchmark item, so that every window of the
item holds one.  Each document is scanned once; the few windows around an anchor
that it holds are looked up by a hash of their words and confirmed on the words
themselves.  So the automaton has fewer nodes than the benchmark has bytes, where
windows as patterns would take some ten for each.  Matches map to words, and
those to code point spans of the original text.
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

WINDOW = 13
#: Words of an anchor.
ANCHOR = 5
#: Bytes of benchmark text in one automaton; a larger benchmark is scanned in
#: slices of so much, each by an automaton of its own.  A test measures its memory.
SLICE_BYTES = 8 << 20

_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PATTERNS: dict = {}


def words(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


def windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    """What no document should hold of an item: every `size` words in a row; all its words if it has fewer, but not none."""
    w = words(text)
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def _line(w: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Words with one space around each, and where the spaces are: word i lies between space i and space i + 1."""
    line = b" " + b" ".join(w) + b" "
    return line, np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)


class Patterns:
    """All windows of benchmark items, and an automaton of their anchors.

    A window (see windows()) is known by where its words lie in `text`, which has
    all items' words once.
    """

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        import ahocorasick

        self.size = size
        anchor = min(ANCHOR, size)
        lines, begins, ends, owners, at = [], [], [], [], 0
        sizes: dict[str, set[int]] = {}  # by anchor, how many words the windows have that hold it
        for n, (_, text) in enumerate(items):
            if not (w := words(text)):
                continue
            line, spaces = _line(w)
            k = min(size, len(w))
            begins.append(at + spaces[: len(w) - k + 1])
            ends.append(at + spaces[k:] + 1)
            owners.append(np.full(len(w) - k + 1, n, np.int32))
            for i in range(0, max(1, len(w) - anchor + 1), size - anchor + 1):
                sizes.setdefault(line[spaces[i] : spaces[min(i + anchor, len(w))] + 1].decode("latin-1"), set()).add(k)
            lines.append(line)
            at += len(line)
        self.text = b"".join(lines)
        self.begins, self.ends, self.owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends, owners))
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(self.text[a:b]) for a, b in zip(self.begins, self.ends, strict=True)), np.uint64, len(self.begins))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.begins, self.ends, self.owners = (x[order] for x in (self.hashes, self.begins, self.ends, self.owners))
        self.automaton = ahocorasick.Automaton()
        for x, ks in sizes.items():
            self.automaton.add_word(x, (x.count(" ") - 1, tuple(sorted(ks))))
        if sizes:
            self.automaton.make_automaton()

    def holders(self, window: bytes) -> np.ndarray:
        """The items that have the window, as often as they have it."""
        h = np.uint64(xxhash.xxh3_64_intdigest(window))
        a, b = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        same = [i for i in range(a, b) if self.text[self.begins[i] : self.ends[i]] == window]
        return self.owners[same]

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[int]]:
        """Words of a text, which of them a window covers, and the items found."""
        w = words(text)
        if not w or not len(self.hashes):
            return len(w), np.zeros(0, np.int64), set()
        line, spaces = _line(w)
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return len(w), np.zeros(0, np.int64), set()
        ends = np.searchsorted(spaces, [end for end, _ in found])
        tries = set()
        for end, (_, (n, sizes)) in zip(ends.tolist(), found, strict=True):
            for k in sizes:
                first = end - n if k < self.size else end - n - (k - n)  # an item of fewer words begins with its anchor
                tries.update((x, k) for x in range(max(0, first), min(end - n, len(w) - k) + 1))
        cover, who = np.zeros(len(w) + 1, np.int64), set()
        for x, k in tries:
            if len(got := self.holders(line[spaces[x] : spaces[x + k] + 1])):
                cover[x] += 1
                cover[x + k] -= 1
                who.update(got.tolist())
        return len(w), np.flatnonzero(np.cumsum(cover[:-1]) > 0), who


def patterns(key: str, items: list[tuple[str, str]], size: int) -> Patterns:
    """The patterns of items, built once in a worker."""
    if key not in _PATTERNS:
        _PATTERNS.clear()
        _PATTERNS[key] = Patterns(items, size)
    return _PATTERNS[key]


def hit_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans, end exclusive, of runs of covered words in the original text."""
    if not len(hit):
        return []
    raw = np.frombuffer(text.encode(), np.uint8)
    flag = np.frombuffer(raw.tobytes().translate(_FOLD), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [(int(points[edge[2 * r[0]]]), int(points[edge[2 * r[-1] + 1]])) for r in runs]


def item_slices(benchmark: DataFrame, most: int = SLICE_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Benchmark items, streamed to the driver in slices of at most so many bytes (one item at least).

    Items whose id is null share the name "".
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    part, size = [], 0
    for item, text in rows.toLocalIterator():
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += len(text)
    if part:
        yield part


def _runs(hit: np.ndarray) -> list[int]:
    """First and end of each run of words, in turn."""
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    return np.stack([np.append(hit[:1], hit[cut + 1]), np.append(hit[cut], hit[-1:]) + 1], axis=1).ravel().tolist()


def _outcome(text: str | None, n: int, hit: np.ndarray, items: list[str]) -> tuple:
    return n, len(hit), sorted(items), [list(x) for x in hit_spans(text, hit)]


_OUTCOME = "n_words long, n_hit long, items array<string>, hit_spans array<array<long>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, keep: list[str] | None = None) -> DataFrame:
    """What of the benchmark each document holds.

    Returns, for each row of docs: the columns in `keep` (doc_id), n_words,
    n_hit (words inside any occurrence of a window), items (array of the ids of
    items with an occurring window, ascending as strings, each once), hit_spans
    (array of start and end code points of runs of hit words), contaminated
    (n_hit > 0 and 20 * n_hit >= n_words).  A null or empty text has no words
    and no hits; an empty benchmark hits nothing; items whose id is null share
    the name ""; rows repeat as they come.  Columns of docs beside `keep` and
    text are ignored, whatever their names.
    """
    keep = ["doc_id"] if keep is None else keep
    rows, name = _examined(docs, benchmark, keep, window, slice_bytes)
    return rows.select(*common.named(keep), *name, F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, all columns, whatever their names."""
    rows, _ = _examined(docs, benchmark, docs.columns, options.get("window", WINDOW), options.get("slice_bytes", SLICE_BYTES))
    return rows.where("not (n_hit > 0 and 20 * n_hit >= n_words)").select(*common.named(docs.columns))


def _examined(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int, slice_bytes: int) -> tuple[DataFrame, list[str]]:
    """c0, c1, ... for the columns in keep and what decontaminate() finds; and the names of the latter."""
    spark = docs.sparkSession
    names = keep if "text" in keep else [*keep, "text"]
    at, rows = names.index("text"), common.plain(docs, names)
    out = common.kinds(rows.select(*rows.columns[: len(keep)]), _OUTCOME)

    def each(found):
        def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = zip(*found(batch), strict=True) if batch.num_rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=out.names)

        return rows_of

    slices = item_slices(benchmark, slice_bytes)
    first, second = next(slices, []), next(slices, None)
    if second is None:
        look = scanner(spark, first, window)

        def scan(batch: pa.RecordBatch) -> list[tuple]:
            return [_outcome(text, n, hit, who) for text in batch.column(at).to_pylist() for n, hit, who in [look(text)]]

        return common.arrow_map(rows, each(scan), out), out.names[len(keep) :]

    # more than one automaton: what each finds is written, for texts with hits only, and joined to the rows at the end
    key = F.md5(F.col(f"c{at}").cast("binary"))
    texts = rows.select(key.alias("key"), F.col(f"c{at}").alias("text"))
    parts, part = [], first
    while part is not None:
        look = scanner(spark, part, window)

        def hits(batch: pa.RecordBatch, look=look) -> pa.RecordBatch:
            got = [(k, _runs(hit), sorted(who)) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, hit, who in [look(text)] if len(hit)]
            columns = zip(*got, strict=True) if got else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)], names=["key", "runs", "items"])

        parts.append(common.written(common.arrow_map(texts, hits, "key string, runs array<long>, items array<string>").dropDuplicates(["key"]), "hits"))
        part, second = second, next(slices, None)
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    merged = common.written(every.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "hits")
    for p in parts:
        common.forget(p)
    joined = rows.withColumn("key", key).join(merged, "key", "left").select(*rows.columns, "runs", "items")

    def gathered(batch: pa.RecordBatch) -> list[tuple]:
        result = []
        for text, runs, who in zip(*(batch.column(i).to_pylist() for i in (at, len(names), len(names) + 1)), strict=True):
            n = len(words(text))
            cover = np.zeros(n, bool)
            for a, b in zip(runs[::2], runs[1::2], strict=True) if runs else ():
                cover[a:b] = True
            result.append(_outcome(text, n, np.flatnonzero(cover), who or []))
        return result

    return common.arrow_map(joined, each(gathered), out), out.names[len(keep) :]


def scanner(spark: SparkSession, items: list[tuple[str, str]], window: int):
    """Scans a text for items: its words, those that a window covers, and the ids of the items found."""
    shared = spark.sparkContext.broadcast(items)
    key = f"{window}-{hashlib.md5(repr(items).encode()).hexdigest()}"

    def look(text: str | None) -> tuple[int, np.ndarray, set[str]]:
        n, hit, who = patterns(key, shared.value, window).scan(text)
        return n, hit, {shared.value[i][0] for i in who}

    return look


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of decontaminate()'s rows."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with d as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
items as (select item_id, {_WORDS} as w from benchmark),
iw as (select distinct item_id, least(len(w), {WINDOW}) as k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') as x
       from items, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) t(i) where len(w) > 0),
dw as (select row, i, s.k, array_to_string(w[i:i + s.k - 1], ' ') as x
       from d, (select distinct k from iw) s, unnest(range(1, len(w) - s.k + 2)) t(i)),
hits as (select row, i, iw.k, item_id from dw join iw on dw.k = iw.k and dw.x = iw.x),
per as (select row, count(distinct pos) as n_hit from hits, unnest(range(i, i + k)) t(pos) group by row),
who as (select row, count(*) as n_items, string_agg(item, ',' order by item) as items
        from (select distinct row, cast(item_id as varchar) as item from hits) group by row)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join per using (row) left join who using (row)"""
