"""Language-model scoring with a log-frequency Bloom filter (operator 5).

Tokens and bigrams of the training texts are counted exactly.  A bigram's count
c is quantised to level 1 + floor(log2(c)); it enters a Bloom filter once for
each level, and its level is read back by probing for level 1, 2, ... until one
is missing.  q is the middle of the counts that share a level.  Tokens keep their
exact counts, which the base score needs anyway, and beside it Q, the sum of q
over the bigrams that begin with them.  The probability of token v after h is

    (q(h, v) + K * u(v)) / (Q(h) + K) = w * q(h, v) / Q(h) + (1 - w) * u(v)

with w = Q(h) / (Q(h) + K), K = UNIGRAM_WEIGHT and u the base probability: over
all known tokens and one unknown token it sums to 1 after every h, but for what
false positives of the filter add.

Filter and token table are dealt into segments by the hash of a bigram's first
token; bigrams of the few most frequent first tokens are dealt by their own hash,
so no segment stands out.  A small model is broadcast.  A larger one is probed by
segment: texts are dealt into chunks, each chunk asks each segment for its
distinct tokens and bigrams, and the answers go back to the chunk.  Both ways
give the same scores; nothing is left out at any size.

Tokens are runs of anything but ASCII white space, A-Z lower-cased, then one end
of text, and are known by a 64-bit hash; a bigram by its first token's hash and
40 bits of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordhash

#: Most bytes of a model (filter and tokens) that is broadcast; a larger one is probed by segment.
MODEL_BYTES = 48 << 20
TOKEN_BYTES = 24
BITS_EACH = 12
PROBES = 4
#: Bytes of training text a segment, about; sets the number of segments, not less than 2**10 and not more than 2**14.
SEGMENT_BYTES = 16 << 20
LEAST_SEGMENTS, MOST_SEGMENTS = 10, 14
#: Bytes of the texts that ask the segments together, about.
CHUNK_BYTES = 8 << 20
#: Weight of the unigram, in occurrences of the history.
UNIGRAM_WEIGHT = 4.0
#: Tokens of which a task counts n-grams before it passes the counts on.
HELD = 3_000_000
#: Of those, tokens whose bigrams are hashed at a time.
SLICE = 1 << 18
#: Bytes of text in which frequent first tokens are looked for, and how many are dealt by bigram; this sets where counts lie, not what they are.
HOT_SAMPLE = 4 << 20
HOT = 256
ADDED = 0.1

_END = np.uint64(0x243F6A8885A308D3)
_START = np.uint64(0x13198A2E03707344)
_PAIR = np.uint64(0xA4093822299F31D1)
_TAIL = np.uint64((1 << 40) - 1)
_LOW = np.uint64((1 << 16) - 1)

#: Five times the middle of the counts of each level, as whole numbers: 1, then 1.4 times the least.
MIDDLE5 = np.array([0, 5, *(7 << n for n in range(1, 55))], np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, an end after each text, and each text's offset into them."""
    words, first = wordhash.words(*wordhash.buffers(texts), wordhash.IS_TOKEN)
    n = len(first) - 1
    out = np.full(len(words) + n, _END)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))] = words
    return out, first + np.arange(n + 1)


def history(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token before each token; the start of the text for its first."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[at[:-1]] = _START
    return before


def tails(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """40 bits of a bigram's hash, which tell it from others of the same first token."""
    return wordhash.mix64(h * _PAIR + t) >> np.uint64(24)


def bigrams(h: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The hash by which a bigram is in the filter: the upper 48 bits, which are told apart far better than a filter does."""
    return wordhash.mix64(h ^ (tail * _PAIR + np.uint64(1))) & ~_LOW


def held_out():
    """Whether crc32 of the id as text is divisible by 10; false for null."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def _packed(h: np.ndarray, *others: np.ndarray) -> bytes:
    """Ascending hashes and columns beside them: gaps and values by byte planes, as many as they need, compressed."""
    columns = [np.diff(h, prepend=np.uint64(0)), *(x.astype(np.uint64) for x in others)]
    wide = [-(-int(x.max(initial=0)).bit_length() // 8) for x in columns]
    planes = [(x >> np.uint64(8 * i)).astype(np.uint8) for x, w in zip(columns, wide, strict=True) for i in range(w)]
    raw = np.concatenate(planes).tobytes() if planes else b""
    return len(h).to_bytes(8, "little") + bytes(wide) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpacked(raw: bytes, columns: int = 1) -> list[np.ndarray]:
    n, wide = int.from_bytes(raw[:8], "little"), raw[8 : 8 + columns]
    size = n * sum(wide)
    planes = iter(np.frombuffer(pa.decompress(raw[8 + columns :], size, codec="zstd", asbytes=True), np.uint8).reshape(-1, n) if size else ())
    out = []
    for w in wide:
        x = np.zeros(n, np.uint64)
        for i in range(w):
            x |= next(planes).astype(np.uint64) << np.uint64(8 * i)
        out.append(x)
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _all_of(raws, columns: int) -> list[np.ndarray]:
    """The columns of many packed values, one after the other."""
    parts = [_unpacked(raw, columns) for raw in raws]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * columns


def _runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """Each value of an ascending array of whole numbers, with its first place and its end."""
    edges = np.flatnonzero(np.diff(x.astype(np.int64), prepend=-1, append=-2))
    return [(int(x[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _summed(h: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct h, ascending, and the sums of their values."""
    order = np.argsort(h)
    keys = h[order]
    new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return [keys[new], *(np.add.reduceat(v.astype(np.int64)[order], new) if len(new) else np.zeros(0, np.int64) for v in values)]


@dataclass
class Layout:
    """Where tokens and bigrams lie: 2**bits segments; hot first tokens, ascending."""

    bits: int
    hot: np.ndarray

    def of_tokens(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def is_hot(self, h: np.ndarray) -> np.ndarray:
        return self.hot[np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)] == h

    def of_bigrams(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        return self.of_tokens(np.where(self.is_hot(h), f, h))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).head()[0]


def layout(docs: DataFrame, hot_sample: int = HOT_SAMPLE) -> Layout:
    """A layout for docs' texts; its hot tokens are the most frequent of about hot_sample bytes of text."""
    size = text_bytes(docs)
    bits = int(np.clip(np.ceil(np.log2(max(1, size) / SEGMENT_BYTES)), LEAST_SEGMENTS, MOST_SEGMENTS))
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, hot_sample / max(1, size))))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, n = np.unique(tokens(batch.column("text"))[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    top = common.arrow_map(some.select("text"), count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HOT).collect()
    return Layout(bits, np.unique(np.append(np.array([r.h for r in top], np.int64).view(np.uint64), _START)))


@dataclass
class Counts:
    """Counts of tokens and bigrams: rows of kind 1 (tokens, counts, Q of the first tokens that aren't hot), 2 (bigrams and levels), 3 (parts of Q of hot first tokens), each for a segment."""

    rows: DataFrame
    layout: Layout


_COUNTS = "kind int, segment int, data binary, tokens long, known long, entries long"


def _count(lay: Layout):
    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Counts of the parts, which are emptied."""
        firsts = np.cumsum([0, *(len(x) for x, _ in parts[:-1])])
        begin = np.concatenate([at[:-1] + a for (_, at), a in zip(parts, firsts, strict=True)])
        t = np.concatenate([*(x for x, _ in parts), np.array([_START])])
        parts.clear()
        order = np.argsort(t)
        t = t[order]
        new = np.diff(t, prepend=~t[:1]) != 0
        vocabulary = t[new]
        del t
        rank = np.empty(len(order), np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32) - 1
        del order, new
        start, rank = rank[-1], rank[:-1]
        n = np.bincount(rank, minlength=len(vocabulary))
        before = np.empty_like(rank)
        before[1:] = rank[:-1]
        before[begin] = start
        both = np.empty(len(rank), np.uint64)
        for a in range(0, len(both), SLICE):
            x, y = before[a : a + SLICE], rank[a : a + SLICE]
            both[a : a + SLICE] = (x.astype(np.uint64) << np.uint64(40)) | tails(vocabulary[x], vocabulary[y])
        del before, rank
        both.sort()
        new = np.flatnonzero(np.diff(both, prepend=~both[:1]))
        c = np.diff(new, append=len(both))
        both = both[new]
        del new
        h, tail = vocabulary[(both >> np.uint64(40)).astype(np.int64)], both & _TAIL
        del both
        segment = lay.of_bigrams(h, bigrams(h, tail))
        order = np.argsort(segment.astype(np.uint16), kind="stable")  # by segment, then by first token
        h, tail, c, segment = h[order], tail[order], c[order], segment[order]
        twos = {s: _packed(h[a:b], tail[a:b], c[a:b]) for s, a, b in _runs(segment)}
        seen = n > 0
        vocabulary, n = vocabulary[seen], n[seen]
        ones = {s: _packed(vocabulary[a:b], n[a:b]) for s, a, b in _runs(lay.of_tokens(vocabulary))}
        names = sorted(ones.keys() | twos.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([ones.get(s) for s in names], pa.binary()), pa.array([twos.get(s) for s in names], pa.binary())], names=["segment", "ones", "twos"])

    def each(batches):
        parts, held = [], 0
        for batch in batches:
            for a, b in wordhash.slices(batch.column("text")):
                parts.append(tokens(batch.column("text").slice(a, b - a)))
                held += len(parts[-1][0])
                if held >= HELD:
                    yield rows(parts)
                    held = 0
                    common.give_back()
        batch = None
        if held:
            yield rows(parts)
        common.give_back()

    return each


def _add(lay: Layout):
    def each(batches):
        for table in common.groups(batches, ["segment"]):
            own = table["segment"][0].as_py()
            h, n = _summed(*_all_of(table["ones"].drop_null().to_pylist(), 2))
            first, tail, c = _all_of(table["twos"].drop_null().to_pylist(), 3)
            firsts = np.unique(first)
            key, c = _summed((np.searchsorted(firsts, first).astype(np.uint64) << np.uint64(40)) | tail, c)
            rank = (key >> np.uint64(40)).astype(np.int64)
            level = np.frexp(c.astype(np.float64))[1]
            starts = np.flatnonzero(np.diff(rank, prepend=-1))
            mass = np.add.reduceat(MIDDLE5[level], starts) if len(starts) else np.zeros(0, np.int64)  # each first token has a bigram
            f = bigrams(firsts[rank], key & _TAIL)
            order = np.argsort(f)
            hot = lay.is_hot(firsts)
            known, n, q = _summed(np.concatenate([h, firsts[~hot]]), np.concatenate([n, np.zeros(int((~hot).sum()), np.int64)]), np.concatenate([np.zeros(len(h), np.int64), mass[~hot]]))
            out = [(1, _packed(known, n, q), int(n.sum()), int((n > 0).sum()), 0), (2, _packed(f[order] >> np.uint64(16), level[order]), 0, 0, int(level.sum())), (3, _packed(firsts[hot], mass[hot]), 0, 0, 0)]
            kind, data, total, distinct, entries = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array([own] * 3, pa.int32()), pa.array(data, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, distinct, entries))], names=[x.split()[0] for x in _COUNTS.split(", ")])
        common.give_back()

    return each


def count_ngrams(docs: DataFrame, lay: Layout | None = None) -> Counts:
    """Counts of every token and bigram of docs' texts, written to the work folder."""
    lay = lay or layout(docs)
    parts = docs.select("text").mapInArrow(_count(lay), "segment int, ones binary, twos binary")
    added = parts.repartition(common.partitions(docs.sparkSession), "segment").sortWithinPartitions("segment").mapInArrow(_add(lay), _COUNTS)
    return Counts(common.written(added, "ngrams"), lay)


def _seeds(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of (bigram, level), from which all its probes follow."""
    x = wordhash.mix64(h + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return x, wordhash.mix64(x + np.uint64(1)) | np.uint64(1)


def _probe(x: np.ndarray, y: np.ndarray, i: int, bits) -> np.ndarray:
    """The i-th bit position inside the bigram's segment."""
    return ((x + np.uint64(i) * y) >> np.uint64(20)) % bits


def levels(data: np.ndarray, base: np.ndarray, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each bigram the levels found from 1 on, without a gap; base is its segment's first bit in data, bits how many it has."""
    out, live = np.zeros(len(h), np.int64), np.arange(len(h))
    for level in range(1, 64):
        x, y = _seeds(h[live], level)
        for i in range(PROBES):
            at = base[live] + _probe(x, y, i, bits[live])
            hit = (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live, x, y = live[hit], x[hit], y[hit]
        if not len(live):
            break
        out[live] = level
    return out


def segment_bits(counts: Counts, bits_each: int = BITS_EACH) -> np.ndarray:
    """Bits of each segment of the filter; a segment without bigrams has the least."""
    out = np.full(1 << counts.layout.bits, 64, np.uint64)
    for s, entries in counts.rows.where("kind = 2").groupBy("segment").agg(F.sum("entries")).collect():  # a row a segment
        out[s] = max(64, -(-entries * bits_each // 64) * 64)
    return out


def filter_pieces(counts: Counts, bits: np.ndarray) -> DataFrame:
    """segment and its bits, of segments that have bigrams."""

    def fill(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for s, raw in zip(batch.column("segment").to_pylist(), batch.column("data").to_pylist(), strict=True):
            h, level = _unpacked(raw, 2)
            h <<= np.uint64(16)
            flags = np.zeros(int(bits[s]), bool)
            for k in range(1, int(level.max(initial=0)) + 1):
                x, y = _seeds(h[level >= k], k)
                for i in range(PROBES):
                    flags[_probe(x, y, i, bits[s])] = True
            out.append(np.packbits(flags, bitorder="little").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(out, pa.binary())], names=["segment", "bits"])

    return common.arrow_map(counts.rows.where("kind = 2").select("segment", "data"), fill, "segment int, bits binary")


@dataclass
class Filter:
    """Bits of all segments, gathered."""

    data: np.ndarray
    base: np.ndarray  # first bit of each segment
    bits: np.ndarray
    layout: Layout

    def levels(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The levels found of bigrams f, which begin with h."""
        s = self.layout.of_bigrams(h, f)
        return levels(self.data, self.base[s], self.bits[s], f)


def build_filter(counts: Counts, bits: np.ndarray | None = None) -> Filter:
    """The filter of counts, gathered; its size is for the caller to bound."""
    bits = segment_bits(counts) if bits is None else bits
    base = np.cumsum(np.append(0, bits[:-1]), dtype=np.uint64)
    data = np.zeros(int(bits.sum()) // 8, np.uint8)
    for s, raw in filter_pieces(counts, bits).toLocalIterator():
        data[int(base[s]) // 8 : int(base[s] + bits[s]) // 8] = np.frombuffer(raw, np.uint8)
    return Filter(data, base, bits, counts.layout)


@dataclass
class Tokens:
    """Known tokens, ascending, with their counts and five times their Q."""

    h: np.ndarray
    n: np.ndarray
    q: np.ndarray

    def find(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and Q of each token; 0 of unknown ones."""
        if not len(self.h):
            return np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        at = np.minimum(np.searchsorted(self.h, t), len(self.h) - 1)
        there = self.h[at] == t
        return np.where(there, self.n[at], 0), np.where(there, self.q[at], 0)


def gather_tokens(rows) -> Tokens:
    """Tokens of the packed data of rows of kind 1 and 3."""
    by_kind: dict[int, list[bytes]] = {1: [], 3: []}
    for r in rows:
        by_kind[r.kind].append(r.data)
    h, n, q = _all_of(by_kind[1], 3)
    first, mass = _all_of(by_kind[3], 2)
    return Tokens(*_summed(np.concatenate([h, first]), np.concatenate([n, np.zeros(len(first), np.uint64)]), np.concatenate([q, mass])))


def probabilities(n: np.ndarray, q5: np.ndarray, before5: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Base and model probability of tokens: n the token's count, q5 and before5 five times the bigram's q and the first token's Q."""
    u = (n + ADDED) / norm
    return u, (q5 / 5 + UNIGRAM_WEIGHT * u) / (before5 / 5 + UNIGRAM_WEIGHT)


_SCORES = "held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(batch, find, find_levels, norm: float):
    """Record batches of batch's rows with their scores, by look-ups of tokens and of bigrams."""
    for a, b in wordhash.slices(batch.column("text")):
        piece = batch.slice(a, b - a)
        t, at = tokens(piece.column("text"))
        before = history(t, at)
        distinct, place = np.unique(np.append(t, _START), return_inverse=True)
        n, mass = (x[place] for x in find(distinct))
        n, mass = n[:-1], np.append(mass[-1], mass[:-2])  # Q of the token before each
        mass[at[:-1]] = mass[0]
        base, p = probabilities(n, MIDDLE5[find_levels(before, bigrams(before, tails(before, t)))], mass, norm)
        starts = at[:-1]
        columns = [piece.column("doc_id"), piece.column("held_out"), pa.array(np.diff(at)), pa.array(np.add.reduceat((n > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(np.log10(base), starts)), pa.array(np.add.reduceat(np.log10(p), starts))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(x.split()[0] for x in _SCORES.split(", "))])


def score_texts(docs: DataFrame, counts: Counts, *, model_bytes: int = MODEL_BYTES, chunk_bytes: int = CHUNK_BYTES, bits_each: int = BITS_EACH) -> DataFrame:
    """Scores of docs' rows by the n-grams in counts.

    Returns doc_id, held_out, n_tokens (with the end), n_known (tokens that were
    trained on), train_tokens, base_score (unigrams, ADDED added to each count)
    and score (the model's log10 probability of the text).  A null or empty text
    is an end alone; rows repeat as they come; with no training tokens all tokens
    are unknown.  Other columns are ignored.
    """
    spark = docs.sparkSession
    total, known, entries = counts.rows.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("tokens", "known", "entries"))).head()
    norm = total + ADDED * (known + 1)
    bits = segment_bits(counts, bits_each)
    source = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCORES}"
    if int(bits.sum()) // 8 + known * TOKEN_BYTES <= model_bytes:
        shared = spark.sparkContext.broadcast((build_filter(counts, bits), gather_tokens(counts.rows.where("kind <> 2").select("kind", "data").toLocalIterator())))

        def each(batches):
            bloom, table = shared.value
            for batch in batches:
                yield from _scored(batch, table.find, bloom.levels, norm)
            common.give_back()

        out = source.mapInArrow(each, kind)
    else:
        texts = source.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(text_bytes(docs) // chunk_bytes + 1)))
        out = _by_segment(texts, counts, bits, norm, kind)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def _asked(texts, lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens and bigrams that texts look up, ascending within segments, and the bigrams' segments."""
    ones, twos = [np.array([_START])], []
    for piece in texts.chunks:
        for a, b in wordhash.slices(piece):
            t, at = tokens(piece.slice(a, b - a))
            h = history(t, at)
            f = bigrams(h, tails(h, t))
            ones.append(np.unique(t))
            f, first = np.unique(f, return_index=True)
            twos.append((f, lay.of_bigrams(h[first], f)))
    f, first = np.unique(np.concatenate([x for x, _ in twos]), return_index=True)
    segment = np.concatenate([s for _, s in twos])[first]
    order = np.argsort(segment, kind="stable")
    return np.unique(np.concatenate(ones)), f[order], segment[order]


def _by_segment(texts: DataFrame, counts: Counts, bits: np.ndarray, norm: float, kind: str) -> DataFrame:
    """Scores of texts by a model that no worker holds as a whole."""
    spark, lay = texts.sparkSession, counts.layout
    hot = gather_tokens(counts.rows.where("kind = 3").select("kind", "data").toLocalIterator())  # at most HOT + 1 tokens
    spread = texts.repartition(common.partitions(spark), "chunk")  # one shuffle serves the asking and the scoring

    def ask(batches):
        for table in common.groups(batches, ["chunk"]):
            one, two, segment = _asked(table["text"], lay)
            rows = [(s, 1, _packed(one[a:b])) for s, a, b in _runs(lay.of_tokens(one))] + [(s, 2, _packed(two[a:b] >> np.uint64(16))) for s, a, b in _runs(segment)]
            at, kinds, data = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(kinds, pa.int32()), pa.array([table["chunk"][0].as_py()] * len(rows), pa.int64()), pa.array(data, pa.binary())], names=["segment", "kind", "chunk", "data"])
            del table, one, two, segment, rows, at, kinds, data
            common.give_back()

    def answer(batches):
        last, mine = None, None
        for batch in batches:
            out = []
            for s, k, chunk, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (s, k) != last:
                    last, mine = (s, k), Tokens(*[np.zeros(0, np.int64)] * 3) if k == 1 else np.zeros(int(bits[s]) // 8, np.uint8)
                if chunk < 0:  # the segment's own comes first
                    if k == 1:
                        h, n, q = _unpacked(raw, 3)
                        mine = Tokens(h, n.astype(np.int64), q.astype(np.int64))
                    else:
                        mine = np.frombuffer(raw, np.uint8)
                else:
                    h = _unpacked(raw)[0]
                    if k == 1:
                        got = _packed(np.zeros(len(h), np.uint64), *mine.find(h))
                    else:
                        h <<= np.uint64(16)
                        got = _packed(np.zeros(len(h), np.uint64), levels(mine, np.zeros(len(h), np.uint64), np.full(len(h), bits[s]), h))
                    out.append((chunk, k, s, got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "kind", "segment", "data"])
        common.give_back()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        one, two, _ = _asked(left["text"], lay)
        right = right.sort_by([("kind", "ascending"), ("segment", "ascending")])  # the order in which they were asked
        kinds, data = right["kind"].to_pylist(), right["data"].to_pylist()
        _, n, q = _all_of([d for k, d in zip(kinds, data, strict=True) if k == 1], 3)
        table = Tokens(one, n.astype(np.int64), q.astype(np.int64) + hot.find(one)[1])
        level = _all_of([d for k, d in zip(kinds, data, strict=True) if k == 2], 2)[1].astype(np.int64)
        order = np.argsort(two)
        two, level = two[order], level[order]
        look_up = lambda _, f: level[np.searchsorted(two, f)]
        del right, data, order
        common.give_back()
        out = pa.Table.from_batches([x for batch in left.to_batches() for x in _scored(batch, table.find, look_up, norm)])
        common.give_back()
        return out

    asked = spread.sortWithinPartitions("chunk").mapInArrow(ask, "segment int, kind int, chunk long, data binary")
    own = counts.rows.where("kind = 1").select("segment", "kind", F.lit(-1).cast("long").alias("chunk"), "data")
    own = own.unionByName(filter_pieces(counts, bits).select("segment", F.lit(2).alias("kind"), F.lit(-1).cast("long").alias("chunk"), F.col("bits").alias("data")))
    answers = own.unionByName(asked).repartition(common.partitions(spark), "segment").sortWithinPartitions("segment", "kind", "chunk").mapInArrow(answer, "chunk long, kind int, segment int, data binary")
    return spread.groupBy("chunk").cogroup(answers.repartition(common.partitions(spark), "chunk").groupBy("chunk")).applyInArrow(score, kind)


def score(docs: DataFrame, **options) -> DataFrame:
    """score_texts() of docs by a model of those rows that are not held out."""
    return score_texts(docs, count_ngrams(docs.where(~held_out())), **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents"))
