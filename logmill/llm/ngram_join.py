"""N-gram Jaccard join by MinHash banding (operator 8).

Texts with equal word sequences form a class.  Each class has a MinHash
signature over its shingles of five words; bands of it are shuffled, and classes
that meet in a band become candidates.  Candidates whose signatures agree are
gathered into clusters, in which all pairs are verified on their full shingle
sets, block by block, as bit sets over the shingles that at least two members
hold.  A link is a pair of rows with a Jaccard similarity of at least 0.8.

A pair at the threshold meets in a band with probability
1 - (1 - 0.8**ROWS)**BANDS, which ROWS and BANDS (banding()) bring above the
target recall.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordhash
from .components import LINKS, Links, block_pairs, components, group_heads

THRESHOLD = 0.8
RECALL = 0.9999
#: Candidates whose signatures agree in less than THRESHOLD minus this are no pair: over five standard deviations.
SLACK = 0.2
#: Classes in a band's bucket that are compared by signature; a larger bucket becomes one cluster.
BUCKET = 1000
#: Shingles in a block of a cluster; a text counts for LEAST_SHINGLES at least, which bounds a block's members too.
BLOCK_SHINGLES = 1 << 19
LEAST_SHINGLES = 1 << 8
#: Distinct shared shingles that a bit set holds at a time.
BITS = 1 << 13


def banding(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5) -> tuple[int, int]:
    """Bands and rows of each for a recall at the threshold."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))), rows


class Signer:
    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.Generator(np.random.PCG64(11))
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
        """32-bit minima of each row's shingles; rows without shingles are left out."""
        starts = at[:-1][np.diff(at) > 0]
        out = np.empty((len(starts), len(self.a)), np.uint32)
        for k, a in enumerate(self.a):
            out[:, k] = np.minimum.reduceat((shingles * a >> np.uint64(32)).astype(np.uint32), starts) if len(starts) else 0
        return out

    def band_hashes(self, signatures: np.ndarray) -> np.ndarray:
        x = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64) @ self.mix
        return wordhash.mix64(x + np.arange(self.bands, dtype=np.uint64)).astype(np.int64)


def class_keys(words: np.ndarray, first: np.ndarray) -> list[str | None]:
    """A 128-bit hash of each row's word sequence in hex, null for rows without words."""
    counts = np.diff(first)
    place = wordhash.mix64((np.arange(len(words)) - np.repeat(first[:-1], counts)).astype(np.uint64))
    halves = []
    for salt in (np.uint64(0x51ED270B), np.uint64(0xC2B2AE3D27D4EB4F)):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(wordhash.mix64((words ^ salt) * (place | np.uint64(1)) + place), out=sums[1:])
        halves.append(sums[first[1:]] - sums[first[:-1]])
    return [f"{a:016x}{b:016x}" if n else None for a, b, n in zip(*(h.tolist() for h in halves), counts, strict=True)]


def _sign(bands: int, rows: int):
    signer = Signer(bands, rows)

    def each(batches):
        for batch in batches:
            for a, b in wordhash.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                words, first = wordhash.words(*wordhash.buffers(part.column("text")))
                shingles, at = wordhash.shingles(words, first)
                sig = signer.signatures(shingles, at)
                has = pa.array(np.where(np.diff(at) > 0, np.cumsum(np.diff(at) > 0) - 1, -1))
                has = pa.compute.if_else(pa.compute.equal(has, -1), pa.scalar(None, pa.int64()), has)
                raw = pa.array([s.tobytes() for s in (sig & 0xFFFF).astype("<u2")], pa.binary())
                bands_ = pa.ListArray.from_arrays(np.arange(0, (len(sig) + 1) * bands, bands, dtype=np.int32), signer.band_hashes(sig).ravel())
                columns = [part.column("doc_id"), part.column("th"), pa.array(class_keys(words, first), pa.string()), pa.array(np.diff(at)), raw.take(has), bands_.take(has)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "key", "shingles", "sig", "bands"])

    return each


def _bucket(least: float):
    """Edges of a forest over those members of a bucket whose signatures agree."""

    def each(batches):
        for t in common.groups(batches, ["band", "hash"]):
            keys, sig = t["key"].to_pylist(), np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(t.num_rows, -1)
            links, open_ = Links(keys, np.ones(len(keys), np.int64)), np.ones(len(keys), bool)
            for i in range(len(keys)):  # a member in the tree of i needs no comparison with i
                js = np.flatnonzero(open_[i + 1 :]) + i + 1
                js = js[[links.find(int(j)) != links.find(i) for j in js]] if links.edges else js
                if len(js):
                    links.row(i, js[(sig[js] == sig[i]).mean(axis=1) >= least])
            if (out := links.rows()) is not None:
                yield out

    return each


def _sets(batches):
    for batch in batches:
        for a, b in wordhash.slices(batch.column("text")):
            part = batch.slice(a, b - a)
            shingles, at = wordhash.shingles(*wordhash.words(*wordhash.buffers(part.column("text"))))
            sets = [np.unique(shingles[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("copies"), part.column("cluster"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "copies", "cluster", "n", "set"])


def _uint64(sets: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all sets in turn, as the column holds them."""
    parts = [wordhash.buffers(c)[0] for c in sets.chunks]
    return np.concatenate(parts).view(np.uint64)


def _shared(every: np.ndarray) -> tuple[int, np.ndarray]:
    """How many values come more than once, and each value's number among those, -1 where it comes once."""
    order = np.argsort(every)
    values = every[order]
    new = np.ones(len(values) + 1, bool)
    np.not_equal(values[1:], values[:-1], out=new[1:-1])
    first = new[:-1] & ~new[1:]
    run = np.cumsum(first, dtype=np.int32) - np.int32(1)
    run[new[:-1] & new[1:]] = -1
    number = np.empty(len(values), np.int32)
    number[order] = run
    return int(first.sum()), number


def _verify(threshold: float):
    def each(batches):
        for t in common.groups(batches, ["cluster", "bi", "bj"]):
            blk, bi, bj = t["blk"].to_numpy(), t["bi"][0].as_py(), t["bj"][0].as_py()
            links = Links(t["key"].to_pylist(), t["copies"].to_numpy())
            sizes = t["n"].to_numpy()
            shared, column = _shared(_uint64(t["set"]))  # what one member holds is in no intersection
            owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[column >= 0]
            column = column[column >= 0]
            mine, others = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            inter = np.zeros((len(mine), len(others)), np.int32)
            for start in range(0, shared, BITS):
                now = (column >= start) & (column < start + BITS)
                width = min(BITS, shared - start)
                bits = np.zeros((len(sizes), -(-width // 64) * 8), np.uint8)
                c = column[now] - start
                np.bitwise_or.at(bits, (owner[now], c >> 3), (1 << (c & 7)).astype(np.uint8))
                b = bits.view(np.uint64)
                other = b[others]
                for r, i in enumerate(mine):
                    inter[r] += np.bitwise_count(other & b[i]).sum(axis=1, dtype=np.int32)
            for r, i in enumerate(mine):
                union = sizes[i] + sizes[others] - inter[r]
                js = others[inter[r] >= threshold * union - 1e-9]
                links.row(int(i), js[js > i] if bi == bj else js)
            if (out := links.rows()) is not None:
                yield out

    return each


def jaccard_join(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Links among rows of docs whose sets of five-word shingles have a Jaccard similarity of at least threshold.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased; a text of fewer than five words, but not none, has one shingle
    of all its words.  A null text or one without words links with nothing.
    Returns for each row: doc_id, th (xxhash64 of its text), n_links (other rows
    linked directly, those of equal words included), class_id (least doc_id of
    equal words), group_id (least doc_id reachable by links), kept (true for the
    rows of one (doc_id, th) of each group, null doc_ids last) and linked (false
    for rows without words).  Rows that share a doc_id count
    each for itself; a group whose doc_ids are all null has a null group_id.
    No rows give no rows; other columns are ignored.
    """
    bands, rows_ = banding(threshold, recall)
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    signed = common.written(source.mapInArrow(_sign(bands, rows_), "doc_id long, th long, key string, shingles long, sig binary, bands array<long>"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th"))
    classes = common.written(
        signed.where("key is not null").groupBy("key").agg(first.alias("first"), F.count("*").alias("copies"), F.first("shingles").alias("shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .select("key", "first.doc_id", "first.th", "copies", "shingles", "sig", "bands"),
        "classes",
    )

    # candidates: members of buckets with others, by signature or, where a bucket is large, by one centre
    placed = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    buckets = placed.groupBy("band", "hash").agg(F.count("*").alias("members"), F.min("key").alias("centre")).where("members > 1")
    buckets = common.written(buckets, "buckets")  # apart from the join, so that adaptive execution can split a large bucket
    met = common.written(placed.join(buckets, ["band", "hash"]), "met")
    stars = met.where((F.col("members") > BUCKET) & (F.col("key") != F.col("centre"))).select(F.col("key").alias("a"), F.col("centre").alias("b"))
    small = met.where(F.col("members") <= BUCKET).select("band", "hash", "key").join(classes.select("key", "sig"), "key")
    near = small.repartition(common.partitions(docs.sparkSession), "band", "hash").sortWithinPartitions("band", "hash").mapInArrow(_bucket(threshold - SLACK), LINKS)
    clusters = common.written(components(near.select(F.col("key").alias("a"), F.explode("edges").alias("b")).union(stars)), "clusters")
    common.forget(met)

    # verification: one text of each class in a cluster, as its set of shingles
    wanted = common.written(clusters.join(classes.select("key", "doc_id", "th", "copies"), clusters.node == F.col("key")).select("key", "component", "doc_id", "th", "copies").withColumnsRenamed({"component": "cluster", "doc_id": "d", "th": "h"}), "wanted")
    small_side = wanted.count() * 150 <= common.BROADCAST_BYTES
    texts = source.join(F.broadcast(wanted) if small_side else wanted, source.doc_id.eqNullSafe(F.col("d")) & (source.th == F.col("h")))
    sets = texts.select("key", "copies", "cluster", "text").mapInArrow(_sets, "key string, copies long, cluster string, n long, set binary")
    sets = common.written(sets, "sets")
    sets = sets.join(sets.groupBy("key").count().where("count > 1").select("key"), "key", "left_anti").unionByName(sets.join(sets.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi").dropDuplicates(["key"]))
    found = common.written(block_pairs(sets, ["cluster"], "key", F.greatest("n", F.lit(LEAST_SHINGLES)), BLOCK_SHINGLES).mapInArrow(_verify(threshold), LINKS), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("key").alias("a"), F.explode("edges").alias("b")))

    first_of = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th"))
    heads = group_heads(member, classes.select(F.col("key").alias("node"), "doc_id", "th"), first_of).select(F.col("node").alias("key"), "head")
    own = classes.select("key", "doc_id", "th", "copies").join(links, "key", "left").join(heads, "key", "left")
    alone = F.col("head").isNull()
    own = own.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("doc_id").alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"), F.when(alone, F.col("th")).otherwise(F.col("head.th")).alias("head_th"))
    own = common.written(own, "members")  # apart from the join with the rows, so that a class of very many copies can be split
    out = signed.select("doc_id", "th", "key").join(own, "key", "left")
    lone = F.col("key").isNull()
    out = out.select("doc_id", "th", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(lone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), (lone | (F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("th") == F.col("head_th")))).alias("kept"), (~lone).alias("linked"))
    return out


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whatever their names, without those that jaccard_join() has no need to keep: one row of each group stays.

    Rows without words all stay.
    """
    joined = common.written(jaccard_join(docs, **options), "joined")
    kept = joined.where("kept").groupBy("doc_id", "th", "linked").agg(F.count("*").alias("alike"))
    kept = common.written(kept.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), (F.col("linked") & (F.col("alike") > 1)).alias("again")), "kept")
    rows = common.plain(docs)
    doc_id, text = (F.col(f"c{docs.columns.index(name)}") for name in ("doc_id", "text"))
    rows = rows.withColumn("th", F.xxhash64(F.coalesce(text, F.lit(""))))
    rows = rows.join(kept, doc_id.eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")))
    once = rows.where("again").dropDuplicates(["d", "h"])
    return rows.where("not again").unionByName(once).select(*common.named(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(common.read(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "group_id", "kept")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as x from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
size as (select doc_id, count(*) as n from s group by doc_id),
common_ as (select x from s group by x having count(*) > 1),
t as (select s.* from s semi join common_ using (x)),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as n from t a join t b on a.x = b.x and a.doc_id <> b.doc_id group by all),
pairs as (select a, b from inter i join size p on p.doc_id = a join size q on q.doc_id = b where 10 * i.n >= {round(10 * THRESHOLD)} * (p.n + q.n - i.n)),
reach(a, b) as (select doc_id, doc_id from d union select r.a, p.b from reach r join pairs p on r.b = p.a),
groups_ as (select a as doc_id, min(b) as group_id from reach group by a),
classes as (select doc_id, case when len(w) = 0 then doc_id else min(doc_id) over (partition by w) end as class_id from d),
deg as (select a as doc_id, count(*) as n_links from pairs group by a)
select doc_id, coalesce(n_links, 0) as n_links, class_id, group_id, doc_id = group_id as kept
from groups_ join classes using (doc_id) left join deg using (doc_id)"""
