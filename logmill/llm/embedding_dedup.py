"""Embedding near-dedup with a forest of random-projection trees (operator 3).

Each tree splits recursively at the median of a random projection; vectors
within a margin of the median go to both sides (spill overlap).  A tree is fitted
on a bounded sample of all vectors, and every vector is routed through it.  Leaves
that still hold too many vectors are split on: each by a tree of its own, fitted on
a bounded sample of its vectors where they lie, until every leaf is small or can't
be split.  So the trees grow with the table and the leaves don't.  Vectors that
share a leaf are compared in double precision, and the links found are joined into
components.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import LINKS, Links, block_pairs, components, group_heads

THRESHOLD = 0.95
TREES = 6
#: Share of the distance between two unit vectors at the threshold that spills at either side of a split.
MARGIN = 0.065
#: Vectors wanted in a leaf, as estimated from the sample; leaves of over MOST times as many are split on.
LEAF = 1000
MOST = 4
#: Vectors that a tree is fitted on, at most about so many, and in a leaf of them at least.
SAMPLE = 20_000
SAMPLE_LEAF = 40
#: Vectors in a block of a leaf, and those that one task routes through a leaf's own tree.
BLOCK = 4096
ROUTED = 1 << 16


class Tree:
    """Splits as arrays: seeds of directions, thresholds and children; a child below 0 is leaf -child - 1."""

    def __init__(self, sample: np.ndarray, share: float, seed: int, margin: float, leaf: int) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.margin, self.leaves, self.dim = margin, 0, sample.shape[1]
        seeds, medians, children = [], [], []

        def grow(rows: np.ndarray, depth: int) -> int:
            if len(rows) * share <= leaf or len(rows) < 2 * SAMPLE_LEAF or depth >= 40:
                self.leaves += 1
                return -self.leaves
            own = int(rng.integers(1 << 62))
            along = sample[rows] @ direction(own, self.dim)
            median = float(np.median(along))
            left, right = rows[along < median + margin], rows[along >= median - margin]
            if max(len(left), len(right)) > 0.9 * len(rows):  # mostly one spot: a split would only copy it
                self.leaves += 1
                return -self.leaves
            n = len(seeds)
            seeds.append(own)
            medians.append(median)
            children.append([0, 0])
            children[n] = [grow(left, depth + 1), grow(right, depth + 1)]
            return n

        self.root = grow(np.arange(len(sample)), 0)
        self.seeds, self.medians, self.children = seeds, medians, children
        self._directions: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_directions": {}}

    def route(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Leaves and the rows of x in each."""
        out, todo = [], [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((-node - 1, rows))
                continue
            if node not in self._directions:
                self._directions[node] = direction(self.seeds[node], self.dim)
            along = x[rows] @ self._directions[node] - self.medians[node]
            todo.append((self.children[node][0], rows[along < self.margin]))
            todo.append((self.children[node][1], rows[along >= -self.margin]))
        return out


def direction(seed: int, dim: int) -> np.ndarray:
    x = np.random.Generator(np.random.PCG64(seed)).standard_normal(dim)
    return x / np.linalg.norm(x)


def leaf_id(*path: int) -> int:
    return xxhash.xxh3_64_intdigest(repr(path)) >> 1


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision of vectors of one length."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is beyond a double's range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prepare(kind: str):
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        """vec_id, key (a hash of a vector that can link, else null), dim, raw."""
        keys, dims, raws = [], [], []
        for v in batch.column("embedding"):
            x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid else None  # a null component is NaN
            fine = x is not None and len(x) and np.isfinite(x).all() and (x != 0).any()
            raws.append((x + x.dtype.type(0)).tobytes() if fine else None)  # + 0: -0.0 is 0.0
            keys.append(xxhash.xxh3_128_hexdigest(raws[-1]) if fine else None)
            dims.append(len(x) if fine else None)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.string()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "key", "dim", "raw"])

    return each


def _compare(threshold: float, kind: str):
    def each(batches):
        for t in common.groups(batches, ["leaf", "bi", "bj"]):
            x, blk = unit(t["raw"].to_pylist(), kind), t["blk"].to_numpy()
            bi, bj = t["bi"][0].as_py(), t["bj"][0].as_py()
            leaf = t["leaf"][0].as_py()
            leaves = t["leaves"].to_pylist()
            links = Links(t["key"].to_pylist(), t["copies"].to_numpy())
            mine, others = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            for start in range(0, len(mine), 256):
                some = mine[start : start + 256]
                near = x[some] @ x[others].T >= threshold
                for i, row in zip(some, near, strict=True):
                    js = others[row]
                    if bi == bj:
                        js = js[js > i]
                    if len(js):  # a pair counts in the first leaf that it shares
                        own = set(leaves[i])
                        links.row(int(i), np.array([j for j in js if next(y for y in leaves[j] if y in own) == leaf], np.int64))
            if (out := links.rows()) is not None:
                yield out

    return each


def place(classes: DataFrame, kind: str, *, trees: int, bound: float, sample: int, leaf: int, seed: int) -> DataFrame:
    """key and leaves (ascending) of each row of classes (dim, key, raw)."""
    spark = classes.sparkSession
    forests: dict[int, list[Tree]] = {}
    for dim, n in classes.groupBy("dim").count().orderBy("dim").toLocalIterator():
        part = classes.where(F.col("dim") == dim).select("key", "raw")
        if n > sample:
            part = part.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
        fit = [bytes(r.raw) for r in part.orderBy("key").limit(2 * sample).collect()]
        x = unit(fit, kind) if fit else np.zeros((0, dim))
        forests[dim] = [Tree(x, n / max(1, len(x)), seed * 1000 + t, bound, leaf) for t in range(trees)]
    shared = spark.sparkContext.broadcast(forests)

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column("dim").to_numpy()
        leaves: list[list[int]] = [[] for _ in dims]
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = unit(batch.column("raw").take(pa.array(at)).to_pylist(), kind)
            for t, tree in enumerate(shared.value[int(dim)]):
                for n, got in tree.route(x):
                    own = leaf_id(int(dim), t, n)
                    for i in at[got]:
                        leaves[i].append(own)
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array([sorted(x) for x in leaves], pa.list_(pa.int64()))], names=["key", "leaves"])

    placed = common.written(common.arrow_map(classes.select("dim", "key", "raw"), route, "key string, leaves array<long>"), "placed")
    whole = None  # large leaves that can't be split
    while True:
        sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > MOST * leaf)
        large = common.written(sizes if whole is None else sizes.join(whole, "leaf", "left_anti"), "large")
        if large.isEmpty():
            return placed
        split, stuck = _split(classes, placed, large, kind, bound, sample, leaf, seed)
        own = placed.select("key", F.explode("leaves").alias("leaf")).join(large.select("leaf"), "leaf", "left_anti").select("key", "leaf")
        placed = common.written(own.unionByName(split).groupBy("key").agg(F.array_sort(F.collect_set("leaf")).alias("leaves")), "placed")
        whole = common.written(stuck if whole is None else whole.unionByName(stuck), "whole")


def _split(classes: DataFrame, placed: DataFrame, large: DataFrame, kind: str, bound: float, sample: int, leaf: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """key and leaf of the vectors of large leaves (leaf, n), routed through trees of those leaves; and the leaves whose tree has no split.

    A leaf's vectors are dealt to several tasks, each of which gets its tree.
    """
    spark = classes.sparkSession
    inside = placed.select("key", F.explode("leaves").alias("leaf")).join(large, "leaf").join(classes.select("key", "dim", "raw"), "key")
    inside = common.written(inside.select("leaf", "n", "key", "dim", "raw", F.pmod(F.xxhash64("key", F.lit(1)), F.ceil(F.col("n") / ROUTED)).alias("part")), "inside")

    def fit(batches):
        for t in common.groups(batches, ["leaf"]):
            own, n = t["leaf"][0].as_py(), t["n"][0].as_py()
            x = unit(t["raw"].to_pylist(), kind)
            tree = Tree(x, n / len(x), leaf_id(own, seed), bound, leaf)
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([n], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary()), pa.array([tree.leaves > 1])], names=["leaf", "n", "tree", "splits"])

    some = inside.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("n")).select("leaf", "n", "key", "raw")
    fitted = common.written(some.repartition(common.partitions(spark), "leaf").sortWithinPartitions("leaf", "key").mapInArrow(fit, "leaf long, n long, tree binary, splits boolean"), "trees")
    # a tree for each part of its leaf, before the part's vectors
    sent = fitted.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / ROUTED) - 1)).alias("part"), F.lit("").alias("key"), F.col("tree").alias("raw"))

    def route(batches):
        own, tree = None, None
        for batch in batches:
            leaves, keys, raws = batch.column("leaf").to_numpy(), batch.column("key").to_pylist(), batch.column("raw").to_pylist()
            heads = [i for i, k in enumerate(keys) if k == ""] + [len(keys)]
            for begin, end in zip([0, *heads], [*heads, len(keys)], strict=True) if heads[0] else zip(heads, [*heads[1:], len(keys)], strict=True):
                if begin < end and keys[begin] == "":
                    own, tree = int(leaves[begin]), pickle.loads(raws[begin])
                    begin += 1
                if begin < end and tree is not None and own == leaves[begin]:
                    got = tree.route(unit(raws[begin:end], kind))
                    names = [own if tree.leaves < 2 else leaf_id(own, n) for n, _ in got]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[begin + i] for _, rows in got for i in rows], pa.string()), pa.array(np.repeat(np.array(names, np.int64), [len(rows) for _, rows in got]))], names=["key", "leaf"])

    both = sent.unionByName(inside.select("leaf", "part", "key", "raw")).repartition(common.partitions(spark), "leaf", "part").sortWithinPartitions("leaf", "part", "key")
    split = common.written(both.mapInArrow(route, "key string, leaf long"), "split")
    common.forget(inside)
    return split, fitted.where("not splits").select("leaf")


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, trees: int = TREES, margin: float = MARGIN, sample: int = SAMPLE, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """Links among rows of (vec_id, embedding) with a cosine of at least threshold.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different lengths.  Returns a row for
    each row: vec_id, n_links (other rows linked directly, equal vectors
    included), component_id (the least vec_id reachable), kept (vec_id is
    component_id).  Rows with a null vec_id count as others' links; their own
    component_id is null if no vec_id is reachable.  Rows that share a vec_id
    count each for itself.  No rows give no rows; other columns are ignored.
    Trees are fitted on about `sample` vectors, chosen by hash; every vector is
    routed.  Double vectors are compared as such, others as the doubles that they are.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull) else "<f8"
    typed = "array<float>" if kind == "<f4" else "array<double>"
    rows = common.written(common.arrow_map(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(typed).alias("embedding")), _prepare(kind), "vec_id long, key string, dim int, raw binary"), "vectors")
    classes = common.written(rows.where("key is not null").groupBy("dim", "key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "classes")
    placed = place(classes, kind, trees=trees, bound=margin * np.sqrt(2 - 2 * threshold), sample=sample, leaf=leaf, seed=seed)
    routed = common.written(classes.select("key", "copies", "raw").join(placed, "key").select(F.explode("leaves").alias("leaf"), "leaves", "key", "copies", "raw").withColumn("one", F.lit(1)), "routed")
    found = common.written(block_pairs(routed, ["leaf"], "key", "one", BLOCK).mapInArrow(_compare(threshold, kind), LINKS), "links")
    common.forget(routed)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("key").alias("a"), F.explode("edges").alias("b")))
    heads = group_heads(member, classes.select(F.col("key").alias("node"), F.col("vec_id").alias("head")), F.min("head"))
    own = classes.select("key", "vec_id", "copies").join(links, "key", "left").join(heads.withColumnRenamed("node", "key"), "key", "left")
    own = own.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("head")).alias("component_id"))
    own = common.written(own, "members")  # apart from the join with the rows, so that a vector of very many copies can be split
    out = rows.select("vec_id", "key").join(own, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.read(spark, sf_dir, "embeddings"))


def query_stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as doubles, and each once more with its first four components tripled: data with links at the threshold."""
    e = common.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return near_vectors(e.unionByName(e.select((F.col("vec_id") + 10_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i < 4, x * 3).otherwise(x)).alias("embedding"))))


ORACLE = f"""
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) as l from v),
pairs as (select a.vec_id as a, b.vec_id as b from n a join n b
          on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (a.l * b.l) >= {THRESHOLD}),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, p.b from reach r join pairs p on r.b = p.a),
comp as (select a as vec_id, min(b) as component_id from reach group by a),
deg as (select a as vec_id, count(*) as n_links from pairs group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join comp using (vec_id) left join deg using (vec_id)"""

ORACLE_STRETCHED = ORACLE.replace("embeddings", "both_").replace("with recursive v as", """with recursive both_ as (
  select vec_id, cast(embedding as double[]) as embedding from embeddings union all
  select vec_id + 10000000, list_concat(list_transform(cast(embedding as double[])[1:4], lambda x: x * 3), cast(embedding as double[])[5:]) from embeddings),
v as""")
