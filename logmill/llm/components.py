"""Links between texts or vectors without a row for each pair, and their components.

Groups of rows that need comparing (leaves, buckets, clusters) are cut into
blocks of bounded weight; a task compares two blocks and returns, for each
member, how many links it found and one edge of a forest over them, so what
leaves a task grows with the rows and not with the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def block_pairs(rows: DataFrame, group: list[str], key: str, weight: str | Column, most: int) -> DataFrame:
    """rows once for each pair of blocks of its group: plus blk (its own), bi and bj (bi <= bj).

    A group has blocks enough that each weighs about `most`; rows are dealt to
    blocks by a hash of their key.  The rows lie together by (group, bi, bj) and
    sorted by it within partitions.
    """
    sizes = rows.groupBy(*group).agg(F.greatest(F.lit(1), F.ceil(F.sum(weight) / most)).cast("int").alias("blocks"), F.count("*").alias("members")).where("members > 1")
    sizes = common.written(sizes, "sizes")  # apart from the join, so that adaptive execution can split a large group
    both = rows.join(sizes, group).withColumn("blk", F.pmod(F.xxhash64(key), "blocks").cast("int"))
    pairs = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")}).drop("other", "blocks", "members")
    at = [*group, "bi", "bj"]
    return pairs.repartition(common.partitions(rows.sparkSession), *at).sortWithinPartitions(*at)


class Links:
    """Links among the members of a group: counts and a forest."""

    def __init__(self, keys: list, copies: np.ndarray) -> None:
        self.keys, self.copies = keys, copies
        self.links = np.zeros(len(keys), np.int64)
        self.root = np.arange(len(keys))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def row(self, i: int, others: np.ndarray) -> None:
        """Link member i to others; each pair comes once."""
        if not len(others):
            return
        self.links[i] += int(self.copies[others].sum())
        self.links[others] += self.copies[i]
        for j in others:
            a, b = self.find(i), self.find(int(j))
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.edges.append((i, int(j)))

    def rows(self) -> pa.RecordBatch | None:
        """key, links and an array of the keys that its edges lead to, for members with links."""
        has = np.flatnonzero(self.links)
        if not len(has):
            return None
        to: dict[int, list] = {int(i): [] for i in has}
        for i, j in self.edges:
            to[i].append(self.keys[j])
        return pa.RecordBatch.from_arrays([pa.array([self.keys[i] for i in has], pa.string()), pa.array(self.links[has]), pa.array([to[int(i)] for i in has], pa.list_(pa.string()))], names=["key", "links", "edges"])


LINKS = "key string, links long, edges array<string>"


#: Edges in a file of components() at least, so that few edges don't make many files.
FILE_EDGES = 1 << 14


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node in edges (a, b).

    Large-star and small-star steps in turn hang all neighbours of a node on
    the least of them, until nothing moves: about log(longest path) rounds, each
    linear in the edges.  Every step is written to the work folder, in files that
    the number of edges before it sets; the least neighbours are written apart from
    their join with the edges, so that adaptive execution can split a node of very
    many.
    """
    e = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).head())

    now = state(e)
    while now[0]:
        files = now[0] // FILE_EDGES + 1
        both = e.union(e.select("v", "u"))
        least = common.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(files), "least")
        large = common.written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct().coalesce(files), "large")
        lower = common.written(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "least")
        near = large.join(lower, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = common.written(near.union(lower.select("u", "m")).distinct().coalesce(files), "edges")
        for x in (e, least, large, lower):
            common.forget(x)
        e, before, now = new, now, state(new)
        if now == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def group_heads(member: DataFrame, nodes: DataFrame, head: Column) -> DataFrame:
    """node and head, an aggregate over all nodes of its component, of each node in member (node, component).

    nodes has a row for each node.  Only nodes with links are here, and their
    components' heads are written apart, so a component of very many can be split.
    """
    own = common.written(member.join(nodes, "node"), "own")
    heads = common.written(own.groupBy("component").agg(head.alias("head")), "heads")
    return common.written(own.select("node", "component").join(heads, "component").select("node", "head"), "heads")
