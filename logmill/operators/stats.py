"""Percentiles, counters and their trailing form.

Nothing here orders all values of a group in one task: values are counted first,
and only those near the rank that is asked for are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rollup import rollup

RING = 4096
FRACTIONS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: The sketch that bounds a percentile is off by at most one of so many parts of the rows.
ACCURACY = 10_000

__all__ = ["FRACTIONS", "RING", "rollup", "running_max", "summary", "trailing"]


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, p50 to p99 and max of a column, by group; percentiles by nearest rank, exact.

    A percentile is the least value with at least that share of all values at or
    below it.  A sketch gives two values that it lies between; what is below them is
    counted, and the values between them, a few of ACCURACY parts of the rows, are
    summed up in order.  Nulls don't count; a group of nulls has null percentiles.
    """
    by = by or []
    held = rows.select(*by, F.col(value).alias("_v"))
    edges = [e for f in FRACTIONS.values() for e in (max(0.0, f - 2 / ACCURACY), min(1.0, f + 2 / ACCURACY))]
    total = held.groupBy(*by).agg(F.count("_v").alias("count"), F.avg("_v").alias("mean"), F.max("_v").alias("max"), F.percentile_approx("_v", F.array(*map(F.lit, edges)), ACCURACY).alias("_q"))
    same = lambda other: [F.col(b).eqNullSafe(F.col(f"_{other}_{b}")) for b in by] or [F.lit(True)]
    bounds = total.select(*(F.col(b).alias(f"_b_{b}") for b in by), F.col("count").alias("_n"), "_q")
    joined = held.where("_v is not null").join(bounds, same("b"))
    # each value once for each percentile: null if it is below the two, gone if it is above them
    of = [F.struct(F.lit(k).alias("k"), F.lit(f).alias("f"), F.when(F.col("_v") >= F.get("_q", F.lit(2 * k)), F.col("_v")).alias("v"), (F.col("_v") <= F.get("_q", F.lit(2 * k + 1))).alias("near")) for k, f in enumerate(FRACTIONS.values())]
    counted = joined.select(*by, "_n", F.explode(F.array(*of)).alias("_x")).where("_x.near").groupBy(*by, F.col("_x.k").alias("_k"), F.ceil(F.col("_x.f") * F.col("_n")).alias("_rank"), F.col("_x.v").alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_k").orderBy(F.asc_nulls_first("_v")))
    found = counted.withColumn("_upto", upto).where("_v is not null and _upto >= _rank")
    found = found.groupBy(*(F.col(b).alias(f"_f_{b}") for b in by)).agg(*(F.min(F.when(F.col("_k") == k, F.col("_v"))).alias(name) for k, name in enumerate(FRACTIONS)))
    return total.join(found, same("f"), "left").select(*by, "count", "mean", *FRACTIONS, "max")


def trailing(rows: DataFrame, value: str, order: str, size: int = RING) -> DataFrame:
    """summary() of the last `size` rows by order."""
    return summary(rows.orderBy(F.desc(order)).limit(size), value)


def numbered(rows: DataFrame, order: str, by: list[str], parts: int = 200) -> DataFrame:
    """rows with _rn, their number from 1 on within their group by order.

    Rows are dealt to ranges of the order, numbered in each, and the ranges' sizes
    before it are added.
    """
    cuts = rows.agg(F.percentile_approx(order, F.array(*(F.lit((i + 1) / parts) for i in range(parts - 1))), ACCURACY)).head()[0] or []
    edges = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array(F.lit(0))
    dealt = rows.withColumn("_range", F.size(F.filter(edges, lambda e: e < F.col(order))))
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(b).alias(f"_o_{b}") for b in by), F.col("_range").alias("_o_range"), before.alias("_before"))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order)))
    same = [F.col(b).eqNullSafe(F.col(f"_o_{b}")) for b in by] + [F.col("_range") == F.col("_o_range")]
    return inside.join(offsets, same).withColumn("_rn", F.col("_in") + F.col("_before")).select(*rows.columns, "_rn")


def running_max(rows: DataFrame, value: str, order: str, by: list[str], size: int = RING) -> DataFrame:
    """Each row with count and max of the `size` rows of its group up to it; order has no ties.

    A frame of `size` rows is the end of one block of so many rows and the
    beginning of the next, so running counts and maxima of blocks from either side
    give every frame, and no task has more than a block.
    """
    n = numbered(rows, order, by).withColumn("_block", F.floor((F.col("_rn") - 1) / size))
    block = Window.partitionBy(*by, "_block").orderBy("_rn")
    first, last = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
    n = n.withColumns({"_c": F.count(value).over(first), "_m": F.max(value).over(first), "_ce": F.count(value).over(last), "_me": F.max(value).over(last)})
    # the end of the block before: from the row size - 1 before this one on
    ends = n.select(*(F.col(b).alias(f"_e_{b}") for b in by), (F.col("_rn") + size - 1).alias("_at"), F.col("_ce").alias("_ce2"), F.col("_me").alias("_me2")).where((F.col("_at") - 1) % size != size - 1)
    same = [F.col(b).eqNullSafe(F.col(f"_e_{b}")) for b in by] + [F.col("_rn") == F.col("_at")]
    short = n.drop("_ce", "_me").join(ends, same, "left")
    return short.select(*rows.columns, (F.col("_c") + F.coalesce("_ce2", F.lit(0))).alias("ring_count"), F.greatest("_m", "_me2").alias("ring_max"))
