"""Mixing sources to target weights by pivotal dependent rounding (operator 10).

Every document of a source should come `rate` times (target over size of the
source): the whole part always, the fraction as a probability.  Probability is
transferred at random, as words, until one side of a pair is 0 or 1.

The few large documents of a source (over 1 of LARGE parts of it, so LARGE at
most) go first, the largest before the others; each is paired with all smaller
documents together, which share one probability.  So a large document is settled
and the smaller ones make up for it.  Then the small documents are paired with
each other, in chunks; what each chunk has left, one document, enters the next
level of a reduction tree, until a source has one left, which is drawn.  The words
of a source miss the target by that small document at most, unless its documents
are so few or uneven that no smaller ones could make up for a large one.

Everything is DataFrame and SQL functions.  Random numbers and chunks are hashes
of the rows, so reruns agree however the rows lie and whatever the number of
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: A document is large if it has more than one of so many parts of its source's words.
LARGE = 1000
#: Small documents that one pivotal chain runs over, about.
CHUNK = 64
#: Probabilities nearer to 0 or 1 than this are 0 or 1.
NIL = 1e-9
WORD = "[^\\x20\\x09-\\x0D]+"


def _random(seed: int, *of: Column | int) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *(F.lit(x) if isinstance(x, int) else x for x in of)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target of each source of (source, size).

    Sources by code point, null last, have the weights in turn.  share times all
    sizes are dealt by weight; a target stops at cap times its source's size, and
    the excess is dealt to the others by weight until no target is above.
    With r = cap * size / weight in ascending order, those are the first sources
    for which dealing what is left would reach r.  share over cap is capped
    everywhere.  Sizes of 0 have the target 0.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    everything = Window.partitionBy()
    ranked = Window.orderBy("r", F.col("source").asc_nulls_last())
    t = total.withColumn("w", turn).withColumns({"most": F.lit(cap) * F.col("source_size"), "all": F.lit(share) * F.sum("source_size").over(everything)})
    t = t.withColumn("r", F.col("most") / F.col("w"))
    before = F.coalesce(F.sum("most").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumns({"left": F.col("all") - before, "rest": F.sum("w").over(ranked.rowsBetween(0, Window.unboundedFollowing))})
    t = t.withColumn("capped", F.col("left") * F.col("w") >= F.col("most") * F.col("rest"))
    t = t.withColumn("level", F.min(F.when(~F.col("capped"), F.struct("r", "source", (F.col("left") / F.col("rest")).alias("level")))).over(everything)["level"])
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("w") * F.col("level")).alias("target"))


def _settle(units: Column, p: Column, words: Column, seed: int) -> Column:
    """Large documents settled from the largest on: takes ("0" or "1" for each) and p, which all smaller documents have then.

    units is an array of structs (below, u) in ascending order of below, the
    size made negative; p is the probability of all documents of the source and
    words their size together.  A document is settled at random where the smaller
    ones can make up for either outcome, else the way that they can make up for,
    and if they can for none, the way that leaves the words nearer to the target.
    """

    def meet(state: Column, x: Column) -> Column:
        p, size = state["p"], -x["below"]
        pool = state["words"] - size
        lack, excess = (1 - p) * size, p * size  # what the others give if it is taken, and get if not
        gives, gets = lack <= p * pool + NIL, excess <= (1 - p) * pool + NIL
        take = F.when(gives & gets, _random(seed, -2, x["u"]) < p).when(gives | gets, gives).otherwise(F.abs(lack - p * pool) < F.abs(excess - (1 - p) * pool))
        after = F.when(pool <= 0, p).otherwise((p * state["words"] - F.when(take, size).otherwise(0)) / pool)
        after = F.when(after < NIL, 0.0).when(after > 1 - NIL, 1.0).otherwise(after)
        return F.struct(F.concat(state["takes"], F.when(take, "1").otherwise("0")).alias("takes"), after.alias("p"), pool.alias("words"))

    return F.aggregate(units, F.struct(F.lit("").alias("takes"), p.alias("p"), words.cast("double").alias("words")), meet)


def _chain(units: Column, seed: int, level: int) -> Column:
    """One pivotal chain over an array of structs (u, size, p): done (u, take) and left (u, size, p)."""

    def meet(state: Column, b: Column) -> Column:
        a = state["left"]
        r = _random(seed, level, a["u"], b["u"])
        # words that a can gain or lose before it is whole, and b likewise
        a_up, a_down, b_up, b_down = (1 - a["p"]) * a["size"], a["p"] * a["size"], (1 - b["p"]) * b["size"], b["p"] * b["size"]
        to_a, to_b = F.least(a_up, b_down), F.least(a_down, b_up)
        gains = r * (to_a + to_b) < to_b  # the chances keep both expectations
        a_done = F.when(gains, a_up <= b_down).otherwise(a_down <= b_up)
        moved = F.when(gains, to_a).otherwise(-to_b)
        take = F.when(gains == a_done, 1).otherwise(0)
        gone = F.struct(F.when(a_done, a["u"]).otherwise(b["u"]).alias("u"), take.alias("take"))
        goes = F.when(a_done, F.struct(b["u"].alias("u"), b["size"].alias("size"), (b["p"] - moved / b["size"]).alias("p"))).otherwise(F.struct(a["u"].alias("u"), a["size"].alias("size"), (a["p"] + moved / a["size"]).alias("p")))
        return F.struct(F.concat(state["done"], F.array(gone)).alias("done"), goes.alias("left"))

    first = F.element_at(units, 1)
    none = F.slice(F.transform(units, lambda x: F.struct(x["u"].alias("u"), F.lit(0).alias("take"))), 1, 0)
    start = F.struct(none.alias("done"), F.struct(first["u"].alias("u"), first["size"].alias("size"), first["p"].alias("p")).alias("left"))
    return F.aggregate(F.slice(units, F.lit(2), F.size(units)), start, meet)


def pivotal(units: DataFrame, chunks: int, seed: int = 0) -> DataFrame:
    """0 or 1 for each row of (source, size, id, tie, p, chunk), in expectation p, as id, tie, take.

    The sizes taken of a source sum to the sum of size * p but for the size of
    one row.  p is in (0, 1), size above 0; chunk is at least 0 and below `chunks`.
    """
    units, level, out = units.select("source", "chunk", "size", F.struct("id", "tie").alias("u"), "p"), 0, None
    while True:
        # largest first; what a chunk has left meets that of other chunks at the next level
        chains = units.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.negative("size").alias("below"), "u", "size", "p"))).alias("units"))
        ran = common.written(chains.select("source", "chunk", _chain(F.col("units"), seed, level).alias("c")), "mix")
        done = ran.select(F.explode("c.done").alias("d")).select("d.u.id", "d.u.tie", "d.take")
        out = done if out is None else out.union(done)
        units = ran.select("source", F.floor(F.col("chunk") / CHUNK).alias("chunk"), "c.left.size", "c.left.u", "c.left.p")
        level += 1
        if chunks <= 1:
            break
        chunks = -(-chunks // CHUNK)
    # what adds up to a whole number but for rounding is taken as such
    last = F.when(F.col("p") > 1 - NIL, 1).when(F.col("p") < NIL, 0).otherwise((_random(seed, -1, F.col("u")) < F.col("p")).cast("int"))
    return out.union(units.select("u.id", "u.tie", last.alias("take")))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """How often the mix takes each row of docs (doc_id, text, source).

    Returns doc_id, th (xxhash64 of the text), source, size (words: runs of
    anything but `[\\x20\\x09-\\x0D]`; 0 if the text is null), source_size, target
    (its source's), copies and taken (copies * size).  A null source is a source
    of its own.  Rows without words come 0 times.  Rows equal in doc_id, text
    and source are told apart by tie, their number among `alike` ones.  No rows give no
    rows; other columns are ignored.
    """
    words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    rows = common.written(docs.select("doc_id", F.xxhash64("text").alias("th"), "source", words.alias("size")), "sizes")
    targets = source_targets(rows, weights, share, cap)
    # repeated rows are counted, not listed, and told apart again below
    alike = rows.groupBy("doc_id", "th", "source", "size").agg(F.count("*").cast("int").alias("alike"))
    t = targets.withColumnRenamed("source", "name")
    each = alike.join(t, alike.source.eqNullSafe(t.name)).drop("name").withColumn("tie", F.explode(F.sequence(F.lit(1), "alike")))
    each = each.withColumn("rate", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    whole = F.floor(F.col("rate") + NIL).cast("int")
    p = F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))
    each = each.withColumn("whole", whole).withColumns({"p": F.when(p > NIL, p).otherwise(0.0), "large": F.col("size") * LARGE > F.col("source_size"), "id": F.struct("doc_id", "th", "source")})
    each = common.written(each, "rates")
    open_ = each.where("p > 0")

    # large documents, an array of at most LARGE a source
    arrays = open_.where("large").groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.negative("size").alias("below"), F.struct("id", "tie").alias("u")))).alias("units"), F.first("p").alias("p"), F.first("source_size").alias("words"))
    settled = common.written(arrays.select("source", "units", _settle(F.col("units"), F.col("p"), F.col("words"), seed).alias("s")), "large")
    drawn = settled.select(F.explode(F.transform("units", lambda x, i: F.struct(x["u"].alias("u"), F.substring(F.col("s.takes"), i + 1, F.lit(1)).cast("int").alias("take")))).alias("d")).select("d.u.id", "d.u.tie", "d.take")

    # small ones, with the probability that the large ones left
    per = open_.where("not large").groupBy("source").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    per = per.join(settled.select(F.col("source").alias("name"), F.col("s.p").alias("after")), F.col("source").eqNullSafe(F.col("name")), "left").drop("name").withColumnRenamed("source", "name")
    per = common.written(per, "sources")
    most = per.agg(F.max("chunks")).head()[0]
    if most:
        small = open_.where("not large").join(per, F.col("source").eqNullSafe(F.col("name"))).withColumn("p", F.coalesce("after", "p"))
        small = small.select("source", "size", "id", "tie", "p", F.pmod(F.xxhash64(F.lit(seed), "id", "tie"), F.col("chunks")).alias("chunk"))
        sure = small.where(f"p < {NIL} or p > 1 - {NIL}").select("id", "tie", F.round("p").cast("int").alias("take"))
        drawn = drawn.union(sure).union(pivotal(small.where(f"p >= {NIL} and p <= 1 - {NIL}"), most, seed))
    drawn = drawn.select(F.col("id.doc_id").alias("d"), F.col("id.th").alias("h"), F.col("id.source").alias("s"), F.col("tie").alias("n"), "take")
    both = each.join(drawn, each.doc_id.eqNullSafe(drawn.d) & (each.th == drawn.h) & each.source.eqNullSafe(drawn.s) & (each.tie == drawn.n), "left")
    copies = (F.col("whole") + F.coalesce("take", F.lit(0))).cast("long")
    return both.select("doc_id", "th", "source", "tie", "alike", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whatever their names, as often as mix() takes them.

    Of rows equal in doc_id, text and source, one comes for all of them.
    """
    taken = mix(docs, **options).groupBy("doc_id", "th", "source").agg(F.sum("copies").cast("int").alias("n"), F.first("alike").alias("alike")).where("n > 0")
    taken = common.written(taken.withColumnsRenamed({"doc_id": "d", "th": "h", "source": "s"}), "taken")
    rows = common.plain(docs)
    doc_id, text, source = (F.col(f"c{docs.columns.index(name)}") for name in ("doc_id", "text", "source"))
    small = F.broadcast(taken) if taken.count() * 100 <= common.BROADCAST_BYTES else taken
    rows = rows.withColumn("th", F.xxhash64(text)).join(small, doc_id.eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & source.eqNullSafe(F.col("s")))
    one = rows.where("alike = 1").unionByName(rows.where("alike > 1").dropDuplicates(["d", "h", "s"]))
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).select(*common.named(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
