"""Operator 9 [native]: mixing sources to target weights by a hypergeometric splitting tree.

Sizes are words.  Sources in code point order (null last) weigh weights[k % len(weights)]
and share the total of all sizes; a target stops at `max_repeats` times its source's size,
the excess is shared again by weight (water filling).

Blocks: a source's documents fall into BINS bins by the MD5 of their id, a fixed
permutation.  A source takes whole epochs, then bins in order up to its target, and of the
bin where the target falls the documents in MD5 order; so a quota is exact to one document.
A block is one taken (source, bin, epoch), and a source's block quota is their number.

Splitting tree: the root holds the block quotas of all sources and all shards; a node
halves its shards, and how many blocks of each source go to the left half is one draw from
the multivariate hypergeometric distribution of the node's quotas, as many in all as the
left shards' part of the node's blocks.  The leaves hold each shard's quota of each source.
Then every source's blocks are put in random order, and shards draw theirs one after
another: disjoint blocks, none left over.  Rows are ordered within a shard by a random key.

The tree is drawn on the driver from one number per colour.  A colour is a source, or, of
more than COLOURS sources, those with equal number modulo COLOURS: their blocks share one
random order, which splits a colour's quota among its sources by the same distribution.

Defined cases: null text has size 0; a source of size 0 has target 0; an empty table gives
an empty result; rows with equal doc_id and source are taken together; columns besides
doc_id, source and text pass through mix(), whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, durable, spread_join

WEIGHTS = (1, 2, 3)
BINS = 1024
#: Numbers that the driver holds of each node of the tree, at most.
COLOURS = 4096
#: A colour's random order is ranked in so many ranges, so no colour is one task's.
RANGES = 64
#: The plan (under 150 bytes a row) is broadcast up to so many rows, and else shuffled.
BROADCAST_BINS = 400_000
#: Words that one task should write.
TASK_WORDS = 40_000_000
#: Stands for all keys of a bin: greater than any digest.
ALL = "~"


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """(source, source_size, target double) from (source, source_size): one row per source."""
    one = Window.partitionBy(F.lit(0))  # sources, not documents
    order = F.pmod(F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    w = sizes.withColumn("__w", F.get(F.array(*map(F.lit, weights)), order).cast("double"))
    w = w.withColumn("__cap", (max_repeats * F.col("source_size")).cast("double"))
    up = one.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    w = w.select(
        "*",
        F.sum("source_size").over(one).cast("double").alias("__all"),
        F.coalesce(F.sum("__cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"),
        F.sum("__w").over(up.rowsBetween(0, Window.unboundedFollowing)).alias("__left"),
    )
    # The level at which the sources from this one on would share what those before leave.
    w = w.withColumn("__level", (F.col("__all") - F.col("__before")) / F.col("__left"))
    free = F.col("__level") * F.col("__w") <= F.col("__cap")
    w = w.withColumn("__free", F.min(F.when(free, F.col("__cap") / F.col("__w"))).over(one))
    level = F.min(F.when(free & (F.col("__cap") / F.col("__w") == F.col("__free")), F.col("__level"))).over(one)
    w = w.withColumn("__at", level)
    target = F.least(F.col("__cap"), F.coalesce(F.col("__at") * F.col("__w"), F.col("__cap")))
    return w.select("source", "source_size", target.alias("target"))


def _key(seed: str) -> Column:
    """The permutation's key of a row."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))


def _bin(key: Column) -> Column:
    """The bin: the key's first digits."""
    return F.floor(F.conv(F.substring(key, 1, 3), 16, 10).cast("int") / (4096 // BINS)).cast("int")


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, key, bin)."""
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), _key(seed).alias("key"))
    return rows.withColumn("bin", _bin(F.col("key")))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """Per source and bin of rows (_sized): (source, bin, n, source_size, target, number,
    epochs, last): how often its documents are taken at least, and the last key that is taken
    once more (ALL, or '' for none); number is the source's place, n the bin's rows."""
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    share = targets(bins.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    share = durable(share.withColumn("number", number).withColumn("epochs", F.least(_epochs(), F.lit(max_repeats))))
    bins = bins.join(share.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    by = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(by), F.lit(0))  # at most BINS rows a source
    bins = durable(bins.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size") - begin))
    split = bins.where("rest > 0 and rest < size").select(F.col("source").alias("s"), F.col("bin").alias("b"), "rest")
    inside = rows.join(split, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    units = inside.groupBy("s", "b", "rest", "key").agg(F.sum("size").alias("unit"))
    ahead = F.sum("unit").over(Window.partitionBy("s", "b").orderBy("key")) - F.col("unit")
    # A document is in if the target lies beyond its middle.
    edge = units.withColumn("ahead", ahead).where(F.col("ahead") + F.col("unit") / 2 < F.col("rest"))
    edge = edge.groupBy("s", "b").agg(F.max("key").alias("edge"))
    bins = bins.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")), "left")
    last = F.when(F.col("rest") <= 0, F.lit("")).when(F.col("rest") >= F.col("size"), F.lit(ALL)).otherwise(F.coalesce("edge", F.lit("")))
    last = F.when(F.col("epochs") < max_repeats, last).otherwise(F.lit(""))
    return durable(bins.select("source", "bin", "n", "source_size", "target", "number", "epochs", last.alias("last")))


def _epochs() -> Column:
    return F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")


def _left(draw: np.random.Generator, own: np.ndarray, n: int) -> np.ndarray:
    """A draw of n of the blocks; quotas beyond the generator's range are drawn in halves."""
    if own.sum() < 10**9:
        return draw.multivariate_hypergeometric(own, n, method="marginals") if len(own) else own
    half = own // 2
    k = n * int(half.sum()) // int(own.sum())
    return _left(draw, half, k) + _left(draw, own - half, n - k)


def split_quotas(quotas: np.ndarray, shards: int, seed: str = "mix") -> np.ndarray:
    """[shard, colour]: the leaves of the splitting tree over the colours' block quotas."""
    draw = np.random.default_rng(list(seed.encode()))
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(own: np.ndarray, a: int, b: int) -> None:
        if b - a == 1:
            out[a] = own
            return
        m = (a + b) // 2
        mine = _left(draw, own, int(own.sum()) * (m - a) // (b - a))
        split(mine, a, m)
        split(own - mine, m, b)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def draw_blocks(bins: DataFrame, shards: int, seed: str = "mix") -> DataFrame:
    """bins (plan) with `shards`, an array of the shard of each block: empty if none is taken."""
    n = F.col("epochs") + (F.col("last") != "").cast("int")
    colour = F.pmod("number", F.lit(COLOURS))
    quotas = bins.groupBy(colour.alias("c")).agg(F.sum(n).alias("q")).collect()  # COLOURS rows at most
    drawn = np.zeros(max((r.c for r in quotas), default=-1) + 1, np.int64)
    for r in quotas:
        drawn[r.c] = r.q
    ends = np.cumsum(split_quotas(drawn, shards, seed), 0)  # [shard, colour]: blocks up to the shard
    blocks = bins.where(n > 0).select("source", "bin", colour.alias("c"), F.explode(F.sequence(F.lit(1), n)).alias("epoch"))
    key = F.xxhash64(F.lit(seed), F.col("epoch"), F.col("bin"), F.coalesce("source", F.lit("")), F.col("source").isNull())
    blocks = durable(blocks.withColumn("k", key).withColumn("range", F.shiftrightunsigned(key, 64 - RANGES.bit_length() + 1).cast("int")))
    before = Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy("c", "range").agg(F.count("*").alias("m"))  # COLOURS * RANGES rows at most
    counts = counts.select("c", "range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("c", "range").orderBy("k", "source", "bin", "epoch")) - 1
    bounds = bins.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(ends.T)], "c int, ends array<long>")
    placed = blocks.withColumn("own", own).join(F.broadcast(counts), ["c", "range"]).join(F.broadcast(bounds), "c")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("ahead") + F.col("own")))
    lists = placed.groupBy(F.col("source").alias("s"), F.col("bin").alias("b")).agg(F.sort_array(F.collect_list(F.struct("epoch", shard.alias("shard")))).alias("l"))
    lists = lists.select("s", "b", F.transform("l", lambda e: e["shard"]).alias("shards"))
    out = bins.join(lists, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")), "left").drop("s", "b")
    return durable(out.withColumn("shards", F.coalesce("shards", F.array().cast("array<int>"))))


def _on_bin(rows: DataFrame, bins: DataFrame, facts: list[str]) -> DataFrame:
    """rows (with struct __of of source, bin and key) joined with the facts of their bin."""
    place = lambda s, b: F.struct(F.coalesce(s, F.lit("")).alias("s"), s.isNull().alias("no"), b.alias("b"))
    b = bins.select(place(F.col("source"), F.col("bin")).alias("\x01at"), F.struct(*facts).alias("\x01b"), "n")
    rows = rows.withColumn("\x01at", place(F.col("\x01of.source"), F.col("\x01of.bin")))
    if bins.count() <= BROADCAST_BINS:
        return rows.join(F.broadcast(b.drop("n")), "\x01at")
    return spread_join(rows, b, ["\x01at"], "n")


def _mine() -> Column:
    """Shards of the blocks that hold a row: those of all epochs, and of the last one if the
    row's key is not beyond the quota's."""
    more = (F.col("\x01of.key") <= F.col("\x01b.last")).cast("int")
    return F.slice(F.col("\x01b.shards"), F.lit(1), F.col("\x01b.epochs") + more)


def taken(docs: DataFrame, shards: int = 64, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, shards) for every row: the shards
    that drew a block with the row, one for each copy."""
    rows = durable(_sized(docs, seed))
    bins = draw_blocks(plan(rows, weights, max_repeats), shards, seed)
    own = rows.select("doc_id", "source", "size", F.struct("source", "bin", "key").alias("\x01of"))
    out = _on_bin(own, bins, ["source_size", "target", "epochs", "last", "shards"]).withColumn("shards", _mine())
    return out.select("doc_id", "source", "size", "\x01b.source_size", "\x01b.target", F.size("shards").alias("copies"), "shards")


def mix(docs: DataFrame, shards: int = 64, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, epoch: str = "epoch", shard: str = "shard") -> DataFrame:
    """The mixture: docs' rows, each as often as it is taken, with epoch and shard added
    (columns of docs that have these names are replaced).

    Rows come partitioned by shard, in tasks of about TASK_WORDS words, in random order
    within a task.  The texts move once: the plan joins them as a table of sources times
    BINS rows.
    """
    rows = durable(_sized(docs, seed))
    bins = draw_blocks(plan(rows, weights, max_repeats), shards, seed)
    spread = max(1, -(-int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // (shards * TASK_WORDS)))
    key = _key(seed)
    out = docs.select("*", F.struct(F.col("source"), _bin(key).alias("bin"), key.alias("key")).alias("\x01of"))
    out = _on_bin(out, bins, ["epochs", "last", "shards"])
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (epoch, shard)]
    out = out.select(*kept, "\x01of", F.posexplode(_mine()).alias("\x01e", shard))
    order = F.xxhash64("\x01of.key", "\x01e").alias("\x01o")
    out = out.select(*kept, (F.col("\x01e") + 1).alias(epoch), shard, order)
    return out.repartition(shard, F.pmod("\x01o", F.lit(spread))).sortWithinPartitions(shard, "\x01o").drop("\x01o")
