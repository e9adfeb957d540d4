"""Set-oriented kernels: intervals, ordinals, closures, as-of look-ups, prefixes, links.

Ordered kernels cut the keys into zones of the ordering column once a key has more than
HOT_ROWS rows, so that such a key spreads over tasks; only a bounded number of facts per key
and zone passes from zone to zone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, StringType

from nestquery.plans.durable import durable

#: Rows of a key that one task may order.
HOT_ROWS = 1_000_000
#: Links of an Arrow batch that a task gives back at once; ends that are broadcast.
LINK_ROWS, BROADCAST_LINKS = 65_536, 50_000


def _zone_count(df: DataFrame) -> int:
    return max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _zone(cuts: list[float], c: Column) -> Column:
    """The number of cuts below c, by a balanced tree of comparisons."""
    cuts = sorted(set(cuts))

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(c > cuts[m], tree(m + 1, b)).otherwise(tree(a, m))

    return tree(0, len(cuts))


def _zoned(df: DataFrame, keys: list[str], order: str, hot_rows: int) -> DataFrame:
    """df with __z, the zone of the ordering column; one zone if no key is large or the column
    is no number."""
    one = df.withColumn("__z", F.lit(0))
    if not isinstance(df.schema[order].dataType, NumericType):
        return one
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else df.count()
    if (most or 0) <= hot_rows:
        return one
    cuts = df.approxQuantile(order, [i / _zone_count(df) for i in range(1, _zone_count(df))], 0.002)
    return df.withColumn("__z", _zone(cuts, F.col(order)))


def _on_zone(z: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the facts of their key and zone (null keys are keys)."""
    facts = [c for c in heads.columns if c not in (*keys, "__z")]
    heads = heads.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__z").alias("__zz"), *facts)
    on = F.col("__z") == F.col("__zz")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return z.join(heads, on).drop("__zz", *[f"__k{i}" for i in range(len(keys))])


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("__z").rowsBetween(Window.unboundedPreceding, -1)


def _before(df: DataFrame, keys: list[str], lo: str, hi: str, hot_rows: int) -> DataFrame:
    """df with __z and __h: the greatest hi of a key's ranges before this one (null: none)."""
    z = _zoned(df, keys, lo, hot_rows)
    own = Window.partitionBy(*keys, "__z").orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    heads = z.groupBy(*keys, "__z").agg(F.max(hi).alias("__t")).withColumn("__c", F.max("__t").over(_earlier(keys))).drop("__t")
    z = _on_zone(z.withColumn("__h", F.max(hi).over(own)), heads, keys)
    return z.withColumn("__h", F.greatest("__h", "__c")).drop("__c")


def coalesce_intervals(df: DataFrame, keys: list[str], lo: str, hi: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, lo, hi, n): overlapping and touching [lo, hi) ranges of a key made one."""
    z = _before(df.select(*keys, lo, hi), keys, lo, hi, hot_rows)
    z = z.withColumn("__new", F.col("__h").isNull() | (F.col(lo) > F.col("__h")))
    # Equal ranges come in the order in which __h has met them.
    own = Window.partitionBy(*keys, "__z").orderBy(lo, hi, F.col("__h").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    # Runs within a zone; the first may go on one of an earlier zone.
    runs = z.withColumn("__g", F.sum(F.col("__new").cast("int")).over(own)).groupBy(*keys, "__z", "__g").agg(
        F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n"), F.max(F.col("__new").cast("int")).alias("__new")
    )
    closed = runs.where("__g > 0")
    # A run is named by its first range; a zone's open run takes the name of the last one.
    heads = runs.groupBy(*keys, "__z").agg(F.max(F.when(F.col("__g") > 0, F.col(lo))).alias("__last"), F.max(F.when(F.col("__g") == 0, F.lit(1))).alias("__open"))
    past = Window.partitionBy(*keys).orderBy("__z").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*keys, "__z", "__open", F.last("__last", ignorenulls=True).over(past).alias("__name"))
    heads = heads.where("__open = 1").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__z").alias("__zz"), "__name")
    on = F.col("__z") == F.col("__zz")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    carried = runs.where("__g = 0").join(heads, on).select(*keys, F.col("__name").alias("__run"), lo, hi, "n")
    parts = closed.select(*keys, F.col(lo).alias("__run"), lo, hi, "n").unionByName(carried)
    return parts.groupBy(*keys, "__run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.sum("n").alias("n")).drop("__run")


def holes(df: DataFrame, keys: list[str], lo: str, hi: str, sizes: DataFrame | None = None, size: str = "size", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, lo, hi): the gaps between the merged ranges of a key; with sizes (keys, size) also
    those from 0 to the first range and from the last one to the key's size."""
    r = df.select(*keys, lo, hi)
    if sizes is not None:
        kind = df.schema[lo].dataType
        edge = lambda c: sizes.select(*keys, c.cast(kind).alias(lo), c.cast(kind).alias(hi))
        r = r.unionByName(edge(F.lit(0))).unionByName(edge(F.col(size)))
    z = _before(r, keys, lo, hi, hot_rows).where(F.col("__h") < F.col(lo))
    return z.select(*keys, F.col("__h").alias("__a"), F.col(lo).alias("__b")).select(*keys, F.col("__a").alias(lo), F.col("__b").alias(hi))


def running_extents(df: DataFrame, keys: list[str], order: list[str], length: str, name: str = "log", hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with the logical offset of each part in its key's concatenation."""
    z = _zoned(df, keys, order[0], hot_rows)
    w = Window.partitionBy(*keys, "__z").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    heads = z.groupBy(*keys, "__z").agg(F.sum(length).alias("__t")).withColumn("__c", F.sum("__t").over(_earlier(keys))).drop("__t")
    z = _on_zone(z.withColumn("__s", F.sum(length).over(w)), heads, keys)
    return z.withColumn(name, F.coalesce("__s", F.lit(0)) + F.coalesce("__c", F.lit(0))).drop("__s", "__c", "__z")


def previous_overlap(df: DataFrame, keys: list[str], lo: str, hi: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with `overlaps`: whether a range begins before the one before it ends."""
    z = _zoned(df, keys, lo, hot_rows)
    last = F.lag(F.struct(hi)).over(Window.partitionBy(*keys, "__z").orderBy(lo, hi))
    heads = z.groupBy(*keys, "__z").agg(F.max(F.struct(F.col(lo).alias("a"), F.col(hi).alias("b"))).alias("__t"))
    heads = heads.withColumn("__c", F.last("__t").over(_earlier(keys))["b"]).drop("__t")
    z = _on_zone(z.withColumn("__l", last), heads, keys)
    end = F.when(F.col("__l").isNotNull(), F.col("__l")[hi]).otherwise(F.col("__c"))
    return z.withColumn("overlaps", F.coalesce(F.col(lo) < end, F.lit(False))).drop("__l", "__c", "__z")


def ordinal_names(df: DataFrame, kind: Column, order: list[str], name: str = "ordinal_name", hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with type-1, type-2 ... per lower-cased kind in order."""
    z = _zoned(df.withColumn("__kind", F.lower(kind)), ["__kind"], order[0], hot_rows)
    n = F.row_number().over(Window.partitionBy("__kind", "__z").orderBy(*order))
    heads = z.groupBy("__kind", "__z").agg(F.count("*").alias("__t")).withColumn("__c", F.sum("__t").over(_earlier(["__kind"]))).drop("__t")
    z = _on_zone(z.withColumn("__n", n), heads, ["__kind"])
    number = (F.col("__n") + F.coalesce("__c", F.lit(0))).cast("string")
    return z.withColumn(name, F.concat("__kind", F.lit("-"), number)).drop("__n", "__c", "__z", "__kind")


def asof_forward(left: DataFrame, right: DataFrame, at: str, value: str, carry: list[str], by: str | None = None) -> DataFrame:
    """left with the right row of least `value` >= `at` (nulls if there is none), per `by`.

    Both sides are merged into one ordered stream per key and zone of the axis, so nothing
    is joined pair by pair and no key is one task's; a zone whose stream ends without a
    right row takes the first of the next zones, from a table of one row per key and zone.
    """
    cuts = right.approxQuantile(value, [i / _zone_count(left) for i in range(1, _zone_count(left))], 0.002)
    key = (F.col(by) if by else F.lit(0)).alias("__k")
    row = F.struct(F.col(value).alias("__v"), *[F.col(c) for c in carry])
    x = lambda c: F.col(c).alias("__x")
    a = left.select(F.struct("*").alias("__l"), key, x(at), F.lit(0).alias("__s")).withColumn("__z", _zone(cuts, F.col("__x")))
    r = right.select(key, x(value), row.alias("__r"), F.lit(1).alias("__s")).withColumn("__z", _zone(cuts, F.col("__x")))
    heads = r.groupBy("__k", "__z").agg(F.min("__r").alias("__head"))
    heads = heads.unionByName(a.select("__k", "__z").distinct(), allowMissingColumns=True).groupBy("__k", "__z").agg(F.min("__head").alias("__head"))
    # From the high end down: a frame that grows costs one step a row, one that shrinks starts anew.
    later = Window.partitionBy("__k").orderBy(F.desc("__z")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(F.col("__k").alias("__kk"), F.col("__z").alias("__zz"), F.last("__head", ignorenulls=True).over(later).alias("__next"))
    on = Window.partitionBy("__k", "__z").orderBy(F.desc("__x"), F.desc("__s"), F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(r, allowMissingColumns=True).withColumn("__r", F.last("__r", ignorenulls=True).over(on)).where("__s = 0")
    got = both.join(heads, F.col("__k").eqNullSafe(F.col("__kk")) & (F.col("__z") == F.col("__zz")), "left")
    # Rows without a key match nothing.
    found = F.when(F.col("__k").isNotNull() & F.col("__x").isNotNull(), F.coalesce("__r", "__next"))
    return got.withColumn("__r", found).select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in carry], F.col("__r.__v").alias(value))


def covering_range(points: DataFrame, ranges: DataFrame, key: str, at: str, lo: str, hi: str) -> DataFrame:
    """points with the range [lo, hi) of their key that holds `at` (nulls: none), for ranges
    that don't overlap: the first that ends after the point, if it begins in time."""
    after = points.withColumn("__at", F.col(at) + 1)
    got = asof_forward(after, ranges.select(key, lo, hi), "__at", hi, [lo], by=key).drop("__at")
    inside = F.col(lo) <= F.col(at)
    return got.select(*points.columns, F.when(inside, F.col(lo)).alias(lo), F.when(inside, F.col(hi)).alias(hi))


def hit_counts(points: DataFrame, ranges: DataFrame, key: str, at: str, length: str, lo: str, hi: str) -> DataFrame:
    """(hit, miss): bytes asked for at points that lie in their key's ranges, and the others."""
    got = covering_range(points, ranges, key, at, lo, hi)
    held = F.when(F.col(lo).isNull(), 0).otherwise(F.least(F.col(at) + F.col(length), F.col(hi)) - F.col(at))
    got = got.select(held.alias("h"), F.col(length).alias("n"))
    return got.agg(F.coalesce(F.sum("h"), F.lit(0)).alias("hit"), F.coalesce(F.sum(F.col("n") - F.col("h")), F.lit(0)).alias("miss"))


def implicit_dirs(paths: DataFrame, path: str) -> DataFrame:
    """(path, depth, is_dir) of all prefixes of slash-separated paths."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    each = paths.select(parts.alias("c")).where(F.size("c") > 0).select("c", F.explode(F.sequence(F.lit(1), F.size("c"))).alias("depth"))
    each = each.select(F.array_join(F.slice("c", F.lit(1), F.col("depth")), "/").alias("path"), "depth", (F.col("depth") < F.size("c")).cast("int").alias("d"))
    return each.groupBy("path", "depth").agg(F.max("d").alias("is_dir"))


def path_closure(nodes: DataFrame, node: str, above: str, name: str) -> DataFrame:
    """(node, path) by parent pointers; nodes whose chain does not end at a null parent are
    left out.  Pointer doubling: 2^k steps up after k joins, so depth costs its logarithm,
    and nodes whose chain is longer than there are nodes are in circles."""
    t = durable(nodes.select(F.col(node).alias("n"), F.col(above).alias("up"), F.col(name).alias("path")))
    steps, most = 1, t.count()
    while steps <= most and not t.where("up is not null").isEmpty():
        steps *= 2
        u = t.select(F.col("n").alias("m"), F.col("up").alias("up2"), F.col("path").alias("head"))
        t = durable(t.join(u, F.col("up") == F.col("m"), "left").where("up is null or m is not null").select(
            "n", F.when(F.col("up").isNull(), None).otherwise(F.col("up2")).alias("up"),
            F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("head", F.lit("/"), "path")).alias("path"),
        ))
    return t.where("up is null").select(F.col("n").alias(node), "path")


def _shortened(step: DataFrame, rows: int) -> DataFrame:
    """(s, t, at) of links (s, at), each s once: t the target, at where the links that lie beside
    it in a task, up to some `rows` at once, lead; s itself for what leads into a circle of them."""
    kind = step.schema["s"].dataType.simpleString()

    def short(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held).combine_chunks()
        s, t = (table.column(c).combine_chunks() for c in ("s", "at"))
        after = pc.fill_null(pc.index_in(t, value_set=s), -1).to_numpy(zero_copy_only=False)
        own = np.arange(len(after), dtype=after.dtype)
        to = np.where(after < 0, own, after)
        for _ in range(len(after).bit_length()):  # 2^k steps after k rounds
            to, last = to[to], to
            if np.array_equal(to, last):
                break
        circle = pa.array(after[to] >= 0)
        return pa.table({"s": s, "t": t, "at": pc.if_else(circle, s, t.take(pa.array(to)))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from short(held).to_batches(max_chunksize=LINK_ROWS)
                held, n = [], 0
        if n:
            yield from short(held).to_batches(max_chunksize=LINK_ROWS)

    return step.select("s", "at").mapInArrow(run, f"s {kind}, t {kind}, at {kind}")


def _doubled(step: DataFrame) -> DataFrame:
    """(s, at): where links (s, at), each s once, end, by pointer doubling; s itself for what
    leads into a circle, which no number of steps gets out of."""
    steps, most = 1, step.count()
    parts = int(step.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = step.join(step.select(F.col("s").alias("x")), F.col("at") == F.col("x"), "left").select("s", "at", F.col("x").isNotNull().alias("open"))
    ends = durable(ends)
    while steps <= most and not ends.where("open").isEmpty():
        steps *= 2
        on = ends.select(F.col("s").alias("x"), F.col("at").alias("at2"), F.col("open").alias("open2"))
        moved = ends.where("open").join(on, F.col("at") == F.col("x")).select("s", F.col("at2").alias("at"), F.col("open2").alias("open"))
        # A union has the parts of both sides, and would have more each round.
        ends = durable(ends.where("not open").unionByName(moved).coalesce(parts))
    return ends.select("s", F.when(F.col("open"), F.col("s")).otherwise(F.col("at")).alias("at"))


def _link_ends(step: DataFrame, rows: int) -> DataFrame:
    """(s, t, at): where links (s, t), each s once, end; s itself for what leads into a circle.

    Ranges of sources are shortened each by itself; what is left to resolve are the links that
    one leads to from another, often far fewer.  If they aren't, they are doubled.
    """
    n = step.count()
    if n <= rows:
        return durable(_shortened(step.repartition(1), rows))
    near = durable(_shortened(step.repartitionByRange("s"), rows))
    heads = near.where("not (at <=> s)").select(F.col("at").alias("head")).distinct()
    left = durable(near.join(heads, F.col("s") == F.col("head"), "left_semi").select("s", "at"))
    m = left.count()
    far = _link_ends(left, rows) if 2 * m <= n or m <= rows else _doubled(left)
    far = far.select(F.col("s").alias("x"), F.col("at").alias("end"))
    out = near.join(F.broadcast(far) if m <= BROADCAST_LINKS else far, F.col("at") == F.col("x"), "left")
    circle = F.col("at").eqNullSafe(F.col("s")) | F.col("end").eqNullSafe(F.col("x")) & F.col("x").isNotNull()
    return durable(out.select("s", "t", F.when(circle, F.col("s")).when(F.col("x").isNull(), F.col("at")).otherwise(F.col("end")).alias("at")))


def resolve_links(links: DataFrame, source: str, target: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(source, target, resolved): chains of any length followed to their end; null for what
    leads into a circle.

    Of rows with one source the least target counts for those that lead there.
    """
    start = durable(links.select(F.col(source).alias("s"), F.col(target).alias("t")))
    step = durable(start.groupBy("s").agg(F.min("t").alias("at")).where("s is not null"))
    kind = step.schema["s"].dataType
    if kind == step.schema["at"].dataType and (isinstance(kind, IntegralType) or kind == StringType()):
        ends = _link_ends(step, hot_rows)
        if start.count() == step.count():  # each source once: a link ends where its source does
            found = F.when(~F.col("at").eqNullSafe(F.col("s")), F.col("at"))
            return ends.select(F.col("s").alias(source), F.col("t").alias(target), found.alias("resolved"))
    else:
        ends = _doubled(step)
    on = ends.select(F.col("s").alias("x"), F.col("at").alias("end"))
    out = start.join(on, F.col("t") == F.col("x"), "left")
    found = F.when(F.col("x").isNull(), F.col("t")).when(~F.col("end").eqNullSafe(F.col("x")), F.col("end"))
    return out.select(F.col("s").alias(source), F.col("t").alias(target), found.alias("resolved"))


def _follow_once(open_: DataFrame, links: DataFrame) -> DataFrame:
    """One step of resolve_paths: of each row (name, at, seen) the first prefix of `at` that is
    a link gives way to where that link (key, to, via, ended) has got so far.

    Columns more: hit (a link was there), lost (a link is met again), ended.
    """
    parts = F.split("at", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("key")))
    each = open_.select("name", F.explode(prefix).alias("p")).select("name", "p.depth", "p.key")
    first = each.join(links, "key").groupBy("name").agg(F.min(F.struct("depth", "key", "to", "via", "ended", "lost")).alias("l"))
    both = open_.join(first, "name", "left")
    hit = F.col("l").isNotNull()
    rest = F.slice(parts, F.col("l.depth") + 1, F.greatest(F.size(parts) - F.col("l.depth"), F.lit(0)))
    at = F.concat_ws("/", F.col("l.to"), F.when(F.size(rest) > 0, F.array_join(rest, "/")))
    lost = F.col("l.lost") | F.arrays_overlap("seen", "l.via")
    return both.select(
        "name", F.when(hit, F.regexp_replace(at, r"^\./", "")).otherwise(F.col("at")).alias("at"),
        F.when(hit, F.array_union("seen", "l.via")).otherwise(F.col("seen")).alias("seen"),
        F.coalesce(lost, F.lit(False)).alias("lost"), F.when(hit, F.col("l.ended") & (F.size(rest) == 0)).otherwise(True).alias("ended"),
    )


def resolve_paths(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path, resolved): links (path, target) followed component by component, the last one too;
    null where a look-up meets a link a second time.

    Links are resolved first, each round through what the others have got to, so a chain costs
    the logarithm of its length; then each path takes a round for each link that it passes.
    """
    own = durable(links.groupBy("path").agg(F.min("target").alias("target")).withColumn("id", F.monotonically_increasing_id()))
    state = durable(own.select(F.col("path").alias("name"), F.col("target").alias("at"), F.array("id").alias("seen"), F.lit(False).alias("lost"), F.lit(False).alias("ended")))
    as_link = lambda s: s.select(F.col("name").alias("key"), F.col("at").alias("to"), F.col("seen").alias("via"), "ended", "lost")

    def run(rows: DataFrame, against) -> DataFrame:
        done = rows.limit(0)
        while not (open_ := rows.where("not ended and not lost")).isEmpty():
            done = done.unionByName(rows.where("ended or lost"))
            rows = durable(_follow_once(open_.select("name", "at", "seen"), as_link(against(done, rows))))
        return done.unionByName(rows)

    state = durable(run(state, lambda done, rows: done.unionByName(rows)))
    empty = F.slice(F.array(F.lit(0).cast("long")), 1, 0)
    asked = durable(paths.select(F.col("path").alias("name")).where("name is not null").distinct())
    asked = asked.select("name", F.col("name").alias("at"), empty.alias("seen"), F.lit(False).alias("lost"), F.lit(False).alias("ended"))
    out = run(asked, lambda done, rows: state)
    return out.select(F.col("name").alias("path"), F.when(~F.col("lost"), F.col("at")).alias("resolved"))
