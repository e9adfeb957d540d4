"""Operator 6: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits; a bit is 1 if it is set in over half of the XXH64 values (seed 42)
of the text's word shingles.  Two fingerprints link at `distance` or fewer differing bits.

Search: equal fingerprints collapse to one first (partial aggregation, so a group of
copies of any size is cheap).  The bits are grouped into partitions of correlated bits;
each partition i gets its own threshold t_i >= -1 with sum(t_i + 1) = distance + 1, so
every link differs in at most t_i bits of some partition with t_i >= 0.  Thresholds come
from dynamic programming on the estimated candidates and probe rows, from bit statistics
over all fingerprints.  A fingerprint is indexed under its value in each partition and
probes all values within t_i bits; candidates are verified on all 64 bits.

Buckets over BLOCK rows are split into blocks, and pairs of blocks go to different tasks;
only spanning edges of the links found leave a task, never all pairs.

similar() and keep_one() link documents by the exact Jaccard similarity of their shingle
sets.  The search above finds the close candidates.  64 bits don't reach further: texts at
similarity 0.8 differ in 9.7 bits on average, and a distance that holds them all (18) has
partitions so selective that candidates grow with the square of the corpus.  So bands of
minhashes add the candidates between, and every candidate is verified on whole sets.

Defined cases: null or empty text has no words and fingerprint zero (an empty set), linked
like any other; fewer words than a shingle make one shingle of them all; rows with equal
doc_id stay apart rows; a null doc_id is kept with its fingerprint, and is no candidate for
component_id (null if a component has no other).  Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import bounded_batches
from .common import connected_components, durable, spanning_edges, spread_join
from .shingle_sets import BANDS, band_keys, linked, sets_of, shingle_hashes, verified
from .shingle_sets import BLOCK as BUCKET

BITS = 64
#: Rows of a bucket compared in one task; larger buckets are split.
BLOCK = 4096
#: Names of rows (40 bytes each) that are broadcast, so that texts stay where they are.
BROADCAST_ROWS = 500_000
#: Pairs compared at once.
SLAB = 1 << 21
#: Relative cost of a probe row moved through the shuffle and of a candidate pair verified.
ROW_COST, PAIR_COST = 60.0, 1.0


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the shingles' hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xxh

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py(), shingle, xxh)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set; over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8)
            bits = np.unpackbits(x, bitorder="little").reshape(-1, BITS).astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        counts = np.r_[n, both.ravel().astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts.astype(np.int64))], names=["k", "n"])

    rows = fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect()  # 4,097 sums
    flat = np.zeros(1 + BITS * BITS, np.int64)
    for k, n in rows:
        flat[k] = n
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in groups of nearly equal width, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for g in range(groups):
        width = (len(left) + groups - g - 1) // (groups - g)
        own = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda b: corr[b, own].sum()))
            left.remove(own[-1])
        out.append(own)
    return out


def closeness(n: int, both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0..most of the bits: a Markov chain
    over the bits in order, its steps from the joint frequencies of neighbours."""
    f = both / max(n, 1)
    p = np.diag(f)
    agree = p**2 + (1 - p) ** 2
    state = np.zeros((2, most + 2))
    state[1, 0], state[0, 1] = agree[bits[0]], 1 - agree[bits[0]]
    for a, b in zip(bits, bits[1:]):
        q = np.array([f[a, b], p[a] - f[a, b], p[b] - f[a, b], 1 - p[a] - p[b] + f[a, b]])
        joint = float((np.maximum(q, 0) ** 2).sum())  # both bits agree
        stay = min(joint / max(agree[a], 1e-12), 1)
        enter = min(max((agree[b] - joint) / max(1 - agree[a], 1e-12), 0), 1)
        new = np.zeros_like(state)
        new[1] = state[1] * stay + state[0] * enter
        differ = state[1] * (1 - stay) + state[0] * (1 - enter)
        new[0, 1:] = differ[:-1]
        new[0, -1] += differ[-1]
        state = new
    return np.cumsum(state.sum(0))[: most + 1]


def variants(width: int, t: int) -> float:
    from math import comb

    return sum(comb(width, k) for k in range(1, t + 1)) / 2 + 1


def allocate(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, of least estimated cost."""
    best: tuple[float, list] = (float("inf"), [])
    for groups in range(1, distance + 2):
        parts = group_bits(n, both, groups)
        cost = []
        for bits in parts:
            near = closeness(n, both, bits, distance)
            cost.append([0.0] + [ROW_COST * n * variants(len(bits), t) + PAIR_COST * n * n / 2 * near[t] for t in range(distance + 1)])
        plan: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (sofar, ts) in plan.items():
                for share in range(distance + 2 - used):
                    x = (sofar + c[share], [*ts, share - 1])
                    if used + share not in new or x[0] < new[used + share][0]:
                        new[used + share] = x
            plan = new
        total, ts = plan[distance + 1]
        if total < best[0]:
            best = (total, [(b, t) for b, t in zip(parts, ts) if t >= 0])
    return best[1]


def probe_rows(reps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp, probe): a row for the value of each partition and for each variant."""
    from itertools import combinations

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (bits, t) in enumerate(plan):
                mask = np.uint64(sum(1 << b for b in bits))
                value = fp & mask
                out = [(value, fp, False)]
                for k in range(1, t + 1):
                    for flip in combinations(sorted(bits), k):
                        # Of two that differ in these bits, the one whose lowest bit is 0 probes.
                        own = (fp >> np.uint64(flip[0])) & np.uint64(1) == 0
                        out.append((value[own] ^ np.uint64(sum(1 << b for b in flip)), fp[own], True))
                for v, f, probe in out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), i, np.int32)), pa.array(v.view(np.int64)), pa.array(f.view(np.int64)), pa.array(np.full(len(v), probe))],
                        names=["part", "value", "fp", "probe"],
                    )

    return reps.select("fp").mapInArrow(run, "part int, value long, fp long, probe boolean")


def _links(group: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int):
    """Spanning edges of the links within whole groups; rows sorted by group, indexed first."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    number = np.repeat(np.arange(len(start)), size)
    indexed = np.bincount(number[~probe], minlength=len(start))
    end = (start + indexed)[number]
    begin = np.where(probe, start[number], np.arange(len(group)) + 1)
    count = np.maximum(end - begin, 0)
    edges = []
    bounds = np.r_[0, np.cumsum(count)]
    row = 0
    while row < len(count):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLAB, "right")) - 1)
        c = count[row:stop]
        left = np.repeat(np.arange(row, stop), c)
        right = np.repeat(begin[row:stop] - (np.cumsum(c) - c), c) + np.arange(len(left))
        near = np.bitwise_count(fp[left] ^ fp[right]) <= distance
        if near.any():
            edges.append(spanning_edges(fp[left[near]].view(np.int64), fp[right[near]].view(np.int64)))
        row = stop
    return edges


def links(reps: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between distinct fingerprints with the same components as all links."""
    n, both = bit_statistics(reps)
    plan = allocate(n, both, distance)
    rows = probe_rows(reps, plan)
    hot = rows.where("not probe").groupBy("part", "value").count().where(F.col("count") > block)
    if not hot.isEmpty():
        rows = rows.join(hot, ["part", "value"], "left").withColumn(
            "blocks", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
        )
        own: Column = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "part", "value", "fp", "probe",
            F.when(F.col("probe"), F.col("x")).otherwise(F.least(own, "x")).alias("x"),
            F.when(F.col("probe"), F.col("x")).otherwise(F.greatest(own, "x")).alias("y"),
        )
    else:
        rows = rows.select("part", "value", "fp", "probe", F.lit(0).alias("x"), F.lit(0).alias("y"))
    rows = rows.select(F.xxhash64("part", "value", "x", "y").alias("g"), "fp", "probe")
    rows = rows.repartition("g").sortWithinPartitions("g", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]
        for batch in (*batches, None):
            if batch is None:
                ready, held = held, [x[:0] for x in held]
            else:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                new[1] = new[1].view(np.uint64)
                rows = [np.concatenate(x) for x in zip(held, new)]
                cut = int(np.searchsorted(rows[0], rows[0][-1], "left")) if len(rows[0]) else 0
                ready, held = [x[:cut] for x in rows], [x[cut:] for x in rows]
            if len(ready[0]):
                for a, b in _links(*ready, distance):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of docs."""
    fps = durable(fingerprints(docs, shingle))
    reps = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    parts = connected_components(links(reps, distance, block))
    named = durable(reps.join(parts, reps.fp == parts.node, "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("k"))
    per_fp = durable(spread_join(named, least, ["component"], "k").select("fp", "component_id", "n"))
    return spread_join(fps, per_fp, ["fp"], "n").select("doc_id", "fp", "component_id")


def _named(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h, key, fp, bands) for every row; key (128 bits) names the shingle set, h the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest, xxh64_intdigest

        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), shingle, xxh64_intdigest) for t in batch.column(2).cast(pa.binary())]
            sets = [np.unique(x) for x in hashes]
            fps = np.fromiter(map(fingerprint, hashes), np.uint64, len(hashes)).view(np.int64)
            keys = np.concatenate([band_keys(x) for x in sets]) if sets else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
            named = pa.array([xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), named, pa.array(fps), bands], names=["doc_id", "h", "key", "fp", "bands"])

    bounded_batches(docs.sparkSession)
    return _named(docs).mapInArrow(run, "doc_id long, h long, key binary, fp long, bands array<long>")


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 4, block: int = BUCKET) -> DataFrame:
    """(key, doc_id, h, n, component) for every shingle set of docs: its n rows are equal but for
    repeated words; doc_id and h (hash of the text) name the first of them.

    Rounds keep a large group of copies cheap: first the links between fingerprints, and of
    every node one pair with the least node that shares a band with it, are verified; then, in
    buckets that still hold several components, a task compares nodes of different components.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h"))
    nodes = _signatures(docs, shingle).groupBy("key").agg(first.alias("who"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    same = durable(nodes.groupBy("fp").agg(F.min("node").alias("low"), F.count("*").alias("n")))
    name = lambda c, to: same.select(F.col("fp").alias(c), F.col("low").alias(to))
    tight = links(same, distance).join(name("a", "u"), "a").join(name("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    equal = spread_join(nodes.select("node", "fp"), same.where("n > 1"), ["fp"], "n").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))

    bands = nodes.select("node", F.explode("bands").alias("g"))
    least = bands.groupBy("g").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high")
    buckets = durable(spread_join(bands, least.select("g", "low", "n"), ["g"], "n"))
    star = buckets.groupBy(F.col("node").alias("b")).agg(F.min("low").alias("a")).where("a <> b").select("a", "b")
    pairs = durable(star.unionByName(tight).unionByName(equal).distinct())
    used = buckets.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    used = durable(used.join(nodes.select("node", "who"), "node").select("node", F.col("who.doc_id").alias("i"), F.col("who.h").alias("k")))
    some = used.count()
    few = F.broadcast(used) if some <= BROADCAST_ROWS else used
    owned = _named(docs).join(few, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")))
    sets = durable(sets_of(owned, shingle))
    if sets.count() > some:  # rows repeat id and text
        sets = durable(sets.dropDuplicates(["node"]))

    near = durable(verified(pairs, sets, similarity))
    parts = connected_components(near).withColumnRenamed("node", "m")
    split = buckets.join(parts, F.col("node") == F.col("m"), "left").select("g", "node", F.coalesce("component", "node").alias("c"))
    open_ = split.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where("c0 <> c1").select("g", "n", F.col("n").alias("rows"))
    left = spread_join(split, open_, ["g"], "rows")
    near = durable(near.unionByName(linked(left, sets, similarity, block)))
    parts = connected_components(near).withColumnRenamed("node", "m")
    out = nodes.join(parts, F.col("node") == F.col("m"), "left")
    return out.select("key", "who.doc_id", "who.h", "n", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """docs with one row of each component of similar(): that of the smallest doc_id (null
    last), and of rows that repeat it that of the least text hash, so a row goes only for a
    row of its own component.  Rows that repeat id and text are one."""
    found = similar(docs, shingle, similarity, distance)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("w")
    best = found.groupBy("component").agg(first).select(F.col("w.doc_id").alias("\x01i"), F.col("w.h").alias("\x01h"))
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("i"), F.xxhash64(text).alias("h"))
    own = durable(own.groupBy("i", "h").agg(F.count("*").alias("n")))
    kept = own.join(best, F.col("i").eqNullSafe(F.col("\x01i")) & (F.col("h") == F.col("\x01h")), "left")
    # Rows that go, and rows that repeat id and text, of which one stays.
    odd = durable(kept.where("n > 1 or `\x01h` is null").select(F.col("i").alias("\x01i"), F.col("h").alias("\x01h"), F.col("\x01h").isNotNull().alias("\x01one")))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("\x01i")) & (F.xxhash64(text) == F.col("\x01h"))
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    out = docs.join(few(odd.drop("\x01one")), mine, "left_anti")
    again = durable(odd.where("`\x01one`").drop("\x01one"))
    if again.isEmpty():
        return out
    return out.unionByName(docs.join(few(again), mine, "left_semi").dropDuplicates(["doc_id", "text"]))
