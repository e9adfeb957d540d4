"""Sets of word shingles: minhash bands, exact Jaccard similarity, and the links of a bucket.

Words are cut and lowered as in simhash_gph; a text's set holds the XXH64 values of its
shingles.  A pair at similarity s shares none of BANDS bands of ROWS minhashes with
probability (1 - s**ROWS)**BANDS, 6e-7 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import bounded_batches
from .common import shares, spread_join

BANDS, ROWS = 20, 3
#: Shingles minhashed at once.
CHUNK = 1 << 14
#: Nodes of a bucket compared in one task; larger buckets are split.
BLOCK = 2048
_SEEDS = np.random.default_rng(6).integers(0, 2**64, BANDS * ROWS, np.uint64)


def shingle_hashes(text: bytes | None, shingle: int, xxh) -> np.ndarray:
    """XXH64 values of the shingles in order, repeats included; none for a text without words."""
    words = text.lower().split() if text else []  # bytes: ASCII letters and spaces only
    if len(words) <= shingle:
        return np.array([xxh(b" ".join(words), 42)] if words else [], np.uint64)
    joined = b" ".join(words)
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=begin[1:])
    spans = zip(begin[:-shingle].tolist(), (begin[shingle:] - 1).tolist())
    return np.array([xxh(joined[a:b], 42) for a, b in spans], np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: equal if the band's minhashes are."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        x = hashes[i : i + CHUNK, None] ^ _SEEDS
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ least[r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xxh

        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle, xxh)).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    bounded_batches(docs.sparkSession)
    return docs.select("node", "text").mapInArrow(run, "node long, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity."""
    for end, name in (("a", "ha"), ("b", "hb")):
        asked = pairs.select(end).groupBy(end).agg(F.count("*").alias("n"))
        table = asked.join(sets.select(F.col("node").alias(end), F.col("hashes").alias(name)), end)
        pairs = spread_join(pairs, table, [end], "n", shares(asked, "n"))
    sizes = F.size("ha") + F.size("hb")
    long_enough = F.least(F.size("ha"), F.size("hb")) >= similarity * F.greatest(F.size("ha"), F.size("hb")) - 1e-9
    same = F.size(F.array_intersect("ha", "hb"))
    return pairs.where(F.when(long_enough, same >= similarity * (sizes - same) - 1e-9).otherwise(False)).select("a", "b")


def _bucket_links(node: np.ndarray, c: np.ndarray, flat: np.ndarray, bounds: np.ndarray, similarity: float):
    """Edges that join a bucket's components c; node k has the set flat[bounds[k]:bounds[k + 1]].
    A pair that is connected already is not compared."""
    label = np.unique(c, return_inverse=True)[1]
    values, codes = np.unique(flat, return_inverse=True)
    size = np.diff(bounds)
    mark = np.zeros(len(values), np.int32)
    a, b = [], []
    for i in range(len(node) - 1):
        apart = label[i + 1 :] != label[i]
        if not apart.any():
            continue
        own = codes[bounds[i] : bounds[i + 1]]
        mark[own] = 1
        same = np.add.reduceat(mark[codes[bounds[i + 1] :]], bounds[i + 1 : -1] - bounds[i + 1])
        mark[own] = 0
        near = np.flatnonzero(apart & (same >= similarity * (size[i] + size[i + 1 :] - same) - 1e-9)) + i + 1
        if len(near):
            joined, first = np.unique(label[near], return_index=True)
            a += [node[i]] * len(first)
            b += node[near[first]].tolist()
            label[np.isin(label, joined)] = label[i]
    return a, b


def linked(rows: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b): edges between components c of rows (g, node, c, n) with the same outcome as all
    links within each bucket g of n nodes.  Pairs of blocks of a large bucket go to different tasks."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(F.xxhash64("g", F.least(own, "x"), F.greatest(own, "x")).alias("g"), "node", "c")
    rows = rows.join(sets, "node").select("g", "node", "c", "hashes").repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is None:
                ready, held = held, None
            else:
                t = pa.Table.from_batches([batch])
                t = t if held is None else pa.concat_tables([held, t])
                g = t.column(0).to_numpy()
                cut = int(np.searchsorted(g, g[-1], "left")) if len(g) else 0
                ready, held = t.slice(0, cut), t.slice(cut)
            if ready is None or not len(ready):
                continue
            g, node, c = (ready.column(k).to_numpy() for k in range(3))
            lists = ready.column(3).combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            flat = lists.flatten().to_numpy()
            bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            start = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            for s, e in zip(start[:-1].tolist(), start[1:].tolist()):
                own = bounds[s : e + 1]
                a, b = _bucket_links(node[s:e], c[s:e], flat[own[0] : own[-1]], own - own[0], similarity)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")
