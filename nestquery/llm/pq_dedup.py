"""Operator 1: embedding near-duplicates by product quantisation.

Vectors of one label and dimension link at cosine >= `threshold` (double precision).  On
unit vectors that is distance <= r = sqrt(2 - 2 threshold).

Index: a coarse quantiser makes inverted lists; each list holds its vectors' residuals as
codes of M subspaces and the length e(y) of what the codes miss.  Both codebooks come from
k-means over a bounded sample (SAMPLE vectors of least hash); all vectors are indexed.

Search: vector x of list i probes its own list and each later list j that can hold a
neighbour: if y lies in j within r of x, x lies within r of the bisector of the two
centroids, so (|x-c_j|^2 - |x-c_i|^2) / (2 |c_i-c_j|) <= r.  In a list, the asymmetric
distance d(x, code(y)) from table lookups bounds the true one from below by d - e(y);
survivors get the exact cosine.  Both tests keep every link, so recall is 1 by design.

Equal vectors of a label collapse to one first, with a weight.  Lists over BLOCK rows are
split into blocks, and pairs of blocks go to different tasks; probes of a list are dealt
over chunks of BLOCK as well, so no task holds more than two blocks and a chunk.  Tasks
return link counts per vector and spanning edges, never pairs.  Dimensions with no more
than BLOCK distinct vectors are one block and need no quantiser; all others have their own.

Defined cases: null, zero, empty or non-finite vectors, and rows with a null label, link
with nothing and are components of their own; rows with one vec_id are one node of the
graph; a null vec_id is kept, counts as a neighbour, and names no component (null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable, smallest_labels, spread_join

SAMPLE, SUBSPACES, CODES, BLOCK = 16_384, 8, 64, 2048
SAMPLE_BYTES = 64 << 20
#: Vectors that a list should hold on average; the number of lists has a bound for the driver.
LIST_ROWS, MOST_LISTS = 4096, 1024
#: Lists of more than a block (some 50 bytes each) whose sizes are broadcast.
BROADCAST_LISTS = 100_000
EPS = 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows; empty ones keep their place."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(1)[None] - 2 * x @ c.T, 1)


class Quantiser:
    """Coarse centroids and residual codebooks for one dimension."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(rest[:, cut], CODES) for cut in self.cuts]
        gap = np.sqrt(np.maximum(((self.coarse[:, None] - self.coarse[None]) ** 2).sum(2), 0))
        self.gap = np.where(gap == 0, np.inf, gap)

    def lists(self, x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own list of each row; row and list of each further probe."""
        d = (x**2).sum(1)[:, None] + (self.coarse**2).sum(1)[None] - 2 * x @ self.coarse.T
        own = np.argmin(d, 1)
        margin = (d - d[np.arange(len(x)), own][:, None]) / (2 * self.gap[own])
        # Equal centroids have margin 0: such a list may be the nearest as well.
        rows, lists = np.nonzero((margin <= r + EPS) & (np.arange(len(self.coarse))[None] > own[:, None]))
        return own, rows, lists

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.stack([nearest(rest[:, cut], b) for cut, b in zip(self.cuts, self.books)], 1)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """[row, subspace, code]: squared distance of the row's part to the code."""
        out = np.zeros((len(rest), len(self.books), CODES))
        for m, (cut, b) in enumerate(zip(self.cuts, self.books)):
            part = rest[:, cut]
            out[:, m, : len(b)] = np.maximum((part**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * part @ b.T, 0)
        return out


def _matrix(raw: pa.Array | pd.Series) -> np.ndarray:
    raw = list(raw)
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares may overflow or vanish
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _classes(vectors: DataFrame) -> DataFrame:
    """(label, raw binary, rep, weight): usable vectors, equal ones of a label once."""
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("label").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(np.asarray(x.as_py(), np.float64) + 0.0).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])

    packed = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "v").mapInArrow(
        pack, "vec_id long, label string, raw binary"
    )
    return packed.groupBy("label", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK, list_rows: int = LIST_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    r = float(np.sqrt(2 - 2 * threshold)) + 1e-7  # what rounding of distances could hide
    # Classes are numbered, so that no two are taken for one.
    classes = durable(_classes(vectors).withColumn("class", F.monotonically_increasing_id()))
    quantisers = {}
    for d, n in classes.groupBy(F.length("raw")).count().where(F.col("count") > block).orderBy(F.length("raw")).collect():
        rows = min(SAMPLE, max(SAMPLE_BYTES // d, CODES))
        least = classes.where(F.length("raw") == d).select(F.xxhash64("label", "raw").alias("h"), "raw").orderBy("h").limit(rows).collect()
        quantisers[d] = Quantiser(_unit(_matrix([bytes(x.raw) for x in least])), int(np.clip(n // list_rows, 1, MOST_LISTS)))
    held = vectors.sparkSession.sparkContext.broadcast(quantisers)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column(2).to_pylist()])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                part = b.take(pa.array(at))
                q = held.value.get(int(d))
                n = len(at)
                own, rows, lists = q.lists(_unit(_matrix(part.column(2).to_pylist())), r) if q else (np.zeros(n, int), np.zeros(0, int), np.zeros(0, int))
                pick = pa.array(np.r_[np.arange(n), rows])
                out = part.take(pick)
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(np.r_[own, lists].astype(np.int32)), pa.array(np.r_[np.zeros(n, bool), np.ones(len(rows), bool)])],
                    names=["class", "label", "raw", "weight", "list", "probe"],
                )

    routed = classes.select("class", "label", "raw", "weight").mapInArrow(
        route, "class long, label string, raw binary, weight long, list int, probe boolean"
    )
    key = [F.col("label"), F.length("raw").alias("dim"), F.col("list")]
    routed = routed.select(*key, "class", "raw", "weight", "probe")
    lists = routed.groupBy("label", "dim", "list").agg(
        F.sum((~F.col("probe")).cast("long")).alias("stored"), F.sum(F.col("probe").cast("long")).alias("asking"), F.count("*").alias("rows")
    ).where((F.col("stored") > block) | (F.col("asking") > block))
    lists = durable(lists)
    routed = routed.join(F.broadcast(lists) if lists.count() <= BROADCAST_LISTS else lists, ["label", "dim", "list"], "left")
    parts_of = lambda n: F.greatest(F.coalesce(F.ceil(F.col(n) / block), F.lit(1)), F.lit(1)).cast("int")
    routed = routed.withColumn("blocks", parts_of("stored")).withColumn("chunks", parts_of("asking"))
    # Stored rows of block c meet blocks >= c (z = 0) and every chunk of probes (z); a chunk of
    # probes meets each block.  Chunk 0 comes along where a block meets itself.
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    chunk = F.pmod(F.xxhash64("class", F.lit("chunk")), F.col("chunks")).cast("int")
    task = lambda x, y, z: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"))
    blocks, first = F.sequence(F.lit(0), F.col("blocks") - 1), F.lit(0)
    pairs = F.transform(blocks, lambda t: task(F.least(own, t), F.greatest(own, t), first))
    more = F.when(F.col("chunks") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("chunks") - 1, F.lit(1))), lambda z: task(own, own, z)))
    asked = F.transform(blocks, lambda t: task(t, t, chunk))
    tasks = F.when(F.col("probe"), asked).otherwise(F.concat(pairs, F.coalesce(more, F.slice(pairs, 1, 0))))
    routed = routed.select(
        "label", "dim", "list", "class", "raw", "weight", F.explode(tasks).alias("t"), F.when(F.col("probe"), -1).otherwise(own).alias("own")
    ).select("label", "dim", "list", "class", "raw", "weight", "t.x", "t.y", "t.z", "own")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        q = held.value.get(int(g["dim"].iloc[0]))
        x, y, z, lst = (int(g[c].iloc[0]) for c in ("x", "y", "z", "list"))
        own, cls, weight = g["own"].to_numpy(), g["class"].to_numpy(), g["weight"].to_numpy()
        plain = _matrix(g["raw"])
        unit = _unit(plain)
        stored = np.flatnonzero(own == y)
        asking = np.flatnonzero(own == x) if x != y else np.arange(len(g)) if z == 0 else np.flatnonzero(own == -1)
        links = np.zeros(len(g), np.int64)
        a_all, b_all = [], []
        if q:
            codes, missed = q.codes(unit[stored] - q.coarse[lst])
        for i in range(0, len(asking), 128):
            a = asking[i : i + 128]
            if q:
                tables = q.tables(unit[a] - q.coarse[lst])
                far = np.zeros((len(a), len(stored)))
                for m in range(codes.shape[1]):
                    far += tables[:, m][:, codes[:, m]]
                hit = np.sqrt(far) <= r + missed[None] + EPS
            else:
                hit = np.ones((len(a), len(stored)), bool)
            if x == y:  # each pair of stored rows once
                hit &= (own[a] == -1)[:, None] | (a[:, None] < stored[None])
            s, t = np.nonzero(hit)
            s, t = a[s], stored[t]
            for k in range(0, len(s), 1 << 17):
                p, o = s[k : k + (1 << 17)], t[k : k + (1 << 17)]
                u, v = plain[p], plain[o]
                dot = np.einsum("ij,ij->i", u, v)
                with np.errstate(all="ignore"):
                    cos = dot / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
                odd = ~np.isfinite(cos)
                if odd.any():
                    cos[odd] = np.einsum("ij,ij->i", unit[p[odd]], unit[o[odd]])
                ok = (cos >= threshold) & (cls[p] != cls[o])
                a_all.append(p[ok])
                b_all.append(o[ok])
                np.add.at(links, p[ok], weight[o[ok]])
                np.add.at(links, o[ok], weight[p[ok]])
        a, b = (np.concatenate(z) if z else np.zeros(0, int) for z in (a_all, b_all))
        label = smallest_labels(a, b, len(g))
        some = np.flatnonzero(links > 0)
        return pd.DataFrame({"a": cls[some], "b": cls[label[some]], "n": links[some]})

    found = durable(routed.groupBy("label", "dim", "list", "x", "y", "z").applyInPandas(search, "a long, b long, n long"))
    rep = classes.select("label", "raw", "class", "rep", "weight")
    parts = connected_components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    rep = rep.join(counts, "class", "left").join(parts.withColumnRenamed("node", "class"), "class", "left")
    rep = rep.select("label", F.md5("raw").alias("digest"), "rep", "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "class").alias("part"))
    rep = durable(rep)
    least = rep.groupBy("part").agg(F.min("rep").alias("component_id"), F.count("*").alias("k"))
    rep = spread_join(rep, least, ["part"], "k")
    rep = durable(rep.select("label", "digest", "component_id", "weight", (F.col("n") + F.col("weight") - 1).alias("n_links")))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for x in b.column(2):
                x = x.as_py()
                v = None if not x or None in x else np.asarray(x, np.float64) + 0.0
                raw.append(None if v is None or not np.isfinite(v).all() or not v.any() else v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.mapInArrow(name, "vec_id long, label string, raw binary").select("vec_id", "label", F.md5("raw").alias("digest"))
    rows = durable(rows)
    usable = F.col("label").isNotNull() & F.col("digest").isNotNull()
    linked = spread_join(rows.where(usable), rep, ["label", "digest"], "weight").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
