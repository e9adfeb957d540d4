"""Shared pieces: table access, durable cuts of lineage, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever the operators speak of words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Edges of a graph that one task may hold.
LOCAL_EDGES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, below spark.checkpoint.dir.

    Unset, it is a temporary folder where driver and executors are one process, and an
    error on a cluster, whose machines don't share one.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "nestquery-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def _short_plans(spark: SparkSession):
    """Plans as texts are for people to read; the driver keeps those of a thousand queries."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    with _short_plans(df.sparkSession):
        return df.checkpoint(eager=True)


def durable_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: for rows with texts."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _short_plans(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row (a lambda variable is bound once)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    """Sum of an array of longs; 0 for an empty one."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def scan(values: Column, zero: Column, op, part: int = 256) -> Column:
    """Exclusive running results of an associative op over an array, in parts: appending to
    one array copies it every time, appending to parts of it copies a part."""
    grown = lambda xs, first: F.aggregate(
        xs, F.struct(first.alias("now"), F.slice(F.array(first), 1, 0).alias("out")),
        lambda a, x: F.struct(op(a["now"], x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")), lambda a: a["out"],
    )

    def run(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / part).cast("int")), lambda i: F.slice(v, i * part + 1, F.lit(part)))
        ends = lambda p: grown(F.transform(p, lambda x: F.aggregate(x, zero, op)), zero)
        return let(parts, lambda p: F.flatten(F.zip_with(p, ends(p), grown)))

    return let(values, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(F.slice(F.array(zero), 1, 0)))


def shares(table: DataFrame, count: str) -> tuple[int, int]:
    """All rows that a table of one row per key counts, and those of the largest key."""
    return tuple(x or 0 for x in table.agg(F.sum(count), F.max(count)).first())


def fair_share(spark: SparkSession, rows: int) -> int:
    """Rows that a task of a shuffle should get, of so many."""
    return max(64, rows // int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, size: tuple[int, int] | None = None) -> DataFrame:
    """Inner join of rows with a table of one row per key, `count` of rows each (dropped).

    Rows of a key with over twice a partition's fair share are dealt over several salts by
    their hash, and the table's row is repeated for each: no task gets much more than a fair
    share for one key.  Only the names of such keys are broadcast; whatever the data, there
    are fewer of them than half the partitions.  Keys that are null match nothing.  size is
    shares(table), for a caller that knows it.
    """
    total, most = shares(table, count) if size is None else size
    fair = fair_share(table.sparkSession, total)
    if most <= 2 * fair:
        return rows.join(table.drop(count), keys)
    salts = F.when(F.col(count) > 2 * fair, F.ceil(F.col(count) / fair)).otherwise(1).cast("int").alias("\x01salts")
    hot = table.where(F.col(count) > 2 * fair).select(*keys, salts)
    own = [F.col(f"`{c}`") for c in rows.columns]
    salt = F.coalesce(F.pmod(F.xxhash64(*own), F.col("\x01salts")), F.lit(0)).cast("int").alias("\x01salt")
    dealt = rows.join(F.broadcast(hot), keys, "left").select(*own, salt)
    facts = [F.col(f"`{c}`") for c in table.columns if c != count]
    held = table.select(*facts, F.explode(F.sequence(F.lit(0), salts - 1)).alias("\x01salt"))
    return dealt.join(held, [*keys, "\x01salt"]).drop("\x01salt")


def smallest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most nodes - 1 edges with the same components as the links a[i] - b[i]."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = smallest_labels(inverse[: len(a)], inverse[len(a) :], len(nodes))
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """connected_components() of few edges (u, v) of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = smallest_labels(inverse[: len(a)], inverse[len(a) :], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, native: bool = False) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b).

    component is the smallest node reachable.  Large-star and small-star rounds: every
    round is a minimum per node (partially aggregated before its shuffle) joined back to
    the edges by spread_join, so a hub with any number of links is never gathered in one
    task.  Rounds grow with the logarithm of the longest path; each ends in a reliable
    checkpoint.  A graph of at most LOCAL_EDGES edges (16 MB of longs) is finished in one
    task, unless only native operations are asked for.
    """
    e = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct()
    )
    e = durable(e)
    seen = None
    if not native and e.count() <= LOCAL_EDGES:
        return durable(_in_one_task(e))
    while True:
        back = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = e.unionByName(back)
        degrees = both.groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        now = degrees.agg(F.sum("n"), F.max("n"), F.sum("s")).first()
        if now == seen or not now[0]:
            break
        seen = now
        # Joins of hubs need their tables twice; without a hub, or after one, plans stay plain.
        hub = now[1] > 2 * fair_share(e.sparkSession, now[0])
        held = durable if hub else lambda x: x
        spread = spread_join if hub else lambda rows, table, keys, count: rows.join(table.drop(count), keys)
        low = held(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
        large = held(spread(back, low, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = held(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = (
            spread(large, low, ["u"], "n")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = durable(small)
    return e.groupBy("u").agg(F.min("v").alias("component")).select(
        F.col("u").alias("node"), "component"
    ).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
