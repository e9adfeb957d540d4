"""Cuts of lineage in the folder that driver and executors share, and bounds of batches."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a temporary folder where driver and executors are one
    process, and an error on a cluster, whose machines don't share one."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return shared or os.path.join(tempfile.gettempdir(), "nestquery")


def work_folder(spark: SparkSession, kind: str = "expand") -> str:
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


#: Bytes of archives, or of texts, that Spark hands to a Python worker at once; none is cut.
BATCH_SETTING, ARCHIVE_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ARCHIVE_BYTES, unless it has a bound of its own.

    A batch is in an executor several times over, as vectors that grow by doubling and as the
    stream to the worker.  Frames read the setting when they run, so it stays set.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(ARCHIVE_BYTES))


def write_archives(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] = ()) -> None:
    """Write rows that can hold archives as Parquet, in pages and row groups that are closed by
    their bytes: Parquet looks at them after 100 rows first, which may be any size, and a reader
    has a page or a group's rows in memory at once."""
    out = df.write.mode(mode).partitionBy(*by).option("compression", "zstd").option("parquet.block.size", ARCHIVE_BYTES)
    for unit in ("page", "block"):
        out = out.option(f"parquet.{unit}.size.row.check.min", 1).option(f"parquet.{unit}.size.row.check.max", 1000)
    out.parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint.

    A checkpoint keeps the estimate of its plan's size, and a join's is the product of both sides',
    so a frame that is joined with itself in rounds has one of twice the digits each time, 2^24
    times as many after 24; an estimate beyond a long gives way to none.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution()
    try:
        if plan.optimizedPlan().stats().sizeInBytes() < 1 << 63:
            return out
    except ValueError:  # thousands of digits, which Python doesn't read
        pass
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), spark)
