"""Incremental expansion of a growing folder, as a Structured Streaming query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nestquery.functions import text
from nestquery.plans.durable import durable, write_archives
from nestquery.plans.expand import Catalog, expand, first_wins
from nestquery.sources.files import named

TABLES = ("entries", "mounts", "content")


#: Batches that one trigger of the stream expands together.
BATCHES_AT_ONCE = 64


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 256) -> StreamingQuery:
    """Expand new files batch by batch into Parquet tables below `out`.

    A batch holds at most files_per_batch files.  The jobs of an expansion cost the same for a
    few files as for many, so a trigger takes up to BATCHES_AT_ONCE batches, expands them
    together and deals the rows over folders of their batch's own number.  It empties these
    first, so a trigger that is repeated after a failure leaves no rows twice.  A file that has
    changed comes again in a later batch; current() reads each file from its last one.
    """
    stream = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch * BATCHES_AT_ONCE).load(folder)
    )

    def one(batch: DataFrame, trigger: int) -> None:
        c = expand(named(batch, folder))
        first = trigger * BATCHES_AT_ONCE
        # No more names than a trigger has files.
        place = F.row_number().over(Window.orderBy("top")) - 1
        files = c.entries.where("fs_id = '.' and kind = 'file'").select(F.col("name").alias("top"))
        of = F.broadcast(durable(files.withColumn("batch", F.lit(first) + F.floor(place / files_per_batch))))
        for name in TABLES:
            _empty(batch.sparkSession, [f"{out}/{name}/batch={first + k}" for k in range(BATCHES_AT_ONCE)])
            rows = getattr(c, name)
            # Folders above the files go to the first batch.
            rows = rows.withColumn("top", _top(F.col("fs_id" if name == "content" else "path"))).join(of, "top", "left").drop("top")
            rows = rows.withColumn("batch", F.coalesce("batch", F.lit(first)))
            if getattr(c, name).isEmpty():  # keeps the columns
                write_archives(rows.drop("batch"), f"{out}/{name}/batch={first}")
            else:
                write_archives(rows.repartition("batch"), f"{out}/{name}", "append", ["batch"])

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _top(path: Column) -> Column:
    """The file of the folder that a path lies in."""
    return F.split_part(path, F.lit(text.MOUNT), F.lit(1))


def _empty(spark: SparkSession, folders: list[str]) -> None:
    for x in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def current(spark: SparkSession, out: str, files: DataFrame | None = None) -> Catalog:
    """The catalog of what follow() has written: of every file the rows of its last batch."""
    entries, mounts, content = (spark.read.parquet(f"{out}/{name}") for name in TABLES)
    last = entries.where("fs_id = '.' and kind = 'file'").groupBy(F.col("name").alias("top")).agg(F.max("batch").alias("batch"))
    kept = lambda df, c: df.withColumn("top", _top(F.col(c))).join(last, ["top", "batch"], "left_semi").drop("top", "batch")
    dirs = first_wins(entries.where("fs_id = '.' and kind <> 'file'"), ["path"], ["batch"]).drop("batch")
    return Catalog(kept(entries, "path").unionByName(dirs), kept(mounts, "path"), kept(content, "fs_id"), files)
