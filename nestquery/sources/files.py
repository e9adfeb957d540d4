"""Root sources: a folder of files, or any DataFrame of (name, content)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestquery.sources.rawfiles import RawFiles

MOST = 2**31 - 64
#: Files that are still being downloaded are no archives.
PARTIAL = r"\.(crdownload|part)$"


def read_folder(spark: SparkSession, path: str, glob: str | None = None, hidden: bool = False) -> DataFrame:
    """(name, size, mtime_ns, content) of all regular files below a folder.

    The files are read by Spark on the executors; content is read only if it is selected.
    Files of more than MOST bytes, which are no cell of a table, come with a null content.
    Names that begin with . or _ are passed over by Spark; hidden adds them, for a folder
    that driver and executors have mounted.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(path)
    large = found.where(F.col("length") > MOST).withColumn("content", F.lit(None).cast("binary"))
    files = named(found.where(F.col("length") <= MOST).unionByName(large), path)
    if not hidden:
        return files
    spark.dataSource.register(RawFiles)
    return files.unionByName(spark.read.format("rawfiles").option("hidden", "true").load(path))


def named(files: DataFrame, root: str) -> DataFrame:
    """Columns of a binaryFile scan with names relative to the root."""
    scheme_less = F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:/*", "/")
    top = "/" + root.split("://")[-1].split(":", 1)[-1].strip("/") + "/" if root.strip("/") else "/"
    at = F.instr(scheme_less, top.rstrip("/") + "/")
    name = scheme_less.substr(at + len(top), F.char_length(scheme_less))
    return files.select(
        name.alias("name"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        "content",
    )


def list_links(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, link_target) of folders and symbolic links of a local folder, which a
    file scan leaves out; for folders that the driver can list."""
    rows = []
    for here, dirs, files in os.walk(path):
        for n in [*dirs, *files]:
            full = os.path.join(here, n)
            rel = os.path.relpath(full, path)
            if os.path.islink(full):
                rows.append((rel, "symlink", _inside(path, full)))
            elif n in dirs:
                rows.append((rel, "dir", None))
    return spark.createDataFrame(rows, "name string, kind string, link_target string")


def _inside(root: str, link: str) -> str:
    """A link's target from the root, if it stays below it; else as it is."""
    raw = os.readlink(link)
    full = os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(link)), raw))
    inner = os.path.relpath(full, os.path.abspath(root))
    return raw if inner.startswith("..") else inner
