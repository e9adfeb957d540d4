"""The fixpoint: files -> archives among them -> their members -> archives among those ...

Every level is one Arrow pass over the archives of the level before, in parallel over
archives; it lists members, probes their first bytes and carries on only the bytes of
those that are archives themselves.  A level is written once, to Parquet, and read as the
next frontier and as part of the catalog: a lost executor repeats one level's tasks.
Of a member that is no archive only the first bytes are decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from nestquery.functions import text
from nestquery.plans.durable import ARCHIVE_BYTES, bounded_batches, work_folder, write_archives
from nestquery.schema import ENTRY, FOUND
from nestquery.sources import members as M
from nestquery.sources.codecs import DecodeError, materialise, peek
from nestquery.sources.files import PARTIAL
from nestquery.sources.stuffit import use_tables

#: Rows of an Arrow batch that a parser task gives back at once, and bytes of content.
BATCH_ROWS, BATCH_BYTES = 2048, ARCHIVE_BYTES


@dataclass
class Catalog:
    """entries and mounts; content: the bytes of archives inside archives; files: the root.

    Archives of the root are not copied: reading their members reads `files` again.
    """

    entries: DataFrame
    mounts: DataFrame
    content: DataFrame
    files: DataFrame | None = None
    stuffit_tables: str | None = None  # a file of tables, for the executors to read

    def save(self, path: str) -> None:
        for name in ("entries", "mounts", "content"):
            write_archives(getattr(self, name), f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, files: DataFrame | None = None) -> Catalog:
        return Catalog(*(spark.read.parquet(f"{path}/{n}") for n in ("entries", "mounts", "content")), files)


def _rows(fs_id: str, found: list[M.Member], data: bytes, depth: int, max_bytes: int) -> Iterator[dict]:
    """Entry rows of an archive's members: the first of a name wins, and directories that are
    only implied are added."""
    taken: dict[str, dict] = {}
    no = 0
    in_fork = fs_id.rpartition("/")[2].startswith("._")  # resources are not looked into

    def row(name: str, kind: str, **more) -> dict:
        nonlocal no
        folder, _, base = name.rpartition("/")
        no += 1
        return {
            "fs_id": fs_id, "name": name, "path": f"{fs_id}/{name}", "parent": f"{fs_id}/{folder}" if folder else fs_id,
            "base": base, "depth": depth, "kind": kind, "member_id": 0, "ord": no - 1, "size": 0, "mtime_ns": None, "perm": 0,
            "link_target": None, "recipe": None, "finder": None, "format": None, "content": None, "open_error": None,
        } | more

    for x in found:
        parts = x.name.split("/")
        above = ["/".join(parts[:i]) for i in range(1, len(parts))]
        if any(p in taken and taken[p]["kind"] not in ("dir", "implicit_dir") for p in above):
            continue
        for p in above:
            if p not in taken:
                taken[p] = row(p, "implicit_dir")
        old = taken.get(x.name)
        facts = {"member_id": x.member_id, "size": x.size, "mtime_ns": x.mtime_ns, "perm": x.perm, "link_target": x.link_target, "finder": x.finder}
        if old is not None:
            if old["kind"] == "implicit_dir" and x.kind == "dir":
                old.update(facts, kind="dir")
            continue
        new = row(x.name, x.kind, **facts)
        taken[x.name] = new
        if x.kind != "file":
            continue
        new["recipe"] = x.recipe()
        if x.size is not None and x.size < 16 or in_fork:
            continue
        recipe, whole = new["recipe"], lambda x=x, r=new["recipe"]: materialise(r, data, x.size)
        try:
            if (x.size or 0) > max_bytes:  # what only the whole tells is left open
                fmt, plain = M.probe(x.name.rpartition("/")[2], peek(recipe, data, x.size), lambda: b"", x.size), None
            else:
                fmt = M.probe(x.name.rpartition("/")[2], peek(recipe, data, x.size), whole, x.size)
                plain = whole() if fmt is not None else None
            if fmt is not None:
                new["format"], new["content"] = fmt, plain
                if plain is None or len(plain) > max_bytes:
                    new["content"], new["open_error"] = None, f"more than {max_bytes} bytes"
        except DecodeError:
            continue  # read() tells why
    yield from taken.values()


def _expand(frontier: DataFrame, depth: int, max_bytes: int, tables: str | None) -> DataFrame:
    schema = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_tables(tables)
        out: list[dict] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):  # one archive in memory at a time
                fs_id, base, fmt, mtime, data = (batch.column(k)[i].as_py() for k in range(5))
                found, error = M.members(fmt, data, base, mtime)
                if error:  # travels as a row of its own, to the archive's mount
                    out.append(dict.fromkeys(schema.names) | {"fs_id": fs_id, "name": ".", "path": fs_id, "base": base, "depth": depth, "kind": "mount", "open_error": error})
                for r in _rows(fs_id, found, data, depth, max_bytes):
                    out.append(r)
                    size += len(r["content"] or b"")
                    if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return frontier.select("child", "base", "format", "mtime_ns", "content").mapInArrow(run, FOUND)


def _root(files: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is not None:  # a file scan follows symbolic links, to files and to folders
        parts = F.split("name", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        through = files.select("name", F.explode(above).alias("p")).join(links.where("kind = 'symlink'").select(F.col("name").alias("p")), "p").select("name").distinct()
        files = files.join(through, "name", "left_anti").select(*files.columns)
    base = text.base(F.col("name"))
    fmt = F.when(~base.rlike(PARTIAL), text.probe_format(base, F.col("content"), F.col("size")))
    recipe = F.struct(
        F.lit("root").alias("codec"), F.col("size").alias("packed_size"), F.lit(None).cast("long").alias("crc"),
        F.array(F.struct(F.lit(0).cast("long").alias("log"), F.lit(0).cast("long").alias("phys"), F.col("size").alias("len"))).alias("extents"),
        F.lit(None).cast("binary").alias("prefix"), F.lit(None).cast("string").alias("error"),
    )
    null = lambda t: F.lit(None).cast(t)
    cols = {
        "fs_id": F.lit("."), "name": F.col("name"), "path": F.col("name"), "parent": text.parent(F.col("name")), "base": base,
        "depth": F.lit(0), "kind": F.lit("file"), "member_id": F.xxhash64("name"), "ord": null("long"), "size": F.col("size"),
        "mtime_ns": F.col("mtime_ns"), "perm": F.lit(0o644), "link_target": null("string"), "recipe": recipe,
        "finder": null(ENTRY["finder"].dataType), "format": fmt, "content": F.when(fmt.isNotNull(), F.col("content")), "open_error": null("string"),
    }
    out = files.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in FOUND.fields])
    folders = F.split("name", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(folders) - 1), lambda i: F.array_join(F.slice(folders, F.lit(1), i), "/"))
    implied = files.where(F.contains("name", F.lit("/"))).select(F.explode(above).alias("name")).distinct().withColumn("kind", F.lit("dir")).withColumn("link_target", null("string"))
    if links is not None:
        implied = links.unionByName(implied.join(links, "name", "left_anti"))
    other = cols | {"kind": F.col("kind"), "size": F.lit(0), "mtime_ns": null("long"), "link_target": F.col("link_target"), "recipe": null(ENTRY["recipe"].dataType), "format": null("string"), "content": null("binary")}
    return out.unionByName(implied.select(*[other[f.name].cast(f.dataType).alias(f.name) for f in FOUND.fields]))


def expand(files: DataFrame, links: DataFrame | None = None, max_depth: int = 16, max_bytes: int = 1 << 30, stuffit_tables: str | None = None) -> Catalog:
    """The catalog of files (name, size, mtime_ns, content) and all archives in them.

    max_depth ends recursion and max_bytes the materialising of one member; what they hold
    back stays listed, as a mount in state `recognised`, and open_error tells of max_bytes.
    stuffit_tables names a file that executors can read (see sources/stuffit.py).
    Files without content (too large for the source) are listed and not probed.
    """
    spark = files.sparkSession
    bounded_batches(spark)
    folder = work_folder(spark)
    levels: list[DataFrame] = []
    root = level = _root(files, links)
    for depth in range(max_depth + 1):
        write_archives(level if depth else level.withColumn("content", F.lit(None).cast("binary")), f"{folder}/{depth}")
        level = spark.read.schema(FOUND).parquet(f"{folder}/{depth}")
        levels.append(level)
        ready = "format is not null" + (" and content is not null" if depth else "")
        if depth == max_depth or level.where(ready).isEmpty():
            break
        frontier = (level if depth else root).where(ready)
        frontier = frontier.withColumn("child", F.concat("path", F.lit(text.MOUNT)))
        level = _expand(_spread(frontier) if depth else frontier, depth + 1, max_bytes, stuffit_tables)
    found = levels[0]
    for x in levels[1:]:
        found = found.unionByName(x)
    entries = found.where("kind <> 'mount'").select(*[f.name for f in ENTRY.fields])
    errors = found.where("kind = 'mount'").select(F.col("fs_id").alias("child_fs_id"), F.col("open_error").alias("__e"))
    size = F.coalesce(F.length("content").cast("long"), F.col("size")).alias("size")
    mounts = found.where("format is not null").select("fs_id", "name", "path", "format", F.concat("path", F.lit(text.MOUNT)).alias("child_fs_id"), "depth", size, "open_error")
    held = F.col("open_error").isNotNull() | (F.col("depth") >= max_depth)
    state = F.when(held, "recognised").when(F.col("__e").isNotNull(), "failed").otherwise("opened")
    mounts = mounts.join(errors, "child_fs_id", "left").select("fs_id", "name", "path", state.alias("state"), "format", "child_fs_id", "size", F.coalesce("open_error", "__e").alias("open_error"))
    content = found.where("content is not null").select(F.concat("path", F.lit(text.MOUNT)).alias("fs_id"), "content")
    return Catalog(entries, mounts, content, files, stuffit_tables)


def _spread(frontier: DataFrame) -> DataFrame:
    """Archives dealt over tasks one by one: their sizes differ by orders of magnitude.
    Those of the root stay where the scan has put them."""
    n = frontier.sparkSession.sparkContext.defaultParallelism * 4
    return frontier.select("child", "base", "format", "mtime_ns", "content").repartition(n, "child")


def rescan(files: DataFrame, known: Catalog, **params) -> Catalog:
    """A catalog of the files that are new or have changed since `known` (by name, size and
    time), with all that is still there taken over."""
    root = known.entries.where("fs_id = '.' and kind = 'file'").select("name", "size", "mtime_ns")
    same = files.select("name", "size", "mtime_ns").join(root, ["name", "size", "mtime_ns"], "left_semi")
    fresh = expand(files.join(same.select("name"), "name", "left_anti"), **params)
    top = lambda c: F.split_part(c, F.lit(text.MOUNT), F.lit(1))
    keep = lambda df, c: df.join(same.select(F.col("name").alias("__top")), top(F.col(c)) == F.col("__top"), "left_semi")
    dirs = known.entries.where("fs_id = '.' and kind <> 'file'").join(fresh.entries.where("fs_id = '.'").select("path"), "path", "left_anti")
    old = keep(known.entries, "path").unionByName(dirs)
    return Catalog(
        fresh.entries.unionByName(old),
        fresh.mounts.unionByName(keep(known.mounts, "path")),
        fresh.content.unionByName(keep(known.content, "fs_id")),
        files,
        fresh.stuffit_tables,
    )


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order (not any one, as dropDuplicates gives)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")
