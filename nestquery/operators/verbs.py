"""Query verbs over a catalog: walk, glob, readdir, stat, readlink, read, read_at, propfind.

Paths may lead through symbolic links: stat, readdir, read and read_at follow them, component
by component and within their file system; readlink, walk and glob don't.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestquery.functions import text
from nestquery.functions.glob import glob_to_regex
from nestquery.operators.kernels import resolve_paths
from nestquery.plans.durable import ARCHIVE_BYTES, bounded_batches, durable
from nestquery.plans.expand import Catalog
from nestquery.sources.codecs import DecodeError, materialise, slice_of
from nestquery.sources.members import sidecar_facts
from nestquery.sources.stuffit import use_tables

SEARCH_LIMIT, PAGE = 2000, 100
MEMBERS, READ_ROWS, READ_BYTES, BROADCAST_MEMBERS = 32_768, 1024, ARCHIVE_BYTES, 50_000
PROPS = ["resourcetype", "displayname", "getcontentlength", "getlastmodified", "getcontenttype", "getetag"]
FILE_PROPS = {"getcontentlength", "getcontenttype", "getetag"}


def mount_points(c: Catalog) -> DataFrame:
    """Every recognised archive once more, as a directory whose name ends with the mark."""
    e = c.entries
    m = c.mounts.select("path", "format")
    perm = F.col("perm").bitwiseOR(F.shiftright(F.col("perm").bitwiseAND(0o444), 2))  # readable: searchable
    mark = lambda name: F.concat(name, F.lit(text.MOUNT)).alias(name)
    out = e.join(m, "path", "left_semi")
    other = [x for x in e.columns if x not in ("name", "path", "base", "kind", "perm", "recipe", "finder")]
    return out.select(mark("name"), mark("path"), mark("base"), F.lit("mount").alias("kind"), perm.alias("perm"), F.lit(None).cast(e.schema["recipe"].dataType).alias("recipe"), F.lit(None).cast(e.schema["finder"].dataType).alias("finder"), *other)


def tree(c: Catalog) -> DataFrame:
    """All entries and mount points."""
    return c.entries.unionByName(mount_points(c))


def within(path: Column, root: str) -> Column:
    if root == ".":
        return F.lit(True)
    return (path == root) | F.startswith(path, F.lit(root + "/")) | F.startswith(path, F.lit(root + text.MOUNT + "/"))


def walk(c: Catalog, root: str = ".") -> DataFrame:
    """The tree below a path, across mounts, in order of archive and creation."""
    return tree(c).where(within(F.col("path"), root)).orderBy("fs_id", "ord", "path")


def glob(c: Catalog, pattern: str, root: str = ".", limit: int | None = SEARCH_LIMIT) -> DataFrame:
    """Entries whose path relative to root matches; a trailing slash asks for directories.

    The root is no candidate, but at the top '.' is.  With a limit the first by path come.
    """
    only_dirs = pattern.endswith("/")
    regex = glob_to_regex(pattern[:-1] if only_dirs else pattern)
    t = tree(c).select("path", "kind", "size", "mtime_ns")
    if root == ".":
        relative = F.col("path")
        top = c.entries.sparkSession.range(1).select(F.lit(".").alias("path"), F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime_ns"))
        t = t.unionByName(top)
    else:
        t = t.where(F.startswith("path", F.lit(root + "/")))
        relative = F.col("path").substr(F.lit(len(root) + 2), F.char_length("path"))
    t = t.where(relative.rlike(regex))
    if only_dirs:
        t = t.where(F.col("kind").isin("dir", "implicit_dir", "mount"))
    return t if limit is None else t.orderBy("path").limit(limit)


def links(c: Catalog) -> DataFrame:
    """(path, target) of all symbolic links, targets as paths of the catalog."""
    top = F.col("fs_id") == "."
    target = F.when(top, F.col("link_target")).when(F.col("link_target") == ".", F.col("fs_id")).otherwise(F.concat("fs_id", F.lit("/"), "link_target"))
    return c.entries.where("kind = 'symlink'").select("path", target.alias("target"))


def follow(c: Catalog, paths: DataFrame) -> DataFrame:
    """(path, resolved): where paths lead through links; null in circles.  What they lead to
    need not exist."""
    l = links(c)
    if l.isEmpty():
        return paths.select("path").distinct().withColumn("resolved", F.col("path"))
    return resolve_paths(paths.select("path"), l)


def _one(c: Catalog, path: str) -> str | None:
    """Where one path leads: only the links among its prefixes start a look-up."""
    parts = path.split("/")
    above = ["/".join(parts[: i + 1]) for i in range(len(parts))]
    if c.entries.where((F.col("kind") == "symlink") & F.col("path").isin(above)).isEmpty():
        return path
    return follow(c, c.entries.sparkSession.createDataFrame([(path,)], "path string")).first().resolved


def readdir(c: Catalog, path: str, count: int | None = None, after: str | None = None) -> DataFrame:
    """Children by name in byte order; pages by the last name seen."""
    t = tree(c).where(F.col("parent") == _one(c, path))
    if after is not None:
        t = t.where(F.col("base") > after)
    t = t.orderBy("base")
    return t if count is None else t.limit(count)


def stat(c: Catalog, path: str, follow_last: bool = True) -> DataFrame:
    """The row of what a path leads to; the link's own (lstat) unless the last one is followed."""
    folder, _, base = path.rpartition("/")
    to = _one(c, path) if follow_last else f"{_one(c, folder)}/{base}" if folder else path
    return tree(c).where(F.col("path") == to)


def readlink(c: Catalog, path: str) -> DataFrame:
    return stat(c, path, follow_last=False).where("kind = 'symlink'").select("path", "link_target")


def resolve_symlinks(c: Catalog) -> DataFrame:
    """(path, target, resolved) of all links, each within its own file system; links in circles
    and to nothing resolve to null."""
    l = links(c)
    there = tree(c).select(F.col("path").alias("p"))
    ended = l.join(follow(c, l), "path").join(there, F.col("resolved") == F.col("p"), "left")
    return ended.select("path", "target", F.col("p").alias("resolved"))


def unprobed(c: Catalog) -> DataFrame:
    """Regular files that are no recognised archives."""
    return c.entries.where("kind = 'file'").join(c.mounts, "path", "left_anti")


def read(c: Catalog, wanted: DataFrame | None = None) -> DataFrame:
    """(path, size, content, error) of regular files (of `wanted`, a DataFrame of path).

    wanted may have offset and length (null: to the end) as well: content is then that range,
    and no more is decoded than it takes; size stays the file's, where it is known.  Wanted
    links, and paths through links, give what they lead to, under the path asked for.

    Up to MEMBERS entries of an archive meet its bytes at once, so an archive moves once
    for that many members, however large it is.  Files of the root need `files`, the source that was expanded.  What can't
    be decoded has a null content and an error.
    """
    bounded_batches(c.entries.sparkSession)
    e = c.entries.where("kind = 'file'").select("fs_id", "name", "path", "ord", "size", "recipe")
    null = F.lit(None).cast("long")
    if wanted is None:
        e = e.select("*", null.alias("offset"), null.alias("length"))
    else:
        ranged = "offset" in wanted.columns
        w = wanted.select("path", *[(F.col(x).cast("long") if ranged else null).alias(x) for x in ("offset", "length")]).distinct()
        if not links(c).isEmpty():
            w = w.join(follow(c, w), "path").withColumnRenamed("path", "asked").withColumnRenamed("resolved", "path")
            e = e.join(w, "path").withColumn("path", F.col("asked")).drop("asked")
        else:
            e = e.join(w, "path")

    tables = c.stuffit_tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.string()))],
                names=["path", "size", "content", "error"],
            )

        use_tables(tables)
        for b in batches:
            for i in range(b.num_rows):  # an archive and some of its members
                source, out, held = b.column(0)[i].as_py() or b"", [], 0
                for m in b.column(1)[i].as_py():
                    size = m["size"]
                    try:
                        if m["offset"] is None:
                            data, error = materialise(m["recipe"], source, size), None
                            size = len(data)
                        else:
                            data, error = slice_of(m["recipe"], source, size, m["offset"], m["length"]), None
                    except DecodeError as x:
                        data, error = None, str(x)
                    out.append((m["path"], size, data, error))
                    held += len(data or b"")
                    if held >= READ_BYTES or len(out) >= READ_ROWS:
                        yield batch(out)
                        out, held = [], 0
                if out:
                    yield batch(out)

    some = F.collect_list(F.struct("path", "size", "recipe", "offset", "length")).alias("members")
    inner = e.where("fs_id <> '.'").groupBy("fs_id", F.floor(F.col("ord") / MEMBERS).alias("part")).agg(some)
    archives = c.content
    if c.files is not None:
        archives = archives.unionByName(c.files.select(F.concat("name", F.lit(text.MOUNT)).alias("fs_id"), "content"))
    if wanted is not None:
        if e.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS:
            inner = F.broadcast(inner)
        else:  # archives of which nothing is wanted don't move
            asked = e.select("fs_id").distinct()
            if asked.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS:
                archives = archives.join(F.broadcast(asked), "fs_id", "left_semi")
    inner = archives.withColumnRenamed("content", "archive").join(inner, "fs_id")
    out = inner.select("archive", "members").mapInArrow(run, "path string, size long, content binary, error string")
    if c.files is not None:
        root = e.where("fs_id = '.'").select("name", "path", "offset", "length").join(c.files.select("name", "content"), "name")
        most = F.lit(2**31 - 1)
        part = F.when(F.col("length") == 0, F.lit(b"")).otherwise(F.substring("content", (F.least("offset", most - 1) + 1).cast("int"), F.coalesce(F.least("length", most), most).cast("int")))
        data = F.when(F.col("offset").isNull(), F.col("content")).otherwise(part)
        error = F.when(F.col("content").isNull(), F.lit("too large for the source"))
        out = out.unionByName(root.select("path", F.length("content").cast("long").alias("size"), data.alias("content"), error.alias("error")))
    return out


def read_at(c: Catalog, path: str, offset: int, length: int) -> DataFrame:
    """(path, data, error): up to length bytes from offset; fewer at the end."""
    if offset < 0 or length < 0:
        raise ValueError("negative offset or length")
    one = c.entries.sparkSession.createDataFrame([(path, offset, length)], "path string, offset long, length long")
    return read(c, one).select("path", F.col("content").alias("data"), "error")


def learned_sizes(c: Catalog) -> DataFrame:
    """(path, size) of files whose size shows only by reading them to the end."""
    unknown = c.entries.where("kind = 'file' and size is null").select("path")
    return read(c, unknown).select("path", "size", "error")


def with_sizes(c: Catalog, learned: DataFrame) -> Catalog:
    """The catalog with learned sizes filled in where none was known; others are kept."""
    found = learned.where("error is null").groupBy(F.col("path").alias("p")).agg(F.min("size").alias("s"))
    e = c.entries.join(found, F.col("path") == F.col("p"), "left").withColumn("size", F.when(F.col("kind") == "file", F.coalesce("size", "s")).otherwise(F.col("size")))
    return Catalog(e.select(*c.entries.columns), c.mounts, c.content, c.files, c.stuffit_tables)


def get_facts(c: Catalog, paths: DataFrame) -> DataFrame:
    """(path, status, location, etag, length, content_type) that a GET answers with: 303 leads a
    directory to its own path with a slash, 404 stands for nothing there."""
    t = live_props(tree(c)).select(F.col("path").alias("p"), "kind", "getetag", "getcontentlength", "getcontenttype")
    got = follow(c, paths).join(t, F.col("resolved") == F.col("p"), "left")
    is_dir = F.col("kind").isin("dir", "implicit_dir", "mount")
    return got.select(
        "path", F.when(F.col("p").isNull(), 404).when(is_dir, 303).otherwise(200).alias("status"),
        F.when(is_dir, F.concat(F.lit("/"), text.path_escape(F.col("path")), F.lit("/"))).alias("location"),
        F.col("getetag").alias("etag"), F.col("getcontentlength").alias("length"), F.col("getcontenttype").alias("content_type"),
    )


def live_props(t: DataFrame) -> DataFrame:
    """t with the properties of PROPS; those of files are null for directories."""
    is_dir = F.col("kind").isin("dir", "implicit_dir", "mount")
    of_file = lambda x: F.when(~is_dir, x)
    known = F.col("mtime_ns").isNotNull()
    return t.select(
        "*",
        F.when(is_dir, "collection").otherwise("").alias("resourcetype"),
        F.col("base").alias("displayname"),
        of_file(F.col("size")).alias("getcontentlength"),
        F.when(known, text.http_date(F.timestamp_micros(F.expr("mtime_ns div 1000")))).alias("getlastmodified"),
        of_file(F.lit("application/octet-stream")).alias("getcontenttype"),
        of_file(F.when(known & F.col("size").isNotNull(), text.etag(F.col("mtime_ns"), F.col("size")))).alias("getetag"),
    )


def propfind(c: Catalog, path: str, depth: int, props: list[str] | None = None, include: list[str] | None = None, names_only: bool = False) -> DataFrame:
    """(href, found map, missing array) of a path, and of its children at depth 1.

    props None is allprop, with `include` beside it; names_only gives names for values.
    """
    if depth not in (0, 1):
        raise ValueError("depth must be 0 or 1")
    if names_only and (props is not None or include is not None) or props is not None and include is not None:
        raise ValueError("prop, propname and allprop with include exclude each other")
    t = tree(c)
    self_ = F.col("path") == path
    t = t.where(self_ | (F.col("parent") == path) if depth else self_)
    if path == ".":
        t = t.where("path <> '.'")
    asked = list(dict.fromkeys(props if props is not None else [*PROPS, *(include or [])]))
    t = live_props(t)
    value = lambda p: F.col(p).cast("string") if p in PROPS else F.lit(None).cast("string")
    pairs = F.array(*[F.struct(F.lit(p).alias("key"), value(p).alias("value")) for p in asked])
    found = F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))
    missing = F.transform(F.filter(pairs, lambda x: x["value"].isNull()), lambda x: x["key"])
    wanted = [p for p in asked if p not in PROPS] if props is None else asked
    missing = F.filter(missing, lambda k: k.isin(*wanted)) if wanted else F.array().cast("array<string>")
    href = text.path_escape(F.when(F.col("kind").isin("dir", "implicit_dir", "mount"), F.concat("path", F.lit("/"))).otherwise(F.col("path")))
    if names_only:
        return t.select(href.alias("href"), F.map_from_entries(F.transform(F.filter(pairs, lambda x: x["value"].isNotNull()), lambda x: F.struct(x["key"], F.lit("")))).alias("found"), F.array().cast("array<string>").alias("missing"))
    return t.select(href.alias("href"), found.alias("found"), missing.alias("missing"))


def multistatus(found: DataFrame) -> DataFrame:
    """(href, xml) of propfind's rows: one response element each."""
    prop = lambda k, v: F.concat(F.lit("<D:"), k, F.lit(">"), text.xml_escape(v), F.lit("</D:"), k, F.lit(">"))
    ok = F.array_join(F.transform(F.map_entries("found"), lambda x: F.when((x["key"] == "resourcetype") & (x["value"] == "collection"), F.lit("<D:resourcetype><D:collection/></D:resourcetype>")).otherwise(prop(x["key"], x["value"]))), "")
    no = F.array_join(F.transform("missing", lambda k: F.concat(F.lit("<D:"), k, F.lit("/>"))), "")
    stat_ = lambda body, status: F.concat(F.lit("<D:propstat><D:prop>"), body, F.lit(f"</D:prop><D:status>HTTP/1.1 {status}</D:status></D:propstat>"))
    return found.select(
        "href",
        F.concat(
            F.lit("<D:response><D:href>"), text.xml_escape(F.col("href")), F.lit("</D:href>"),
            F.when(F.size("found") > 0, stat_(ok, "200 OK")).otherwise(""), F.when(F.size("missing") > 0, stat_(no, "404 Not Found")).otherwise(""),
            F.lit("</D:response>"),
        ).alias("xml"),
    )


def directory_page(c: Catalog, path: str) -> DataFrame:
    """(page, html): the children as list items in pages of PAGE rows.

    Children are numbered by ranges of names, one task each, so a directory of any size
    spreads over tasks.
    """
    t = tree(c).where(F.col("parent") == _one(c, path)).select("base", F.col("kind").isin("dir", "implicit_dir", "mount").alias("d"))
    t = durable(t.repartitionByRange("base").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ahead = t.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    n = F.row_number().over(Window.partitionBy("range").orderBy("base")) - 1
    shown = F.when(F.col("d"), F.concat("base", F.lit("/"))).otherwise(F.col("base"))
    item = F.concat(F.lit('<li><a href="'), text.path_escape(shown), F.lit('">'), text.html_escape(shown), F.lit("</a></li>"))
    rows = t.withColumn("n", n).join(F.broadcast(ahead), "range").withColumn("n", F.col("n") + F.col("ahead"))
    rows = rows.select(F.floor(F.col("n") / PAGE).alias("page"), "n", item.alias("item"))
    return rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("x")).select("page", F.array_join(F.transform("x", lambda x: x["item"]), "").alias("html"))


def progress(c: Catalog) -> DataFrame:
    """(mounts, archive_bytes, entries): what the expansion has found."""
    m = c.mounts.select(F.lit(1).alias("m"), F.col("size").alias("b"), F.lit(0).alias("e"))
    e = c.entries.select(F.lit(0).alias("m"), F.lit(0).cast("long").alias("b"), F.lit(1).alias("e"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return m.unionByName(e).agg(total("m").alias("mounts"), total("b").alias("archive_bytes"), total("e").alias("entries"))


def finder_text(c: Catalog) -> DataFrame:
    """(path, text): Finder metadata in words."""
    f = c.entries.where("finder is not null")
    kind = F.concat(text.mac_roman(F.col("finder.ftype")), F.lit("/"), text.mac_roman(F.col("finder.creator")))
    return f.select("path", F.concat_ws(" ", kind, F.concat(F.lit("flags="), F.hex("finder.flags")), F.col("finder.comment")).alias("text"))


def search_page(c: Catalog, pattern: str, root: str = ".") -> DataFrame:
    """(html, found): the first SEARCH_LIMIT matches as list items, and their number.

    The pattern is shown escaped.
    """
    got = glob(c, pattern, root)
    slash = F.when(F.col("kind").isin("dir", "implicit_dir", "mount"), F.lit("/")).otherwise("")
    item = F.concat(F.lit('<li><a href="/'), text.path_escape(F.concat("path", slash)), F.lit('">'), text.html_escape(F.concat("path", slash)), F.lit("</a></li>"))
    rows = got.select("path", item.alias("item")).agg(F.sort_array(F.collect_list(F.struct("path", "item"))).alias("x"))
    title = F.concat(F.lit("<h1>"), text.html_escape(F.lit(pattern)), F.lit("</h1>"), text.breadcrumb(F.lit(root)))
    return rows.select(F.concat(title, F.lit("<ul>"), F.array_join(F.transform("x", lambda x: x["item"]), ""), F.lit("</ul>")).alias("html"), F.size("x").alias("found"))


SIDECAR = "path string, ftype binary, creator binary, flags int, x int, y int, ctime_ns long, mtime_ns long, locked boolean, comment string, fork_size long"


def sidecars(c: Catalog) -> DataFrame:
    """Metadata of every sidecar file (`._name`), wherever it comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (facts := sidecar_facts(data)) is not None:
                    rows.append({"path": path} | facts)
            if schema is None:
                kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
                schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in SIDECAR.split(", "))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    wanted = c.entries.where("kind = 'file' and base like '.\\_%'").select("path")
    return read(c, wanted).where("content is not null").select("path", "content").mapInArrow(run, SIDECAR)


def propfind_request(body: str | None) -> dict:
    """Arguments of propfind() from a request's XML; ValueError for what it must not hold."""
    if not (body or "").strip():
        return {}
    try:
        top = ET.fromstring(body)
    except ET.ParseError as e:
        raise ValueError(f"bad request: {e}") from None
    local = lambda x: x.tag.rpartition("}")[2]
    if top.tag != "{DAV:}propfind":
        raise ValueError("bad request: no propfind")
    parts: dict[str, ET.Element] = {}
    for x in top:
        if x.tag.startswith("{DAV:}") and local(x) in ("prop", "propname", "allprop", "include"):
            if local(x) in parts:
                raise ValueError(f"bad request: {local(x)} twice")
            parts[local(x)] = x
    kinds = [k for k in ("prop", "propname", "allprop") if k in parts]
    if len(kinds) != 1 or "include" in parts and kinds != ["allprop"]:
        raise ValueError("bad request: one of prop, propname and allprop")
    names = lambda k: [local(x) for x in parts[k]]
    for k in ("prop", "include"):
        if k in parts and not names(k):
            raise ValueError(f"bad request: empty {k}")
    if kinds == ["prop"]:
        return {"props": names("prop")}
    return {"names_only": True} if kinds == ["propname"] else {"include": names("include")} if "include" in parts else {}


def dispatch(c: Catalog, method: str, path: str, depth: str | None = None, body: str | None = None, query: str = "") -> tuple[int, DataFrame | None]:
    """(status, rows) of a request: search and directory pages, GET facts, multistatus; methods
    that would write are not allowed."""
    path = path.strip("/") or "."
    if method == "GET" and path.rpartition("/")[2] == ".glob.html":
        return 200, search_page(c, query, path.rpartition("/")[0] or ".")
    if method in ("GET", "HEAD"):
        one = c.entries.sparkSession.createDataFrame([(path,)], "path string")
        facts = get_facts(c, one)
        status = 303 if path == "." else facts.first().status
        return (200, directory_page(c, path)) if status == 303 else (status, facts)
    if method == "OPTIONS":
        return 200, c.entries.sparkSession.createDataFrame([("OPTIONS, GET, HEAD, PROPFIND",)], "allow string")
    if method != "PROPFIND":
        return 405, None
    if depth not in ("0", "1"):
        return 400, None
    try:
        return 207, multistatus(propfind(c, path, int(depth), **propfind_request(body)))
    except ValueError:
        return 400, None
