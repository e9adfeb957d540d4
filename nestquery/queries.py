"""Queries of the engine over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestquery.functions import text
from nestquery.functions.glob import glob_to_regex
from nestquery.operators import kernels, pack, verbs
from nestquery.plans.durable import work_folder
from nestquery.plans.expand import Catalog, expand, first_wins

#: Documents in one packed archive.
VOLUME = 128


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    member = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    volume = F.concat(F.lit("vol-"), F.floor(F.col("doc_id") / VOLUME).cast("string"))
    return _stored(pack.pack(docs, volume, member, F.col("text"), fmt))


def _stored(files: DataFrame) -> DataFrame:
    """Packed files as a source proper, which can be read again."""
    path = work_folder(files.sparkSession)
    files.write.parquet(path)
    return files.sparkSession.read.parquet(path)


def _contents(c: Catalog, wanted: DataFrame) -> DataFrame:
    got = verbs.read(c, wanted)
    return got.select("path", F.length("content").cast("long").alias("size"), F.col("error").isNull().alias("ok"), F.md5("content").alias("md5"))


def _roundtrip(fmt: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = expand(_packed(spark, sf_dir, fmt))
        return _contents(c, verbs.glob(c, "**/*.txt", limit=None))

    return query


def _stream_roundtrip(fmt: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents")
        files = pack.squeeze(docs, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"), fmt)
        c = expand(_stored(files))
        return _contents(c, c.entries.where("depth = 1").select("path"))

    return query


def _roundtrip_sql(middle: str) -> str:
    return f"""SELECT 'vol-' || (doc_id // {VOLUME}) || '{middle}/' || lang || '/' || source || '/' || doc_id || '.txt' AS path,
       CAST(strlen(text) AS BIGINT) AS size, true AS ok, md5(text) AS md5 FROM documents"""


def _stream_sql(fmt: str) -> str:
    return f"SELECT doc_id || '.txt.{fmt}◆/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size, true AS ok, md5(text) AS md5 FROM documents"


def _url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$", "")


URL_PATH_SQL = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def zip_catalog(spark, sf_dir):
    """Every row of the catalog of packed archives: implied directories, sizes, order, mounts."""
    c = expand(_packed(spark, sf_dir, "zip"))
    return verbs.tree(c).where("depth > 0 or kind = 'mount'").select("path", "kind", "size", "depth", "base")


ZIP_CATALOG_SQL = f"""
WITH d AS (SELECT 'vol-' || (doc_id // {VOLUME}) || '.zip◆' AS v, lang, source, doc_id || '.txt' AS f, CAST(strlen(text) AS BIGINT) AS size FROM documents)
SELECT v || '/' || lang || '/' || source || '/' || f AS path, 'file' AS kind, size, 1 AS depth, f AS base FROM d
UNION ALL SELECT DISTINCT v || '/' || lang, 'implicit_dir', 0, 1, lang FROM d
UNION ALL SELECT DISTINCT v || '/' || lang || '/' || source, 'implicit_dir', 0, 1, source FROM d
UNION ALL SELECT DISTINCT v, 'mount', 0, 0, v FROM d
"""


def zip_catalog_query(spark, sf_dir):
    # The packed size of an archive is the compressor's own affair.
    return zip_catalog(spark, sf_dir).withColumn("size", F.when(F.col("kind") != "mount", F.col("size")).otherwise(0))


def zip_readdir(spark, sf_dir):
    c = expand(_packed(spark, sf_dir, "zip"))
    return verbs.readdir(c, "vol-0.zip◆/en").select("base", "kind")


def zip_read_at(spark, sf_dir):
    """The second hundred bytes of every member."""
    c = expand(_packed(spark, sf_dir, "zip"))
    ranges = verbs.glob(c, "**/*.txt", limit=None).select("path", F.lit(100).alias("offset"), F.lit(100).alias("length"))
    return verbs.read(c, ranges).select("path", F.md5("content").alias("md5"))


ZIP_READ_AT_SQL = f"""
SELECT 'vol-' || (doc_id // {VOLUME}) || '.zip◆/' || lang || '/' || source || '/' || doc_id || '.txt' AS path,
       md5(from_hex(substr(hex(encode(text)), 201, 200))) AS md5 FROM documents"""


def zip_propfind(spark, sf_dir):
    c = expand(_packed(spark, sf_dir, "zip"))
    got = verbs.propfind(c, "vol-0.zip◆/en/src1", 1, ["displayname", "getcontentlength", "owner"])
    return got.select("href", F.col("found")["displayname"].alias("name"), F.col("found")["getcontentlength"].alias("length"), F.array_join(F.sort_array("missing"), ",").alias("missing"))


ZIP_PROPFIND_SQL = f"""
SELECT 'vol-0.zip%E2%97%86/en/src1/' || doc_id || '.txt' AS href, doc_id || '.txt' AS name, CAST(strlen(text) AS VARCHAR) AS length, 'owner' AS missing
FROM documents WHERE doc_id // {VOLUME} = 0 AND lang = 'en' AND source = 'src1'
UNION ALL SELECT 'vol-0.zip%E2%97%86/en/src1/', 'src1', NULL, 'getcontentlength,owner'
WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id // {VOLUME} = 0 AND lang = 'en' AND source = 'src1')
"""


def implicit_dirs(spark, sf_dir):
    return kernels.implicit_dirs(_table(spark, sf_dir, "pages").select(_url_path(F.col("url")).alias("p")), "p")


IMPLICIT_DIRS_SQL = f"""
WITH q AS (SELECT list_filter(string_split({URL_PATH_SQL}, '/'), lambda x: x <> '') AS c FROM pages),
e AS (SELECT c, unnest(range(1, len(c) + 1)) AS d FROM q WHERE len(c) > 0)
SELECT array_to_string(c[1:d], '/') AS path, CAST(d AS INT) AS depth, max(CAST(d < len(c) AS INT)) AS is_dir FROM e GROUP BY 1, 2"""


def _ranges(spark, sf_dir):
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select("user_id", ts.alias("lo"), (ts + 1800).alias("hi"))


RANGES_SQL = "i AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + 1800 AS hi FROM events)"


def coalesce_ranges(spark, sf_dir):
    return kernels.coalesce_intervals(_ranges(spark, sf_dir), ["user_id"], "lo", "hi")


COALESCE_SQL = f"""
WITH {RANGES_SQL}, m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ph FROM i),
g AS (SELECT *, sum(CASE WHEN ph IS NULL OR lo > ph THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) gid FROM m)
SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY user_id, gid"""


def range_holes(spark, sf_dir):
    return kernels.holes(_ranges(spark, sf_dir), ["user_id"], "lo", "hi")


HOLES_SQL = f"""
WITH {RANGES_SQL}, m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ph FROM i)
SELECT user_id, ph AS lo, lo AS hi FROM m WHERE ph < lo"""


def range_overlaps(spark, sf_dir):
    o = kernels.previous_overlap(_ranges(spark, sf_dir), ["user_id"], "lo", "hi")
    return o.groupBy("user_id").agg(F.sum(F.col("overlaps").cast("long")).alias("overlaps"))


OVERLAPS_SQL = f"""
WITH {RANGES_SQL}, o AS (SELECT user_id, coalesce(lo < lag(hi) OVER (PARTITION BY user_id ORDER BY lo, hi), false) AS o FROM i)
SELECT user_id, CAST(sum(CAST(o AS INT)) AS BIGINT) AS overlaps FROM o GROUP BY user_id"""


def cached_ranges(spark, sf_dir):
    """For a point 40 minutes after each event, the merged range of its user that holds it."""
    r = _ranges(spark, sf_dir)
    points = _table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_seconds(F.col("ts").cast("timestamp")) + 2400).alias("at"))
    got = kernels.covering_range(points, kernels.coalesce_intervals(r, ["user_id"], "lo", "hi"), "user_id", "at", "lo", "hi")
    return got.select("event_id", F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("hi", F.lit(-1)).alias("hi"))


CACHED_SQL = f"""
WITH c AS ({COALESCE_SQL}), p AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) + 2400 AS x FROM events)
SELECT event_id, coalesce(lo, -1) AS lo, coalesce(hi, -1) AS hi FROM p LEFT JOIN c ON c.user_id = p.user_id AND lo <= x AND x < hi"""


def ordinal_names(spark, sf_dir):
    return kernels.ordinal_names(_table(spark, sf_dir, "part"), F.col("p_type"), ["p_partkey"]).select("p_partkey", "ordinal_name")


ORDINAL_SQL = "SELECT p_partkey, lower(p_type) || '-' || row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey) AS ordinal_name FROM part"


def running_extents(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").withColumn("len", F.col("l_quantity").cast("long"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "len"]
    return kernels.running_extents(li, ["l_orderkey"], order, "len").select("l_orderkey", "l_linenumber", "l_partkey", "len", "log")


RUNNING_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS len, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(l_quantity AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS log FROM lineitem"""


def asof_forward(spark, sf_dir):
    """For each order the first event whose id is not below its key."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    events = _table(spark, sf_dir, "events").select("event_id", "event_type")
    got = kernels.asof_forward(orders, events, "o_orderkey", "event_id", ["event_type"])
    return got.select("o_orderkey", "event_type", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


ASOF_SQL = "SELECT o_orderkey, event_type, coalesce(event_id, -1) AS event_id FROM orders ASOF LEFT JOIN events ON o_orderkey <= event_id"


def asof_by_user(spark, sf_dir):
    """For each event the user's next purchase."""
    e = _table(spark, sf_dir, "events")
    nexts = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("next_id"), "value")
    got = kernels.asof_forward(e.select("user_id", "event_id"), nexts, "event_id", "next_id", ["value"], by="user_id")
    return got.select("user_id", "event_id", "value", F.coalesce("next_id", F.lit(-1)).alias("next_id"))


ASOF_USER_SQL = """
WITH n AS (SELECT user_id, event_id AS next_id, value FROM events WHERE event_type = 'purchase')
SELECT e.user_id, e.event_id, n.value, coalesce(n.next_id, -1) AS next_id FROM events e ASOF LEFT JOIN n ON e.user_id = n.user_id AND e.event_id <= n.next_id"""


def path_closure(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    node = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    nodes = c.select(node(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("up"), "role")
    return kernels.path_closure(nodes, "id", "up", "role")


CLOSURE_SQL = """
WITH RECURSIVE r AS (SELECT conv_id, turn, role AS path FROM conversations WHERE turn = 0
 UNION ALL SELECT c.conv_id, c.turn, r.path || '/' || c.role FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1)
SELECT conv_id || ':' || turn AS id, path FROM r"""


def symlink_resolve(spark, sf_dir):
    """Links page -> page * 7 mod 101 + 50 among pages: chains, ends and circles."""
    p = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("s"), (F.col("page_id") * 7 % 101 + 50).cast("long").alias("t"))
    return kernels.resolve_links(p, "s", "t")


SYMLINK_SQL = """
WITH RECURSIVE l AS (SELECT CAST(page_id AS BIGINT) AS s, CAST(page_id * 7 % 101 + 50 AS BIGINT) AS t FROM pages),
r AS (SELECT s, t, [s] AS seen, t AS here FROM l
      UNION ALL SELECT r.s, r.t, list_append(r.seen, r.here), l.t FROM r JOIN l ON l.s = r.here WHERE NOT list_contains(r.seen, r.here))
SELECT s, t, CASE WHEN NOT list_contains(seen, here) THEN here END AS resolved FROM r
WHERE list_contains(seen, here) OR here NOT IN (SELECT s FROM l)"""


GLOBS = ["**/en/*", "*.example.com/{de,fr}/[0-9]*", "www.*/**/?1*", "**/*.html", "blog.**"]


def glob_urls(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", _url_path(F.col("url")).alias("p"))
    return p.select("page_id", *[F.col("p").rlike(glob_to_regex(g)).alias(f"g{i}") for i, g in enumerate(GLOBS)])


#: What the globs mean, written for DuckDB by hand.
GLOB_SQL = f"""
WITH p AS (SELECT page_id, {URL_PATH_SQL} AS p FROM pages)
SELECT page_id, regexp_matches(p, '^(.*/)?en/[^/]*$') AS g0, regexp_matches(p, '^[^/]*\\.example\\.com/(de|fr)/[0-9][^/]*$') AS g1,
 regexp_matches(p, '^www\\.[^/]*/(.*/)?[^/]1[^/]*$') AS g2, regexp_matches(p, '^(.*/)?[^/]*\\.html$') AS g3, regexp_matches(p, '^blog\\.[^/]*$') AS g4 FROM p"""


def glob_limit(spark, sf_dir):
    """The first of the members that match, below one folder of each archive."""
    c = expand(_packed(spark, sf_dir, "zip"))
    return verbs.glob(c, "*/en/**/*.txt", limit=100).select("path", "kind", "size")


GLOB_LIMIT_SQL = f"""
SELECT 'vol-' || (doc_id // {VOLUME}) || '.zip◆/en/' || source || '/' || doc_id || '.txt' AS path, 'file' AS kind, CAST(strlen(text) AS BIGINT) AS size
FROM documents WHERE lang = 'en' ORDER BY path LIMIT 100"""


def escapes(spark, sf_dir):
    d = _table(spark, sf_dir, "pages")
    return d.select("page_id", F.md5(text.html_escape(F.col("html"))).alias("html_md5"), F.md5(text.xml_escape(F.col("html"))).alias("xml_md5"), text.path_escape(F.col("url")).alias("url"))


def _replaced(c: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        c = f"replace({c}, {a}, '{b}')"
    return c


_MARKUP = [("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("'\"'", "&#34;"), ("''''", "&#39;")]
ESCAPES_SQL = f"""
SELECT page_id, md5({_replaced("html", [*_MARKUP, ("chr(13)", "\\r"), ("chr(10)", "\\n")])}) AS html_md5,
 md5({_replaced("html", [*_MARKUP, ("chr(9)", "&#x9;"), ("chr(10)", "&#xA;"), ("chr(13)", "&#xD;")])}) AS xml_md5,
 replace(url_encode(url), '%2F', '/') AS url FROM pages"""


def readdir_children(spark, sf_dir):
    """Hosts' first-level children with the number of entries below each."""
    dirs = kernels.implicit_dirs(_table(spark, sf_dir, "pages").select(_url_path(F.col("url")).alias("p")), "p")
    return dirs.select("path", text.parent(F.col("path")).alias("parent"), text.base(F.col("path")).alias("base"), text.sidecar(F.col("path")).alias("sidecar"), text.valid_path(F.col("path")).alias("valid"))


READDIR_SQL = f"""
WITH i AS ({IMPLICIT_DIRS_SQL})
SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent, regexp_extract(path, '[^/]*$') AS base,
 regexp_replace(path, '([^/]+)$', '._\\1') AS sidecar, NOT regexp_matches(path, '(^|/)[.]{{1,2}}(/|$)') AS valid FROM i"""


def first_wins_query(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.md5("text").alias("h"), "doc_id", "lang")
    return first_wins(d, ["h"], ["doc_id"])


FIRST_SQL = "SELECT md5(text) AS h, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1"


def probe_case(spark, sf_dir):
    """Formats of every page, packed one by one in one of six ways by its id."""
    p = _table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("c"))
    way = F.col("page_id") % 6
    head = F.when(way == 0, F.unhex(F.lit("504B0304"))).when(way == 1, F.unhex(F.lit("1F8B08"))).when(way == 2, F.unhex(F.lit("425A6839314159265359")))
    head = head.when(way == 3, F.unhex(F.lit("FD377A585A00"))).when(way == 4, F.unhex(F.lit("45520200"))).otherwise(F.lit(b""))
    name = F.when(F.col("page_id") % 7 == 0, "x.dmg").when(F.col("page_id") % 11 == 0, "x.tar").otherwise("x.bin")
    c = F.concat(head, "c")
    return p.select("page_id", text.probe_format(name, c, F.length(c)).alias("format"))


PROBE_SQL = """
SELECT page_id, CASE WHEN page_id % 7 <> 0 AND page_id % 11 = 0 THEN 'tar' WHEN page_id % 6 = 0 THEN 'zip' WHEN page_id % 6 = 1 THEN 'gzip'
 WHEN page_id % 6 = 2 AND page_id % 7 <> 0 THEN 'bzip2' WHEN page_id % 6 = 3 THEN 'xz' WHEN page_id % 6 = 4 THEN 'apm' END AS format FROM pages"""


def prop_projection(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    ns = F.unix_micros("t") * 1000
    return e.select("event_id", text.etag(ns, F.col("event_id")).alias("etag"), text.etag(-ns - 1, F.col("event_id")).alias("early_etag"), text.http_date(F.col("t")).alias("modified"), text.thousands(F.col("event_id") * 12345).alias("count"))


PROPS_SQL = """
SELECT event_id, '"' || lower(to_hex(epoch_us(ts) * 1000)) || lower(to_hex(event_id)) || '"' AS etag,
 '"-' || lower(to_hex(epoch_us(ts) * 1000 + 1)) || lower(to_hex(event_id)) || '"' AS early_etag, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS modified,
 replace(format('{:,}', event_id * 12345), ',', '_') AS count FROM events"""


def times(spark, sf_dir):
    """DOS and Mac times that stand for each event's second."""
    e = _table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    date = (F.year("t") - 1980) * 512 + F.month("t") * 32 + F.dayofmonth("t")
    time = F.hour("t") * 2048 + F.minute("t") * 32 + F.floor(F.second("t") / 2)
    return e.select(
        "event_id",
        F.unix_seconds(text.dos_time(date.cast("int"), time.cast("int"))).alias("dos"),
        F.unix_seconds(text.mac_time(F.unix_seconds("t") + text.MAC_EPOCH)).alias("mac"),
    )


TIMES_SQL = """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) // 2 * 2 AS dos, CAST(floor(epoch(ts)) AS BIGINT) AS mac FROM events"""


def _mixed(spark, sf_dir):
    """Labelled documents as compressed files, the others as they are."""
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("l", F.lit(1)), "doc_id", "left")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    packed = pack.squeeze(d.where("l = 1"), name, F.col("text"), "gz")
    plain = d.where("l is null").select(name.alias("name"), F.octet_length("text").cast("long").alias("size"), F.lit(10**18).alias("mtime_ns"), F.col("text").cast("binary").alias("content"))
    return expand(_stored(packed.unionByName(plain)))


def anti_unprobed(spark, sf_dir):
    """Files that are no archives, at every depth."""
    return verbs.unprobed(_mixed(spark, sf_dir)).select("path", "depth")


ANTI_SQL = """SELECT CASE WHEN l THEN doc_id || '.txt.gz◆/' || doc_id || '.txt' ELSE doc_id || '.txt' END AS path, CAST(l AS INT) AS depth
FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents)"""


def mount_semi(spark, sf_dir):
    """The root's listing: its files, and again those that are recognised, as folders."""
    return verbs.readdir(_mixed(spark, sf_dir), ".").select("base", "kind")


SEMI_SQL = """WITH d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents)
SELECT doc_id || '.txt' || CASE WHEN l THEN '.gz' ELSE '' END AS base, 'file' AS kind FROM d
UNION ALL SELECT doc_id || '.txt.gz◆', 'mount' FROM d WHERE l"""


def inner_names(spark, sf_dir):
    """Inner names of compressed files, by rules of three formats."""
    p = _table(spark, sf_dir, "pages")
    ends = F.array(*map(F.lit, [".gz", ".tgz", "_.gz", ".tbz", ".xz", ".txz", ".gzip", ""]))
    n = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.get(ends, (F.col("page_id") % 8).cast("int")))
    return p.select("page_id", *[text.inner_name(n, f).alias(f) for f in ("gzip", "bzip2", "xz")])


INNER_SQL = """
WITH p AS (SELECT page_id, 'p' || page_id AS b, ['.gz', '.tgz', '_.gz', '.tbz', '.xz', '.txz', '.gzip', ''][page_id % 8 + 1] AS e FROM pages)
SELECT page_id, b || CASE WHEN e IN ('.gz', '_.gz', '.gzip') THEN '' WHEN e = '.tgz' THEN '.tar' ELSE e END AS gzip,
 b || CASE WHEN e = '.tbz' THEN '.tar' ELSE e END AS bzip2, b || CASE WHEN e = '.xz' THEN '' WHEN e = '.txz' THEN '.tar' ELSE e END AS xz FROM p"""


QUERIES = {
    "zip_roundtrip": (_roundtrip("zip"), _roundtrip_sql(".zip◆")),
    "tar_roundtrip": (_roundtrip("tar"), _roundtrip_sql(".tar◆")),
    "nested_roundtrip": (_roundtrip("tgz"), _roundtrip_sql("") .replace("|| '/' || lang", "|| '.tgz◆/vol-' || (doc_id // 128) || '.tar◆/inner/archive.zip◆/' || lang")),
    "gz_roundtrip": (_stream_roundtrip("gz"), _stream_sql("gz")),
    "bz2_roundtrip": (_stream_roundtrip("bz2"), _stream_sql("bz2")),
    "xz_roundtrip": (_stream_roundtrip("xz"), _stream_sql("xz")),
    "zip_catalog": (zip_catalog_query, ZIP_CATALOG_SQL),
    "zip_readdir": (zip_readdir, f"SELECT DISTINCT source AS base, 'implicit_dir' AS kind FROM documents WHERE doc_id // {VOLUME} = 0 AND lang = 'en'"),
    "zip_read_at": (zip_read_at, ZIP_READ_AT_SQL),
    "zip_propfind": (zip_propfind, ZIP_PROPFIND_SQL),
    "implicit_dirs": (implicit_dirs, IMPLICIT_DIRS_SQL),
    "coalesce_ranges": (coalesce_ranges, COALESCE_SQL),
    "holes": (range_holes, HOLES_SQL),
    "range_overlaps": (range_overlaps, OVERLAPS_SQL),
    "cached_ranges": (cached_ranges, CACHED_SQL),
    "ordinal_names": (ordinal_names, ORDINAL_SQL),
    "running_extents": (running_extents, RUNNING_SQL),
    "asof_forward": (asof_forward, ASOF_SQL),
    "asof_by_user": (asof_by_user, ASOF_USER_SQL),
    "path_closure": (path_closure, CLOSURE_SQL),
    "symlink_resolve": (symlink_resolve, SYMLINK_SQL),
    "glob_urls": (glob_urls, GLOB_SQL),
    "glob_limit": (glob_limit, GLOB_LIMIT_SQL),
    "escapes": (escapes, ESCAPES_SQL),
    "readdir_children": (readdir_children, READDIR_SQL),
    "first_wins": (first_wins_query, FIRST_SQL),
    "probe_case": (probe_case, PROBE_SQL),
    "prop_projection": (prop_projection, PROPS_SQL),
    "times": (times, TIMES_SQL),
    "anti_unprobed": (anti_unprobed, ANTI_SQL),
    "mount_semi": (mount_semi, SEMI_SQL),
    "inner_names": (inner_names, INNER_SQL),
}
