"""Queries over archives of every form, packed from the driver's documents, and over the verbs;
each with the same in DuckDB SQL."""

from __future__ import annotations

import os
import tarfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestquery.operators import forms, kernels, pack, verbs
from nestquery.plans.durable import work_folder, write_archives
from nestquery.plans.expand import Catalog, expand, rescan
from nestquery.sources.files import list_links, read_folder
from nestquery.streaming.ingest import follow

#: Documents in one packed archive.
VOLUME = 32


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _file(folder: Column | None = None) -> Column:
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return name if folder is None else F.concat_ws("/", folder, name)


def _volume() -> Column:
    return F.floor(F.col("doc_id") / VOLUME)


def _catalog(spark: SparkSession, sf_dir: str, member: Column, built: list, **params) -> Catalog:
    files = pack.pack_forms(_docs(spark, sf_dir), _volume(), member, F.col("text"), built)
    path = work_folder(spark)
    write_archives(files, path)
    return expand(spark.read.parquet(path), **params)


def _texts(c: Catalog) -> DataFrame:
    wanted = c.entries.where("kind = 'file' and base like '%.txt' and not startswith(base, '._')").select("path")
    got = verbs.read(c, wanted)
    return got.select("path", F.length("content").cast("long").alias("size"), F.col("error").isNull().alias("ok"), F.md5("content").alias("md5"))


V = f"(doc_id // {VOLUME})"


def _texts_sql(path: str) -> str:
    return f"SELECT {path} AS path, CAST(strlen(text) AS BIGINT) AS size, true AS ok, md5(text) AS md5 FROM documents"


# --- Forms -------------------------------------------------------------------------------

STUB = b"MZ" + bytes(1022)
ZIPS = [
    ("vol-{}.zip", forms.zip_form),
    ("vol-{}.zip", lambda m: forms.zip_form(m, zipfile.ZIP_STORED)),
    ("vol-{}.zip", lambda m: forms.zip_form(m, zipfile.ZIP_BZIP2)),
    ("vol-{}.zip", lambda m: forms.zip_form(m, wide=True)),
    ("vol-{}.exe", lambda m: forms.zip_form(m, prefix=STUB)),
    ("vol-{}.exe", lambda m: forms.zip_form(m, prefix=STUB, wide=True)),
]


def zip_forms(spark, sf_dir):
    """Stored, deflated and bzip2 members, ZIP64, and ZIPs behind a program."""
    return _texts(_catalog(spark, sf_dir, _file(F.concat(F.lit("é/"), F.col("source"))), ZIPS))


def tar_forms(spark, sf_dir):
    """Names too long for a header in the three ways that there are."""
    folder = F.lit("n" * 60 + "/" + "m" * 60)
    built = [("vol-{}.tar", lambda m, k=k: forms.tar_form(m, k)) for k in (tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT)]
    return _texts(_catalog(spark, sf_dir, _file(folder), built))


SPARSE = [("vol-{}.tar", lambda m, k=k: forms.sparse_tar(m, k)) for k in ("gnu", "0.0", "0.1", "1.0")]


def tar_sparse(spark, sf_dir):
    """Sparse members: what lies behind the hole read as a range, and the hole as zeros."""
    c = _catalog(spark, sf_dir, _file(), SPARSE)
    files = c.entries.where("kind = 'file' and depth = 1").select("path")
    behind = verbs.read(c, files.select("path", F.lit(forms.HOLE).alias("offset"), F.lit(None).cast("long").alias("length")))
    hole = verbs.read(c, files).select("path", (F.substring("content", 1, forms.HOLE) == F.lit(bytes(forms.HOLE))).alias("zeros"))
    return behind.select("path", "size", F.md5("content").alias("md5")).join(hole, "path")


def hfs_roundtrip(spark, sf_dir):
    """Fragmented files of volumes in partitions of disk images."""
    built = [("vol-{}.img", lambda m: forms.partition_map([(b"Apple_HFS", forms.hfs_volume(m))]))]
    return _texts(_catalog(spark, sf_dir, _file(F.col("source")), built))


def apm_parts(spark, sf_dir):
    """Documents as partitions, named by type and place; their bytes read as ranges."""
    c = _catalog(spark, sf_dir, _file(), [("vol-{}.dsk", lambda m: forms.partition_map([(b"Apple_doc", d) for _, d in m]))])
    order = kernels.ordinal_names(_docs(spark, sf_dir).select("text", _volume().cast("string").alias("v"), _file().alias("m")), F.col("v"), ["m"])
    path = F.concat(F.lit("vol-"), F.col("v"), F.lit(".dsk◆/doc-"), F.substring_index("ordinal_name", "-", -1))
    wanted = order.select(path.alias("path"), F.lit(0).alias("offset"), F.octet_length("text").alias("length"))
    return verbs.read(c, wanted).select("path", "size", F.md5("content").alias("md5"))


APM_SQL = f"""SELECT 'vol-' || {V} || '.dsk◆/doc-' || row_number() OVER (PARTITION BY {V} ORDER BY doc_id || '.txt') AS path,
 CAST((strlen(text) + 511) // 512 * 512 AS BIGINT) AS size, md5(text) AS md5 FROM documents"""


def resource_links(spark, sf_dir):
    """Resources of sidecar files, read through the links that their names are."""
    c = _catalog(spark, sf_dir, F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), [("._vol-{}", forms.sidecar)])
    wanted = c.entries.where("kind = 'symlink'").select("path")
    where = verbs.resolve_symlinks(c).select("path", F.regexp_extract("resolved", "◆/(\\w+)/", 1).alias("type"))
    return verbs.read(c, wanted).select("path", "size", F.md5("content").alias("md5")).join(where, "path")


def stuffit_roundtrip(spark, sf_dir):
    """Both containers, forks stored and packed by the two classic methods."""
    return _texts(_catalog(spark, sf_dir, _file(F.col("source")), [("vol-{}.sit", forms.sit_classic), ("vol-{}.sit", forms.sit_five)]))


def sidecar_facts(spark, sf_dir):
    """Finder metadata that archives and volumes keep, as sidecar files say it."""
    built = [("vol-{}.img", forms.hfs_volume), ("vol-{}.sit", forms.sit_classic), ("vol-{}.sit", forms.sit_five)]
    c = _catalog(spark, sf_dir, _file(F.col("source")), built)
    got = verbs.sidecars(c).where("path like '%.txt'")
    return got.select("path", F.decode("ftype", "US-ASCII").alias("ftype"), F.decode("creator", "US-ASCII").alias("creator"), "flags", "mtime_ns", "locked", "fork_size")


SIDECAR_SQL = f"""SELECT 'vol-' || {V} || CASE WHEN {V} % 3 = 0 THEN '.img◆/Vol/' ELSE '.sit◆/' END || source || '/._' || doc_id || '.txt' AS path,
 'TEXT' AS ftype, 'ttxt' AS creator, 256 AS flags, {forms.STAMP}000000000 AS mtime_ns, false AS locked, CAST(strlen(doc_id || '.txt') AS BIGINT) AS fork_size FROM documents"""


def finder_text(spark, sf_dir):
    c = _catalog(spark, sf_dir, _file(F.col("source")), [("vol-{}.sit", forms.sit_classic)])
    return verbs.finder_text(c).where("path like '%.txt' and path not like '%/._%'")


def tar_cut(spark, sf_dir):
    """Volumes cut off: what lies before the cut is listed, and read if it is whole."""
    built = [("vol-{}.tar", lambda m: forms.tar_form(m, tarfile.USTAR_FORMAT)[:CUT])]
    c = _catalog(spark, sf_dir, _file(), built)
    return verbs.read(c).where("path like '%◆/%'").select("path", F.col("error").isNull().alias("ok"))


CUT = 30_000
TAR_CUT_SQL = f"""WITH t AS (SELECT doc_id, {V} AS v, strlen(text) AS n, sum(512 + (strlen(text) + 511) // 512 * 512) OVER (PARTITION BY {V} ORDER BY doc_id || '.txt')
  - (512 + (strlen(text) + 511) // 512 * 512) AS begin FROM documents)
SELECT 'vol-' || v || '.tar◆/' || doc_id || '.txt' AS path, begin + 512 + n <= {CUT} AS ok FROM t WHERE begin + 512 <= {CUT}"""


def _damaged(m: list[tuple[str, bytes]]) -> bytes:
    data = bytearray(forms.zip_form(m, zipfile.ZIP_STORED))
    data[30 + len(m[0][0].encode())] ^= 1
    return bytes(data)


def zip_damage(spark, sf_dir):
    """The first member of each volume has a bit wrong: only it doesn't read."""
    c = _catalog(spark, sf_dir, _file(), [("vol-{}.zip", _damaged)])
    return verbs.read(c).where("path like '%◆/%'").select("path", F.coalesce("error", F.lit("")).alias("error"))


ZIP_DAMAGE_SQL = f"""SELECT 'vol-' || {V} || '.zip◆/' || doc_id || '.txt' AS path,
 CASE WHEN row_number() OVER (PARTITION BY {V} ORDER BY doc_id || '.txt') = 1 THEN 'checksum mismatch' ELSE '' END AS error FROM documents"""


def mount_states(spark, sf_dir):
    """Archives in archives that are too large to be opened stay listed."""
    built = [("vol-{}.tgz", pack.nested_bytes), ("vol-{}.zip", lambda m: b"PK\3\4" + bytes(60)), ("vol-{}.zip", lambda m: forms.zip_form([("in.tar", forms.tar_form(m, 0))]))]
    c = _catalog(spark, sf_dir, _file(), built, max_bytes=1000)
    return c.mounts.select("path", "format", "state", F.coalesce("open_error", F.lit("")).alias("error"))


STATES_SQL = f"""WITH v AS (SELECT DISTINCT {V} AS v FROM documents)
SELECT 'vol-' || v || CASE WHEN v % 3 = 0 THEN '.tgz' ELSE '.zip' END AS path, CASE WHEN v % 3 = 0 THEN 'gzip' ELSE 'zip' END AS format,
 CASE WHEN v % 3 = 1 THEN 'failed' ELSE 'opened' END AS state, CASE WHEN v % 3 = 1 THEN 'FormatError: zip: no end record' ELSE '' END AS error FROM v
UNION ALL SELECT 'vol-' || v || CASE WHEN v % 3 = 0 THEN '.tgz◆/vol-' || v || '.tar' ELSE '.zip◆/in.tar' END, 'tar', 'recognised', 'more than 1000 bytes' FROM v WHERE v % 3 <> 1"""


# --- Verbs -------------------------------------------------------------------------------


def _flat_tar(m: list[tuple[str, bytes]]) -> bytes:
    return forms.tar_form(m, tarfile.PAX_FORMAT)


def _linked_tar(m: list[tuple[str, bytes]]) -> bytes:
    real = [(f"real/{n}", d) for n, d in m]
    by = [(f"by/{n}", f"../real/{n}") for n, _ in m]
    return forms.tar_form(real, tarfile.PAX_FORMAT, [("chain", "more/folder"), ("more/folder", "../first"), ("first", "real"), ("one", "two"), ("two", "one"), *by])


def link_reads(spark, sf_dir):
    """Members read through links: of their own, through chains of folder links, in circles."""
    c = _catalog(spark, sf_dir, _file(), [("vol-{}.tar", _linked_tar)])
    d = _docs(spark, sf_dir).select(F.concat(F.lit("vol-"), _volume().cast("string"), F.lit(".tar◆")).alias("v"), _file().alias("m"))
    asked = d.select(F.explode(F.array(*[F.concat_ws("/", "v", F.lit(x), "m") for x in ("by", "chain", "more/folder", "one")])).alias("path"))
    where = verbs.follow(c, asked)
    got = verbs.read(c, asked).select("path", F.md5("content").alias("md5"), "size")
    return where.join(got, "path", "left").select("path", F.coalesce("resolved", F.lit("")).alias("resolved"), F.coalesce("md5", F.lit("")).alias("md5"), F.coalesce("size", F.lit(-1)).alias("size"))


LINK_READS_SQL = f"""WITH d AS (SELECT 'vol-' || {V} || '.tar◆' AS v, doc_id || '.txt' AS m, text FROM documents)
SELECT v || '/' || x || '/' || m AS path, CASE WHEN x = 'one' THEN '' ELSE v || '/real/' || m END AS resolved, CASE WHEN x = 'one' THEN '' ELSE md5(text) END AS md5,
 CASE WHEN x = 'one' THEN -1 ELSE strlen(text) END AS size FROM d, (VALUES ('by'), ('chain'), ('more/folder'), ('one')) l(x)"""


def get_facts(spark, sf_dir):
    """What a GET answers for members, folders and what isn't there."""
    c = _catalog(spark, sf_dir, _file(F.col("source")), [("vol-{}.zip", forms.zip_form)])
    t = verbs.tree(c).where("depth = 1 or kind = 'mount'").select("path")
    got = verbs.get_facts(c, t.unionByName(t.select(F.concat("path", F.lit("?")).alias("path")))).drop("content_type")
    return got.withColumn("length", F.coalesce("length", F.lit(-1)))


GET_FACTS_SQL = f"""WITH m AS (SELECT 'vol-' || {V} || '.zip' AS v, source, doc_id || '.txt' AS f, strlen(text) AS n FROM documents),
t AS (SELECT v || '◆/' || source || '/' || f AS path, 200 AS status, NULL AS location, '"{forms.STAMP * 10**9:x}' || lower(to_hex(n)) || '"' AS etag, CAST(n AS BIGINT) AS length FROM m
 UNION ALL SELECT DISTINCT v || '◆/' || source, 303, '/' || v || '%E2%97%86/' || source || '/', NULL, -1 FROM m
 UNION ALL SELECT DISTINCT v || '◆', 303, '/' || v || '%E2%97%86/', NULL, -1 FROM m)
SELECT * FROM t UNION ALL SELECT path || '?', 404, NULL, NULL, -1 FROM t"""


def walk_order(spark, sf_dir):
    """Members in the order in which their archive holds them, with times and modes."""
    c = _catalog(spark, sf_dir, _file(), [("vol-{}.tar", _flat_tar)])
    return verbs.walk(c).where("depth = 1").select("path", "ord", "mtime_ns", "perm")


WALK_SQL = f"""SELECT 'vol-' || {V} || '.tar◆/' || doc_id || '.txt' AS path, row_number() OVER (PARTITION BY {V} ORDER BY doc_id || '.txt') - 1 AS ord,
 {forms.STAMP}000000000 AS mtime_ns, {0o644} AS perm FROM documents"""


def _gz(spark, sf_dir):
    path = work_folder(spark)
    pack.squeeze(_docs(spark, sf_dir), _file(), F.col("text"), "gz").write.parquet(path)
    return expand(spark.read.parquet(path))


def directory_pages(spark, sf_dir):
    return verbs.directory_page(_gz(spark, sf_dir), ".").select("page", F.md5("html").alias("md5"))


PAGES_SQL = f"""WITH i AS (SELECT doc_id || '.txt.gz' AS b, doc_id || '.txt.gz' AS h, doc_id || '.txt.gz' AS s FROM documents
 UNION ALL SELECT doc_id || '.txt.gz◆', doc_id || '.txt.gz%E2%97%86/', doc_id || '.txt.gz◆/' FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY b) - 1 AS n FROM i)
SELECT n // {verbs.PAGE} AS page, md5(string_agg('<li><a href="' || h || '">' || s || '</a></li>', '' ORDER BY b)) AS md5 FROM n GROUP BY 1"""


def search_page(spark, sf_dir):
    got = verbs.search_page(_gz(spark, sf_dir), "*/*1.txt")
    return got.select(F.md5(F.regexp_extract("html", "(?s)(<ul>.*</ul>)$", 1)).alias("md5"), "found")


SEARCH_SQL = f"""WITH i AS (SELECT doc_id || '.txt.gz◆/' || doc_id || '.txt' AS p, doc_id FROM documents WHERE doc_id % 10 = 1 ORDER BY p LIMIT {verbs.SEARCH_LIMIT})
SELECT md5('<ul>' || string_agg('<li><a href="/' || replace(p, '◆', '%E2%97%86') || '">' || p || '</a></li>', '' ORDER BY p) || '</ul>') AS md5, CAST(count(*) AS INT) AS found FROM i"""


def learned_sizes(spark, sf_dir):
    """Sizes that only decoding tells, filled into the catalog."""
    c = _gz(spark, sf_dir)
    c = verbs.with_sizes(c, verbs.learned_sizes(c))
    return c.entries.where("depth = 1").select("path", "size")


def multistatus(spark, sf_dir):
    c = _catalog(spark, sf_dir, _file(F.col("source")), [("vol-{}.zip", forms.zip_form)])
    body = '<propfind xmlns="DAV:"><prop><displayname/><owner/></prop></propfind>'
    return verbs.multistatus(verbs.propfind(c, "vol-0.zip◆", 1, **verbs.propfind_request(body)))


MULTISTATUS_SQL = f"""WITH t AS (SELECT DISTINCT 'vol-0.zip%E2%97%86/' || source || '/' AS href, source AS n FROM documents WHERE {V} = 0 UNION ALL SELECT 'vol-0.zip%E2%97%86/', 'vol-0.zip◆')
SELECT href, '<D:response><D:href>' || href || '</D:href><D:propstat><D:prop><D:displayname>' || n || '</D:displayname></D:prop><D:status>HTTP/1.1 200 OK</D:status></D:propstat>'
 || '<D:propstat><D:prop><D:owner/></D:prop><D:status>HTTP/1.1 404 Not Found</D:status></D:propstat></D:response>' AS xml FROM t"""


def progress(spark, sf_dir):
    c = _catalog(spark, sf_dir, _file(), [("vol-{}.tar", lambda m: forms.tar_form(m, tarfile.USTAR_FORMAT))])
    return verbs.progress(c).select("mounts", "archive_bytes", "entries")


PROGRESS_SQL = f"""WITH v AS (SELECT {V} AS v, count(*) AS n, (sum(512 + (strlen(text) + 511) // 512 * 512) + 1024 + 10239) // 10240 * 10240 AS b FROM documents GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS mounts, CAST(sum(b) AS BIGINT) AS archive_bytes, CAST(count(*) + sum(n) AS BIGINT) AS entries FROM v"""


def folder_walk(spark, sf_dir):
    """A folder on disk: archives, unfinished downloads, sidecars, plain files and links."""
    built = [("a/vol-{}.zip", forms.zip_form), ("b/vol-{}.zip.part", forms.zip_form), ("._vol-{}", forms.sidecar), ("vol-{}.dat", lambda m: m[0][1] + b" " * 16)]
    files = pack.pack_forms(_docs(spark, sf_dir), _volume(), _file(), F.col("text"), built)
    folder = work_folder(spark, "folder")
    pack.write_files(files, folder)
    os.symlink("a", f"{folder}/alias")
    c = expand(read_folder(spark, folder, hidden=True), list_links(spark, folder))
    same = verbs.readdir(c, "alias").select(F.concat(F.lit("alias/"), "base").alias("path"), "kind", F.lit(-1).alias("depth"))
    return verbs.walk(c).select("path", "kind", "depth").unionByName(same)


FOLDER_SQL = f"""WITH d AS (SELECT doc_id, {V} AS v FROM documents), v AS (SELECT DISTINCT v FROM d),
t AS (SELECT 'a/vol-' || v || '.zip' AS path, 'file' AS kind, 0 AS depth FROM v WHERE v % 4 = 0
 UNION ALL SELECT 'a/vol-' || v || '.zip◆', 'mount', 0 FROM v WHERE v % 4 = 0
 UNION ALL SELECT 'b/vol-' || v || '.zip.part', 'file', 0 FROM v WHERE v % 4 = 1
 UNION ALL SELECT '._vol-' || v, 'file', 0 FROM v WHERE v % 4 = 2
 UNION ALL SELECT '._vol-' || v || '◆', 'mount', 0 FROM v WHERE v % 4 = 2
 UNION ALL SELECT 'vol-' || v || '.dat', 'file', 0 FROM v WHERE v % 4 = 3
 UNION ALL SELECT 'a/vol-' || v || '.zip◆/' || doc_id || '.txt', 'file', 1 FROM d WHERE v % 4 = 0
 UNION ALL SELECT '._vol-' || v || '◆/' || x, k, 1 FROM v, (VALUES ('TEXT', 'implicit_dir'), ('TEXT/named', 'implicit_dir')) y(x, k) WHERE v % 4 = 2
 UNION ALL SELECT '._vol-' || v || '◆/TEXT/' || (127 + row_number() OVER (PARTITION BY v ORDER BY doc_id || '.txt')), 'file', 1 FROM d WHERE v % 4 = 2
 UNION ALL SELECT '._vol-' || v || '◆/TEXT/named/' || doc_id || '.txt', 'symlink', 1 FROM d WHERE v % 4 = 2
 UNION ALL SELECT 'alias', 'symlink', 0 UNION ALL SELECT 'a', 'dir', 0 UNION ALL SELECT 'b', 'dir', 0 FROM (SELECT 1 FROM v WHERE v % 4 = 1 LIMIT 1))
SELECT * FROM t UNION ALL SELECT 'alias/' || substr(path, 3), kind, -1 FROM t WHERE starts_with(path, 'a/') AND depth = 0"""


def rescanned(spark, sf_dir):
    """A kept catalog brought up to date: a volume changed, others new, one gone."""
    files = lambda built: pack.pack_forms(_docs(spark, sf_dir), _volume(), _file(), F.col("text"), built)
    folder = work_folder(spark)
    files([("vol-{}.zip", forms.zip_form)]).write.parquet(f"{folder}/old")
    files([("vol-{}.tar", _flat_tar)]).write.parquet(f"{folder}/more")
    old = spark.read.parquet(f"{folder}/old")
    first = expand(old)
    first.save(f"{folder}/catalog")
    now = old.where("name <> 'vol-1.zip'").withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.col("name") == "vol-0.zip", 7).otherwise(0))
    now = now.unionByName(spark.read.parquet(f"{folder}/more"))
    c = rescan(now, Catalog.load(spark, f"{folder}/catalog", old))
    return verbs.tree(c).where("path like '%◆/%' or name = 'vol-0.zip'").select("path", F.when(F.col("name") == "vol-0.zip", F.col("mtime_ns")).otherwise(0).alias("mtime_ns"))


RESCAN_SQL = f"""SELECT 'vol-' || {V} || e || '◆/' || doc_id || '.txt' AS path, 0 AS mtime_ns FROM documents, (VALUES ('.zip'), ('.tar')) x(e) WHERE NOT ({V} = 1 AND e = '.zip')
UNION ALL SELECT 'vol-0.zip', 1000000000000000007"""


def followed(spark, sf_dir):
    """A folder that grows, expanded batch by batch by a stream that is started twice."""
    folder = work_folder(spark, "stream")
    built = [("vol-{}.zip", forms.zip_form), ("vol-{}.tar", _flat_tar)]
    for part in range(len(built)):  # volumes are packed in the forms by turns
        files = pack.pack_forms(_docs(spark, sf_dir).where(F.pmod(_volume(), F.lit(len(built))) == part), _volume(), _file(), F.col("text"), built)
        pack.write_files(files, f"{folder}/in")
        follow(spark, f"{folder}/in", f"{folder}/out", f"{folder}/offsets", 16).awaitTermination()
    return spark.read.parquet(f"{folder}/out/entries").where("depth = 1").select("path", "size")


def sized_holes(spark, sf_dir):
    """Per user, what the ranges [100 k, 100 k + 50) of its events leave of the whole axis."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("event_id") * 100).alias("lo"), (F.col("event_id") * 100 + 50).alias("hi"))
    sizes = e.groupBy("user_id").agg((F.max("hi") + 50).alias("size"))
    return kernels.holes(e, ["user_id"], "lo", "hi", sizes)


SIZED_HOLES_SQL = """WITH e AS (SELECT user_id, event_id * 100 AS lo, event_id * 100 + 50 AS hi FROM events),
g AS (SELECT user_id, coalesce(lag(hi) OVER (PARTITION BY user_id ORDER BY lo), 0) AS lo, lo AS hi FROM e UNION ALL SELECT user_id, max(hi), max(hi) + 50 FROM e GROUP BY user_id)
SELECT user_id, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM g WHERE lo < hi"""


def cache_counters(spark, sf_dir):
    """Bytes of 100-byte reads that the kept ranges of their user hold, and the others."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ranges = e.where("event_type = 'purchase'").select("user_id", (F.col("event_id") * 100).alias("lo"), (F.col("event_id") * 100 + 130).alias("hi"))
    ranges = kernels.coalesce_intervals(ranges, ["user_id"], "lo", "hi")
    points = e.select("event_id", "user_id", (F.col("event_id") * 100 + 60).alias("at"), F.lit(100).alias("length"))
    return kernels.hit_counts(points, ranges, "user_id", "at", "length", "lo", "hi")


COUNTERS_SQL = """WITH r AS (SELECT user_id, event_id * 100 AS lo, event_id * 100 + 130 AS hi FROM events WHERE event_type = 'purchase'),
m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM r),
g AS (SELECT *, sum(CASE WHEN ph IS NULL OR lo > ph THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m),
c AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, k),
p AS (SELECT e.user_id, event_id * 100 + 60 AS at, CASE WHEN hi IS NOT NULL THEN least(event_id * 100 + 160, hi) - (event_id * 100 + 60) END AS h FROM events e LEFT JOIN c ON c.user_id = e.user_id AND c.lo <= event_id * 100 + 60 AND event_id * 100 + 60 < c.hi)
SELECT CAST(sum(coalesce(h, 0)) AS BIGINT) AS hit, CAST(sum(100 - coalesce(h, 0)) AS BIGINT) AS miss FROM p"""


def link_chain(spark, sf_dir):
    """Every event a link to the next one: one chain through them all, and a circle beside it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("long").alias("s"))
    chain = e.select("s", (F.col("s") + 1).alias("t"))
    n = e.agg(F.max("s")).first()[0] + 2
    circle = e.select((-1 - F.col("s")).alias("s"), (-1 - F.pmod(F.col("s") + 1, F.lit(n - 1))).alias("t"))
    return kernels.resolve_links(chain.unionByName(circle), "s", "t").select("s", F.coalesce("resolved", F.lit(0)).alias("resolved"))


CHAIN_SQL = """SELECT CAST(event_id AS BIGINT) AS s, (SELECT max(event_id) + 1 FROM events) AS resolved FROM events
UNION ALL SELECT -1 - event_id, 0 FROM events"""


QUERIES = {
    "zip_forms": (zip_forms, _texts_sql(f"'vol-' || {V} || CASE WHEN {V} % 6 >= 4 THEN '.exe' ELSE '.zip' END || '◆/é/' || source || '/' || doc_id || '.txt'")),
    "tar_forms": (tar_forms, _texts_sql(f"'vol-' || {V} || '.tar◆/{'n' * 60}/{'m' * 60}/' || doc_id || '.txt'")),
    "tar_sparse": (tar_sparse, f"SELECT 'vol-' || {V} || '.tar◆/' || doc_id || '.txt' AS path, CAST(strlen(text) + {forms.HOLE} AS BIGINT) AS size, md5(text) AS md5, true AS zeros FROM documents"),
    "hfs_roundtrip": (hfs_roundtrip, _texts_sql(f"'vol-' || {V} || '.img◆/hfs-1◆/Vol/' || source || '/' || doc_id || '.txt'")),
    "apm_parts": (apm_parts, APM_SQL),
    "resource_links": (resource_links, f"SELECT '._vol-' || {V} || '◆/TEXT/named/doc-' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5, 'TEXT' AS type FROM documents"),
    "stuffit_roundtrip": (stuffit_roundtrip, _texts_sql(f"'vol-' || {V} || '.sit◆/' || source || '/' || doc_id || '.txt'")),
    "sidecar_facts": (sidecar_facts, SIDECAR_SQL),
    "finder_text": (finder_text, f"SELECT 'vol-' || {V} || '.sit◆/' || source || '/' || doc_id || '.txt' AS path, 'TEXT/ttxt flags=100' AS text FROM documents"),
    "tar_cut": (tar_cut, TAR_CUT_SQL),
    "zip_damage": (zip_damage, ZIP_DAMAGE_SQL),
    "mount_states": (mount_states, STATES_SQL),
    "link_reads": (link_reads, LINK_READS_SQL),
    "get_facts": (get_facts, GET_FACTS_SQL),
    "walk_order": (walk_order, WALK_SQL),
    "directory_pages": (directory_pages, PAGES_SQL),
    "search_page": (search_page, SEARCH_SQL),
    "learned_sizes": (learned_sizes, "SELECT doc_id || '.txt.gz◆/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents"),
    "multistatus": (multistatus, MULTISTATUS_SQL),
    "progress": (progress, PROGRESS_SQL),
    "folder_walk": (folder_walk, FOLDER_SQL),
    "rescanned": (rescanned, RESCAN_SQL),
    "followed": (followed, f"SELECT 'vol-' || {V} || CASE WHEN {V} % 2 = 0 THEN '.zip' ELSE '.tar' END || '◆/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents"),
    "sized_holes": (sized_holes, SIZED_HOLES_SQL),
    "cache_counters": (cache_counters, COUNTERS_SQL),
    "link_chain": (link_chain, CHAIN_SQL),
}
