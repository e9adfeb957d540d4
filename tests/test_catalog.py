"""Expansion and verbs over a folder of archives."""

import bz2
import os

import pyarrow.parquet as pq
import pytest
from fixtures import gen_apm, gen_hfs, gen_nested, gen_rsrc, gen_sit, gen_tar, gen_zip
from pyspark.sql import functions as F

from nestquery.functions import text
from nestquery.operators import verbs
from nestquery.operators.forms import zip_form
from nestquery.operators.verbs import read
from nestquery.plans.durable import ARCHIVE_BYTES, BATCH_SETTING
from nestquery.plans.expand import Catalog, _rows, expand, rescan
from nestquery.sources import members as M
from nestquery.sources.files import list_links, read_folder
from nestquery.sources.rawfiles import RawFiles
from nestquery.streaming.ingest import current, follow

NESTED = "sub/archive.tgz◆/archive.tar◆/archive.zip◆"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    files = {
        "a.zip": gen_zip(), "t.tar": gen_tar(0), "sub/archive.tgz": gen_nested(), "disk.img": gen_apm(), "v.hfs": gen_hfs(),
        "old.sit": gen_sit(), "._res": M.apple_double(bytes(32), 0, 0, len(gen_rsrc())) + gen_rsrc(), "half.zip.part": gen_zip(),
        "bogus.tar": b"this is no tar archive", "image.dmg": bz2.compress(b"not looked into"), "plain.txt": b"just a text, no archive", "tiny": b"x", "bad.zip": b"PK\3\4" + bytes(50),
    }
    for name, data in files.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    os.symlink("plain.txt", root / "alias")
    return root


@pytest.fixture(scope="module")
def cat(spark, folder):
    return expand(read_folder(spark, str(folder), hidden=True), list_links(spark, str(folder)))


def paths(df):
    return {r.path for r in df.select("path").collect()}


def test_mounts(cat):
    got = {r.path: (r.format, r.state) for r in cat.mounts.collect()}
    assert got["a.zip"] == ("zip", "opened") and got["bad.zip"] == ("zip", "failed") and got["bogus.tar"][0] == "tar"
    assert got["sub/archive.tgz◆/archive.tar◆/archive.zip"] == ("zip", "opened")
    assert got[f"{NESTED}/x.bz2"] == ("bzip2", "opened") and got[f"{NESTED}/y_.xz"] == ("xz", "opened")
    assert got["v.hfs"][0] == "hfs" and got["disk.img"][0] == "apm" and got["old.sit"][0] == "sit" and got["._res"][0] == "appledouble"
    assert not {"half.zip.part", "image.dmg", "plain.txt", "tiny"} & set(got)


def test_nested_read(spark, cat):
    want = spark.createDataFrame([(f"{NESTED}/deep/hello world.txt",), (f"{NESTED}/x.bz2◆/x",), ("disk.img◆/hfs-2",)], "path string")
    got = {r.path: bytes(r.content) for r in verbs.read(cat, want).collect()}
    assert got[f"{NESTED}/deep/hello world.txt"] == b"hello from the fourth layer down"
    assert got[f"{NESTED}/x.bz2◆/x"] == b"squeezed by bzip2 " * 4
    assert got["disk.img◆/hfs-2"] == b"B" * 1536


def test_every_file_reads_or_says_why(cat, spark, folder):
    got = verbs.read(cat).collect()
    assert len(got) == cat.entries.where("kind = 'file'").count()
    errors = {r.path: r.error for r in got if r.error}
    assert set(errors) == {"old.sit◆/odd"}
    assert all(r.size is not None for r in got if not r.error)


def test_first_of_a_name_wins_and_implied_directories(cat):
    e = {r.path: r for r in cat.entries.where("fs_id = 'a.zip◆'").collect()}
    assert e["a.zip◆/d"].kind == "implicit_dir" and e["a.zip◆/empty"].kind == "dir"
    assert e["a.zip◆/plain.txt"].size == len("stored text, stored text")
    assert len(e) == len(set(e))


def test_walk_is_in_creation_order(cat):
    rows = verbs.walk(cat, "t.tar").where("fs_id = 't.tar◆'").collect()
    assert [r.ord for r in rows] == sorted(r.ord for r in rows)
    assert verbs.walk(cat, "sub").count() > 5


def test_readdir_and_pages(cat):
    top = [r.base for r in verbs.readdir(cat, ".").collect()]
    assert top == sorted(top, key=str.encode) and "a.zip◆" in top and "bad.zip◆" in top and "sub" in top and "alias" in top
    first = [r.base for r in verbs.readdir(cat, ".", 4).collect()]
    more = [r.base for r in verbs.readdir(cat, ".", 4, first[-1]).collect()]
    assert first + more == top[:8]


def test_glob(cat):
    assert paths(verbs.glob(cat, "**/*.txt", "a.zip◆")) >= {"a.zip◆/d/deflated.txt", "a.zip◆/plain.txt"}
    assert paths(verbs.glob(cat, "*", "a.zip◆/d")) == {f"a.zip◆/d/{n}" for n in ("._deflated.txt", "deflated.txt", "bzipped.txt", "ünï.txt", "link")}
    assert "sub" in paths(verbs.glob(cat, "s*/")) and "plain.txt" not in paths(verbs.glob(cat, "*/"))
    assert "." in paths(verbs.glob(cat, "**")) and verbs.glob(cat, "**", limit=3).count() == 3


def test_stat_and_links(cat):
    m = verbs.stat(cat, "a.zip◆").first()
    assert m.kind == "mount" and m.perm & 0o111 == 0o111 and m.size == len(gen_zip())
    assert verbs.readlink(cat, "a.zip◆/d/link").first().link_target == "plain.txt"
    got = {r.path: r.resolved for r in verbs.resolve_symlinks(cat).collect()}
    assert got["t.tar◆/link"] == "t.tar◆/dir/b.txt" and got["t.tar◆/dir/abs"] == "t.tar◆/a.txt"
    assert got["._res◆/TEXT/named/Greeting:1"] == "._res◆/TEXT/128"


@pytest.mark.parametrize("offset, length", [(0, 0), (0, 10), (3, 5), (20, 100), (500, 3)])
def test_read_at(cat, offset, length):
    data = b"hello from the fourth layer down"
    got = verbs.read_at(cat, f"{NESTED}/deep/hello world.txt", offset, length).first()
    assert bytes(got.data) == data[offset : offset + length]
    with pytest.raises(ValueError):
        verbs.read_at(cat, "x", -1, 2)


def test_learned_sizes(cat):
    got = {r.path: r["size"] for r in verbs.learned_sizes(cat).collect()}
    assert got[f"{NESTED}/x.bz2◆/x"] == 72


def test_propfind(cat):
    got = {r.href: r for r in verbs.propfind(cat, "a.zip◆/d", 1).collect()}
    assert got["a.zip%E2%97%86/d/"].found["resourcetype"] == "collection"
    f = got["a.zip%E2%97%86/d/deflated.txt"].found
    assert f["getcontentlength"] == "700" and f["getlastmodified"] == "Fri, 31 Dec 1999 23:59:58 GMT"
    assert f["getetag"] == f'"{946684798 * 10**9:x}{700:x}"'
    xml = "".join(r.xml for r in verbs.multistatus(verbs.propfind(cat, "a.zip◆/d", 0, ["getetag", "owner"])).collect())
    assert "404 Not Found" in xml and "<D:owner/>" in xml
    for bad in ({"depth": 2}, {"depth": 0, "props": ["a"], "names_only": True}, {"depth": 0, "props": ["a"], "include": ["b"]}):
        with pytest.raises(ValueError):
            verbs.propfind(cat, "a.zip◆", **bad)


def test_pages_and_dumps(cat):
    html = verbs.directory_page(cat, "a.zip◆/d").first().html
    assert "%C3%BCn%C3%AF.txt" in html and html.count("<li>") == 5
    p = verbs.progress(cat).first()
    assert p.mounts == cat.mounts.count() and p.archive_bytes > 0
    assert any("TEXT/ttxt" in r.text for r in verbs.finder_text(cat).collect())


def test_save_load_and_rescan(spark, cat, folder, tmp_path):
    cat.save(str(tmp_path / "c"))
    old = Catalog.load(spark, str(tmp_path / "c"), cat.files)
    assert old.entries.count() == cat.entries.count()
    (folder / "zz.zip").write_bytes(gen_zip())
    os.remove(folder / "tiny")
    try:
        new = rescan(read_folder(spark, str(folder), hidden=True), old)
        got = paths(new.entries)
        assert "zz.zip◆/plain.txt" in got and "tiny" not in got and f"{NESTED}/deep/hello world.txt" in got
        assert new.entries.select("path").distinct().count() == new.entries.count()
        want = spark.createDataFrame([("zz.zip◆/exec",), ("plain.txt",), (f"{NESTED}/x.bz2◆/x",)], "path string")
        assert verbs.read(new, want).where("content is not null").count() == 3
    finally:
        os.remove(folder / "zz.zip")
        (folder / "tiny").write_bytes(b"x")


def test_follow_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.zip").write_bytes(gen_zip())
    for n in (1, 2):
        q = follow(spark, str(src), str(tmp_path / "out"), str(tmp_path / "chk"))
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out/mounts")).count() == n
        (src / "b.tar").write_bytes(gen_tar(0))
    c = current(spark, str(tmp_path / "out"))
    assert paths(c.mounts) == {"a.zip", "b.tar"} and "b.tar◆/a.txt" in paths(c.entries)


def test_a_trigger_takes_many_batches(spark, tmp_path):
    """Batches keep to their files, are expanded together, and a repeated trigger leaves no rows twice."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    (src / "d").mkdir(parents=True)
    for i in range(5):
        (src / f"d/{i}.zip").write_bytes(zip_form([("x", b"text"), *([("in.zip", zip_form([("y", b"more")]))] if i == 3 else [])]))
    follow(spark, str(src), out, str(tmp_path / "chk"), 2).awaitTermination()
    commits = [p for p in (tmp_path / "chk/commits").iterdir() if p.name.isdigit()]
    assert len(commits) == 1

    def rows():
        return {t: sorted(map(repr, spark.read.parquet(f"{out}/{t}").collect())) for t in ("entries", "mounts", "content")}

    before = rows()
    files = spark.read.parquet(f"{out}/entries").where("depth = 0 and kind = 'file'")
    assert sorted((r.batch, r["count"]) for r in files.groupBy("batch").count().collect()) == [(0, 2), (1, 2), (2, 1)]
    assert [r.batch for r in spark.read.parquet(f"{out}/content").collect()] == [1]
    for p in (tmp_path / "chk/commits").iterdir():
        p.unlink()
    follow(spark, str(src), out, str(tmp_path / "chk"), 2).awaitTermination()
    assert rows() == before
    c = current(spark, out)
    assert {"d", "d/0.zip◆/x", "d/3.zip◆/in.zip◆/y"} <= paths(c.entries) and c.mounts.count() == 6


def test_last_batch_counts(spark, tmp_path):
    for n, data in ((0, gen_zip()), (1, gen_nested())):
        c = expand(spark.createDataFrame([("d/x", len(data), n, data), *([("y", 3, 0, b"abc")] if n else [])], "name string, size long, mtime_ns long, content binary"))
        for t in ("entries", "mounts", "content"):
            getattr(c, t).write.parquet(f"{tmp_path}/{t}/batch={n}")
    got = current(spark, str(tmp_path))
    assert {r.format for r in got.mounts.where("path = 'd/x'").collect()} == {"gzip"} and not {"d/x◆/plain.txt"} & paths(got.entries)
    assert got.entries.groupBy("path").count().where("count > 1").isEmpty() and {"d", "d/x", "y"} <= paths(got.entries)


def test_archives_move_in_bounded_batches(spark, tmp_path):
    """Neither a batch for a Python worker nor a row group to be read back holds many archives."""
    data = [os.urandom(1 << 20) for _ in range(40)]
    zips = [zip_form([("in.zip", zip_form([("x", d)], 0))], 0) for d in data]
    c = expand(spark.createDataFrame([(f"{i}.zip", len(z), 0, z) for i, z in enumerate(zips)], "name string, size long, mtime_ns long, content binary").coalesce(1))
    assert int(spark.conf.get(BATCH_SETTING).rstrip("b")) <= ARCHIVE_BYTES
    c.save(f"{tmp_path}/c")
    groups = [m.row_group(i).total_byte_size for p in (tmp_path / "c/content").glob("*.parquet") for m in [pq.ParquetFile(p).metadata] for i in range(m.num_row_groups)]
    assert sum(groups) > 40 << 20 and max(groups) < 2 * ARCHIVE_BYTES
    got = read(c).where("path like '%/x'").select("content").collect()
    assert {bytes(r.content) for r in got} == set(data)


def test_archives_without_wanted_members_stay(spark, cat, monkeypatch):
    wanted = cat.entries.where("kind = 'file' and path like '%.zip◆%'").select("path")
    want = sorted(map(repr, read(cat, wanted).collect()))
    monkeypatch.setattr(verbs, "BROADCAST_MEMBERS", wanted.count() - 1)
    got = read(cat, wanted)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, got.collect())) == want


def test_limits(spark, folder):
    c = expand(read_folder(spark, str(folder), "*.tgz"), max_depth=1)
    assert c.mounts.where("state = 'recognised'").count() == 1


def test_paths_are_unique_and_links_have_targets(cat):
    assert cat.entries.groupBy("path").count().where("count > 1").isEmpty()
    assert cat.entries.where(F.col("kind") == "symlink").where("link_target is null").isEmpty()


def test_heads_only(spark, folder):
    spark.dataSource.register(RawFiles)
    got = {r.name: bytes(r.content) for r in spark.read.format("rawfiles").option("head", 16).option("tail", 4).load(str(folder)).collect()}
    assert got["a.zip"] == gen_zip()[:16] + gen_zip()[-4:] and got["tiny"] == b"x" and "._res" in got


def test_search_page(cat):
    r = verbs.search_page(cat, "**/*.txt").first()
    assert r.found == r.html.count("<li>") > 3 and "hello%20world.txt" in r.html
    assert "<b>" not in verbs.search_page(cat, "<b>").first().html


def test_path_functions(spark):
    rows = [("a//b/./c", "a/b/c"), ("../a/../b", "../b"), ("", "."), ("a/..", "."), ("./a/../../b", "../b"), ("◆/x", "◆/x")]
    got = spark.createDataFrame(rows, "p string, want string").select(text.clean_path(F.col("p")).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]
    one = spark.range(1).select(
        text.join_path(F.lit("a/b"), F.lit("../c")).alias("j"), text.url_string(F.lit("a:b/c d+e?")).alias("u"), text.url_string(F.lit("x/y:z")).alias("v"),
        text.mac_roman(F.unhex(F.lit("41 8A CA".replace(" ", "")))).alias("m"), text.breadcrumb(F.lit("a b/c")).alias("b"), text.html_escape(F.lit("<\r\n'")).alias("h"),
    ).first()
    assert one.j == "a/c" and one.u == "./a:b/c%20d+e%3F" and one.v == "x/y:z" and one.m == "Aä\xa0"
    assert one.b.count("<a ") == 3 and 'href="/a%20b/c/"' in one.b and one.h == "&lt;\\r\\n&#39;"


@pytest.mark.parametrize("members, want", [
    ([("a/b", "file")], {"a": "implicit_dir", "a/b": "file"}),
    ([("a/b", "file"), ("a", "dir")], {"a": "dir", "a/b": "file"}),
    ([("a", "dir"), ("a", "dir"), ("a", "file")], {"a": "dir"}),
    ([("a", "file"), ("a/b", "file")], {"a": "file"}),
    ([("a/b/c", "symlink"), ("a/b", "file")], {"a": "implicit_dir", "a/b": "implicit_dir", "a/b/c": "symlink"}),
])
def test_tree_rules(members, want):
    rows = list(_rows("x◆", [M.Member(n, k, size=0) for n, k in members], b"", 1, 1 << 20))
    assert {r["name"]: r["kind"] for r in rows} == want
    assert [r["ord"] for r in rows] == list(range(len(rows)))


def test_sidecars(cat):
    got = {r.path: r for r in verbs.sidecars(cat).collect()}
    f = got["v.hfs◆/Vol/Dir:x/._many"]
    assert (bytes(f.ftype), bytes(f.creator), f.flags, f.mtime_ns, f.locked, f.fork_size) == (b"TEXT", b"ttxt", 0x100, 10**18, False, 600)
    assert "old.sit◆/fold/._f" in got and "._res" in got and "a.zip◆/d/._deflated.txt" not in got
