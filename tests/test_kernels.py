"""Ordered kernels in zones, links of any length, and requests."""

import random
import tarfile

import pytest
from fixtures import gen_rsrc, gen_zip
from pyspark.sql import functions as F

from nestquery.operators import forms, kernels, verbs
from nestquery.plans.durable import durable
from nestquery.plans.expand import expand
from nestquery.sources import members as M

FILES = "name string, size long, mtime_ns long, content binary"


def catalog(spark, files, **params):
    return expand(spark.createDataFrame([(n, len(d), 10**18, d) for n, d in files.items()], FILES), **params)


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_zones_change_nothing(spark, hot_rows):
    r = random.Random(8)
    rows = [(r.choice("aaab") if i % 50 else None, r.randrange(3000), i) for i in range(700)]
    rows = [(k, lo, lo + r.randrange(0, 9), i) for k, lo, i in rows]
    df = spark.createDataFrame(rows, "k string, lo long, hi long, id long")
    by = {}
    for k, lo, hi, i in sorted(rows, key=lambda x: x[1:]):
        by.setdefault(k, []).append((lo, hi, i))
    got = {x.id: x for x in kernels.running_extents(df.withColumn("n", F.col("hi") - F.col("lo")), ["k"], ["lo", "hi", "id"], "n", hot_rows=hot_rows).collect()}
    late = {x.id: x.overlaps for x in kernels.previous_overlap(df, ["k"], "lo", "hi", hot_rows=hot_rows).collect()}
    names = {x.id: x.ordinal_name for x in kernels.ordinal_names(df.where("k is not null"), F.col("k"), ["lo", "hi", "id"], hot_rows=hot_rows).collect()}
    merged = sorted(map(tuple, kernels.coalesce_intervals(df, ["k"], "lo", "hi", hot_rows=hot_rows).select("k", "lo", "hi", "n").collect()), key=repr)
    want, gaps = [], []
    for k, own in by.items():
        log, runs = 0, []
        for n, (lo, hi, i) in enumerate(own):
            assert got[i].log == log and (k is None or names[i] == f"{k}-{n + 1}")
            log += hi - lo
            if runs and lo <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], hi), runs[-1][2] + 1)
            else:
                runs.append((lo, hi, 1))
        spans = [x[:2] for x in own]
        for (lo, hi, i), (_, end) in zip(own[1:], spans):
            if (lo, hi) not in (spans[0], spans[-1]) and spans.count((lo, hi)) == 1:
                assert late[i] == (lo < end)
        want += [(k, *x) for x in runs]
        gaps += [(k, a[1], b[0]) for a, b in zip([(0, 0), *runs], [*runs, (5000, 5000)]) if a[1] < b[0]]
    assert merged == sorted(want, key=repr)
    sizes = df.select("k").distinct().withColumn("size", F.lit(5000))
    assert sorted(map(tuple, kernels.holes(df, ["k"], "lo", "hi", sizes, hot_rows=hot_rows).collect()), key=repr) == sorted(gaps, key=repr)


@pytest.mark.parametrize("n", [60, 10_000])
def test_chains_of_links(spark, n):
    rows = [(i, i + 1) for i in range(n)] + [(-1, -2), (-2, -1), (-3, -1), (-5, -5), (None, 4)]
    got = kernels.resolve_links(spark.createDataFrame(rows, "s long, t long"), "s", "t").collect()
    assert len(got) == len(rows)
    assert {x.s: x.resolved for x in got} == {**dict.fromkeys(range(n), n), None: n, -1: None, -2: None, -3: None, -5: None}
    assert kernels.resolve_links(spark.createDataFrame([], "s long, t long"), "s", "t").count() == 0


@pytest.mark.parametrize("kind", ["long", "string", "double"])
@pytest.mark.parametrize("hot_rows", [10, 60, 10**6])
def test_links_in_any_order_and_size(spark, hot_rows, kind):
    """Chains within and across ranges of sources, circles, ends that are null, sources met twice."""
    order = [(i * 37) % 300 + 1000 for i in range(300)]  # all over the ranges
    rows = [(i, i + 1) for i in range(200)] + list(zip(order, order[1:])) + [(2000 + i, 2000 + (i * 7 + 7) % 100) for i in range(100)]
    rows += [(-1, -2), (-2, -1), (-3, -1), (-5, -5), (-6, -5), (3000, None), (3001, 3000), *[(4000 + i, 0) for i in range(50)]]

    def end(t, least):
        seen = set()
        while t in least:
            if t in seen:
                return None
            seen.add(t)
            t = least[t]
        return t

    for more in ([], [(100, 5), (100, None), (None, 7), (None, None)]):
        cast = {"long": int, "string": str, "double": float}[kind]
        data = [tuple(None if x is None else cast(x) for x in r) for r in rows + more]
        targets = {}
        for a, t in data:
            targets.setdefault(a, []).append(t)
        least = {a: min((t for t in ts if t is not None), default=None) for a, ts in targets.items() if a is not None}
        want = sorted(((s, t, end(t, least)) for s, t in data), key=repr)
        got = kernels.resolve_links(spark.createDataFrame(data, f"s {kind}, t {kind}"), "s", "t", hot_rows)
        assert got.columns == ["s", "t", "resolved"] and sorted(map(tuple, got.collect()), key=repr) == want


def test_rounds_of_joins_keep_small_estimates(spark):
    """A join's estimated size is a product, so rounds would give it exponentially many digits."""
    df = durable(spark.range(8).select("id", F.col("id").alias("x")))
    for _ in range(12):
        df = durable(df.join(df.select(F.col("id").alias("y")), F.col("x") == F.col("y")).select("id", "x"))
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63
    assert sorted(map(tuple, df.collect())) == [(i, i) for i in range(8)]
    plain = spark.range(8)
    for _ in range(14):  # Spark's own checkpoint keeps the estimate
        plain = plain.join(plain, "id").checkpoint()
    df = durable(plain)
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63 and df.count() == 8


def test_closure_of_long_chains_and_circles(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(150)] + [(900, 901, "x"), (901, 900, "y"), (902, 7777, "z")]
    got = {x.id: x.path for x in kernels.path_closure(spark.createDataFrame(rows, "id long, up long, name string"), "id", "up", "name").collect()}
    assert set(got) == set(range(150)) and got[149].count("/") == 149 and got[2] == "n0/n1/n2"


LINKS = [("a", "b"), ("b", "real"), ("real/in", "/real/deep"), ("x1", "x2"), ("x2", "x1"), ("self", "self/y"), ("out", "../.."), ("gone", "nothing"), ("c0", "c1/deep"), ("c1", "a")]
LINKS += [(f"l{i}", f"l{i + 1}") for i in range(70)] + [("l70", "real")]


@pytest.fixture(scope="module")
def linked(spark):
    data = [("real/f.txt", b"the file itself, so long"), ("real/deep/g.txt", b"another one, deeper down")]
    return catalog(spark, {"t.tar": forms.tar_form(data, tarfile.PAX_FORMAT, LINKS)})


@pytest.mark.parametrize("path, to", [
    ("a/f.txt", "real/f.txt"), ("b", "real"), ("a/in/g.txt", "real/deep/g.txt"), ("c0/g.txt", "real/deep/g.txt"), ("l0/f.txt", "real/f.txt"),
    ("x1", None), ("x2/f.txt", None), ("self", None), ("self/z", None), ("gone", "nothing"), ("real/f.txt", "real/f.txt"), ("a/a", "real/a"),
])
def test_links_are_followed_by_components(spark, linked, path, to):
    p = spark.createDataFrame([(f"t.tar◆/{path}",)], "path string")
    got = verbs.follow(linked, p).first().resolved
    assert got == (None if to is None else f"t.tar◆/{to}")


def test_verbs_follow_links(spark, linked):
    asked = spark.createDataFrame([(f"t.tar◆/{p}",) for p in ("a/f.txt", "l0/in/g.txt", "x1", "gone", "real/f.txt", "a")], "path string")
    got = {x.path: bytes(x.content) for x in verbs.read(linked, asked).collect()}
    assert got == {"t.tar◆/a/f.txt": b"the file itself, so long", "t.tar◆/l0/in/g.txt": b"another one, deeper down", "t.tar◆/real/f.txt": b"the file itself, so long"}
    assert verbs.stat(linked, "t.tar◆/a/f.txt").first().size == 24 and verbs.stat(linked, "t.tar◆/a").first().kind == "implicit_dir"
    assert verbs.stat(linked, "t.tar◆/a", follow_last=False).first().kind == "symlink" and verbs.stat(linked, "t.tar◆/x1").isEmpty()
    assert [r.base for r in verbs.readdir(linked, "t.tar◆/l0").collect()] == ["deep", "f.txt", "in"]
    assert verbs.readlink(linked, "t.tar◆/a/in").first().link_target == "real/deep"
    assert bytes(verbs.read_at(linked, "t.tar◆/a/f.txt", 4, 4).first().data) == b"file"
    ends = {r.path: r.resolved for r in verbs.resolve_symlinks(linked).collect()}
    assert ends["t.tar◆/l0"] == "t.tar◆/real" and ends["t.tar◆/gone"] is None and ends["t.tar◆/x1"] is None and ends["t.tar◆/out"] == "t.tar◆"


def test_forks_are_not_looked_into(spark):
    fork = forms.resource_fork([(b"DATA", 128, None, gen_zip())])
    c = catalog(spark, {"._r": M.apple_double(bytes(32), 0, 0, len(fork)) + fork, "sub/._r": M.apple_double(bytes(32), 0, 0, len(fork)) + fork})
    assert {r.path for r in c.mounts.collect()} == {"._r", "sub/._r"}
    assert c.entries.where("path = '._r◆/DATA/128' and kind = 'file'").count() == 1


def test_what_is_too_large_stays_listed(spark):
    inner = forms.zip_form([("a.zip", forms.zip_form([("x" * 90, b"y" * 900)])), ("b.txt", b"z" * 900)])
    c = catalog(spark, {"o.zip": inner}, max_bytes=50)
    got = {r.path: (r.state, r.open_error) for r in c.mounts.collect()}
    assert got == {"o.zip": ("opened", None), "o.zip◆/a.zip": ("recognised", "more than 50 bytes")}
    assert verbs.read(c).where("path = 'o.zip◆/b.txt' and length(content) = 900").count() == 1


def test_zip_directories_are_walked_to_their_end():
    data = bytearray(forms.zip_form([(f"f{i}", b"x" * 20) for i in range(5)]))
    data[-14:-10] = b"\2\0\2\0"  # the end record counts two
    found, error = M.members("zip", bytes(data), "x", None)
    assert len(found) == 5 and "5 members instead of 2" in error
    data[-14:-10] = b"\5\0\5\0"
    data = bytes(data).replace(b"f4", b"__")
    assert M.members("zip", data, "x", None)[1] is None


def test_sidecar_folder_of_zips():
    data = forms.zip_form([("__MACOSX/d/._f", b"1" * 20), ("__MACOSX/d/f", b"2" * 20), ("d/f", b"3" * 20)])
    assert sorted(m.name for m in M.members("zip", data, "x", None)[0]) == ["d/._f", "d/f"]


@pytest.mark.parametrize("depth", [3, 1500])
def test_deep_folders(depth):
    name = "/".join(["d"] * depth) + "/f"
    got, error = M.members("hfs", forms.hfs_volume([(name, b"deep")], pieces=1), "x", None)
    assert error is None and [m.name for m in got if m.name.endswith("d/f")] == ["Vol/" + name]


@pytest.mark.parametrize("body, want", [
    (None, {}), ("", {}), ('<propfind xmlns="DAV:"><propname/></propfind>', {"names_only": True}), ('<propfind xmlns="DAV:"><allprop/></propfind>', {}),
    ('<D:propfind xmlns:D="DAV:"><D:prop><D:displayname/><x xmlns="y"/></D:prop></D:propfind>', {"props": ["displayname", "x"]}),
    ('<propfind xmlns="DAV:"><allprop/><include><a/></include></propfind>', {"include": ["a"]}),
    ("<propfind", None), ("<propfind/>", None), ('<propfind xmlns="DAV:"/>', None), ('<propfind xmlns="DAV:"><prop/></propfind>', None),
    ('<propfind xmlns="DAV:"><prop><a/></prop><propname/></propfind>', None), ('<propfind xmlns="DAV:"><include><a/></include></propfind>', None),
    ('<propfind xmlns="DAV:"><propname/><include><a/></include></propfind>', None), ('<propfind xmlns="DAV:"><prop><a/></prop><prop><b/></prop></propfind>', None),
])
def test_propfind_requests(body, want):
    if want is None:
        with pytest.raises(ValueError):
            verbs.propfind_request(body)
    else:
        assert verbs.propfind_request(body) == want


def test_dispatch(linked):
    ask = lambda *a, **k: verbs.dispatch(linked, *a, **k)
    assert ask("GET", "/t.tar◆/a/f.txt")[0] == 200 and ask("HEAD", "/t.tar◆/nothing")[0] == 404
    status, page = ask("GET", "/t.tar◆/real/")
    assert status == 200 and "f.txt" in page.first().html
    status, found = ask("GET", "/t.tar◆/.glob.html", query="**/*.txt")
    assert status == 200 and found.first().found == 2
    assert [ask(m, "/x")[0] for m in ("PUT", "DELETE", "MKCOL", "LOCK")] == [405] * 4
    assert ask("PROPFIND", "/t.tar◆", depth="infinity")[0] == 400 and ask("PROPFIND", "/t.tar◆", depth="0", body="<x/>")[0] == 400
    assert ask("PROPFIND", "/t.tar◆/real", depth="1")[1].count() == 4 and ask("OPTIONS", "/")[0] == 200


@pytest.mark.parametrize("size", [0, 1, 4094, 4096, 4097, 8092])
def test_ranges_of_every_codec(spark, size):
    data = bytes(random.Random(size).randrange(97, 100) for _ in range(size))
    from nestquery.sources.codecs import DecodeError, slice_of

    for build, fmt in ((lambda m: forms.zip_form(m), "zip"), (lambda m: forms.sparse_tar(m, "1.0"), "tar"), (forms.hfs_volume, "hfs"), (forms.sit_classic, "sit")):
        raw = build([("f", data)])
        m = next(x for x in M.members(fmt, raw, "x", None)[0] if x.name.rpartition("/")[2] == "f")
        whole = (bytes(forms.HOLE) if fmt == "tar" else b"") + data
        for offset in (0, 1, 4086, 4095, 4096, 5000, 999999):
            for length in (0, 1, 10, 4096, None):
                assert slice_of(m.recipe(), raw, m.size, offset, length) == whole[offset:][:length]
        with pytest.raises(DecodeError):
            slice_of(m.recipe(), raw, m.size, -1, 1)
