"""Parsers against the standard library and hand-packed images."""

import gzip
import io
import tarfile
import zipfile

import pytest
from fixtures import gen_apm, gen_hfs, gen_nested, gen_rsrc, gen_sit, gen_tar, gen_zip
from hypothesis import given, settings
from hypothesis import strategies as st

from nestquery.sources import members as M
from nestquery.sources.codecs import DecodeError, crc16, decode, materialise


def listed(fmt, data):
    found, error = M.members(fmt, data, "x", None)
    assert error is None
    return found


@pytest.mark.parametrize("prefix, comment", [(b"", b""), (b"MZ" + b"junk" * 40, b""), (b"", b"a comment"), (b"", b"PK\5\6 is no record")])
def test_zip_equals_stdlib(prefix, comment):
    data = gen_zip(prefix, comment if b"\5" not in comment else b"")
    z = zipfile.ZipFile(io.BytesIO(data))
    got = {m.name: m for m in reversed(listed("zip", data))}
    for info in z.infolist():
        name = info.filename.removeprefix("__MACOSX/").rstrip("/")
        m = got[name]
        if info.is_dir():
            assert m.kind == "dir"
        elif m.kind == "symlink":
            assert m.link_target == "plain.txt"
        elif name != "plain.txt":
            assert materialise(m.recipe(), data, m.size) == z.read(info)
    assert got["exec"].perm == 0o755
    assert got["d/deflated.txt"].mtime_ns == 946684798 * 10**9
    assert M.probe("x", data) == "zip"


def test_zip_damage_is_data():
    data = bytearray(gen_zip())
    at = data.find(b"stored text")
    data[at] ^= 1
    m = next(m for m in listed("zip", bytes(data)) if m.name == "plain.txt")
    with pytest.raises(DecodeError):
        materialise(m.recipe(), bytes(data), m.size)
    assert M.members("zip", b"PK\3\4" + bytes(100), "x", None)[1]


@pytest.mark.parametrize("fmt", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_tar_equals_stdlib(fmt):
    data = gen_tar(fmt)
    t = tarfile.open(fileobj=io.BytesIO(data))
    got = {m.name: m for m in listed("tar", data)}
    for x in t.getmembers():
        if x.isreg():
            m = got.pop(x.name)
            assert (m.size, m.mtime_ns) == (x.size, 10**18)
            assert materialise(m.recipe(), data, m.size) == t.extractfile(x).read()
        elif x.isdir():
            assert got.pop(x.name).kind == "dir"
        elif x.issym():
            assert got.pop(x.name).link_target == ("dir/b.txt" if x.name == "link" else "a.txt")
    assert not got
    found, error = M.members("tar", data[:2100] + b"?" * 700, "x.tar", None)
    assert found[0].name == "a.txt" and error


@pytest.mark.parametrize("raw, value", [(b"0000644\0", 0o644), (b" 17 \0", 15), (b"", 0), (b"\x80" + bytes(9) + b"\x01\x00", 256), (b"\xff" * 12, -1)])
def test_tar_numbers(raw, value):
    assert M._tar_number(raw) == value


def test_pax_records_and_times():
    assert M._pax(b"12 path=abc\n") == {"path": "abc"}
    assert M._pax_time("1350244992.023960108") == 1350244992023960108
    assert M._pax_time("-1.5") == -1_500_000_000
    for bad in (b"12 path=abc", b"x path=a\n", b"10 noequal\n"):
        with pytest.raises(M.FormatError):
            M._pax(bad)


def test_sparse_maps():
    assert M._sparse([(0, 2), (5, 3), (10, 0)], 10, 100) == [(0, 100, 2), (2, None, 3), (5, 102, 3), (8, None, 2)]
    with pytest.raises(M.FormatError):
        M._sparse([(5, 3), (6, 1)], 10, 0)


def test_pax_sparse_file():
    body = b"2\n0\n3\n1000\n4\n".ljust(512, b"\0") + b"abcdefg"
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        x = tarfile.TarInfo("GNUSparseFile.0/s")
        x.size = len(body)
        x.pax_headers = {"GNU.sparse.major": "1", "GNU.sparse.minor": "0", "GNU.sparse.name": "s", "GNU.sparse.realsize": "1004"}
        t.addfile(x, io.BytesIO(body))
    m, = listed("tar", out.getvalue())
    assert (m.name, m.size) == ("s", 1004)
    assert materialise(m.recipe(), out.getvalue(), m.size) == b"abc" + bytes(997) + b"defg"


def test_resource_fork():
    data = gen_rsrc()
    got = {m.name: m for m in M.resource_members(data)}
    assert set(got) == {"TEXT/128", "TEXT/5", "TEXT/named/Greeting:1", "ICN#/-3", "ICN#/named/_dot"}
    assert got["TEXT/named/Greeting:1"].link_target == "TEXT/128"
    assert materialise(got["TEXT/5"].recipe(), data, 15) == b"second resource"
    side = M.apple_double(bytes(32), 0, 0, len(data)) + data
    assert M.probe("._x", side) == "appledouble"
    assert {m.name for m in listed("appledouble", side)} == set(got)


def test_apple_double_dates_are_seconds():
    d = M.apple_double(b"TEXTttxt", 946_684_800 + 10, 946_684_800 - 10, 0, b"note", locked=True)
    parts = M.read_apple_double(d)
    at, n = parts[8]
    assert d[at : at + 8] == (-10).to_bytes(4, "big", signed=True) + (10).to_bytes(4, "big")
    assert d[parts[10][0] : parts[10][0] + 4] == b"\0\0\0\1"
    assert d[parts[4][0] : parts[4][0] + 4] == b"note"


def test_apm():
    data = gen_apm()
    got = [(m.name, m.size) for m in listed("apm", data)]
    assert got == [("partition_map-1", 2048), ("hfs-1", 1024), ("hfs-2", 1536)]
    m = listed("apm", data)[2]
    assert materialise(m.recipe(), data, m.size) == b"B" * 1536
    assert M.probe("disk.img", data) == "apm"


def test_hfs():
    data = gen_hfs()
    assert M.probe("disk.img", data) == "hfs"
    got = {m.name: m for m in listed("hfs", data)}
    assert set(got) == {"Vol", "Vol/Dir:x", "Vol/Dir:x/many", "Vol/Dir:x/._many", "Vol/plain", "Vol/._plain"}
    many = got["Vol/Dir:x/many"]
    assert materialise(many.recipe(), data, many.size) == b"a" * 512 + b"b" * 512 + b"c" * 512 + b"d" * 512 + b"e" * 7
    side = got["Vol/Dir:x/._many"]
    assert materialise(side.recipe(), data, side.size).endswith(b"R" * 512 + b"S" * 88)
    assert got["Vol/plain"].mtime_ns == 10**18
    assert M.members("hfs", data[: 420 * 1024], "x", None)[1]


def test_stuffit():
    data = gen_sit()
    assert M.probe("x.sit", data) == "sit"
    got = {m.name: m for m in listed("sit", data)}
    f = got["fold/f"]
    assert materialise(f.recipe(), data, f.size) == b"abbabbbb"
    side = got["fold/._f"]
    assert materialise(side.recipe(), data, side.size).endswith(b"rsrc!")
    assert "unsupported" in got["odd"].error and got["fold"].kind == "dir"


def test_codecs():
    assert crc16(b"123456789") == 0xBB3D
    assert decode("gzip", gzip.compress(b"a") + gzip.compress(b"b"), None) == b"ab"
    with pytest.raises(DecodeError):
        decode("gzip", gzip.compress(b"a" * 100)[:-4], None)
    # LZW by hand: a, b, <ab>, <aba> in nine-bit codes, low bits first
    codes = [97, 98, 257, 259]
    raw = sum(c << 9 * i for i, c in enumerate(codes)).to_bytes(5, "little")
    assert decode("sit2", raw, 7) == b"abababa"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.from_regex(r"[a-z]{1,4}(/[a-z]{1,3})?", fullmatch=True), st.binary(max_size=60), max_size=6))
def test_zip_round_trip(files):
    files = {k: v for k, v in files.items() if not any(o.startswith(k + "/") for o in files)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in files.items():
            z.writestr(k, v)
    got = {m.name: materialise(m.recipe(), out.getvalue(), m.size) for m in listed("zip", out.getvalue())}
    assert got == files


def test_names():
    assert M.link_from("d/link", "../plain.txt") == "plain.txt"
    assert M.link_from("d/link", "../../x") == "."
    assert M.inner_name("file.tar_.gz", "gzip") == "file.tar" and M.inner_name("a.tgz", "gzip") == "a.tar"
    assert M.inner_name(".gz", "gzip") == ".gz"
    assert M.probe("a", gen_nested()) == "gzip" and M.probe("a", b"x" * 15) is None and M.probe("b.tar", b"x" * 20) == "tar"
