"""Scalar functions over names, times and numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOUNT = "◆"
#: Seconds from 1904-01-01 to 1970-01-01.
MAC_EPOCH = 2_082_844_800
#: The upper half of the Mac OS Roman character set, from the standard codec.
MAC_ROMAN = bytes(range(128, 256)).decode("mac_roman")


def html_escape(c: Column) -> Column:
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\r", "\\r"), ("\n", "\\n")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_escape(c: Column) -> Column:
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def path_escape(c: Column) -> Column:
    """Percent escapes for a url path: unreserved characters and / stay."""
    c = F.url_encode(c)
    for a, b in [("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def etag(mtime_ns: Column, size: Column) -> Column:
    def signed(x: Column) -> Column:
        return F.when(x < 0, F.concat(F.lit("-"), F.lower(F.hex(-x)))).otherwise(F.lower(F.hex(x)))

    return F.concat(F.lit('"'), signed(mtime_ns), signed(size), F.lit('"'))


def http_date(ts: Column) -> Column:
    """ts in a session whose time zone is UTC."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def mac_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds - MAC_EPOCH)


def dos_time(date: Column, time: Column) -> Column:
    """MS-DOS date and time; fields out of range carry over."""
    year = F.shiftright(date, 9) + 1980
    month, day = F.shiftright(date, 5).bitwiseAND(15), date.bitwiseAND(31)
    start = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    seconds = F.shiftright(time, 11) * 3600 + F.shiftright(time, 5).bitwiseAND(63) * 60 + time.bitwiseAND(31) * 2
    return F.timestamp_seconds(F.unix_date(F.date_add(start, day - 1)).cast("long") * 86400 + seconds)


def thousands(c: Column) -> Column:
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit("_"))


def mac_roman(raw: Column) -> Column:
    """Bytes in Mac OS Roman as a string."""
    return F.translate(F.decode(raw, "ISO-8859-1"), bytes(range(128, 256)).decode("latin-1"), MAC_ROMAN)


def sidecar(path: Column) -> Column:
    return F.regexp_replace(path, r"([^/]+)$", r"._$1")


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The containing directory; '.' at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def valid_path(path: Column) -> Column:
    return (path == ".") | ~path.rlike(r"^$|^/|/$|//|(^|/)\.{1,2}(/|$)")


#: suffix=replacement rules of single-stream formats; the first that fits is used.
SUFFIXES = {
    "gzip": [(".gz", ""), (".gzip", ""), (".tgz", ".tar")],
    "bzip2": [(".bz", ""), (".bz2", ""), (".bzip2", ""), (".tbz", ".tar"), (".tb2", ".tar")],
    "xz": [(".xz", ""), (".txz", ".tar")],
}


def inner_name(name: Column, fmt: str) -> Column:
    """Name of the member of a compressed file; a suffix may be munged to _.gz and the like."""
    out = None
    for suffix, new in SUFFIXES[fmt]:
        n = len(suffix)
        for cut in ("_" + suffix, suffix):
            fits = F.endswith(name, F.lit(cut)) & (F.char_length(name) > len(cut))
            value = F.concat(F.substring(name, F.lit(1), F.char_length(name) - len(cut)), F.lit(new))
            out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(name)


def probe_format(base_name: Column, content: Column, size: Column) -> Column:
    """The archive format of a file from its name and first bytes; null for none.

    Cheap tests come first, and the first that holds wins.  content may be a prefix of at
    least 1,152 bytes, but for the last test of executables, which needs the end.
    """
    head = F.hex(F.substring(content, 1, 16))
    at = lambda h, o=0: F.substring(head, F.lit(2 * o + 1), F.lit(len(h))) == h
    tail = F.hex(F.substring(content, -22, 22))
    mdb = F.hex(F.substring(content, 1025, 128))
    word = lambda o, n: F.conv(F.substring(mdb, 2 * o + 1, 2 * n), 16, 10).cast("long")
    block = word(0x14, 4)
    return (
        F.when(size.isNotNull() & (size < 16), None)
        .when(F.startswith(base_name, F.lit("._")), F.when(at("000516"), "appledouble"))
        .when(F.endswith(base_name, F.lit(".tar")), "tar")
        .when(at(b"StuffIt (c)1997-".hex().upper()) | (at("53") & at(b"rLau".hex().upper(), 10)), "sit")
        .when(at("4552") & (at("0200", 2) | at("0400", 2) | at("0800", 2) | at("1000", 2)), "apm")
        .when(at("1F8B08"), "gzip")
        .when(at("425A68") & F.substring(head, 7, 2).between("30", "39") & at("314159265359", 4) & ~F.endswith(base_name, F.lit(".dmg")), "bzip2")
        .when(at("FD377A585A00"), "xz")
        .when(at("4D5A") & (size >= 100) & F.startswith(tail, F.lit("504B")) & F.endswith(tail, F.lit("0000")), "zip")
        .when(at("504B0304"), "zip")
        .when(
            (at("0" * 32) | at("4C4B60") | at("000060")) & (size >= 400 * 1024)
            & F.startswith(mdb, F.lit("4244")) & (F.substring(mdb, 2 * 0x7C + 1, 4) != "482B") & (block >= 512) & (block % 512 == 0),
            "hfs",
        )
    )


def url_string(path: Column) -> Column:
    """A path as a relative url: sub-delimiters of a segment stay, and a colon in the first
    segment is kept from looking like a scheme."""
    c = path_escape(path)
    for a, b in [("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.when(F.contains(F.substring_index(c, "/", 1), F.lit(":")), F.concat(F.lit("./"), c)).otherwise(c)


def clean_path(path: Column) -> Column:
    """The path without empty and '.' components, '..' taken back as far as it goes; '.' for none."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = lambda a, p: (p == "..") & (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1), F.lit("..")) != "..")
    step = lambda a, p: F.when(up(a, p), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))
    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(out == "", ".").otherwise(out)


def join_path(folder: Column, name: Column) -> Column:
    return clean_path(F.concat_ws("/", folder, name))


def breadcrumb(path: Column) -> Column:
    """Links to every folder above a path, from the top."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    links = F.transform(parts, lambda p, i: F.concat(F.lit('<a href="/'), path_escape(F.array_join(F.slice(parts, F.lit(1), i + 1), "/")), F.lit('/">'), html_escape(p), F.lit("</a>")))
    return F.array_join(F.concat(F.array(F.lit('<a href="/">/</a>')), links), " / ")
