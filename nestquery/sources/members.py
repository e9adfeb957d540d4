"""Parsers: bytes of an archive to its members.

Every parser is a generator of Member.  What it has yielded before an error stays listed;
the error becomes the mount's open_error.  Nothing is decompressed here but what a listing
needs (link texts): members say how their bytes are made.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal, InvalidOperation

from .codecs import DecodeError, crc16, materialise

NS = 1_000_000_000
MAC_EPOCH = 2_082_844_800
APPLE_DOUBLE_EPOCH = 946_684_800  # 2000-01-01


class FormatError(Exception):
    pass


@dataclass
class Member:
    name: str
    kind: str = "file"  # file, dir, symlink
    member_id: int = 0
    size: int | None = None
    mtime_ns: int | None = None
    perm: int = 0
    link_target: str | None = None
    codec: str = "stored"
    extents: list[tuple[int, int | None, int]] = field(default_factory=list)
    packed_size: int | None = None
    crc: int | None = None
    prefix: bytes | None = None
    error: str | None = None
    finder: dict | None = None

    def recipe(self) -> dict:
        return {
            "codec": self.codec,
            "packed_size": self.packed_size,
            "crc": self.crc,
            "extents": [dict(zip(("log", "phys", "len"), x)) for x in self.extents],
            "prefix": self.prefix,
            "error": self.error,
        }


def clean(path: str) -> str:
    """A path without empty, '.' and '..' components, as far as they resolve; '.' for none."""
    out: list[str] = []
    for c in path.split("/"):
        if c == ".." and out and out[-1] != "..":
            out.pop()
        elif c not in ("", "."):
            out.append(c)
    return "/".join(out) or "."


def is_valid(name: str) -> bool:
    return bool(name) and not any(c in ("", ".", "..") for c in name.split("/"))


def link_from(name: str, target: str) -> str:
    """A link's target as a path from the root of its file system; '.' if it leaves it."""
    if target.startswith("/"):
        return clean(target.lstrip("/"))
    path = clean(f"{name.rpartition('/')[0]}/{target}")
    return "." if path.startswith("..") else path


# --- AppleDouble -------------------------------------------------------------------------


def apple_double(finder_info: bytes, mtime: int | None, ctime: int | None, fork_size: int, comment: bytes = b"", align: int = 1, locked: bool = False) -> bytes:
    """Header of an AppleDouble file, up to where the resource fork begins.  Times in
    seconds since 1970."""
    stamp = lambda t: max(-(2**31) + 1, min(2**31 - 1, t - APPLE_DOUBLE_EPOCH)) if t is not None else -(2**31)
    parts = {
        8: struct.pack(">iiii", stamp(ctime), stamp(mtime), -(2**31), -(2**31)),
        9: finder_info.ljust(32, b"\0"),
        10: struct.pack(">I", 1 if locked else 0),
    }
    if comment:
        parts[4] = comment
    n = len(parts) + (fork_size > 0)
    at, table, body = 26 + 12 * n, b"", b""
    for k in sorted(parts):
        table += struct.pack(">III", k, at + len(body), len(parts[k]))
        body += parts[k]
    if fork_size:
        begin = -(-(at + len(body)) // align) * align
        table += struct.pack(">III", 2, begin, fork_size)
        body += bytes(begin - at - len(body))
    return struct.pack(">II16sH", 0x00051607, 0x00020000, b"", n) + table + body


def read_apple_double(data: bytes) -> dict[int, tuple[int, int]]:
    """Entry id -> (offset, size)."""
    if len(data) < 26 or data[:3] != b"\0\x05\x16":
        raise FormatError("not AppleDouble")
    n = struct.unpack(">H", data[24:26])[0]
    if n > 255 or len(data) < 26 + 12 * n:
        raise FormatError("not AppleDouble")
    out: dict[int, tuple[int, int]] = {}
    for i in range(n):
        k, at, size = struct.unpack_from(">III", data, 26 + 12 * i)
        out.setdefault(k, (at, size))
    return out


def fork_range(data: bytes) -> tuple[int, int] | None:
    """Where the resource fork of a sidecar file lies; null forks and too small ones: None."""
    try:
        at, size = read_apple_double(data).get(2, (0, 0))
    except FormatError:
        return None
    return (at, size) if size >= 286 else None


def with_sidecar(path: str, finder_info: bytes, mtime: int, ctime: int, fork: Member | None, comment: bytes, member_id: int, finder: dict) -> Member:
    """The ._ file of a path: header, and the resource fork if there is one."""
    folder, _, base = path.rpartition("/")
    name = f"{folder}/._{base}" if folder else f"._{base}"
    size = fork.size if fork and fork.size else 0
    head = apple_double(finder_info, mtime, ctime, size, comment, 4096 if fork and fork.codec != "stored" else 1)
    out = Member(name, "file", member_id, len(head) + size, mtime * NS, prefix=head, finder=finder)
    if size:
        out.codec, out.extents, out.packed_size, out.crc, out.error = fork.codec, fork.extents, fork.packed_size, fork.crc, fork.error
    return out


# --- ZIP ---------------------------------------------------------------------------------


def _zip_end(data: bytes) -> int:
    """Where the end record lies: the last whose comment fills the rest and is plain text."""
    at = len(data)
    lowest = max(0, len(data) - 22 - 65535)
    while True:
        at = data.rfind(b"PK\5\6", lowest, at + 3)
        if at < 0:
            raise FormatError("zip: no end record")
        if at + 22 <= len(data):
            n = struct.unpack_from("<H", data, at + 20)[0]
            comment = data[at + 22 :]
            if n == len(comment) and not any(c < 32 and c not in (9, 10, 13) for c in comment):
                return at
        if at == lowest:
            raise FormatError("zip: no end record")


def _zip_extras(raw: bytes) -> dict[int, bytes]:
    out: dict[int, bytes] = {}
    at = 0
    while at + 4 <= len(raw):
        k, n = struct.unpack_from("<HH", raw, at)
        out.setdefault(k, raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _zip_time(stamp: int, extras: dict[int, bytes]) -> int:
    """Nanoseconds: of the time extras the one of smallest id, else the DOS time."""
    for k in sorted(extras):
        x = extras[k]
        if k == 0x000A and len(x) >= 32 and struct.unpack_from("<HH", x, 4) >= (1, 24):
            return (struct.unpack_from("<Q", x, 8)[0] - 116_444_736_000_000_000) * 100
        if k in (0x000D, 0x5855) and len(x) >= 8:
            return struct.unpack_from("<I", x, 4)[0] * NS
        if k == 0x5455 and len(x) >= 5 and x[0] & 1:
            return struct.unpack_from("<I", x, 1)[0] * NS
    day, time = stamp >> 16, stamp & 0xFFFF
    year, month = 1980 + (day >> 9), (day >> 5 & 15) - 1
    first = date(year + month // 12, month % 12 + 1, 1).toordinal() - date(1970, 1, 1).toordinal()
    return ((first + (day & 31) - 1) * 86400 + (time >> 11) * 3600 + (time >> 5 & 63) * 60 + (time & 31) * 2) * NS


def _zip_name(raw: bytes, extras: dict[int, bytes]) -> str:
    up = extras.get(0x7075, b"")
    if len(up) > 5 and up[0] == 1:
        raw = up[5:]
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join(chr(c) if c < 128 and c != 37 else f"%{c:02X}" for c in raw)


def zip_members(data: bytes) -> Iterator[Member]:
    end = _zip_end(data)
    count, size, begin = struct.unpack_from("<HII", data, end + 10)
    tail = end
    if end >= 20 and data[end - 20 : end - 16] == b"PK\6\7" and (count == 0xFFFF or size == 0xFFFFFFFF or begin == 0xFFFFFFFF):
        at, disks = struct.unpack_from("<QI", data, end - 12)
        if disks > 1:
            raise FormatError("zip: spanned archive")
        if data[at : at + 4] != b"PK\6\6":
            at = data.rfind(b"PK\6\6", 0, end - 20)
            if at < 0:
                raise FormatError("zip: no zip64 record")
        count, size, begin = struct.unpack_from("<QQQ", data, at + 32)
        tail = at
    shift = tail - size - begin  # bytes put before the archive
    if shift < 0:
        raise FormatError("zip: directory lies before the file")
    first: list[Member] = []
    files: list[Member] = []
    at, error, seen = begin + shift, None, 0
    while at < tail:  # the count is of 16 bits, and some writers let it overflow
        if data[at : at + 4] != b"PK\1\2" or at + 46 > tail:
            error = "zip: bad directory record"
            break
        seen += 1
        by, flags, method, stamp, crc, packed, plain, n, m, k = struct.unpack_from("<4xHxxHHIIIIHHH", data, at)
        outer, where = struct.unpack_from("<II", data, at + 38)
        record, at = at, at + 46
        extras = _zip_extras(data[at + n : at + n + m])
        name = _zip_name(data[at : at + n], extras)
        at += n + m + k
        wide = extras.get(1, b"")
        for field_, value in (("plain", plain), ("packed", packed), ("where", where)):
            if value == 0xFFFFFFFF and len(wide) >= 8:
                value, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
            if field_ == "plain":
                plain = value
            elif field_ == "packed":
                packed = value
            else:
                where = value
        name = name.lstrip("/")
        if name.startswith("__MACOSX/"):  # holds sidecars, and folders that are no one's
            if not name.rpartition("/")[2].startswith("._"):
                continue
            name = name[len("__MACOSX/") :]
        is_dir = name.endswith("/")
        name = name.rstrip("/") if is_dir else name
        if not is_valid(name):
            continue
        unix = outer >> 16
        if by >> 8 in (3, 19):
            perm, link = unix & 0o777, unix & 0o170000 == 0o120000
            is_dir = is_dir or unix & 0o170000 == 0o040000
        elif by >> 8 in (0, 11, 14):
            perm, link = (0o444 if outer & 1 else 0o666) | (0o111 if is_dir or outer & 16 else 0), False
        else:
            perm, link = 0o755 if is_dir else 0o644, False
        mtime = _zip_time(stamp, extras)
        if is_dir:
            first.append(Member(name, "dir", record, 0, mtime, perm))
            continue
        own = where + shift
        x = Member(name, "file", own, plain, mtime, perm, packed_size=packed, crc=crc or None)
        x.codec = {0: "stored", 8: "deflate", 12: "bzip2"}.get(method, f"zip method {method}")
        if flags & 1:
            x.error = "encrypted"
        elif method not in (0, 8, 12):
            x.error = f"unsupported zip method {method}"
        if own + 30 > len(data) or data[own : own + 4] != b"PK\3\4":
            x.error = x.error or "zip: bad local header"
        else:
            a, b = struct.unpack_from("<HH", data, own + 26)
            x.extents = [(0, own + 30 + a + b, packed)]
        if link and not x.error:
            try:
                x.link_target = link_from(name, materialise(x.recipe(), data, plain).decode("utf-8", "replace"))
            except DecodeError:
                x.link_target = "."
            x.kind, x.size = "symlink", 0
            first.append(x)
        else:
            files.append(x)
    yield from first
    yield from sorted(files, key=lambda f: f.member_id)
    if not error and seen % 0x10000 != count % 0x10000:
        error = f"zip: {seen} members instead of {count}"
    if error:
        raise FormatError(error)


# --- TAR ---------------------------------------------------------------------------------


def _tar_number(raw: bytes) -> int:
    if raw[:1] and raw[0] & 0x80:
        value = int.from_bytes(raw, "big") & ~(0x80 << 8 * (len(raw) - 1))
        return value - (1 << 8 * len(raw) - 1) if raw[0] & 0x40 else value
    digits = raw.strip(b" \0").split(b"\0")[0]
    if not digits:
        return 0
    try:
        return int(digits, 8)
    except ValueError:
        raise FormatError("tar: bad number") from None


def _pax(raw: bytes) -> dict[str, str]:
    """Records `length key=value\\n`; offset and size of 0.0 sparse maps gather in one."""
    out: dict[str, str] = {}
    pieces: list[str] = []
    while raw:
        n, gap, _ = raw.partition(b" ")
        if not gap or not n.isdigit() or not len(n) + 2 < int(n) <= len(raw) or raw[int(n) - 1] != 10:
            raise FormatError("tar: bad extended header")
        key, eq, value = raw[len(n) + 1 : int(n) - 1].decode("utf-8", "surrogateescape").partition("=")
        if not eq or not key or ("\0" in value and key in ("path", "linkpath", "uname", "gname")):
            raise FormatError("tar: bad extended header")
        if key in ("GNU.sparse.offset", "GNU.sparse.numbytes"):
            pieces.append(value)
        else:
            out[key] = value
        raw = raw[int(n) :]
    if pieces:
        out["GNU.sparse.map"] = ",".join(pieces)
    return out


def _pax_time(value: str) -> int:
    try:
        return int((Decimal(value) * NS).to_integral_value(rounding="ROUND_FLOOR"))
    except InvalidOperation:
        raise FormatError("tar: bad time") from None


def _sparse(pairs: list[tuple[int, int]], size: int, at: int) -> list[tuple[int, int | None, int]]:
    """Extents of a file of `size` from its data fragments, whose bytes lie one after another."""
    out: list[tuple[int, int | None, int]] = []
    done = 0
    for begin, n in pairs:
        if begin < done or n < 0 or begin + n > size:
            raise FormatError("tar: bad sparse map")
        if begin > done:
            out.append((done, None, begin - done))
        if n:
            out.append((begin, at, n))
        at, done = at + n, begin + n
    if done < size:
        out.append((done, None, size - done))
    return out


def tar_members(data: bytes) -> Iterator[Member]:
    at, pax, long_name, long_link = 0, {}, None, None
    text = lambda b: b.split(b"\0")[0].decode("utf-8", "surrogateescape")
    while at + 512 <= len(data):
        h = data[at : at + 512]
        if not any(h):
            return
        blank = h[:148] + b" " * 8 + h[156:]
        if _tar_number(h[148:156]) not in (sum(blank), sum((c ^ 128) - 128 for c in blank)):
            raise FormatError("tar: bad checksum")
        flag, size, body = h[156:157], _tar_number(h[124:136]), at + 512
        magic = h[257:265]
        if flag in b"xgLK" and size > 1 << 20:
            raise FormatError("tar: header too long")
        if size < 0:
            raise FormatError("tar: bad size")
        if flag in b"xgLK":
            raw = data[body : body + size]
            if len(raw) < size:
                raise FormatError("tar: unexpected end")
            if flag == b"x":
                pax = _pax(raw)
            elif flag == b"L":
                long_name = text(raw)
            elif flag == b"K":
                long_link = text(raw)
            at = body + -(-size // 512) * 512
            continue
        name, link = text(h[:100]), text(h[157:257])
        if magic[:5] == b"ustar" and magic != b"ustar  \0":
            star = h[508:512] == b"tar\0"
            head = text(h[345 : 345 + (131 if star else 155)])
            name = f"{head}/{name}" if head else name
        name = pax.get("path") or long_name or name
        name = pax.get("GNU.sparse.name") or name
        link = pax.get("linkpath") or long_link or link
        mtime = _pax_time(pax["mtime"]) if pax.get("mtime") else _tar_number(h[136:148]) * NS
        size = int(pax["size"]) if pax.get("size", "").isdigit() else size
        x = Member(name, "file", body, size, mtime, _tar_number(h[100:108]) & 0o777, packed_size=size, extents=[(0, body, size)])
        if flag in (b"\0", b"0"):
            x.kind = "dir" if name.endswith("/") else "file"
        elif flag == b"5":
            x.kind = "dir"
        elif flag == b"2":
            x.kind = "symlink"
        elif flag != b"S":
            x.kind = "skip"
        stored = size
        if flag == b"S":
            pairs = [struct.unpack("12s12s", h[386 + 24 * i : 410 + 24 * i]) for i in range(4)]
            more, ext = h[482], body
            while more:
                if ext + 512 > len(data):
                    raise FormatError("tar: unexpected end")
                pairs += [struct.unpack("12s12s", data[ext + 24 * i : ext + 24 * i + 24]) for i in range(21)]
                more, ext = data[ext + 504], ext + 512
            body = ext
            pairs = [tuple(map(_tar_number, p)) for p in pairs if any(p[0]) or any(p[1])]
            x.size, x.member_id = _tar_number(h[483:495]), body
            x.extents = _sparse(pairs, x.size, body)
        elif x.kind == "file" and pax.get("GNU.sparse.major") == "1":
            numbers, place = [], body
            while not numbers or len(numbers) < 1 + 2 * numbers[0]:
                line = data.find(b"\n", place, body + stored)
                if line < 0 or not data[place:line].isdigit():
                    raise FormatError("tar: bad sparse map")
                numbers.append(int(data[place:line]))
                place = line + 1
            start = body + -(-(place - body) // 512) * 512
            x.size = int(pax.get("GNU.sparse.realsize") or pax.get("GNU.sparse.size") or size)
            x.extents = _sparse(list(zip(numbers[1::2], numbers[2::2])), x.size, start)
        elif x.kind == "file" and pax.get("GNU.sparse.map"):
            numbers = [int(n) for n in pax["GNU.sparse.map"].split(",")]
            x.size = int(pax.get("GNU.sparse.size") or size)
            x.extents = _sparse(list(zip(numbers[::2], numbers[1::2])), x.size, body)
        at = body + (0 if flag in b"123456" else -(-stored // 512) * 512)  # those are headers alone
        pax, long_name, long_link = {}, None, None
        x.name = clean(name)
        if x.kind == "skip" or x.name == "." or x.name.startswith(".."):
            continue
        if x.kind == "symlink":
            x.link_target = link_from(x.name, link)
        if x.kind != "file":
            x.size, x.extents = 0, []
        yield x
    if at < len(data) and any(data[at:]):
        raise FormatError("tar: unexpected end")


# --- Streams of one member ---------------------------------------------------------------


def stream_members(data: bytes, codec: str, inner: str, mtime_ns: int | None) -> Iterator[Member]:
    yield Member(inner, "file", 0, None, mtime_ns, 0, codec=codec, extents=[(0, 0, len(data))], packed_size=len(data))


# --- Resource forks ----------------------------------------------------------------------


def _resource_name(raw: bytes) -> str:
    name = raw.decode("mac_roman").replace("/", ":")
    dots = len(name) - len(name.lstrip("."))
    return "_" * dots + name[dots:] or "_"


def resource_members(data: bytes, at: int = 0) -> Iterator[Member]:
    """TYPE/ID files in order of their data, and TYPE/named/NAME links to them."""
    if len(data) < at + 16:
        raise FormatError("resource fork: too short")
    body, table, body_size, table_size = struct.unpack_from(">IIII", data, at)
    if body != 256:
        raise FormatError("resource fork: bad header")
    m = data[at + table : at + table + table_size]
    if len(m) < max(30, table_size):
        raise FormatError("resource fork: bad map")
    types, names = struct.unpack_from(">HH", m, 24)
    if len(m) < types + 2:
        raise FormatError("resource fork: bad map")
    found = []
    try:
        for i in range((struct.unpack_from(">H", m, types)[0] + 1) & 0xFFFF):
            kind, n, first = struct.unpack_from(">4sHH", m, types + 2 + 8 * i)
            for j in range(n + 1):
                number, label, where = struct.unpack_from(">hhI", m, types + first + 12 * j)
                place = at + body + (where & 0xFFFFFF) + 4
                if place > at + body + body_size:
                    raise FormatError("resource fork: bad offset")
                name = None
                if label >= 0:
                    k = m[names + label]
                    name = m[names + label + 1 : names + label + 1 + k]
                found.append((place, kind, number, name))
    except (struct.error, IndexError):
        raise FormatError("resource fork: bad map") from None
    for place, kind, number, name in sorted(found, key=lambda f: f[0]):
        if place > len(data):
            raise FormatError("resource fork: bad offset")
        size = struct.unpack_from(">I", data, place - 4)[0]
        folder = _resource_name(kind)
        path = f"{folder}/{number}"
        yield Member(path, "file", place, size, extents=[(0, place, size)], packed_size=size)
        if name is not None:
            yield Member(f"{folder}/named/{_resource_name(name)}", "symlink", 0, 0, link_target=path)


# --- Apple Partition Map -----------------------------------------------------------------


def apm_members(data: bytes) -> Iterator[Member]:
    """Partitions by start as type-1, type-2 ...; blocks of 512 bytes count if a map is there too."""
    block = struct.unpack_from(">H", data, 2)[0]
    step = 512 if data[512:514] == b"PM" else block
    if data[step : step + 2] != b"PM":
        raise FormatError("partition map: no entries")
    n = struct.unpack_from(">I", data, step + 4)[0]
    parts = []
    for i in range(n):
        e = data[step * (i + 1) : step * (i + 1) + 512]
        if len(e) < 512 or e[:2] != b"PM":
            raise FormatError("partition map: bad entry")
        begin, blocks = struct.unpack_from(">II", e, 8)
        parts.append((begin, blocks, e[48:80].split(b"\0")[0].decode("mac_roman")))
    seen: dict[str, int] = {}
    for begin, blocks, kind in sorted(parts, key=lambda p: p[0]):
        if kind == "Apple_Free":
            continue
        name = kind.removeprefix("Apple_").lower().replace("/", ":") or "_"
        seen[name] = seen.get(name, 0) + 1
        size = blocks * step
        yield Member(f"{name}-{seen[name]}", "file", begin * step, size, extents=[(0, begin * step, size)], packed_size=size)


# --- HFS ---------------------------------------------------------------------------------


def _btree(data: bytes, node_size: int) -> Iterator[tuple[bytes, bytes]]:
    """(key, record) of all leaves, in order."""
    if len(data) < 78:
        raise FormatError("hfs: bad tree")
    at = struct.unpack_from(">I", data, 24)[0]
    visited: set[int] = set()
    while at:
        node = data[at * node_size : (at + 1) * node_size]
        if len(node) < node_size or at in visited:
            raise FormatError("hfs: bad tree")
        visited.add(at)
        at, _, kind, _, n = struct.unpack_from(">IIbBH", node, 0)
        if kind != -1:
            raise FormatError("hfs: bad tree")
        ends = struct.unpack_from(f">{n + 1}H", node, node_size - 2 * (n + 1))[::-1]
        for a, b in zip(ends[:-1], ends[1:]):
            k = node[a]
            begin = a + 1 + k
            yield node[a + 1 : begin], node[begin + (begin & 1) : b]


def hfs_members(data: bytes) -> Iterator[Member]:
    m = data[1024:1186]
    if len(m) < 162 or m[:2] != b"BD":
        raise FormatError("hfs: no volume header")
    blocks, = struct.unpack_from(">H", m, 0x12)
    size, = struct.unpack_from(">I", m, 0x14)
    first, = struct.unpack_from(">H", m, 0x1C)
    if first * 512 + size * blocks > len(data) + 1024:
        raise FormatError("hfs: image is truncated or compressed")
    base = first * 512
    overflow: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    three = lambda b, at=0: [x for x in zip(*[iter(struct.unpack_from(">6H", b, at))] * 2) if x[1]]

    def extents(own: list[tuple[int, int]], cnid: int, fork: int, length: int) -> list[tuple[int, int | None, int]]:
        """Byte extents clipped to the length, chased through the overflow file."""
        own, done, n = list(own), 0, sum(x[1] for x in own)
        while n * size < length:
            more = overflow.get((cnid, fork, n))
            if not more:
                break
            own += more
            n += sum(x[1] for x in more)
        out: list[tuple[int, int | None, int]] = []
        for begin, count in own:
            k = min(count * size, length - done)
            if k > 0:
                out.append((done, base + begin * size, k))
                done += k
        return out

    def fork_bytes(at: int, cnid: int) -> bytes:
        length, = struct.unpack_from(">I", m, at)
        return b"".join(data[p : p + n] for _, p, n in extents(three(m, at + 4), cnid, 0, length))

    tree = fork_bytes(0x82, 3)
    for key, rec in _btree(tree, struct.unpack_from(">H", tree, 32)[0] if len(tree) > 34 else 512):
        if len(key) >= 7:
            fork, cnid, begin = struct.unpack_from(">BIH", key, 0)
            overflow[cnid, fork, begin] = three(rec)
    tree = fork_bytes(0x92, 4)
    dirs: dict[int, tuple[int, str]] = {}
    records = []
    for key, rec in _btree(tree, struct.unpack_from(">H", tree, 32)[0] if len(tree) > 34 else 512):
        if len(key) < 6 or not rec or rec[0] not in (1, 2):
            continue
        parent, n = struct.unpack_from(">xIB", key, 0)
        name = key[6 : 6 + n].decode("mac_roman").replace("/", ":")
        if rec[0] == 1:
            cnid, = struct.unpack_from(">I", rec, 6)
            dirs[cnid] = (parent, name)
        records.append((parent, name, rec))

    def path(cnid: int) -> str | None:
        out: list[str] = []
        passed: set[int] = set()
        while cnid != 1:
            if cnid not in dirs or cnid in passed:
                return None
            passed.add(cnid)
            cnid, name = dirs[cnid]
            out.append(name)
        return "/".join(reversed(out))

    members = []
    for parent, name, rec in records:
        folder = path(parent)
        if folder is None:
            continue
        full = f"{folder}/{name}" if folder else name
        if rec[0] == 1:
            cnid, ctime, mtime = struct.unpack_from(">III", rec, 6)
            members.append((cnid, Member(full, "dir", cnid, 0, (mtime - MAC_EPOCH) * NS, 0, finder={"ctime_ns": (ctime - MAC_EPOCH) * NS, "flags": struct.unpack_from(">H", rec, 30)[0]})))
            continue
        info = rec[4:20]
        cnid, = struct.unpack_from(">I", rec, 20)
        dlen, rlen = struct.unpack_from(">I", rec, 26)[0], struct.unpack_from(">I", rec, 36)[0]
        ctime, mtime = (t - MAC_EPOCH for t in struct.unpack_from(">II", rec, 44))
        finder = {"ftype": info[:4], "creator": info[4:8], "flags": struct.unpack_from(">H", info, 8)[0], "ctime_ns": ctime * NS}
        dx, rx = extents(three(rec, 74), cnid, 0, dlen), extents(three(rec, 86), cnid, 0xFF, rlen)
        short = lambda x, n: None if sum(e[2] for e in x) == n else "hfs: extents end early"
        ident = lambda x, side: ((x[0][1] - base) // size if x else 0) << 33 | side << 32 | cnid
        members.append((ident(dx, 0), Member(full, "file", ident(dx, 0), dlen, mtime * NS, 0, extents=dx, packed_size=dlen, error=short(dx, dlen), finder=finder)))
        fork = Member("", size=rlen, extents=rx, packed_size=rlen, error=short(rx, rlen))
        members.append((ident(rx, 1), with_sidecar(full, info + rec[56:72], mtime, ctime, fork, b"", ident(rx, 1), finder)))
    yield from (x for k, x in sorted(members, key=lambda e: (e[1].kind != "dir", e[0])))


# --- StuffIt -----------------------------------------------------------------------------

SIT_CODECS = {0: "stored", 2: "sit2", 3: "sit3", 13: "sit13", 15: "sit15"}


def _sit_fork(method: int, at: int, packed: int, size: int, crc: int, locked: bool) -> Member:
    method &= 0x0F
    x = Member("", size=size, extents=[(0, at, packed)], packed_size=packed, codec=SIT_CODECS.get(method, f"sit{method}"))
    x.crc = crc if method in (2, 3, 13) else None  # stored forks and method 15 keep none
    if locked:
        x.error = "encrypted"
    elif method not in SIT_CODECS and size:
        x.error = f"unsupported StuffIt method {method}"
    return x


def _sit_file(path: str, ident: int, data: Member, fork: Member, info: bytes, ctime: int, mtime: int, comment: bytes) -> Iterator[Member]:
    """The sidecar with the resource fork, which is stored first, and then the data fork."""
    finder = {"ftype": info[:4], "creator": info[4:8], "flags": struct.unpack_from(">H", info, 8)[0], "ctime_ns": ctime * NS, "comment": comment.decode("mac_roman") or None}
    yield with_sidecar(path, info, mtime, ctime, fork, comment, ident * 2, finder)
    data.name, data.member_id, data.mtime_ns, data.finder = path, ident * 2 + 1, mtime * NS, finder
    yield data


def _sit_classic(data: bytes) -> Iterator[Member]:
    at, folders = 22, []
    end = min(len(data), struct.unpack_from(">I", data, 6)[0] or len(data))
    while at + 112 <= end:
        h = data[at : at + 112]
        if crc16(h[:110]) != struct.unpack_from(">H", h, 110)[0]:
            raise FormatError("stuffit: bad header")
        rmethod, dmethod, n = h[0], h[1], min(h[2], 31)
        name = h[3 : 3 + n].decode("mac_roman").replace("/", ":") or "_"
        info = h[66:76]
        ctime, mtime, rsize, dsize, rpacked, dpacked, rcrc, dcrc = struct.unpack_from(">IIIIIIHH", h, 76)
        ctime, mtime = ctime - MAC_EPOCH, mtime - MAC_EPOCH
        body = at + 112
        if rmethod & 0x6F == 32 or dmethod & 0x6F == 32:
            folders.append(name)
            path = "/".join(folders)
            yield Member(path, "dir", at * 2 + 1, 0, mtime * NS)
            yield with_sidecar(path, info, mtime, ctime, None, b"", at * 2, {"flags": struct.unpack_from(">H", info, 8)[0], "ctime_ns": ctime * NS})
            at = body
        elif rmethod & 0x6F == 33 or dmethod & 0x6F == 33:
            if folders:
                folders.pop()
            at = body
        else:
            fork = _sit_fork(rmethod, body, rpacked, rsize, rcrc, bool(rmethod & 0x90))
            plain = _sit_fork(dmethod, body + rpacked, dpacked, dsize, dcrc, bool(dmethod & 0x90))
            yield from _sit_file("/".join([*folders, name]), at, plain, fork, info, ctime, mtime, b"")
            at = body + rpacked + dpacked


def _sit_v5(data: bytes) -> Iterator[Member]:
    """Headers one after another, each followed by its forks, the resource fork first;
    a header names that of its folder, which may come later."""
    end = min(len(data), struct.unpack_from(">I", data, 84)[0] or len(data))
    at, = struct.unpack_from(">I", data, 88)
    folders: dict[int, tuple[int, str]] = {}
    items: list[tuple[int, str, int, list]] = []
    error = None
    while at + 48 <= end:
        size, = struct.unpack_from(">H", data, at + 6)
        h = data[at : at + size]
        if h[:4] != b"\xa5" * 4 or size < 48 or len(h) < size or crc16(h[:32] + b"\0\0" + h[34:]) != struct.unpack_from(">H", h, 32)[0]:
            error = "stuffit: bad header"
            break
        system, flags = h[4], h[9]
        ctime, mtime, _, _, above, n = struct.unpack_from(">IIIIIH", h, 10)
        ctime, mtime = ctime - MAC_EPOCH, mtime - MAC_EPOCH
        dsize, dpacked, dcrc = struct.unpack_from(">IIH", h, 34)
        skip = 48 + (0 if flags & 0x40 else h[47])
        raw, rest = h[skip : skip + n], h[skip + n :]
        comment = rest[4 : 4 + struct.unpack_from(">H", rest)[0]] if len(rest) > 4 else b""
        begin, at = at, at + size
        if not n:  # the end of a folder
            continue
        info, fork = bytes(10), Member("", size=0, packed_size=0)
        if system == 1:
            k = 50 + data[at + 49] if data[at + 1] & 1 else 36
            o = data[at : at + k]
            if len(o) < k or crc16(o[:2] + b"\0\0" + o[4:]) != struct.unpack_from(">H", o, 2)[0]:
                error = "stuffit: bad header"
                break
            info = o[4:14]
            if o[1] & 1:
                rsize, rpacked, rcrc = struct.unpack_from(">IIH", o, 36)
                fork = _sit_fork(o[48], at + k, rpacked, rsize, rcrc, bool(o[49]))
            at += k
        elif system == 3:
            at += 32
        else:
            error = f"stuffit: unknown system {system}"
            break
        name = raw.decode("mac_roman").replace("/", ":")
        at += fork.packed_size
        if flags & 0x40:
            folders[begin] = (above, name)
            items.append((above, name, begin, [info, ctime, mtime, comment]))
            continue
        plain = _sit_fork(h[46], at, dpacked, dsize, dcrc, bool(flags & 0x20) or h[47] > 0)
        items.append((above, name, begin, [info, ctime, mtime, comment, plain, fork]))
        at += dpacked

    def path(folder: int, name: str) -> str | None:
        out, passed = [name], set()
        while folder:
            if folder not in folders or folder in passed:
                return None
            passed.add(folder)
            folder, above = folders[folder]
            out.append(above)
        return "/".join(reversed(out))

    for folder, name, begin, (info, ctime, mtime, comment, *forks) in items:
        full = path(folder, name)
        if full is None:
            continue
        if forks:
            yield from _sit_file(full, begin, *forks, info, ctime, mtime, comment)
            continue
        finder = {"flags": struct.unpack_from(">H", info, 8)[0], "ctime_ns": ctime * NS, "comment": comment.decode("mac_roman") or None}
        yield Member(full, "dir", begin * 2 + 1, 0, mtime * NS)
        yield with_sidecar(full, info, mtime, ctime, None, comment, begin * 2, finder)
    if error:
        raise FormatError(error)


def sit_members(data: bytes) -> Iterator[Member]:
    if data[:16] == b"StuffIt (c)1997-":
        yield from _sit_v5(data)
    elif data[10:14] == b"rLau":
        yield from _sit_classic(data)
    else:
        raise FormatError("stuffit: bad header")


# --- Registry ----------------------------------------------------------------------------


def _appledouble(data: bytes) -> Iterator[Member]:
    at = fork_range(data)
    if at is not None:
        yield from resource_members(data, at[0])


#: format -> parser of the archive's bytes; streams of one member are handled by members().
PARSERS: dict[str, Callable[[bytes], Iterator[Member]]] = {
    "zip": zip_members,
    "tar": tar_members,
    "sit": sit_members,
    "hfs": hfs_members,
    "apm": apm_members,
    "appledouble": _appledouble,
}
STREAMS = ("gzip", "bzip2", "xz")


def members(fmt: str, data: bytes, base: str, mtime_ns: int | None) -> tuple[list[Member], str | None]:
    """All members that could be listed, and the error that ended the listing."""
    out: list[Member] = []
    try:
        if fmt in STREAMS:
            out += stream_members(data, fmt, inner_name(base, fmt), mtime_ns)
        else:
            for x in PARSERS[fmt](data):
                out.append(x)
    except (FormatError, struct.error, IndexError, ValueError, OverflowError) as e:
        return out, f"{type(e).__name__}: {e}"
    return out, None


def inner_name(base: str, fmt: str) -> str:
    from nestquery.functions.text import SUFFIXES

    for suffix, new in SUFFIXES[fmt]:
        for cut in ("_" + suffix, suffix):
            if base.endswith(cut) and len(base) > len(cut):
                return base[: -len(cut)] + new
    return base


def probe(base: str, head: bytes, whole: Callable[[], bytes] | None = None, size: int | None = None) -> str | None:
    """probe_format() of functions/text.py for the first bytes in hand.

    whole() gives all bytes; it is called only for what the head leaves open: the ends of
    executables, and the length of what looks like a volume of unknown size.
    """
    if whole is None:
        whole, size = (lambda: head), len(head)
    if len(head) < 16:
        return None
    if base.startswith("._"):
        return "appledouble" if fork_range(head) else None
    if base.endswith(".tar"):
        return "tar"
    if head[:16] == b"StuffIt (c)1997-" or (head[:1] == b"S" and head[10:14] == b"rLau"):
        return "sit"
    if head[:2] == b"ER" and head[2:4] in (b"\2\0", b"\4\0", b"\x08\0", b"\x10\0"):
        return "apm"
    if head[:3] == b"\x1f\x8b\x08":
        return "gzip"
    if head[:3] == b"BZh" and 48 <= head[3] <= 57 and head[4:10] == b"1AY&SY" and not base.endswith(".dmg"):
        return "bzip2"
    if head[:6] == b"\xfd7zXZ\0":
        return "xz"
    if head[:4] == b"PK\3\4":
        return "zip"
    if head[:2] == b"MZ":
        data = whole()
        return "zip" if len(data) >= 100 and data[-22:-20] == b"PK" and data[-2:] == b"\0\0" else None
    if not any(head[:16]) or head[:3] in (b"LK\x60", b"\0\0\x60"):
        m = head[1024:1152]
        block = int.from_bytes(m[0x14:0x18], "big")
        if m[:2] == b"BD" and m[0x7C:0x7E] != b"H+" and block >= 512 and block % 512 == 0:
            return "hfs" if (len(whole()) if size is None else size) >= 400 * 1024 else None
    return None


def sidecar_facts(data: bytes) -> dict | None:
    """Finder metadata, dates and comment of a sidecar file; None if it is none."""
    try:
        parts = read_apple_double(data)
    except FormatError:
        return None
    out: dict = dict.fromkeys(("ftype", "creator", "flags", "x", "y", "ctime_ns", "mtime_ns", "locked", "comment", "fork_size"))
    piece = lambda k, n: data[parts[k][0] : parts[k][0] + n] if k in parts and parts[k][1] >= n else b""
    if len(info := piece(9, 16)) == 16:
        out["ftype"], out["creator"] = info[:4], info[4:8]
        out["flags"], out["y"], out["x"] = struct.unpack_from(">Hhh", info, 8)
    if len(dates := piece(8, 16)) == 16:
        stamp = lambda t: None if t == -(2**31) else (t + APPLE_DOUBLE_EPOCH) * NS
        out["ctime_ns"], out["mtime_ns"] = map(stamp, struct.unpack_from(">ii", dates))
    if len(flags := piece(10, 4)) == 4:
        out["locked"] = bool(flags[3] & 1)
    if 4 in parts:
        out["comment"] = data[parts[4][0] : sum(parts[4])].decode("mac_roman")
    out["fork_size"] = parts.get(2, (0, 0))[1]
    return out
