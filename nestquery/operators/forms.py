"""Packers of the rarer forms, for round trips: bytes of archives from (name, data) members.

They write what the parsers must read: ZIP64 and self-extracting ZIPs, sparse TARs, HFS
volumes with fragmented forks, partition maps, resource forks in sidecars, and StuffIt.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
from heapq import heapify, heappop, heappush

from nestquery.sources.codecs import crc16
from nestquery.sources.members import MAC_EPOCH, apple_double

Members = list[tuple[str, bytes]]
STAMP = 981_173_106
#: Zeros before the data of a sparse member.
HOLE = 4096


# --- ZIP ---------------------------------------------------------------------------------


def zip_form(members: Members, method: int = zipfile.ZIP_DEFLATED, prefix: bytes = b"", wide: bool = False, links: dict[str, str] | None = None) -> bytes:
    """A ZIP after prefix bytes; wide: sizes in ZIP64 extras and a ZIP64 end record."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            info = zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6))
            info.compress_type = method
            with z.open(info, "w", force_zip64=wide) as f:
                f.write(data)
        for name, target in (links or {}).items():
            info = zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6))
            info.create_system, info.external_attr = 3, 0o120777 << 16
            z.writestr(info, target)
    data = out.getvalue()
    if wide:
        count, size, begin = struct.unpack_from("<HII", data, len(data) - 12)
        record = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, begin)
        locator = struct.pack("<IIQI", 0x07064B50, 0, len(prefix) + len(data) - 22, 1)
        end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        data = data[:-22] + record + locator + end
    return prefix + data


# --- TAR ---------------------------------------------------------------------------------


def _octal(n: int, width: int) -> bytes:
    return b"%0*o\0" % (width - 1, n)


def _tar_header(name: bytes, size: int, flag: bytes, magic: bytes, tail: bytes = b"") -> bytes:
    h = name[:100].ljust(100, b"\0") + _octal(0o644, 8) + _octal(0, 8) * 2 + _octal(size, 12) + _octal(STAMP, 12) + b" " * 8 + flag
    h = (h + bytes(100) + magic).ljust(345, b"\0") + tail
    h = h.ljust(512, b"\0")
    return h[:148] + b"%06o\0 " % sum(h) + h[156:]


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 512)


def _pax_header(name: bytes, records: list[tuple[str, str]]) -> bytes:
    body = b""
    for k, v in records:
        text = f" {k}={v}\n".encode()
        n = len(text) + 1
        while len(str(n)) + len(text) != n:
            n = len(str(n)) + len(text)
        body += str(n).encode() + text
    return _tar_header(b"pax/" + name[:90], len(body), b"x", b"ustar\x0000") + _padded(body)


def tar_form(members: Members, fmt: int, links: list[tuple[str, str]] = ()) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=fmt) as t:
        for name, target in links:
            x = tarfile.TarInfo(name)
            x.type, x.linkname, x.mtime = tarfile.SYMTYPE, target, STAMP
            t.addfile(x)
        for name, data in members:
            x = tarfile.TarInfo(name)
            x.size, x.mtime = len(data), STAMP
            t.addfile(x, io.BytesIO(data))
    return out.getvalue()


def sparse_tar(members: Members, form: str) -> bytes:
    """Every member has HOLE zeros before its data, in one of the forms gnu, 0.0, 0.1, 1.0."""
    out = b""
    for name, data in members:
        raw, size = name.encode(), HOLE + len(data)
        if form == "gnu":
            tail = bytes(41) + _octal(HOLE, 12) + _octal(len(data), 12) + bytes(72) + b"\0" + _octal(size, 12)
            out += _tar_header(raw, len(data), b"S", b"ustar  \0", tail) + _padded(data)
            continue
        facts = [("GNU.sparse.size", str(size)), ("GNU.sparse.numblocks", "1")]
        body = data
        if form == "0.0":
            facts += [("GNU.sparse.offset", str(HOLE)), ("GNU.sparse.numbytes", str(len(data)))]
        elif form == "0.1":
            facts += [("GNU.sparse.map", f"{HOLE},{len(data)}"), ("GNU.sparse.name", name)]
        else:
            facts = [("GNU.sparse.major", "1"), ("GNU.sparse.minor", "0"), ("GNU.sparse.name", name), ("GNU.sparse.realsize", str(size))]
            body = _padded(f"1\n{HOLE}\n{len(data)}\n".encode()) + data
        out += _pax_header(raw, facts) + _tar_header(raw, len(body), b"0", b"ustar\x0000") + _padded(body)
    return out + bytes(1024)


# --- Resource forks and sidecars -----------------------------------------------------------


def resource_fork(items: list[tuple[bytes, int, str | None, bytes]]) -> bytes:
    """A fork of resources (type, number, name, data)."""
    data, refs, names = b"", [], b""
    for kind, number, name, raw in items:
        label = -1
        if name is not None:
            label, names = len(names), names + bytes([len(name)]) + name.encode("mac_roman")
        refs.append((kind, number, label, len(data)))
        data += struct.pack(">I", len(raw)) + raw
    kinds = sorted({r[0] for r in refs})
    types, lists = struct.pack(">H", len(kinds) - 1), b""
    for k in kinds:
        own = [r for r in refs if r[0] == k]
        types += struct.pack(">4sHH", k, len(own) - 1, 2 + 8 * len(kinds) + len(lists))
        lists += b"".join(struct.pack(">hhII", n, label, where, 0) for _, n, label, where in own)
    body = types + lists
    table = bytes(24) + struct.pack(">HH", 28, 28 + len(body)) + body + names
    return struct.pack(">IIII", 256, 256 + len(data), len(data), len(table)).ljust(256, b"\0") + data + table


def sidecar(members: Members) -> bytes:
    """A sidecar file whose fork holds the members as named TEXT resources."""
    fork = resource_fork([(b"TEXT", 128 + i, name, data) for i, (name, data) in enumerate(members)])
    return apple_double(b"TEXTttxt" + bytes(24), STAMP, STAMP, len(fork)) + fork


# --- Apple partition map -------------------------------------------------------------------


def partition_map(parts: list[tuple[bytes, bytes]]) -> bytes:
    """An image of partitions (type, data) in order, each padded to whole blocks."""
    entry = lambda begin, blocks, kind: (b"PM\0\0" + struct.pack(">III", len(parts) + 1, begin, blocks) + b"part".ljust(32, b"\0") + kind.ljust(32, b"\0")).ljust(512, b"\0")
    at = len(parts) + 2
    entries, body = [entry(1, len(parts) + 1, b"Apple_partition_map")], b""
    for kind, data in parts:
        blocks = -(-len(data) // 512)
        entries.append(entry(at, blocks, kind))
        at, body = at + blocks, body + _padded(data)
    return b"ER\x02\x00".ljust(512, b"\0") + b"".join(entries) + body


# --- HFS -----------------------------------------------------------------------------------


def _node(records: list[bytes], kind: int, after: int) -> bytes:
    out, ends = struct.pack(">IIBBHH", after, 0, kind, 1, len(records), 0), []
    for r in records:
        ends.append(len(out))
        out += r
    ends.append(len(out))
    return out.ljust(512 - 2 * len(ends), b"\0") + b"".join(struct.pack(">H", e) for e in reversed(ends))


def _tree(records: list[bytes]) -> bytes:
    """A B-tree file of 512-byte nodes: its header, and the leaves chained one to the next."""
    leaves: list[list[bytes]] = [[]]
    for r in records:
        own = leaves[-1]
        if own and 14 + sum(map(len, own)) + len(r) + 2 * (len(own) + 2) > 512:
            leaves.append(own := [])
        own.append(r)
    head = struct.pack(">HIIIIHH", 1, 1, len(records), 1, len(leaves), 512, 37).ljust(106, b"\0")
    nodes = [(struct.pack(">IIBBHH", 0, 0, 1, 0, 3, 0) + head).ljust(512, b"\0")]
    nodes += [_node(own, 0xFF, i + 2 if i + 1 < len(leaves) else 0) for i, own in enumerate(leaves)]
    return b"".join(nodes)


def hfs_volume(members: Members, volume: str = "Vol", pieces: int = 5) -> bytes:
    """A volume of folders and files; data forks lie in up to `pieces` fragments, beyond the
    third in the extents overflow file; each file has a resource fork of its name."""
    size, first, mac = 512, 16, MAC_EPOCH + STAMP
    fork = lambda ext: struct.pack(">6H", *sum(ext[:3], ()), *([0] * (6 - 2 * len(ext[:3]))))

    def key(parent: int, name: str) -> bytes:
        raw = name.replace(":", "/").encode("mac_roman")
        k = struct.pack(">BIB", 0, parent, len(raw)) + raw
        k = bytes([len(k)]) + k
        return k + b"\0" * (len(k) & 1)

    blocks: list[bytes] = []

    def put(data: bytes, n: int) -> list[tuple[int, int]]:
        """Fragments of the data, a block apart."""
        whole = [data[i : i + size].ljust(size, b"\0") for i in range(0, len(data), size)]
        step, ext = max(1, -(-len(whole) // n)), []
        for i in range(0, len(whole), step):
            ext.append((len(blocks), len(whole[i : i + step])))
            blocks.extend(whole[i : i + step])
            if n > 1:
                blocks.append(b"\xee" * size)
        return ext

    folders, records, overflow = {"": 2}, [((1, volume), struct.pack(">BBHHIII", 1, 0, 0, 0, 2, mac, mac).ljust(70, b"\0"))], []
    cnid = 16
    for name, data in members:
        parts = name.split("/")
        for i in range(1, len(parts)):
            path, above = "/".join(parts[:i]), "/".join(parts[: i - 1])
            if path not in folders:
                folders[path] = cnid
                records.append(((folders[above], parts[i - 1]), struct.pack(">BBHHIII", 1, 0, 0, 0, cnid, mac, mac).ljust(70, b"\0")))
                cnid += 1
        dext, rsrc = put(data, pieces), parts[-1].encode()
        rext = put(rsrc, 1)
        r = struct.pack(">BBBB", 2, 0, 0, 0) + b"TEXTttxt" + struct.pack(">HHHH", 0x100, 0, 0, 0)
        r += struct.pack(">IHIIHIIIII", cnid, 0, len(data), len(data), 0, len(rsrc), len(rsrc), mac, mac, 0) + bytes(18)
        records.append(((folders["/".join(parts[:-1])], parts[-1]), r + fork(dext) + fork(rext) + bytes(4)))
        done = sum(n for _, n in dext[:3])
        for i in range(3, len(dext), 3):
            overflow.append(bytes([7]) + struct.pack(">BIH", 0, cnid, done) + fork(dext[i : i + 3]))
            done += sum(n for _, n in dext[i : i + 3])
        cnid += 1
    catalog = _tree([key(*k) + r for k, r in sorted(records, key=lambda x: (x[0][0], x[0][1].lower()))])
    extents = _tree(overflow)
    cat, ext = put(catalog, 1), put(extents, 1)
    n = max(len(blocks), 900)
    mdb = bytearray(162)
    mdb[:2] = b"BD"
    struct.pack_into(">H", mdb, 0x12, n)
    struct.pack_into(">I", mdb, 0x14, size)
    struct.pack_into(">H", mdb, 0x1C, first)
    struct.pack_into(">I6H", mdb, 0x82, len(extents), *ext[0], 0, 0, 0, 0)
    struct.pack_into(">I6H", mdb, 0x92, len(catalog), *cat[0], 0, 0, 0, 0)
    head = bytearray(first * 512)
    head[1024 : 1024 + 162] = mdb
    return bytes(head) + b"".join(blocks) + bytes((n - len(blocks)) * size)


# --- StuffIt -------------------------------------------------------------------------------


def lzw(data: bytes) -> bytes:
    """LZW of 9 to 14 bits, low bits first, codes in groups of eight of one width."""
    out = value = bits = group = 0
    packed = bytearray()
    table = {bytes([i]): i for i in range(256)}
    size, width, word = 257, 9, b""

    def put(code: int, n: int) -> None:
        nonlocal value, bits
        value |= code << bits
        bits += n
        while bits >= 8:
            packed.append(value & 255)
            value >>= 8
            bits -= 8

    for i in range(len(data) + 1):
        longer = word + data[i : i + 1]
        if i < len(data) and longer in table:
            word = longer
            continue
        if word:
            put(table[word], width)
            group = (group + 1) % 8
            out += 1
            # The reader's table is one entry behind: it grows with the code after this one.
            if out > 1 and size < 1 << 14:
                size += 1
                if size == 1 << width and width < 14:
                    put(0, (8 - group) % 8 * width)
                    width, group = width + 1, 0
        if i < len(data):
            if 257 + len(table) - 256 < 1 << 14:
                table[longer] = 257 + len(table) - 256
            word = data[i : i + 1]
    put(0, -bits % 8)
    return bytes(packed)


def huffman(data: bytes) -> bytes:
    """A code tree in prefix order, then the codes; high bits first."""
    counts: dict[int, int] = {}
    for b in data:
        counts[b] = counts.get(b, 0) + 1
    heap: list[tuple[int, int, object]] = [(n, b, b) for b, n in counts.items()]
    heapify(heap)
    serial = 256
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heappop(heap), heappop(heap)
        heappush(heap, (n + m, serial, (a, b)))
        serial += 1
    codes: dict[int, str] = {}
    tree: list[str] = []
    todo: list[tuple[object, str]] = [(heap[0][2], "")]
    while todo:
        at, code = todo.pop()
        if isinstance(at, tuple):
            tree.append("0")
            todo += [(at[1], code + "1"), (at[0], code + "0")]
        else:
            tree.append("1" + format(at, "08b"))
            codes[at] = code
    bits = "".join(tree) + "".join(codes[b] for b in data)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


SIT_METHODS = {0: lambda d: d, 2: lzw, 3: huffman}


def _packed(method: int, data: bytes) -> tuple[int, bytes]:
    return (method, SIT_METHODS[method](data)) if data and (method != 3 or len(set(data)) > 1) else (0, data)


def sit_classic(members: Members) -> bytes:
    """Members one level deep in folders, by turns stored and packed by the two classic methods;
    the resource fork of each is its name."""
    mac = MAC_EPOCH + STAMP

    def head(rm, dm, name, rsize=0, dsize=0, rpacked=0, dpacked=0, rcrc=0, dcrc=0):
        raw = name.replace(":", "/").encode("mac_roman")
        h = bytes([rm, dm, len(raw)]) + raw.ljust(63, b"\0") + b"TEXTttxt\x01\0"
        h += struct.pack(">IIIIIIHH", mac, mac, rsize, dsize, rpacked, dpacked, rcrc, dcrc) + bytes(6)
        return h + struct.pack(">H", crc16(h))

    body, folder = b"", ""
    for i, (path, data) in enumerate(sorted(members)):
        above, _, name = path.rpartition("/")
        if above != folder:
            body += (head(33, 33, folder) if folder else b"") + (head(32, 32, above) if above else b"")
            folder = above
        method, packed = _packed((0, 2, 3)[i % 3], data)
        rsrc = name.encode("mac_roman")
        body += head(0, method, name, len(rsrc), len(data), len(rsrc), len(packed), crc16(rsrc), crc16(data)) + rsrc + packed
    body += head(33, 33, folder) if folder else b""
    return b"SIT!" + struct.pack(">HI", 2, 22 + len(body)) + b"rLau" + bytes(8) + body


def sit_five(members: Members) -> bytes:
    """The same in the later container, whose headers name the offset of their folder."""
    mac = MAC_EPOCH + STAMP
    out = bytearray(b"StuffIt (c)1997-".ljust(100, b" "))
    folders: dict[str, int] = {"": 0}

    def head(flags: int, above: int, name: str, method: int, data: bytes, packed: bytes, rsrc: bytes) -> None:
        raw = name.replace(":", "/").encode("mac_roman")
        size = 48 + len(raw)
        h = bytearray(b"\xa5" * 4 + bytes([1, 0]) + struct.pack(">H", size) + bytes([0, flags]))
        h += struct.pack(">IIIIIH", mac, mac, 0, 0, above, len(raw)) + b"\0\0" + struct.pack(">IIH", len(data), len(packed), crc16(data) if method in (2, 3) else 0)
        h += b"\0\0" + bytes([method, 0]) + raw
        struct.pack_into(">H", h, 32, crc16(bytes(h[:32]) + b"\0\0" + bytes(h[34:])))
        o = bytearray(bytes([0, 1 if rsrc else 0]) + b"\0\0" + b"TEXTttxt\x01\0").ljust(36, b"\0")
        if rsrc:
            o += struct.pack(">IIH", len(rsrc), len(rsrc), 0) + b"\0\0" + bytes([0, 0])
        struct.pack_into(">H", o, 2, crc16(bytes(o[:2]) + b"\0\0" + bytes(o[4:])))
        out.extend(h + o + rsrc + packed)

    for i, (path, data) in enumerate(sorted(members)):
        above, _, name = path.rpartition("/")
        if above not in folders:
            folders[above] = len(out)
            head(0x40, 0, above, 0, b"", b"", b"")
        method, packed = _packed((0, 2, 3)[i % 3], data)
        head(0, folders[above], name, method, data, packed, name.encode("mac_roman"))
    struct.pack_into(">I", out, 84, len(out))
    struct.pack_into(">I", out, 88, 100)
    return bytes(out)
