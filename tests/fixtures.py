"""Archives made with the standard library, or packed by hand."""

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile


def gen_zip(prefix=b"", comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = comment
        z.writestr(zipfile.ZipInfo("plain.txt", (2001, 2, 3, 4, 5, 6)), b"stored text, stored text")
        for name, method in (("d/deflated.txt", zipfile.ZIP_DEFLATED), ("d/bzipped.txt", zipfile.ZIP_BZIP2), ("d/ünï.txt", zipfile.ZIP_DEFLATED)):
            z.writestr(zipfile.ZipInfo(name, (1999, 12, 31, 23, 59, 58)), name.encode() * 50, method)
        x = zipfile.ZipInfo("exec")
        x.external_attr = 0o100755 << 16
        x.create_system = 3
        z.writestr(x, b"#!/bin/sh\necho 12345678\n")
        link = zipfile.ZipInfo("d/link")
        link.external_attr = 0o120777 << 16
        link.create_system = 3
        z.writestr(link, b"../plain.txt")
        z.writestr("empty/", b"")
        z.writestr("__MACOSX/d/._deflated.txt", b"side")
        z.writestr("plain.txt", b"second of the same name")
    return prefix + out.getvalue()


def gen_tar(fmt):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=fmt) as t:
        def add(name, data=b"", **more):
            x = tarfile.TarInfo(name)
            x.size, x.mtime = len(data), 1_000_000_000
            for k, v in more.items():
                setattr(x, k, v)
            t.addfile(x, io.BytesIO(data))

        add("a.txt", b"alpha" * 300)
        add("dir", type=tarfile.DIRTYPE, mode=0o755)
        add("dir/b.txt", b"beta")
        if fmt != tarfile.USTAR_FORMAT:
            add("long/" + "n" * 120 + "/" + "m" * 90, b"long names")
        add("link", type=tarfile.SYMTYPE, linkname="dir/b.txt")
        add("dir/abs", type=tarfile.SYMTYPE, linkname="/a.txt")
        add("hard", type=tarfile.LNKTYPE, linkname="a.txt")
        add("fifo", type=tarfile.FIFOTYPE)
    return out.getvalue()


def gen_nested():
    """tgz -> tar -> zip -> bz2, xz and text."""
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("deep/hello world.txt", b"hello from the fourth layer down")
        f.writestr("x.bz2", bz2.compress(b"squeezed by bzip2 " * 4))
        f.writestr("y_.xz", lzma.compress(b"squeezed by xz " * 4))
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        x = tarfile.TarInfo("archive.zip")
        x.size = len(z.getvalue())
        f.addfile(x, io.BytesIO(z.getvalue()))
    return gzip.compress(t.getvalue())


def gen_rsrc():
    """A resource fork with TEXT 128 (named), TEXT 5 and ICN# -3."""
    items = [(b"TEXT", 128, b"first", "Greeting/1"), (b"TEXT", 5, b"second resource", None), (b"ICN#", -3, b"x" * 40, ".dot")]
    data, refs, names = b"", [], b""
    for kind, number, raw, name in items:
        at = -1
        if name is not None:
            at, names = len(names), names + bytes([len(name)]) + name.encode("mac_roman")
        refs.append((kind, number, at, len(data)))
        data += struct.pack(">I", len(raw)) + raw
    kinds = sorted({r[0] for r in refs})
    types, lists = struct.pack(">H", len(kinds) - 1), b""
    first = 2 + 8 * len(kinds)
    for k in kinds:
        own = [r for r in refs if r[0] == k]
        types += struct.pack(">4sHH", k, len(own) - 1, first + len(lists))
        lists += b"".join(struct.pack(">hhII", n, at, where, 0) for _, n, at, where in own)
    body = types + lists
    table = bytes(24) + struct.pack(">HH", 28, 28 + len(body)) + body + names
    return struct.pack(">IIII", 256, 256 + len(data), len(data), len(table)).ljust(256, b"\0") + data + table


def gen_apm():
    def entry(begin, blocks, kind):
        return (b"PM\0\0" + struct.pack(">III", 4, begin, blocks) + b"name".ljust(32, b"\0") + kind.ljust(32, b"\0")).ljust(512, b"\0")

    head = b"ER\x02\x00".ljust(512, b"\0")
    parts = [entry(1, 4, b"Apple_partition_map"), entry(12, 3, b"Apple_HFS"), entry(8, 2, b"Apple_HFS"), entry(10, 2, b"Apple_Free")]
    image = (head + b"".join(parts)).ljust(8 * 512, b"\0")
    return image + b"A" * 1024 + b"F" * 1024 + b"B" * 1536


def gen_hfs():
    """A volume with a folder, a file of two fragments and a fork, and an overflow extent."""
    size, first = 512, 16
    blocks = {}

    def node(records, kind=0xFF, after=0):
        out, ends = struct.pack(">IIBBHH", after, 0, kind, 1, len(records), 0), []
        for r in records:
            ends.append(len(out))
            out += r
        ends.append(len(out))
        return out.ljust(512 - 2 * len(ends), b"\0") + b"".join(struct.pack(">H", e) for e in reversed(ends))

    def header(leaf):
        rec = struct.pack(">HIIIIHH", 1, leaf, 1, leaf, leaf, 512, 37).ljust(106, b"\0")
        return (struct.pack(">IIBBHH", 0, 0, 1, 0, 3, 0) + rec).ljust(512, b"\0")

    def key(parent, name):
        k = struct.pack(">BIB", 0, parent, len(name)) + name
        k = bytes([len(k)]) + k
        return k + b"\0" * (len(k) & 1)

    mac = 2_082_844_800 + 1_000_000_000

    def folder(cnid):
        return struct.pack(">BBHHIII", 1, 0, 0, 0, cnid, mac, mac).ljust(70, b"\0")

    def file(cnid, dlen, dext, rlen, rext):
        r = struct.pack(">BBBB", 2, 0, 0, 0) + b"TEXTttxt" + struct.pack(">HHHH", 0x100, 0, 0, 0)
        r += struct.pack(">IHIIHIIIII", cnid, 0, dlen, dlen, 0, rlen, rlen, mac, mac, 0)
        r += bytes(16) + struct.pack(">H", 0)
        pad = lambda e: struct.pack(">6H", *sum(e, ()), *([0] * (6 - 2 * len(e))))
        return r + pad(dext) + pad(rext) + bytes(4)

    catalog = [
        key(1, b"Vol") + folder(2),
        key(2, b"Dir/x") + folder(16),
        key(16, b"many") + file(17, 4 * 512 + 7, [(10, 1), (12, 1), (14, 1)], 600, [(20, 2)]),
        key(2, b"plain") + file(18, 11, [(30, 1)], 0, []),
    ]
    blocks[0] = header(1)
    blocks[1] = node([bytes([7]) + struct.pack(">BIH", 0, 17, 3) + struct.pack(">6H", 16, 2, 0, 0, 0, 0)])
    blocks[2] = header(1)
    blocks[3] = node(catalog)
    for b, c in ((10, b"a"), (12, b"b"), (14, b"c"), (16, b"d"), (17, b"e")):
        blocks[b] = c * 512
    blocks[20] = b"R" * 512
    blocks[21] = b"S" * 512
    blocks[30] = b"hello plain"
    n = 900
    mdb = bytearray(162)
    mdb[:2] = b"BD"
    struct.pack_into(">H", mdb, 0x12, n)
    struct.pack_into(">I", mdb, 0x14, size)
    struct.pack_into(">H", mdb, 0x1C, first)
    struct.pack_into(">I6H", mdb, 0x82, 1024, 0, 2, 0, 0, 0, 0)
    struct.pack_into(">I6H", mdb, 0x92, 1024, 2, 2, 0, 0, 0, 0)
    image = bytearray((first + n) * 512)
    image[1024 : 1024 + 162] = mdb
    for b, data in blocks.items():
        at = first * 512 + b * size
        image[at : at + len(data)] = data
    return bytes(image)


def gen_sit():
    """A classic archive: a folder with a stored and a Huffman-coded fork."""
    from nestquery.sources.codecs import crc16

    def head(rm, dm, name, rlen=0, dlen=0, rpack=0, dpack=0, rcrc=0, dcrc=0):
        mac = 2_082_844_800 + 1_000_000_000
        h = bytes([rm, dm, len(name)]) + name.ljust(63, b"\0") + b"TEXTttxt\0\0"
        h += struct.pack(">IIIIIIHH", mac, mac, rlen, dlen, rpack, dpack, rcrc, dcrc) + bytes(6)
        return h + struct.pack(">H", crc16(h))

    bits = "0" + "1" + format(97, "08b") + "1" + format(98, "08b") + "0110" + "1111"
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    plain = b"abbabbbb"
    body = head(32, 32, b"fold")
    body += head(0, 3, b"f", 5, len(plain), 5, len(packed), 0, crc16(plain)) + b"rsrc!" + packed
    body += head(33, 33, b"fold") + head(5, 5, b"odd", 0, 4, 0, 4) + b"????"
    return b"SIT!" + struct.pack(">HI", 2, 22 + len(body)) + b"rLau" + bytes(8) + body
