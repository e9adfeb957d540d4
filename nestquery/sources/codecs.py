"""Decoders of member bytes.  decode() raises DecodeError; callers keep its text as data."""

from __future__ import annotations

import bz2
import lzma
import zlib

from .stuffit import method13, method15

class DecodeError(Exception):
    pass


def crc16(data: bytes, crc: int = 0) -> int:
    """CRC-16 with the reflected polynomial 0xA001."""
    for b in data:
        crc = _CRC16[(crc ^ b) & 255] ^ (crc >> 8)
    return crc


def _crc16_row(i: int) -> int:
    for _ in range(8):
        i = (i >> 1) ^ (0xA001 if i & 1 else 0)
    return i


_CRC16 = [_crc16_row(i) for i in range(256)]


def _gzip(data: bytes) -> bytes:
    out = bytearray()
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out += z.decompress(data) + z.flush()
        if not z.eof:
            raise DecodeError("unexpected end of gzip stream")
        data = z.unused_data
    return bytes(out)


def _deflate(data: bytes) -> bytes:
    z = zlib.decompressobj(-15)
    out = z.decompress(data) + z.flush()
    if not z.eof:
        raise DecodeError("unexpected end of deflate stream")
    return out


def _lzw(data: bytes, size: int) -> bytes:
    """LZW of 9 to 14 bits with a clear code, low bits first, codes in groups of eight."""
    out = bytearray()
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b""]
    width, bit, previous, group = 9, 0, b"", 0
    total = len(data) * 8
    while len(out) < size and bit + width <= total:
        at = bit >> 3
        code = int.from_bytes(data[at : at + 4], "little") >> (bit & 7) & ((1 << width) - 1)
        bit += width
        group = (group + 1) % 8
        if code == 256:
            bit += (8 - group) % 8 * width  # the rest of the group is padding
            table, width, previous, group = table[:257], 9, b"", 0
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise DecodeError("bad LZW code")
        out += entry
        if previous and len(table) < 1 << 14:
            table.append(previous + entry[:1])
            if len(table) == 1 << width and width < 14:
                bit += (8 - group) % 8 * width
                width, group = width + 1, 0
        previous = entry
    return bytes(out[:size])


def _huffman(data: bytes, size: int) -> bytes:
    """A code tree in prefix order (1 and a byte: leaf; 0: two subtrees), then codes; high bits first."""
    bits = int.from_bytes(data, "big")
    total, at = len(data) * 8, 0

    def take(n: int) -> int:
        nonlocal at
        if at + n > total:
            raise DecodeError("unexpected end of Huffman stream")
        at += n
        return bits >> (total - at) & ((1 << n) - 1)

    nodes: list[list[int]] = []  # child: node number, or -1 - byte

    def leaf_or_node() -> int:
        if take(1):
            return -1 - take(8)
        nodes.append([0, 0])
        return len(nodes) - 1

    root = leaf_or_node()
    open_ = [(root, 0)] if root >= 0 else []
    while open_:
        node, side = open_.pop()
        child = leaf_or_node()
        nodes[node][side] = child
        if side == 0:
            open_.append((node, 1))
        if child >= 0:
            open_.append((child, 0))
    stream = format(bits & ((1 << (total - at)) - 1), f"0{total - at}b") if total > at else ""
    out, k = bytearray(), 0
    while len(out) < size:
        node = root
        while node >= 0:
            if k >= len(stream):
                raise DecodeError("unexpected end of Huffman stream")
            node = nodes[node][stream[k] == "1"]
            k += 1
        out.append(-1 - node)
    return bytes(out)


def decode(codec: str, packed: bytes, size: int | None) -> bytes:
    try:
        if codec == "stored":
            return packed
        if codec == "deflate":
            return _deflate(packed)
        if codec == "gzip":
            return _gzip(packed)
        if codec == "bzip2":
            return bz2.decompress(packed)
        if codec == "xz":
            return lzma.decompress(packed, lzma.FORMAT_XZ)
        if codec == "sit2":
            return _lzw(packed, size or 0)
        if codec == "sit3":
            return _huffman(packed, size or 0)
        if codec == "sit13":
            return method13(packed, size or 0)
        if codec == "sit15":
            return method15(packed, size or 0)
    except (OSError, zlib.error, lzma.LZMAError, EOFError, ValueError) as e:
        raise DecodeError(f"{codec}: {e}") from None
    raise DecodeError(f"unsupported codec {codec}")


def gather(source: bytes, extents: list) -> bytes:
    """Bytes of (log, phys, len) slices in order; a hole (phys None) is zeros."""
    parts = []
    for x in extents:
        log, phys, n = (x["log"], x["phys"], x["len"]) if isinstance(x, dict) else x
        if phys is None:
            parts.append(bytes(n))
            continue
        part = source[phys : phys + n]
        if len(part) < n:
            raise DecodeError("data lies beyond the end of the archive")
        parts.append(part)
    return b"".join(parts)


def materialise(recipe: dict, source: bytes, size: int | None) -> bytes:
    """The bytes of an entry from the bytes of its archive; checks CRCs that are kept."""
    if recipe.get("error"):
        raise DecodeError(recipe["error"])
    prefix = recipe.get("prefix") or b""
    inner = None if size is None else size - len(prefix)
    codec = recipe["codec"]
    data = decode(codec, gather(source, recipe["extents"]), inner)
    if inner is not None and len(data) != inner:
        raise DecodeError(f"{codec}: {len(data)} bytes instead of {inner}")
    if recipe.get("crc"):
        got = crc16(data) if codec.startswith("sit") else zlib.crc32(data)
        if got != recipe["crc"]:
            raise DecodeError("checksum mismatch")
    return prefix + data


#: Bytes of a member that the probe looks at.
HEAD = 1152


def peek(recipe: dict, source: bytes, size: int | None, n: int = HEAD) -> bytes:
    """The first bytes of an entry, decoding no more than they need where the codec can."""
    if recipe.get("error"):
        raise DecodeError(recipe["error"])
    prefix, codec, extents = recipe.get("prefix") or b"", recipe["codec"], recipe["extents"]
    if len(prefix) >= n:
        return prefix[:n]
    try:
        if codec == "stored":
            short, left = [], n - len(prefix)
            for x in extents:
                if left <= 0:
                    break
                short.append({"log": x["log"], "phys": x["phys"], "len": min(x["len"], left)})
                left -= short[-1]["len"]
            return prefix + gather(source, short)
        if len(extents) == 1 and extents[0]["phys"] is not None:
            packed = memoryview(source)[extents[0]["phys"] : extents[0]["phys"] + extents[0]["len"]]
        else:
            packed = memoryview(gather(source, extents))
        if codec in ("deflate", "gzip"):
            z, out = zlib.decompressobj(-15 if codec == "deflate" else 31), b""
            for at in range(0, len(packed), 1 << 14):
                out += z.decompress(packed[at : at + (1 << 14)], n - len(out))
                if len(out) >= n or z.eof:
                    break
            return prefix + out
        if codec in ("bzip2", "xz"):
            z, out = (bz2.BZ2Decompressor() if codec == "bzip2" else lzma.LZMADecompressor(lzma.FORMAT_XZ)), b""
            for at in range(0, len(packed), 1 << 16):
                out += z.decompress(packed[at : at + (1 << 16)], n - len(out))
                if len(out) >= n or z.eof:
                    break
            return prefix + out
    except (OSError, zlib.error, lzma.LZMAError, EOFError) as e:
        raise DecodeError(f"{codec}: {e}") from None
    return materialise(recipe, source, size)[:n]


def slice_of(recipe: dict, source: bytes, size: int | None, offset: int, length: int | None) -> bytes:
    """Up to length bytes (null: all) of an entry from offset on.

    Of stored entries only the extents that meet the range are touched; streams are decoded
    up to its end.  A checksum is tested only where all is decoded.
    """
    if offset < 0 or (length or 0) < 0:
        raise DecodeError("negative offset or length")
    if recipe.get("error"):
        raise DecodeError(recipe["error"])
    if size is not None:
        length = max(0, min(size - offset, size if length is None else length))
    if length == 0:
        return b""
    prefix = recipe.get("prefix") or b""
    if recipe["codec"] == "stored" and length is not None:
        begin, end = max(0, offset - len(prefix)), max(0, offset + length - len(prefix))
        parts, log = [], 0
        for x in recipe["extents"]:
            a, b = max(begin, log), min(end, log + x["len"])
            if a < b:
                parts.append({"log": a, "phys": None if x["phys"] is None else x["phys"] + a - log, "len": b - a})
            log += x["len"]
        return prefix[offset : offset + length] + gather(source, parts)
    if length is None or size is not None and offset + length >= size:
        return materialise(recipe, source, size)[offset : None if length is None else offset + length]
    return peek(recipe, source, size, offset + length)[offset : offset + length]
