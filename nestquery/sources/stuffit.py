"""Decoders of StuffIt methods 13 (LZSS with Huffman codes) and 15 (arithmetic-coded
block sorting), from their published descriptions.

Two tables of the format are parameters, as they hold thousands of values: the five code sets
that method 13 has built in, and the gaps by which method 15 randomises blocks.  use_tables()
reads them from a JSON file {"codes": {"1": {"first": [321 lengths], "second": [321 lengths],
"offsets": [lengths]}, ...}, "gaps": [256 numbers]}; without it forks that need them say so.
"""

from __future__ import annotations

import json
from functools import lru_cache


class StuffItError(ValueError):
    pass


@lru_cache(4)
def _read_tables(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


_tables: dict = {}


def use_tables(path: str | None) -> None:
    """Decode with the tables of a file, or with none."""
    global _tables
    _tables = _read_tables(path) if path else {}


class _Bits:
    """Bits of a byte string, low bits first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.n < n:
            if self.at < len(self.data):
                self.held |= self.data[self.at] << self.n
            elif self.at > len(self.data) + 8:
                raise StuffItError("unexpected end")
            self.at += 1
            self.n += 8

    def take(self, n: int) -> int:
        self.fill(n)
        value = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return value


class _Code:
    """A prefix code, looked up by (length, low-first bits)."""

    def __init__(self, codes: dict[tuple[int, int], int]):
        self.codes = codes
        self.longest = max((n for n, _ in codes), default=0)

    @staticmethod
    def from_lengths(lengths: list[int]) -> _Code:
        """Shorter codes first, in order of symbols, counted up from zero."""
        codes, code = {}, 0
        for n in range(1, 33):
            for symbol, own in enumerate(lengths):
                if own == n:
                    codes[n, int(format(code, f"0{n}b")[::-1], 2)] = symbol
                    code += 1
            code <<= 1
        return _Code(codes)

    def read(self, bits: _Bits) -> int:
        bits.fill(self.longest)
        for n in range(1, self.longest + 1):
            symbol = self.codes.get((n, bits.held & ((1 << n) - 1)))
            if symbol is not None:
                bits.held >>= n
                bits.n -= n
                return symbol
        raise StuffItError("bad code")


# Fixed values of method 13: the code that spells code lengths.
META_CODES = [
    0x5D8, 0x058, 0x040, 0x0C0, 0x000, 0x078, 0x02B, 0x014, 0x00C, 0x01C, 0x01B, 0x00B, 0x010,
    0x020, 0x038, 0x018, 0x0D8, 0xBD8, 0x180, 0x680, 0x380, 0xF80, 0x780, 0x480, 0x080, 0x280,
    0x3D8, 0xFD8, 0x7D8, 0x9D8, 0x1D8, 0x004, 0x001, 0x002, 0x007, 0x003, 0x008,
]
META_LENGTHS = [
    11, 8, 8, 8, 8, 7, 6, 5, 5, 5, 5, 6, 5, 6, 7, 7, 9, 12, 10, 11, 11, 12, 12, 11, 11, 11, 12,
    12, 12, 12, 12, 5, 2, 2, 3, 4, 5,
]


def _spelled(bits: _Bits, meta: _Code, count: int) -> _Code:
    lengths, n = [], 0
    while len(lengths) < count:
        word = meta.read(bits)
        if word == 31:
            n = -1
        elif word == 32:
            n += 1
        elif word == 33:
            n -= 1
        elif word == 34:
            if bits.take(1):
                lengths.append(n)
        elif word == 35:
            lengths += [n] * (bits.take(3) + 2)
        elif word == 36:
            lengths += [n] * (bits.take(6) + 10)
        else:
            n = word + 1
        lengths.append(n)
    return _Code.from_lengths(lengths[:count])


def method13(data: bytes, size: int) -> bytes:
    """Streams that spell their own codes, and those that name one of the format's five
    built-in sets, if use_tables() has them."""
    bits = _Bits(data)
    kind = bits.take(8)
    if kind >> 4:
        own = _tables.get("codes", {}).get(str(kind >> 4))
        if own is None:
            raise StuffItError(f"no table of built-in code set {kind >> 4}")
        first, second, offsets = (_Code.from_lengths(own[k]) for k in ("first", "second", "offsets"))
    else:
        meta = _Code({(n, c): i for i, (n, c) in enumerate(zip(META_LENGTHS, META_CODES))})
        first = _spelled(bits, meta, 321)
        second = first if kind & 8 else _spelled(bits, meta, 321)
        offsets = _spelled(bits, meta, (kind & 7) + 10)
    out, code = bytearray(), first
    while len(out) < size:
        symbol = code.read(bits)
        if symbol < 256:
            out.append(symbol)
            code = first
            continue
        code = second
        if symbol < 0x13E:
            n = symbol - 256 + 3
        elif symbol < 0x140:
            n = bits.take(10 if symbol == 0x13E else 15) + 65
        else:
            break
        width = offsets.read(bits)
        back = width + 1 if width < 2 else (1 << width - 1) + bits.take(width - 1) + 1
        if back > len(out):
            raise StuffItError("bad offset")
        for _ in range(n):
            out.append(out[-back])
    return bytes(out[:size])


class _Model:
    def __init__(self, first: int, last: int, step: int, limit: int):
        self.first, self.n, self.step, self.limit = first, last - first + 1, step, limit
        self.reset()

    def reset(self) -> None:
        self.counts, self.total = [self.step] * self.n, self.step * self.n

    def seen(self, i: int) -> None:
        self.counts[i] += self.step
        self.total += self.step
        if self.total > self.limit:
            self.counts = [(c + 1) >> 1 for c in self.counts]
            self.total = sum(self.counts)


class _Arithmetic:
    WIDTH = 26

    def __init__(self, data: bytes):
        self.data, self.at, self.bit = data, 0, 8
        self.range, self.code = 1 << self.WIDTH - 1, 0
        for _ in range(self.WIDTH):
            self.code = self.code << 1 | self.next()

    def next(self) -> int:
        self.bit -= 1
        if self.bit < 0:
            self.at, self.bit = self.at + 1, 7
        if self.at >= len(self.data):
            if self.at > len(self.data) + 8:
                raise StuffItError("unexpected end")
            return 0
        return self.data[self.at] >> self.bit & 1

    def read(self, m: _Model) -> int:
        unit = self.range // m.total
        want, low, i = self.code // unit, 0, 0
        while i < m.n - 1 and low + m.counts[i] <= want:
            low += m.counts[i]
            i += 1
        self.code -= low * unit
        self.range = self.range - low * unit if low + m.counts[i] == m.total else m.counts[i] * unit
        m.seen(i)
        while self.range <= 1 << self.WIDTH - 2:
            self.range <<= 1
            self.code = self.code << 1 | self.next()
        return m.first + i

    def number(self, m: _Model, bits: int) -> int:
        return sum(self.read(m) << i for i in range(bits))


def method15(data: bytes, size: int) -> bytes:
    """Blocks that are randomised, which encoders do for repetitive input only, need the gaps of
    use_tables(): the lowest bit is turned of the byte after each gap, the gaps starting anew
    with each block."""
    import numpy as np

    a = _Arithmetic(data)
    one = _Model(0, 1, 1, 256)
    choose = _Model(0, 10, 8, 1024)
    ranks = [_Model(1 << k, (2 << k) - 1, step, 1024) for k, step in zip(range(1, 8), (8, 4, 4, 4, 2, 2, 1))]
    if a.number(one, 8) != ord("A") or a.number(one, 8) != ord("s"):
        raise StuffItError("bad signature")
    bits = a.number(one, 4) + 9
    ended, out = a.read(one), bytearray()
    last, run, left = -1, 0, False
    while not ended and len(out) < size:
        turned = a.read(one)
        if turned and not _tables.get("gaps"):
            raise StuffItError("no table for a randomised block")
        start, order, block = a.number(one, bits), list(range(256)), bytearray()
        while True:
            c = a.read(choose)
            if c < 2:
                unit, zeros = 1, 0
                while c < 2:
                    zeros += unit << c
                    unit <<= 1
                    c = a.read(choose)
                if len(block) + zeros > 1 << bits:
                    raise StuffItError("bad block")
                block += bytes([order[0]]) * zeros
            if c == 10:
                break
            k = 1 if c == 2 else a.read(ranks[c - 3])
            order.insert(0, order.pop(k))
            block.append(order[0])
            if len(block) > 1 << bits:
                raise StuffItError("bad block")
        choose.reset()
        for m in ranks:
            m.reset()
        ended = a.read(one)
        if not block:
            continue
        if start >= len(block):
            raise StuffItError("bad block")
        follow = np.argsort(np.frombuffer(bytes(block), np.uint8), kind="stable").tolist()
        raw = bytearray()
        for _ in range(len(block)):
            start = follow[start]
            raw.append(block[start])
        if turned:
            gaps = _tables["gaps"]
            at, k = gaps[0], 0
            while at < len(raw):
                raw[at] ^= 1
                k = (k + 1) % len(gaps)
                at += max(gaps[k], 1)
        # After four equal bytes comes a count of more of them; runs may cross blocks.
        for b in raw:
            if left:
                out += bytes([last]) * b
                left, run = False, 0
            else:
                run = run + 1 if b == last else 1
                last = b
                out.append(b)
                left = run == 4
    if len(out) < size:
        raise StuffItError("unexpected end")
    return bytes(out[:size])
