"""StuffIt decoders against small encoders."""

import json
import random

import pytest

from nestquery.sources.stuffit import META_CODES, META_LENGTHS, StuffItError, _Model, method13, method15, use_tables


class Writer:
    """The arithmetic decoder's mirror, on integers of any length."""

    def __init__(self):
        self.low, self.range, self.shift = 0, 1 << 25, 0

    def put(self, m, value):
        i = value - m.first
        unit = self.range // m.total
        below = sum(m.counts[:i])
        self.low += below * unit
        self.range = self.range - below * unit if below + m.counts[i] == m.total else m.counts[i] * unit
        m.seen(i)
        while self.range <= 1 << 24:
            self.range, self.low, self.shift = self.range << 1, self.low << 1, self.shift + 1

    def number(self, m, value, bits):
        for i in range(bits):
            self.put(m, value >> i & 1)

    def bytes(self):
        n = 26 + self.shift
        return (self.low + self.range // 2 << -n % 8).to_bytes(-(-n // 8), "big")


def arsenic(data, bits=9, gaps=None):
    w, one, choose = Writer(), _Model(0, 1, 1, 256), _Model(0, 10, 8, 1024)
    ranks = [_Model(1 << k, (2 << k) - 1, step, 1024) for k, step in zip(range(1, 8), (8, 4, 4, 4, 2, 2, 1))]
    packed, i = bytearray(), 0
    while i < len(data):
        n = 1
        while i + n < len(data) and data[i + n] == data[i] and n < 259:
            n += 1
        packed += data[i : i + 1] * min(n, 4) + (bytes([n - 4]) if n >= 4 else b"")
        i += n
    w.number(one, ord("A"), 8)
    w.number(one, ord("s"), 8)
    w.number(one, bits - 9, 4)
    blocks = [bytes(packed[k : k + (1 << bits)]) for k in range(0, len(packed), 1 << bits)]
    w.put(one, 0 if blocks else 1)
    for k, b in enumerate(blocks):
        if gaps:
            b, at, g = bytearray(b), gaps[0], 0
            while at < len(b):
                b[at] ^= 1
                g = (g + 1) % len(gaps)
                at += gaps[g]
        b = bytes(b)
        turns = sorted(range(len(b)), key=lambda r: b[r:] + b[:r])
        last = [b[r - 1] for r in turns]
        w.put(one, int(bool(gaps)))
        w.number(one, turns.index(0), bits)
        order, zeros = list(range(256)), 0
        for c in [*last, None]:
            at = None if c is None else order.index(c)
            if at == 0:
                zeros += 1
                continue
            while zeros:
                w.put(choose, 1 - zeros % 2)
                zeros = (zeros - 1) // 2
            if at is None:
                break
            order.insert(0, order.pop(at))
            if at == 1:
                w.put(choose, 2)
            else:
                m = at.bit_length() - 2
                w.put(choose, 3 + m)
                w.put(ranks[m], at)
        w.put(choose, 10)
        choose.reset()
        for m in ranks:
            m.reset()
        w.put(one, int(k == len(blocks) - 1))
    return w.bytes()


@pytest.mark.parametrize("data", [
    b"a", b"banana banana bandana", b"x" * 3, b"x" * 4, b"x" * 700 + b"y" * 5 + b"z", bytes(range(256)) * 3,
    bytes(random.Random(1).choice(b"abcd") for _ in range(3000)), bytes(random.Random(2).randrange(256) for _ in range(1500)),
])
def test_method15(data):
    assert method15(arsenic(data), len(data)) == data


def test_method15_damage():
    with pytest.raises(StuffItError):
        method15(b"not at all", 5)
    with pytest.raises(StuffItError):
        method15(arsenic(b"abc" * 200)[:20], 600)


def test_method13():
    bits = []

    def put(value, n):
        bits.extend(value >> i & 1 for i in range(n))

    meta = lambda i: put(META_CODES[i], META_LENGTHS[i])

    def flat(count, length):
        """All symbols with codes of one length: the length once, then long repeats."""
        meta(length - 1)
        left = count - 1
        while left:
            n = min(left, 74)
            if n >= 11:
                meta(36)
                put(n - 11, 6)
            else:
                n = 1
                meta(length - 1)
            left -= n

    symbol = lambda s, n: bits.extend(int(b) for b in format(s, f"0{n}b"))
    put(0x08 | 1, 8)  # own codes, one for both places, 11 offset symbols
    flat(321, 9)
    flat(11, 4)
    for c in b"abcab":
        symbol(c, 9)
    symbol(256 + 4, 9)  # 7 bytes
    symbol(3, 4)  # from 5 + 0..3 back
    put(0, 2)
    symbol(0x13E, 9)  # 65 + 5 bytes
    put(5, 10)
    symbol(0, 4)  # from 1 back
    symbol(0x140, 9)
    raw = bytes(sum(b << i for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8))
    want = b"abcab" + b"abcabab" + b"b" * 70
    assert method13(raw, len(want)) == want
    with pytest.raises(StuffItError):
        method13(b"\x10" + raw[1:], 10)


def test_tables_are_parameters(tmp_path):
    gaps = [random.Random(7).randrange(3, 40) for _ in range(256)]
    flat = {"first": [9] * 321, "second": [9] * 321, "offsets": [4] * 11}
    (tmp_path / "t.json").write_text(json.dumps({"codes": {"2": flat}, "gaps": gaps}))
    data = bytes(random.Random(1).choice(b"abcd") for _ in range(3000))
    bits = [int(b) for b in format(0x20, "08b")[::-1]] + [int(b) for c in (97, 98, 97, 0x140) for b in format(c, "09b")]
    raw = bytes(sum(b << i for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8))
    try:
        use_tables(str(tmp_path / "t.json"))
        assert method15(arsenic(data, gaps=gaps), len(data)) == data
        assert method13(raw, 3) == b"aba"
        with pytest.raises(StuffItError):
            method13(b"\x30" + raw[1:], 3)
    finally:
        use_tables(None)
    with pytest.raises(StuffItError):
        method13(raw, 3)
    with pytest.raises(StuffItError):
        method15(arsenic(data, gaps=gaps), len(data))
