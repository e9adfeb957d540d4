"""Operator 10: SentencePiece byte-pair encoding and decoding.

The encoder works on flat numpy arrays.  The text becomes symbols, cut into words at
places that no piece of the vocabulary spans.  In every round each word finds the best
rank among its adjacent pairs (a segmented minimum), merges the leftmost non-overlapping
occurrences of it at once, and the arrays are compacted; words without a pair drop out.
A merge whose result could at once take part in an equal or better merge would make
simultaneous merges differ from one-by-one merges: such results are flagged when the
vocabulary is loaded, and only their leftmost occurrence is merged in a round.

Null text counts as empty.  An empty text has the end id alone and decodes to ''.
A model that the encoder would code wrongly (another normaliser, no byte pieces) is refused.
Texts of any length are encoded whole; repeated rows are encoded each.  Columns other
than the text pass through unchanged; those of the output's names are replaced.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.durable import bounded_batches

SPACE_MARK = "▁"
NO_RANK = np.iinfo(np.int32).max
EMPTY, ABSENT = -1, -2
#: Words whose ids one Python worker remembers between blocks (some 200 bytes each); the memory is
#: emptied when it is full, as a worker keeps it while it waits for other tasks.
REMEMBERED_WORDS, REMEMBERED_CHARS = 200_000, 4_000_000
#: Characters of a word from which on it is cut further, or merged by a heap.
LONG_WORD = 256
#: Characters of texts, and of new words, that are encoded together: the rounds take some 100
#: bytes for each.
BLOCK_CHARS = 250_000
#: Runs of spaces and literal space marks, which plain splitting would cut wrongly.
TANGLED = re.compile(rf"{SPACE_MARK}|  |^ | $| \n")


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("nestquery-each-byte", _each_byte)


class _Numbered(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class PieceModel:
    """Vocabulary tables of a byte-fallback BPE model, and the codec over them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.eos = sp.eos_id()
        self.byte_id = np.zeros(256, np.int32)
        self.surface: list[bytes] = []
        for i, piece in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            elif plain[i]:
                self.surface.append(piece.replace(SPACE_MARK, " ").encode())
            else:
                self.surface.append(b"")
        self.silent = {i for i in range(n) if self.surface[i] == b""}
        self.spaced = {i for i in range(n) if plain[i] and pieces[i][0] == SPACE_MARK}
        symbol = {p: i for i, p in enumerate(pieces) if plain[i]}
        for p in list(symbol):
            for c in p:
                symbol.setdefault(c, len(pieces) + len(symbol))
        scores = np.array([sp.get_score(i) if plain[i] else -np.inf for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs: dict[tuple[int, int], int] = {}
        rash = set()
        for p, i in symbol.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
                    rash.update(x for x in (a, b) if x < n and rank[i] <= rank[x])
        self.size = n
        self.width = n + len(symbol) + 2
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        made = np.array(list(pairs.values()), np.int32)
        self._hash(keys, made, rank[made])
        self.pairs = {k: (int(rank[v]), v) for k, v in pairs.items()}
        self.beside = {p[i : i + 2] for p in symbol for i in range(len(p) - 1)}
        self.rash = np.zeros(self.width, bool)
        self.rash[list(rash)] = True
        table = np.full(0x110000, -1, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                table[ord(p)] = i
        self.char_symbol = table
        joined = {c for p in symbol if len(p) > 1 for c in p}
        cuts = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in symbol)
        lone = "" if "\n" in joined else r"\n"
        self.word = re.compile(rf"{lone}|{SPACE_MARK}*[^{SPACE_MARK}{lone}]+|{SPACE_MARK}+".lstrip("|")) if not cuts else re.compile(r"(?s).+")
        self.lone_lines = not cuts and bool(lone)
        self._forget()

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair: an open-addressed table, probed until all are found."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = ABSENT
        at = self._slot(key)
        found = self.slot_key[at]
        open_ = np.flatnonzero((found != key) & (found != EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.slot_key[at[open_]]
            open_ = open_[(found != key[open_]) & (found != EMPTY)]
        hit = self.slot_key[at] == key
        return np.where(hit, self.slot_rank[at], NO_RANK), np.where(hit, self.slot_made[at], -1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash(self, keys: np.ndarray, made: np.ndarray, rank: np.ndarray) -> None:
        self.bits = int(len(keys) * 4).bit_length()
        self.mask = (1 << self.bits) - 1
        self.slot_key = np.full(1 << self.bits, EMPTY, np.int64)
        self.slot_made = np.full(1 << self.bits, -1, np.int32)
        self.slot_rank = np.full(1 << self.bits, NO_RANK, np.int32)
        for i, at in enumerate(self._slot(keys).tolist()):
            while self.slot_key[at] != EMPTY:
                at = (at + 1) & self.mask
            self.slot_key[at], self.slot_made[at], self.slot_rank[at] = keys[i], made[i], rank[i]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another and their number for each word."""
        if max(map(len, words), default=0) <= LONG_WORD:
            return self._rounds(words)
        parts = [[w] if len(w) <= LONG_WORD else self._parts(w) for w in words]
        flat = list(chain.from_iterable(parts))
        ids, count = self._rounds([w if len(w) <= LONG_WORD else "" for w in flat])
        pieces = np.split(ids, np.cumsum(count)[:-1])
        pieces = [self._one_by_one(w) if len(w) > LONG_WORD else x for w, x in zip(flat, pieces)]
        ends = np.cumsum([len(x) for x in pieces])
        last = ends[np.cumsum([len(x) for x in parts]) - 1]
        return np.concatenate(pieces), np.diff(np.r_[0, last])

    def _parts(self, word: str) -> list[str]:
        """A long word cut wherever no piece holds the two characters side by side."""
        at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.beside]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)])]

    def _one_by_one(self, word: str) -> np.ndarray:
        """Merges in order of a heap: for long runs without any place to cut, where rash
        merges would take a round each."""
        symbol = self.char_symbol[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (got := self.pairs.get((symbol[i], symbol[j]))) is not None:
                heapq.heappush(heap, (got[0], i, symbol[i], symbol[j], got[1]))

        for i in range(n):
            offer(i)
        gone = -2
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], symbol[j] = made, gone
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        left = np.array([i for i in range(n) if symbol[i] != gone], np.int64)
        ids = np.array([symbol[i] for i in left], np.int32)
        known = (ids >= 0) & (ids < self.size)
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)[left]
        return ids if known.all() else self._bytes(np.zeros(len(ids), np.int64), ids, known, chars)[1]

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode_words() by rounds of simultaneous merges."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        start = np.arange(len(chars), dtype=np.int32)  # first character of each symbol
        symbol = self.char_symbol[chars]
        # rank[i], made[i]: of symbol i with the next one of its word
        rank, made = np.full(len(symbol), NO_RANK, np.int32), np.full(len(symbol), -1, np.int32)
        rank[:-1], made[:-1] = self._lookup(symbol[:-1], symbol[1:])
        rank[:-1][word[1:] != word[:-1]] = NO_RANK
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(word)])
            best = np.repeat(np.minimum.reduceat(rank, first), count)
            live = best != NO_RANK
            if not live.all():
                done.append((word[~live], start[~live], symbol[~live]))
                word, start, symbol, rank, made, best = (x[live] for x in (word, start, symbol, rank, made, best))
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            # In a run of overlapping occurrences every other one merges, from the left.  A run
            # ends with its word: the last symbol of a word has no pair.
            new_run = np.r_[True, np.diff(at) != 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            # A rash result anywhere in a word holds back all but the leftmost merge.
            leftmost = np.r_[True, word[at][1:] != word[at][:-1]]
            if not leftmost.all():
                rash_word = np.zeros(len(words), bool)
                rash_word[word[at][self.rash[made[at]]]] = True
                at = at[leftmost | ~rash_word[word[at]]]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            word, start, symbol, rank, made = (x[keep] for x in (word, start, symbol, rank, made))
            # Only pairs with a merged symbol changed.
            touched = np.zeros(len(symbol) + 1, bool)
            touched[at] = touched[at - 1] = True  # at 0 the one before is the spare last place
            left = np.flatnonzero(touched[:-1])
            last = left == len(symbol) - 1
            right = np.where(last, 0, left + 1)
            r, m = self._lookup(symbol[left], symbol[right])
            r[last | (word[left] != word[right])] = NO_RANK
            rank[left], made[left] = r, m
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, start, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(start, kind="stable")
        word, start, symbol = word[order], start[order], symbol[order]
        known = (symbol >= 0) & (symbol < self.size)
        if not known.all():
            word, symbol = self._bytes(word, symbol, known, chars[start])
        return symbol, np.bincount(word, minlength=len(words))

    def _bytes(self, word, symbol, known, chars):
        """Symbols outside the vocabulary (single characters) become the ids of their bytes."""
        width = np.where(known, 1, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))
        out = np.repeat(symbol, width)
        at = np.cumsum(width) - width
        odd = np.flatnonzero(~known)
        raw = np.frombuffer(chars[odd].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        places = np.repeat(at[odd], width[odd]) + np.arange(len(raw)) - np.repeat(np.cumsum(width[odd]) - width[odd], width[odd])
        out[places] = self.byte_id[raw]
        return np.repeat(word, width), out

    def cut(self, text: str) -> list[str]:
        """The words of a text after the escape of spaces, in order; '' may be among them."""
        if self.lone_lines and not TANGLED.search(text):
            marked = SPACE_MARK + text.replace(" ", " " + SPACE_MARK)
            return (marked.replace("\n", " \n ") if "\n" in text else marked).split(" ")
        return self.word.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after another, the end id after each, and where each begins."""
        cut = [self.cut(t) if t else [] for t in texts]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
        if new := list(islice(self.known, len(self.word_count), None)):
            self.known_chars += sum(map(len, new))
            parts = [self.encode_words(new[a:b]) for a, b in _blocks(map(len, new))]
            ids, count = (np.concatenate(x) for x in zip(*parts))
            begin = len(self.word_ids) + np.cumsum(count) - count
            self.word_ids = np.r_[self.word_ids, ids]
            self.word_begin = np.r_[self.word_begin, begin]
            self.word_count = np.r_[self.word_count, count]
        count, begin = self.word_count[at], self.word_begin[at]
        words = np.fromiter(map(len, cut), np.int64, len(cut))
        ends = np.r_[0, np.cumsum(count)][np.cumsum(words)]  # without end ids
        source = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out = np.insert(self.word_ids[source], ends, self.eos)
        if len(self.known) > REMEMBERED_WORDS or self.known_chars > REMEMBERED_CHARS:
            self._forget()
        return out, np.r_[0, ends + np.arange(1, len(texts) + 1)]

    def _forget(self) -> None:
        self.known, self.known_chars = _Numbered(), 0
        self.word_ids = np.zeros(0, np.int32)
        self.word_begin, self.word_count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; byte pieces join into characters, invalid bytes become U+FFFD."""
        surface = self.surface
        silent = [i for i, x in enumerate(ids) if x in self.silent]
        text, begin, head = "", 0, True
        for end in [*silent, len(ids)]:
            if end > begin:
                raw = b"".join([surface[x] for x in ids[begin:end]])
                if head and ids[begin] in self.spaced:
                    raw = raw[1:]
                text += raw.decode("utf-8", "nestquery-each-byte")
                head = False
            begin = end + 1
        return text


#: Texts that show whether a model does what the encoder assumes: no normaliser, byte pieces for
#: unknown characters, a space before the text, none removed.
PROBES = ["", "a  b", " lead and trail ", "Ａ①ﬁ e\u0301 \u00a0x", "one\n\t two\r\n", "日本語 𐍈 \U0001f9ff \ue000", "▁▁x▁", "Hello, world! 12345 == <s> </s>"]


def checked(model: PieceModel, sp) -> PieceModel:
    """The model, if it codes the probes as the library does; else ValueError."""
    for p in PROBES:
        ids = sp.encode(p, add_eos=True)
        if model.encode([p])[0].tolist() != ids or model.decode(ids) != sp.decode(ids):
            raise ValueError(f"the model needs another encoder: it codes {p!r} differently")
    return model


@lru_cache(2)
def load(path: str | None) -> PieceModel:
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return checked(PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path))


def _blocks(lengths: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that end where BLOCK_CHARS are reached."""
    begin = end = size = 0
    for end, n in enumerate(lengths, 1):
        size += n
        if size >= BLOCK_CHARS:
            yield begin, end
            begin, size = end, 0
    if begin < end:
        yield begin, end


def encode_decode(
    df: DataFrame,
    text: str = "text",
    model_path: str | None = None,
    ids: str = "ids",
    decoded: str = "decoded",
    drop_text: bool = False,
) -> DataFrame:
    """Add `ids` array<int> (end id last) and `decoded` string.

    model_path is read by the executors; None stands for the 32k piece file of the
    public tokenizers package.  drop_text leaves the text column out of the result.
    """
    kept = [c for c in df.columns if c not in (ids, decoded) and not (drop_text and c == text)]
    schema = T.StructType([df.schema[c] for c in kept] + [
        T.StructField(ids, T.ArrayType(T.IntegerType(), False), False),
        T.StructField(decoded, T.StringType(), False),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for a, b in _blocks(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                flat, offsets = model.encode(texts[a:b].to_pylist())
                listed = flat.tolist()
                plain = [model.decode(listed[x:y]) for x, y in zip(offsets[:-1], offsets[1:])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in kept]
                    + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), pa.array(plain, pa.string())],
                    names=[*kept, ids, decoded],
                )

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
