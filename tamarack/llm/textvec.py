"""Vectorised text primitives shared by the corpus operators.

Texts are joined into one code-point array per chunk, so that splitting, hashing
and table lookups are numpy calls over millions of characters instead of Python
calls per word.  A chunk holds about ``CHUNK`` code points (one text may be longer:
texts are never cut), which bounds the memory of a worker.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

CHUNK = 1_000_000
_MUL = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def char_values() -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each code point."""
    return mix64(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_MUL))


@functools.cache
def _powers_upto(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inv = pow(_MUL, -1, 1 << 64)
    base, back = np.full(n, _MUL, np.uint64), np.full(n, inv, np.uint64)
    base[0] = back[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    up, down = _powers_upto(max(16, int(n).bit_length()))
    return up[:n], down[:n]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in the keys' order, and where in it each distinct key begins.

    Well mixed keys are sorted by their upper bits, with their places in the lower ones,
    which is much faster than sorting places.  Should two different keys share all upper
    bits, places are sorted after all.
    """
    n = len(keys)
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    packed = keys & ~low
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    place = (packed & low).astype(np.int64)
    ordered = keys[place]
    new = np.ones(n, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.flatnonzero(new)
    between = first[1:]
    if np.any((packed[between] ^ packed[between - 1]) <= low):
        place = np.argsort(keys, kind="stable")
        ordered = keys[place]
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        first = np.flatnonzero(new)
    return place, first


def times(first: np.ndarray, n: int) -> np.ndarray:
    """How many of the ``n`` places each distinct key of ``grouped`` has."""
    return np.diff(np.append(first, n))


def sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each run of numbers from one place to the next; the last one's end is the last place."""
    out = np.add.reduceat(x, np.minimum(at[:-1], max(0, len(x) - 1)), dtype=np.int64) if len(x) and len(at) > 1 else np.zeros(len(at) - 1, np.int64)
    return np.where(np.diff(at) > 0, out, 0)


def to_codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value[i] * B**i, from which ``span_hash`` reads any span's hash."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of value[start + i] * B**i over each span: equal spans, equal numbers."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` code points together."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


class HashTable:
    """Open addressing from 64-bit keys to int32 values; lookups are vectorised."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, spare_bits: int = 4):
        self.bits = max(4, int(len(keys)).bit_length() + spare_bits)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        todo, vals = keys.astype(np.uint64), values.astype(np.int32)
        slot = self._slot(todo)
        while len(todo):
            free = self.values[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)[1]] = True
            put = first & free
            self.keys[slot[put]], self.values[slot[put]] = todo[put], vals[put]
            todo, vals, slot = todo[~put], vals[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        for i in range(1, self.probes):
            ask = np.flatnonzero(out < 0)
            if not len(ask):
                break
            at = (slot[ask] + i) & ((1 << self.bits) - 1)
            out[ask] = np.where(self.keys[at] == keys[ask], self.values[at], -1)
        return out


class WordCache:
    """Remembers a run of numbers for each unit of text, by the unit's hash.

    Hashes are a sorted array and the runs lie end to end in one flat array, so nothing
    is a Python object per unit.  ``lookup`` returns the row of each unit and calls
    ``compute`` with the first position of each unit not seen before, to get the new
    numbers and run lengths.  Beyond ``limit`` units the cache starts afresh; that costs
    time and changes no result.
    """

    def __init__(self, limit: int = 1_500_000, dtype=np.int32):
        self.limit, self.dtype = limit, dtype
        self.clear()

    def clear(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lookup(self, hashes: np.ndarray, compute) -> np.ndarray:
        if len(self.start) > self.limit:
            self.clear()
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, uniq)
        rows = np.full(len(uniq), -1, np.int32)
        if len(self.hashes):
            near = np.minimum(at, len(self.hashes) - 1)
            hit = self.hashes[near] == uniq
            rows[hit] = self.rows[near[hit]]
        new = np.flatnonzero(rows < 0)
        if len(new):
            flat, size = compute(first[new])
            rows[new] = len(self.start) + np.arange(len(new))
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(flat), self.dtype)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.used += len(flat)
            self.hashes = np.insert(self.hashes, at[new], uniq[new])
            self.rows = np.insert(self.rows, at[new], rows[new])
        return rows[inverse]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of the rows end to end, and where each begins (with the end at last)."""
        size = self.size[rows]
        ends = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return self.flat[spans(self.start[rows], size)], ends


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same for the next ones."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def utf8_ends(cp: np.ndarray) -> np.ndarray:
    """Prefix sums of the UTF-8 lengths of code points."""
    out = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF), out=out[1:])
    return out


@functools.cache
def lower_table() -> np.ndarray:
    """Simple lower-case mapping of each code point (those with longer mappings stay)."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) != c:
            table[c] = ord(low)
    return table


#: Code points with the White_Space property.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)


@functools.cache
def class_table() -> np.ndarray:
    """SPACE, LETTER, NUMBER, OTHER of each code point; surrogates are SPECIAL."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[0xD800:0xE000] = SPECIAL
    table[list(WHITE_SPACE)] = SPACE
    return table


#: The white space between the words of a text in the operators' contracts.
WORD_GAPS = (32, *range(9, 14))


@functools.cache
def gap_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[list(WORD_GAPS)] = True
    return table


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the joined texts, begin and end of each word, and each text's first word."""
    cp = to_codepoints(" ".join(texts) + " ")
    gap = gap_table()[cp]
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    text_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=text_at[1:])
    return cp, start, end, np.searchsorted(start, text_at)


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words, in text order, and each text's first shingle.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    cp, start, end, word_at = word_spans(texts)
    words = mix64(span_hash(prefix_hash(char_values()[cp]), start, end) + (end - start).astype(np.uint64))
    n = np.diff(word_at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = spans(word_at[:-1], count)
    size = np.repeat(np.minimum(n, width), count)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    return mix64(span_hash(prefix_hash(words), begin, begin + size) + size.astype(np.uint64)), at
