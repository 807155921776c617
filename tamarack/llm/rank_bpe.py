"""Byte-pair encoding by a contiguous rank array, for many short words at once.

A word is a row of part ids with the rank of each adjacent pair beside it.  The least
rank is found by a scan, its boundary deleted, and the two neighbouring ranks are looked
up again, until no pair of the row has a rank.  Rows of equal length are worked on
together: each live row loses one boundary a step, so all live rows keep one length and
the scan, the deletion and the refresh are array operations.  Words of more than
``LONG`` bytes use a heap over the same ranks, in n log n steps.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import numpy as np

from . import textvec as tv
from .common import loaded

LONG = 160
_NONE = np.int32(2**31 - 1)
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character which stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankBpe:
    """Encoder and decoder for a word-end BPE vocabulary file (its path is a parameter)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + self.end] for s in symbols], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = tv.HashTable((left << np.uint64(32) | right) + np.uint64(1), np.arange(len(pairs)))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = list(self.special.items())
        self.special_ids = np.array([i for _, i in self.specials], np.int32)
        self.special_pattern = re.compile("|".join(re.escape(s) for s in self.special)) if self.special else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.cache = tv.WordCache()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = self.ranks.get((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1))
        return np.where(got < 0, _NONE, got)

    def encode_rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one byte length, given as a (words, length) matrix of bytes.

        Returns the ids in a matrix padded at the right, and how many each word has.
        """
        m, n = words.shape
        ids = self.inner[words]
        ids[:, -1] = self.final[words[:, -1]]
        out, size = ids.copy(), np.full(m, n, np.int64)
        rows = np.arange(m)
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, n - 1)
        while ids.shape[1] > 1:
            best = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), best]
            live = least != _NONE
            if not live.all():
                out[rows[~live], : ids.shape[1]], size[rows[~live]] = ids[~live], ids.shape[1]
                rows, ids, ranks, best, least = rows[live], ids[live], ranks[live], best[live], least[live]
            if not len(rows):
                return out, size
            width = ids.shape[1]
            k, col = np.arange(len(rows)), np.arange(width - 1)
            ids = np.take_along_axis(ids, col + (col > best[:, None]), 1)
            ids[k, best] = self.merged[least]
            col = col[: width - 2]
            ranks = np.take_along_axis(ranks, col + (col >= best[:, None]), 1)
            has = np.flatnonzero(best > 0)
            ranks[has, best[has] - 1] = self.rank(ids[has, best[has] - 1], ids[has, best[has]])
            has = np.flatnonzero(best < width - 2)
            ranks[has, best[has]] = self.rank(ids[has, best[has]], ids[has, best[has] + 1])
        out[rows, : ids.shape[1]], size[rows] = ids, ids.shape[1]
        return out, size

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word: least rank first, leftmost among equals."""
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.final[raw[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n:
                    got = int(self.rank(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if got != _NONE:
                        heapq.heappush(heap, (got, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_spans(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``start`` in the bytes, end to end, and how many each has."""
        count = np.zeros(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            n = int(size[group[0]]) if len(group) else 0
            if n > LONG:
                for i in group:
                    ids = self.encode_long(raw[start[i] : start[i] + n].tobytes())
                    count[i] = len(ids)
                    found.append((np.array([i]), ids))
                continue
            step = max(1, 1_000_000 // max(n, 1))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                ids, got = self.encode_rows(raw[start[part, None] + np.arange(n)])
                count[part] = got
                found.append((part, ids[np.arange(n) < got[:, None]]))
        at = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        for part, ids in found:
            flat[tv.spans(at[part], count[part])] = ids
        return flat, count

    def _prepare(self, text: str) -> str:
        """NFC between special strings, which become one surrogate each."""
        if self.special_pattern and "<|" in text and self.special_pattern.search(text):
            parts, at = [], 0
            for m in self.special_pattern.finditer(text):
                number = [s for s, _ in self.specials].index(m.group())
                parts += [self._prepare(text[at : m.start()]), chr(0xD800 + number)]
                at = m.end()
            return "".join([*parts, self._prepare(text[at:])])
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "İ" in text:
                text = text.replace("İ", "i̇")
        return text

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the texts, and begin, end and text number of each word."""
        ready = [self._prepare(t) for t in texts]
        cp = tv.lower_table()[tv.to_codepoints(" ".join(ready) + "   ")]
        kind = tv.class_table()[cp]
        begin = np.empty(len(kind), bool)
        begin[0] = kind[0] != tv.SPACE
        begin[1:] = (kind[1:] != tv.SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == tv.NUMBER) | (kind[1:] == tv.SPECIAL))
        quote = np.flatnonzero((cp[:-2] == 39) & begin[:-2])
        if len(quote):
            one, two = cp[quote + 1], cp[quote + 2]
            for c in _CONTRACTIONS:
                hit = quote[one == ord(c[1])] if len(c) == 2 else quote[(one == ord(c[1])) & (two == ord(c[2]))]
                begin[hit + 1] = False
                after = hit + len(c)
                begin[after] = kind[after] != tv.SPACE
        start = np.flatnonzero(begin)
        stop = np.flatnonzero((kind[:-1] != tv.SPACE) & (begin[1:] | (kind[1:] == tv.SPACE))) + 1
        ends = np.cumsum([len(t) + 1 for t in ready])
        return cp, start, stop, np.searchsorted(ends, start, "right")

    def rows(self, texts: list[str]):
        """Cache row of each word of the texts, and where each text's words begin and end."""
        cp, start, stop, owner = self.words(texts)
        values = tv.char_values()[cp]
        hashes = tv.mix64(tv.span_hash(tv.prefix_hash(values), start, stop) + (stop - start).astype(np.uint64))
        del values

        def compute(first: np.ndarray):
            at = tv.utf8_ends(cp)
            raw = np.frombuffer(cp.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            begin, end = at[start[first]], at[stop[first]]
            mark = cp[start[first]].astype(np.int64) - 0xD800
            special = np.flatnonzero((mark >= 0) & (mark < len(self.specials)))
            flat, count = self.encode_spans(raw, begin, np.where(np.isin(np.arange(len(first)), special), 1, end - begin))
            ends = np.cumsum(count)
            flat[ends[special] - 1] = self.special_ids[mark[special]]
            return flat, count

        return self.cache.lookup(hashes, compute), np.searchsorted(owner, np.arange(len(texts) + 1))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit numbers; a null text has none."""
        texts = [t or "" for t in texts]
        out = []
        for a, b in tv.chunks(texts):
            rows, cut = self.rows(texts[a:b])
            ids, ends = self.cache.gather(rows)
            ids = ids.astype("<u4")
            cut = ends[cut].tolist()
            out += [ids[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return out

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        return [self.tokens.get(i, "").encode() for i in range(max(self.tokens) + 1)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the file names no decoder, so tokens joined by spaces."""
        token = self.token_bytes
        return b" ".join([token[i] for i in ids.tolist()])


def load(path: str) -> RankBpe:
    """The worker's encoder for a vocabulary file."""
    return loaded(RankBpe, path)
