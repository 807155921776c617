"""Exact token counts at every prefix of a text, by dynamic programming (operator 5).

A sequence of pieces is the encoding of a text exactly if each two neighbours stay apart
when the two are encoded alone.  So the encoding of a prefix is known from its last piece:
the one piece that ends there and may follow the last piece of the prefix before it.  The
table of last pieces and counts is filled once from left to right, and then holds the
count of every prefix; cutting a text to a budget needs no second encoding.

Merges never cross a place whose two characters stand side by side in no piece, so texts
are split there into units (a word with the space before it, mostly).  The table is filled
for many new units at once, and units seen before are looked up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import loaded, map_batches, read, tokenizer_path

PIECE_BPE = "piece_bpe_32k.model"
LIMIT = 4096
SPACE_MARK = 0x2581
#: Units longer than this are walked one by one instead of side by side.
LONG = 64
_NEVER = np.int64(1) << 40


class PrefixCounter:
    """Counts by the pieces of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kept = [(p.piece, p.score) for p in model.pieces if p.type == p.NORMAL]
        inside = set("".join(p for p, _ in kept)) - {p for p, _ in kept}
        kept += [(c, 0.0) for c in sorted(inside)]  # no piece of their own: bytes, if they stay alone
        self.names = [p for p, _ in kept]
        score = np.array([s for _, s in kept])
        self.size = np.array([len(p) for p in self.names], np.int64)
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        self.hash = self._hashes(self.names)
        self.number = {p: i for i, p in enumerate(self.names)}
        self.cost = np.array([len(p.encode()) if p in inside else 1 for p in self.names], np.int32)
        self._derive()
        usable = np.flatnonzero(self.time < _NEVER)
        self.table = tv.HashTable(self._key(self.hash[usable], self.size[usable]), usable)
        self.every = tv.HashTable(self._key(self.hash, self.size), np.arange(len(self.names)))
        self.longest = int(self.size[usable].max())
        self.runs = np.array([p.strip(chr(SPACE_MARK)) == "" for p in self.names])
        # Pieces of marks alone share one score, which the rule for borders can't order.
        widest = range(1, int(self.size[self.runs].max(initial=1)) + 1)
        merge = lambda n: [len(x) for x in self._merge(chr(SPACE_MARK) * n)[0]]
        self.run_apart = np.array([[False] + [merge(a + b) == [a, b] for b in widest] for a in [0, *widest]])
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for p in self.names if len(p) == 1]] = True
        self.joins = np.zeros(0x110000, bool)
        beside = {p[i : i + 2] for p in self.names for i in range(len(p) - 1)}
        self.joins[[ord(c) for c in set("".join(beside))]] = True
        self.letter = tv.class_table() == tv.LETTER
        pairs = np.array([[ord(a), ord(b)] for a, b in beside], np.uint64)
        self.beside = tv.HashTable(pairs[:, 0] << np.uint64(32) | pairs[:, 1], np.ones(len(pairs)))
        self.pair_key, self.pair_ok = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, bool)
        self.cache = tv.WordCache(600_000)

    @staticmethod
    def _hashes(names: list[str]) -> np.ndarray:
        cp = tv.to_codepoints("".join(names))
        ends = np.cumsum([len(p) for p in names])
        return tv.span_hash(tv.prefix_hash(tv.char_values()[cp]), ends - [len(p) for p in names], ends)

    @staticmethod
    def _key(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
        return hashes + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def _derive(self) -> None:
        """For each piece, the last merge which makes it, and when; never, if none does."""
        n = len(self.names)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.time = np.full(n, _NEVER)
        for i, name in enumerate(self.names):
            parts, last, time = self._merge(name)
            if len(parts) == 1:
                self.time[i] = time
                self.left[i], self.right[i] = (self.number[x] for x in last or (name, name))

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None, int]:
        """Merges the characters of a short text: the parts, the last merge and its time."""
        parts, last, time = list(text), None, -1
        while len(parts) > 1:
            found = [(self.rank[self.number[x]], k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in self.number]
            if not found:
                break
            rank, k = min(found)
            last, time = (parts[k], parts[k + 1]), max(time, int(rank))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, last, time

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece ``b`` may follow ``a``: undoes their merges, the latest first, and
        asks each time if the two at the border would have been merged before."""
        ok = np.ones(len(a), bool)
        runs = self.runs[a] & self.runs[b]
        ok[runs] = self.run_apart[self.size[a[runs]], self.size[b[runs]]]
        live = np.flatnonzero(~runs)
        a, b = a[live].copy(), b[live].copy()
        after_a, after_b = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(live):
            up, _ = tv.powers(self.longest + 1)
            both = self.every.get(self._key(self.hash[a] + up[self.size[a]] * self.hash[b], self.size[a] + self.size[b]))
            rank = np.where(both >= 0, self.rank[both], _NEVER)
            bad = (rank < after_a) & (rank <= after_b) & (both >= 0)
            ok[live[bad]] = False
            go = ~bad & ((self.time[a] >= 0) | (self.time[b] >= 0))
            live, a, b, after_a, after_b = live[go], a[go], b[go], after_a[go], after_b[go]
            undo = self.time[a] > self.time[b]
            after_a, after_b = np.where(undo, self.time[a], after_a), np.where(undo, after_b, self.time[b])
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return ok

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_apart`` through a direct-mapped memory of pairs."""
        key = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1)
        slot = ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)
        out = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_key[slot] != key)
        if len(miss):
            uniq, back = np.unique(key[miss], return_inverse=True)
            pair = uniq - np.uint64(1)
            ok = self._apart((pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64))
            out[miss] = ok[back]
            self.pair_key[slot[miss]], self.pair_ok[slot[miss]] = key[miss], out[miss]
            # Two keys of one slot in one call: only the last stays, with its own answer.
            self.pair_ok[slot[miss]] = out[miss]
        return out

    def fill(self, prefix: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts at every prefix of the units, end to end, and the units' sizes."""
        base = np.cumsum(size) - size
        count = np.zeros(int(size.sum()), np.int32)
        last = np.full(len(count), -1, np.int32)
        order = np.argsort(-size, kind="stable")
        step = int(size.max(initial=0))
        ordered = size[order]
        for i in range(1, step + 1):
            live = order[: np.searchsorted(-ordered, -i, "right")]
            for k in range(1, min(i, self.longest) + 1):
                if not len(live):
                    break
                end = start[live] + i
                piece = self.table.get(self._key(tv.span_hash(prefix, end - k, end), np.full(len(live), k)))
                has = np.flatnonzero(piece >= 0)
                if len(has) and i > k:
                    at = base[live[has]] + i - k - 1
                    has = has[self.follows(last[at], piece[has])]
                if len(has):
                    at = base[live[has]] + i - 1
                    last[at] = piece[has]
                    count[at] = self.cost[piece[has]] + (count[at - k] if i > k else 0)
                    live = np.delete(live, has)
        return count, size

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the marked texts (each with a mark before it), unit and text borders."""
        cp = tv.to_codepoints("".join([" " + t for t in texts])).copy()
        cp[cp == 32] = SPACE_MARK
        text_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=text_at[1:])
        new = np.zeros(len(cp) + 1, bool)
        new[text_at] = True
        joins = self.joins[cp]
        new[1:-1] |= ~(joins[1:] & joins[:-1])
        letter = self.letter[cp]
        ask = np.flatnonzero(~new[1:-1] & ~(letter[1:] & letter[:-1])) + 1
        if len(ask):
            pair = cp[ask - 1].astype(np.uint64) << np.uint64(32) | cp[ask]
            new[ask] = self.beside.get(pair) < 0
        return cp, np.flatnonzero(new[:-1]), np.flatnonzero(new), text_at

    def rows(self, texts: list[str]):
        """Cache row of each unit of the texts, the units' borders and the texts' borders."""
        cp, start, borders, text_at = self.units(texts)
        size = np.diff(borders)
        prefix = tv.prefix_hash(tv.char_values()[cp])
        hashes = tv.mix64(tv.span_hash(prefix, start, start + size) + size.astype(np.uint64))

        def compute(first: np.ndarray):
            begin, n = start[first], size[first]
            lone = (n == 1) & ~self.known[cp[begin]]
            short = np.flatnonzero(~lone & (n <= LONG))
            base = np.cumsum(n) - n
            out = np.zeros(int(n.sum()), np.int32)
            out[base[lone]] = np.diff(tv.utf8_ends(cp[begin[lone]]))
            out[tv.spans(base[short], n[short])] = self.fill(prefix, begin[short], n[short])[0]
            for i in np.flatnonzero(~lone & (n > LONG)):
                out[base[i] : base[i] + n[i]] = self.walk(cp[begin[i] : begin[i] + n[i]])
            return out, n

        return self.cache.lookup(hashes, compute), borders, text_at

    def walk(self, cp: np.ndarray) -> np.ndarray:
        """Counts at every prefix of one long unit."""
        text = cp.tobytes().decode("utf-32-le", "surrogatepass")
        count, last, apart = np.zeros(len(text), np.int32), [0] * len(text), {}
        for i in range(1, len(text) + 1):
            for k in range(1, min(i, self.longest) + 1):
                piece = self.number.get(text[i - k : i])
                if piece is None or self.time[piece] == _NEVER:
                    continue
                if i > k:
                    pair = (last[i - k - 1], piece)
                    if pair not in apart:
                        apart[pair] = bool(self.follows(*(np.array([x]) for x in pair))[0])
                    if not apart[pair]:
                        continue
                last[i - 1] = piece
                count[i - 1] = self.cost[piece] + (count[i - k - 1] if i > k else 0)
                break
        return count

    def count_batch(self, texts: list[str], limit: int) -> tuple[list[int], list[int]]:
        """Tokens of each text, and code points of its longest prefix of at most ``limit`` tokens."""
        totals: list[int] = []
        fits: list[int] = []
        for a, b in tv.chunks(texts):
            rows, borders, text_at = self.rows(texts[a:b])
            last = self.cache.flat[self.cache.start[rows] + self.cache.size[rows] - 1]
            before = np.zeros(len(rows) + 1, np.int64)
            np.cumsum(last, out=before[1:])
            unit_at = np.searchsorted(borders, text_at)
            # A mark stands before every text; an empty text has no tokens at all.
            for t, text in enumerate(texts[a:b]):
                x, y = int(unit_at[t]), int(unit_at[t + 1])
                total = int(before[y] - before[x]) if text else 0
                totals.append(total)
                if total <= limit:
                    fits.append(len(text))
                    continue
                counts, ends = self.cache.gather(rows[x:y])
                counts = counts + np.repeat(before[x:y] - before[x], np.diff(ends))
                fits.append(int(np.flatnonzero(np.append(0, counts[1:]) <= limit)[-1]))
        return totals, fits

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of text[:i] for each i from 0 to len(text)."""
        if not text:
            return [0]
        rows, *_ = self.rows([text])
        counts, ends = self.cache.gather(rows)
        whole = self.cache.flat[self.cache.start[rows] + self.cache.size[rows] - 1]
        counts = counts + np.repeat(np.cumsum(whole) - whole, np.diff(ends))
        return [0, *counts[1:].tolist()]


def load(path: str) -> PrefixCounter:
    """The worker's counter for a vocabulary file."""
    return loaded(PrefixCounter, path)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = PIECE_BPE, limit: int = LIMIT) -> DataFrame:
    """Exact token count of each whole text and where it would have to be cut for a budget.

    Returns ``id_col``, n_tokens, over_limit (more than ``limit`` tokens) and fit_chars (code
    points of the longest prefix of at most ``limit`` tokens).  One row per input row, repeated
    rows included; a null or empty text has no tokens; a very long text is counted whole, by a
    table as long as the text; an empty table gives an empty table; a null id stays null; other
    columns are not read, so their names can't clash.
    """

    def fn(keys, texts):
        coder = load(tokenizer_path(model))
        totals, fits = coder.count_batch([t or "" for t in texts], limit)
        yield {"key": keys, "n_tokens": totals, "over_limit": [x > limit for x in totals], "fit_chars": fits}

    kind = dict(df.dtypes)[id_col]
    return map_batches(df.select(id_col, text_col), fn, f"key {kind}, n_tokens bigint, over_limit boolean, fit_chars bigint").withColumnRenamed("key", id_col)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    keyed = docs.select(F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")).alias("k"), "text")
    return token_counts(keyed, "k").select("k.doc_id", "k.n_bytes", "n_tokens", "over_limit", "fit_chars")
