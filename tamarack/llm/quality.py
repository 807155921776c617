"""Quality rules (operator 2): counting rules and n-gram perplexity bands by language.

The language model is a modified Kneser-Ney model over the code points of a text, white
space being one gap, of order ``ORDER``.  No alphabet is fixed and nothing is folded: an
n-gram is known by 64 bits of hash, and the model has as many n-grams as the corpus.  Spark
counts the n-grams of running prose (texts that pass the counting rules and are nearly all
letters; junk must not teach the model junk), and derives discounts, backoff weights and
probabilities by joins.

Texts are dealt by a hash of their words into ``FOLDS`` parts, and a text is judged by the
model of the other parts: neither it nor its copies have taught the model which judges it,
so a perplexity means the same for prose and for texts which aren't the model's.

The model is stored as sorted arrays of hashes with whole numbers beside them, in slices of
at most ``SLICE`` n-grams, chosen by the two code points before the one foretold.  All that
one place of a text asks for, backing off included, is in one slice; texts are read once for
each slice, and their sums, being of whole numbers, are the same however many slices there
are.  A text is rejected if its mean negative log probability lies outside the band of its
language, which comes from the quartiles of the model's texts.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import discard, durable, fresh, map_arrow, pieces, read, release

ORDER, FOLDS = 4, 2
#: N-grams and contexts of one slice of the model: 12 bytes each at every worker.
SLICE = 8_000_000
#: Log probabilities are whole numbers of such parts of a nat.
UNIT = 1 << 20
#: The log probability of a code point of which nothing is known.
EVEN = -round(float(np.log(0x110000)) * UNIT)
#: A band reaches so many interquartile ranges below and above the median, and further for
#: texts of few symbols: by the factor sqrt(1 + SHORT / symbols).  It reaches further up,
#: since sound texts may quote another language.
BELOW, ABOVE, SHORT = 5.0, 9.0, 500.0
#: Quartiles are read from a histogram with bins of this width, so a language has some
#: thousands of them however many texts it has.
BIN = 1e-3
#: The symbols counted as such by the rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Running prose has at least this share of letters and digits among its visible code
#: points, and at most this share of capitals.
PROSE_PERCENT, CAPITAL_PERCENT = 92, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GAP = 32
#: Bytes of text which a task works on at once (more where one text has more).
PIECE = 1 << 18
#: N-grams which a task holds before it passes them on.
HELD = 1_000_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ``ORDER - 1`` gaps; the first window and the number of windows of each.

    Runs of white space are one gap, and a gap ends each text, so every text has a window.
    """
    cp = tv.to_codepoints(" ".join(texts) + " ")
    gap = (tv.class_table()[cp] == tv.SPACE) | (cp == 0)
    ends = np.cumsum([len(t) + 1 for t in texts])
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[ends[:-1]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    size = np.diff(np.concatenate([[0], total[ends]]))
    at = np.cumsum(size) - size + np.arange(len(texts)) * (ORDER - 1)
    out = np.full(int(size.sum()) + len(texts) * (ORDER - 1), GAP, np.uint32)
    out[tv.spans(at + ORDER - 1, size)] = np.where(gap, GAP, cp)[keep]
    return out, at, size


def hashes(symbols: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` symbols from each place on (the last axis, where there are more)."""
    n, values = symbols.shape[-1] - order + 1, tv.char_values()[symbols]
    out = np.zeros((*symbols.shape[:-1], n), np.uint64)
    for i in range(order):
        out *= _STEP
        out += values[..., i : i + n]
    return out


def salt(model: int, lang: str, order: int) -> np.uint64:
    """What tells the n-grams of models, languages and orders apart."""
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{model} {order} {lang}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def salts(groups: list[tuple[int, str]], order: int) -> np.ndarray:
    return np.array([salt(m, x, order) for m, x in groups], np.uint64)


class Windows:
    """The distinct windows of some texts, with the group (model and language) they belong to."""

    def __init__(self, texts: list[str], groups: list[tuple[int, str]]):
        self.groups = list(dict.fromkeys(groups))
        number = {g: i for i, g in enumerate(self.groups)}
        of = np.array([number[g] for g in groups], np.int64)
        self.symbols, begin, self.size = symbols(texts)
        inside = np.ones(len(self.symbols) - ORDER + 1, bool)
        inside[((begin + self.size)[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
        own = hashes(self.symbols, ORDER)[inside]
        own += np.repeat(salts(self.groups, ORDER)[of], self.size)
        own = tv.mix64(own)
        self.place, first = tv.grouped(own)
        self.times, at = tv.times(first, len(own)), self.place[first]
        self.hash = own[at]
        self.group = of[np.searchsorted(np.cumsum(self.size), at, "right")]
        self.rows = np.lib.stride_tricks.sliding_window_view(self.symbols, ORDER)[np.flatnonzero(inside)[at]]


@functools.cache
def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in SYMBOLS]] = True
    return table


def base_counts(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of the counting rules for each text."""
    n = len(texts)
    cp, start, end, word_at = tv.word_spans(texts)
    text_at = np.zeros(n + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=text_at[1:])
    prefix = tv.prefix_hash(tv.char_values()[cp])
    owner = np.repeat(np.arange(n), np.diff(word_at))
    # Windows of three words, told apart by text.
    words = tv.mix64(tv.span_hash(prefix, start, end) + (end - start).astype(np.uint64))
    here = np.flatnonzero(owner[2:] == owner[:-2]) if len(words) > 2 else np.zeros(0, np.int64)
    window = tv.mix64(tv.span_hash(tv.prefix_hash(words), here, here + 3)) + tv.mix64(owner[here] + 1)
    place, first = tv.grouped(window)
    often = tv.times(first, len(window))
    found = here[place[np.repeat(often > 1, often)]]
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[found + i] = True
    # Lines with a word; the blank which joins texts ends the last line of each.
    stop = cp == 10
    stop[text_at[1:] - 1] = True
    line_end = np.flatnonzero(stop)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    line_owner = np.searchsorted(text_at, line_start, "right") - 1
    line_owner = np.where(line_owner >= n, n - 1, line_owner)
    full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    a, b, o = line_start[full], line_end[full], line_owner[full]
    lines = tv.mix64(tv.span_hash(prefix, a, b) + (b - a).astype(np.uint64)) + tv.mix64(o + 1)
    _, first = np.unique(lines, return_index=True)
    return {
        "n_words": np.diff(word_at),
        "word_chars": tv.sums(end - start, word_at),
        "n_symbols": tv.sums(_symbol_table()[cp], text_at),
        "n_dup_lines": np.bincount(o, minlength=n) - np.bincount(o[first], minlength=n),
        "n_repeat_words": tv.sums(covered, word_at),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * n)


@functools.cache
def _capital_table() -> np.ndarray:
    return tv.lower_table() != np.arange(0x110000)


def prose(texts: list[str]) -> np.ndarray:
    """Whether each text is nearly all letters and digits, and mostly small ones."""
    cp = tv.to_codepoints(" ".join(texts) + " ")
    kind, at = tv.class_table()[cp], np.cumsum([0, *[len(t) + 1 for t in texts]])
    wordlike = (kind == tv.LETTER) | (kind == tv.NUMBER)
    visible, letters, capitals = (tv.sums(x, at) for x in (kind != tv.SPACE, wordlike, _capital_table()[cp]))
    return (100 * letters >= PROSE_PERCENT * visible) & (100 * capitals <= CAPITAL_PERCENT * letters)


def _group_names(models, langs) -> list[tuple[int, str]]:
    return [(m, x or "") for m, x in zip(models.to_pylist(), langs.to_pylist(), strict=True)]


def _fold(text: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(FOLDS)).cast("int")


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """model, lang, gram, n: how often each n-gram of the highest order occurs in the texts of each model.

    A text's fold is the model which judges it; it teaches all the others.  Each task adds up
    what it has read before rows leave it, some millions at a time.
    """

    def run(batches):
        import pyarrow as pa

        parts: list[tuple] = []
        names: dict[tuple[int, str], int] = {}

        def merged():
            key, group, rows, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            place, first = tv.grouped(key)
            at = place[first]
            return key[at], group[at], rows[at], np.add.reduceat(n[place], first)

        def emitted(key, group, rows, n):
            every = list(names)
            # Alike n-grams side by side, as far as 12 bits of a symbol tell them, make small files.
            alike = group.astype(np.uint64)
            for i in range(ORDER):
                alike = alike << np.uint64(12) | rows[:, i].astype(np.uint64) & np.uint64(0xFFF)
            order = np.argsort(alike)
            for i in range(0, len(order), 100_000):
                part = order[i : i + 100_000]
                grams = np.ascontiguousarray(rows[part]).view(f"<U{ORDER}").ravel()
                of = pa.array(group[part])
                columns = [pa.array([g[0] for g in every], pa.int32()).take(of), pa.array([g[1] for g in every], pa.string()).take(of), pa.array(grams.tolist(), pa.string()), pa.array(n[part])]
                yield pa.RecordBatch.from_arrays(columns, names=["model", "lang", "gram", "n"])

        for batch in batches:
            for a, b in pieces(batch, 2 * PIECE):
                part = batch.slice(a, b - a)
                texts = part.column(2).to_pylist()
                taken = np.flatnonzero(~base_failed(base_counts(texts)) & prose(texts))
                if not len(taken):
                    continue
                groups = _group_names(part.column(0), part.column(1))
                found = Windows([texts[i] for i in taken], [groups[i] for i in taken])
                number = np.array([names.setdefault(g, len(names)) for g in found.groups])
                parts.append((found.hash, number[found.group].astype(np.int32), found.rows, found.times))
                del found
                if sum(len(p[0]) for p in parts) > HELD:
                    parts[:] = [merged()]
                    if 4 * len(parts[0][0]) > 3 * HELD:
                        yield from emitted(*parts.pop())
        if parts:
            yield from emitted(*merged())

    rows = docs.select(_fold(text_col).alias("model"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = map_arrow(rows, run, "model int, lang string, gram string, n bigint")
    if FOLDS == 2:
        counts = counts.withColumn("model", 1 - F.col("model"))
    else:
        others = F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda m: m != F.col("model"))
        counts = counts.withColumn("model", F.explode(others))
    return counts.groupBy("model", "lang", "gram").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> DataFrame:
    """model, lang, gram, logp, logb of every n-gram of every order, by modified Kneser-Ney.

    ``logp`` is the interpolated log probability of the n-gram's last symbol after the others
    (null for a context which is no n-gram itself, such as the gaps before a text); ``logb``
    is the log of the weight left to shorter contexts where the n-gram is the context (0 where
    nothing follows it).  Both are in units.  The empty gram is the even distribution.
    """
    levels = [durable(counts)]
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[-1].groupBy("model", "lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        levels.append(durable(shorter) if k > 3 else shorter)  # the shortest are few and cheaply made again
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    grams = grams.withColumn("k", F.length("gram"))
    # One small row a model, language and order; written, so that Spark knows its size and sends it if it is small.
    seen = durable(grams.groupBy("model", "lang", "k").agg(*[F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)]))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usual = F.least("n1", "n2", "n3") > 0
    # Where counts of counts are missing (few texts), half a count is taken from each.
    taken = [F.when(usual, F.greatest(F.lit(0.1), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).otherwise(0.5).alias(f"d{i}") for i in (1, 2, 3)]
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    grams = grams.join(seen.select("model", "lang", "k", *taken), ["model", "lang", "k"])
    grams = grams.select("model", "lang", "k", "gram", F.expr("substring(gram, 1, k - 1)").alias("context"), "n", F.least(less, F.col("n") * 0.9).alias("d"))
    total = durable(grams.groupBy("model", "lang", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("left")))
    own = durable(grams.join(total, ["model", "lang", "context"]).select("model", "lang", "k", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"), "left"))
    of = lambda k: own.filter(F.col("k") == k)
    probs = [of(1).select("model", "lang", "gram", (F.col("own") + F.col("left") / 0x110000).alias("p"))]
    for k in range(2, ORDER + 1):
        shorter = probs[-1].select("model", "lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
        longer = of(k).withColumn("suffix", F.expr("substring(gram, 2)")).join(shorter, ["model", "lang", "suffix"])
        longer = longer.select("model", "lang", "gram", (F.col("own") + F.col("left") * F.col("q")).alias("p"))
        probs.append(durable(longer) if 3 <= k < ORDER else longer)
    every = probs[0]
    for p in probs[1:]:
        every = every.unionByName(p)
    weights = total.select("model", "lang", F.col("context").alias("gram"), "left")
    whole = lambda c: F.round(F.log(c) * UNIT).cast("int")
    logp = F.when(F.col("gram") == "", F.lit(EVEN)).otherwise(whole("p"))
    out = durable(every.join(weights, ["model", "lang", "gram"], "full").select("model", "lang", "gram", logp.alias("logp"), F.coalesce(whole("left"), F.lit(0)).alias("logb")))
    discard(*levels, seen, total, own, *probs)
    return out


class Sorted:
    """A sorted array of hashes with a number beside each.

    Hashes are even, so their upper bits say nearly where one stands: an index by them leaves
    a few neighbours to compare.
    """

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        order = np.argsort(hashes)
        self.keys, self.numbers = hashes[order], numbers[order]

    @functools.cached_property
    def index(self) -> np.ndarray:
        """Where the hashes of each value of the upper bits begin; made by the worker."""
        bits = max(1, len(self.keys).bit_length())
        return np.searchsorted(self.keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its number or 0."""
        hit, out = np.zeros(len(ask), bool), np.zeros(len(ask), np.int64)
        if not len(self.keys):
            return hit, out
        upper = (ask >> np.uint64(64 - max(1, len(self.keys).bit_length()))).astype(np.int64)
        at, end = self.index[upper], self.index[upper + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            here = at[todo]
            key, want = self.keys[here], ask[todo]
            same = key == want
            found = todo[same]
            hit[found], out[found] = True, self.numbers[here[same]]
            at[todo] += 1
            todo = todo[(key < want) & (here + 1 < end[todo])]
        return hit, out

    def __getstate__(self):
        return {"keys": self.keys, "numbers": self.numbers}


class Arrays:
    """One slice of the model: sorted hashes of n-grams and of contexts, each with its numbers."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], number: int = 0, slices: int = 1):
        self.grams, self.contexts = Sorted(*grams), Sorted(*contexts)
        self.number, self.slices = number, slices

    def logp(self, rows: np.ndarray, group: np.ndarray, groups: list[tuple[int, str]]) -> np.ndarray:
        """Log probability, in units, of the last symbol of each row of symbols, backing off where it is unknown.

        Rows of other slices count 0.
        """
        out = np.zeros(len(rows), np.int64)
        ask = np.arange(len(rows)) if self.slices == 1 else np.flatnonzero(which(rows[:, -3:-1], self.slices) == self.number)
        for k in range(ORDER, -1, -1):
            part, of = rows[ask], group[ask]
            own = tv.mix64(hashes(part[:, ORDER - k :], k)[:, 0] + salts(groups, k)[of])
            hit, value = self.grams.find(own)
            out[ask] += value
            ask, part, of = ask[~hit], part[~hit], of[~hit]
            if not len(ask):
                break
            if k == 0:
                out[ask] += EVEN
                break
            context = tv.mix64(hashes(part[:, ORDER - k : -1], k - 1)[:, 0] + salts(groups, k - 1)[of])
            out[ask] += self.contexts.find(context)[1]
        return out

    def sums(self, texts: list[str], groups: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the negative log probabilities of each text's symbols, in units, and how many it has."""
        found = Windows(texts, groups)
        value = self.logp(found.rows, found.group, found.groups)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), found.size)[found.place]
        # Whole numbers far below 2**53, so that doubles add them up exactly.
        total = np.bincount(owner, np.repeat(value, found.times), len(texts))
        return -total.astype(np.int64), found.size


def which(two: np.ndarray, slices: int) -> np.ndarray:
    """The slice of the n-grams whose last symbol follows these two."""
    return (tv.mix64(hashes(two, 2)[:, 0]) % np.uint64(slices)).astype(np.int64)


def arrays(model: DataFrame, slices: int) -> DataFrame:
    """slice, kind, hashes, numbers: the model's n-grams (kind 0) and contexts (kind 1) as packed arrays.

    What is too short to name two symbols before the foretold one belongs to all slices.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            groups = _group_names(batch.column(0), batch.column(1))
            every = list(dict.fromkeys(groups))
            number = {g: i for i, g in enumerate(every)}
            of = np.array([number[g] for g in groups], np.int64)
            grams = batch.column(2).to_pylist()
            size = np.array([len(g) for g in grams])
            has = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            logp = batch.column(3).fill_null(0).to_numpy()
            logb = batch.column(4).to_numpy()
            out: list[tuple] = []
            for k in range(ORDER + 1):
                at = np.flatnonzero(size == k)
                if not len(at):
                    continue
                rows = tv.to_codepoints("".join([grams[i] for i in at.tolist()])).reshape(len(at), k)
                own = tv.mix64(hashes(rows, k)[:, 0] + salts(every, k)[of[at]])
                for kind, value, wanted, before in ((0, logp, has[at], rows[:, -3:-1]), (1, logb, logb[at] != 0, rows[:, -2:])):
                    place = which(before, slices) if before.shape[1] == 2 else None
                    for s in range(slices):
                        here = np.flatnonzero(wanted if place is None else wanted & (place == s))
                        if len(here):
                            out.append((s, kind, own[here].astype("<u8").tobytes(), value[at[here]].astype("<i4").tobytes()))
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["slice", "kind", "hashes", "numbers"])

    return map_arrow(model.select("model", "lang", "gram", "logp", "logb"), run, "slice int, kind int, hashes binary, numbers binary")


def load_slice(packed: DataFrame, number: int, slices: int) -> Arrays:
    """One slice of the model on the driver: at most about ``SLICE`` n-grams, 12 bytes each."""
    rows = packed.filter(F.col("slice") == number).toArrow()
    kind = rows.column("kind").to_numpy()
    tables = []
    for k in (0, 1):
        at = np.flatnonzero(kind == k).tolist()
        parts = [np.concatenate([np.zeros(0, t), *[np.frombuffer(rows.column(c)[i].as_buffer(), t) for i in at]]) for c, t in (("hashes", "<u8"), ("numbers", "<i4"))]
        tables.append(tuple(parts))
    return Arrays(*tables, number, slices)


def score(docs: DataFrame, model: DataFrame, name: str, text_col: str, lang_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of the table, written, with a struct ``name``: lang, the rules' counts, base_failed, prose, sum and size of each text."""
    spark = docs.sparkSession
    slices = max(1, -(-model.count() // SLICE))
    packed = durable(arrays(model, slices))
    fields = [T.StructField("lang", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTS]]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("prose", T.BooleanType()), T.StructField("sum", T.LongType()), T.StructField("size", T.LongType())]
    stats = T.StructType(fields)
    row, fold, lang, text = (fresh(docs, c) for c in ("__row", "__fold", "__lang", "__text"))

    def summed(rows: DataFrame, number: int, keep: list[str]) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(load_slice(packed, number, slices))
        release()
        width = len(keep)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for a, b in pieces(batch, PIECE):
                    part = batch.slice(a, b - a)
                    texts = part.column(width + 2).to_pylist()
                    groups = _group_names(part.column(width), part.column(width + 1))
                    total, size = sent.value.sums(texts, groups)
                    base = base_counts(texts)
                    columns = [pa.array([g[1] for g in groups], pa.string()), *[pa.array(base[c], pa.int64()) for c in COUNTS], pa.array(base_failed(base)), pa.array(prose(texts)), pa.array(total), pa.array(size)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.StructArray.from_arrays(columns, names=[f.name for f in fields])], names=[*keep, name])

        rows = rows.select(*keep, _fold(text_col).alias(fold), F.coalesce(F.col(lang_col), F.lit("")).alias(lang), F.coalesce(F.col(text_col), F.lit("")).alias(text))
        schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField(name, stats)])
        return durable(map_arrow(rows, run, schema)), sent

    if slices == 1:
        out, sent = summed(docs, 0, keep)
        sent.destroy()
    else:
        # Rows are numbered once and written: their numbers must hold for all slices.
        numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
        parts = []
        for s in range(slices):
            part, sent = summed(numbered, s, [row])
            sent.destroy()
            parts.append(part)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        first = {f.name: F.max(F.col(f"{name}.{f.name}")).alias(f.name) for f in fields} | {"sum": F.sum(F.col(f"{name}.sum")).alias("sum")}
        facts = every.groupBy(row).agg(*first.values())
        facts = facts.select(row, F.struct(*[f.name for f in fields]).alias(name))
        out = durable(numbered.join(facts, row).select(*keep, name))
        discard(numbered, *parts)
    discard(packed)
    return out


def entropy(name: str) -> Column:
    return F.col(f"{name}.sum") / F.col(f"{name}.size") / UNIT


def fit_bands(scored: DataFrame, name: str) -> DataFrame:
    """lang, middle, spread: median and interquartile range of the model's texts.

    They are read from a histogram, so all texts count and none moves.  A range narrower
    than ten bins (a language of copies) is widened to that.
    """
    ours = ~F.col(f"{name}.base_failed") & F.col(f"{name}.prose")
    bins = scored.filter(ours).groupBy(F.col(f"{name}.lang").alias("lang"), F.floor(entropy(name) / BIN).alias("bin")).agg(F.count("*").alias("n"))
    table = bins.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("all"))

    def q(share: float) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("bin"))
        step = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.when(a["bin"].isNull() & (a["n"] + b["n"] >= F.col("all") * share), b["bin"]).otherwise(a["bin"]).alias("bin"))
        return F.aggregate("bins", start, step, lambda a: a["bin"] * BIN)

    return durable(table.select("lang", q(0.5).alias("middle"), F.greatest(q(0.75) - q(0.25), F.lit(10 * BIN)).alias("spread")))


def judge(scored: DataFrame, bands: DataFrame, name: str) -> DataFrame:
    """Adds kept, perplexity, and its lower and upper bound to the struct column."""
    own = fresh(scored, "__band")
    reach = F.col(f"{own}.spread") * F.sqrt(1 + SHORT / F.col(f"{name}.size"))
    low, high = F.col(f"{own}.middle") - BELOW * reach, F.col(f"{own}.middle") + ABOVE * reach
    inside = F.coalesce(entropy(name).between(low, high), F.lit(True))
    joined = scored.join(bands.select(F.struct("*").alias(own)), F.col(f"{name}.lang") == F.col(f"{own}.lang"), "left")
    verdict = {"kept": ~F.col(f"{name}.base_failed") & inside, "perplexity": F.exp(entropy(name)), "lower": F.exp(low), "upper": F.exp(high)}
    stats = F.col(name)
    for key, value in verdict.items():
        stats = stats.withField(key, value)
    return joined.withColumn(name, stats).drop(own)


def _judged(docs: DataFrame, name: str, text_col: str, lang_col: str, keep: list[str]) -> DataFrame:
    model = fit(count_grams(docs, text_col, lang_col))
    scored = score(docs, model, name, text_col, lang_col, keep)
    discard(model)
    return judge(scored, fit_bands(scored, name), name)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The verdict on each text, by models and bands fitted on the prose among them.

    One row per input row, repeated rows included.  A null text counts as empty and fails the
    counting rules; a null language is a language of its own; one without prose has no band
    and loses nothing to it; very long texts are read whole; an empty table gives an empty
    table; other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    done = _judged(texts, "v", "text", "lang", ["key"])
    return done.select(F.col("key").alias(id_col), *[F.col(f"v.{c}") for c in (*COUNTS, "base_failed", "kept", "perplexity", "lower", "upper")])


def keep_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of the table that pass, with all their columns, whatever these are called.

    Rows are written once with their figures, so that no text is scored again for the verdict.
    """
    name = fresh(docs, "__verdict")
    return _judged(docs, name, text_col, lang_col, docs.columns).filter(F.col(f"{name}.kept")).select(docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))
