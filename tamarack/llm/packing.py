"""Best-fit packing of documents into sequences of a fixed number of tokens (operator 7)."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .bpe import WORD_BPE
from .common import durable, map_arrow, map_batches, read, shuffle_width, tokenizer_path
from .rank_bpe import load

CAPACITY = 2048
#: Ranges of ids into which the rows of one length are dealt to number them.
DEAL = 64

Pattern = tuple[list[tuple[int, int]], int]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns ``([(length, times), ...], sequences)`` which use every piece once.

    Lengths only matter by their counts, so the plan works on the histogram, which has at
    most ``capacity`` bins whatever the corpus.  First, gaps are filled exactly: the
    complement of each length is looked up among single lengths, then pair sums, then
    triple sums, as far as their counts go.  What is left goes by best fit.
    """
    left = defaultdict(int, {k: v for k, v in counts.items() if v > 0})
    out: list[Pattern] = []
    singles = sum(1 << k for k in left)

    def take(lengths: list[int]) -> bool:
        nonlocal singles
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(left[k] // m for k, m in need.items())
        if not times:
            return False
        out.append((sorted(need.items(), reverse=True), times))
        for k, m in need.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
                singles &= ~(1 << k)
        return True

    def pairs(total: int, most: int):
        """Pairs of lengths with this sum, the longer (at most ``most``) first."""
        x = min(most, total - 1)
        while 2 * x >= total:
            if singles >> x & 1 and singles >> (total - x) & 1:
                yield x, total - x
            x -= 1

    if left[capacity]:
        take([capacity])
    left.pop(capacity, None)
    singles &= ~(1 << capacity)
    for parts in (1, 2, 3):
        sums = 0
        for a in sorted(left, reverse=True):
            gap = capacity - a
            if parts == 1:
                if singles >> gap & 1 and a in left:
                    take([a, gap])
                continue
            if parts == 2:
                for b, c in pairs(gap, gap):
                    if a not in left:
                        break
                    take([a, b, c])
                continue
            if a not in left:
                continue
            sums = 0
            for b in left:
                sums |= singles << b
            for b in sorted((b for b in left if b < gap), reverse=True):
                if a not in left or 3 * b < gap:
                    break
                if sums >> (gap - b) & 1:
                    for c, d in pairs(gap - b, b):
                        if a not in left or b not in left:
                            break
                        take([a, b, c, d])
    return out + best_fit(left, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns by best fit, the longest pieces first: each goes to the fullest open sequence that takes it.

    Sequences with equal gaps are filled together.  A sequence that took a piece is fuller
    than it was, so it takes the next ones of that length too, as long as they fit.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    gaps: list[int] = []
    held: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)

    def put(gap: int, items: tuple[tuple[int, int], ...], times: int) -> None:
        if times:
            if not held[gap]:
                bisect.insort(gaps, gap)
            held[gap].append((items, times))

    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            at = bisect.bisect_left(gaps, k)
            gap = gaps[at] if at < len(gaps) else capacity
            each = gap // k
            if at < len(gaps):
                items, times = held[gap].pop()
                if not held[gap]:
                    gaps.pop(at)
            else:
                items, times = (), -(-n // each)
            full = min(times, n // each)
            n -= full * each
            put(gap - each * k, (*items, (k, each)), full)
            times -= full
            if times and n:
                put(gap - n * k, (*items, (k, n)), 1)
                times, n = times - 1, 0
            if items:
                put(gap, items, times)
    return [(list(items), times) for gap in held for items, times in held[gap]]


def slots(patterns: list[Pattern], capacity: int) -> np.ndarray:
    """Where the pieces of each length go, by their number within the length.

    Rows of (length, first, times, sequence, offset): piece ``r`` >= first of the length,
    below the next row's first, is in sequence ``sequence + (r - first) // times`` at
    ``offset + (r - first) % times * length``.
    """
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for items, count in patterns:
        offset = 0
        for k, m in items:
            rows.append((k, used[k], m, base, offset))
            used[k] += m * count
            offset += k * m
        base += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = WORD_BPE, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of each document: its ids and ``end_id``, cut only where longer than ``capacity``.

    Returns id, piece, start, length and ids_crc32.  A null or empty text is one piece
    holding ``end_id`` alone.
    """

    def fn(keys, texts):
        coder = load(tokenizer_path(vocab))
        texts = [t or "" for t in texts]
        for a, b in tv.chunks(texts):
            out: dict[str, list] = {"key": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for key, ids in zip(keys[a:b], coder.encode_batch(texts[a:b]), strict=True):
                raw = ids.tobytes() + end_id.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for name, x in zip(out, (key, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(x)
            yield out

    kind = dict(df.dtypes)[id_col]
    return map_batches(df.select(id_col, text_col), fn, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("key", id_col)


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of at most ``capacity``.

    Only the histogram of lengths reaches the driver (``capacity`` rows at most).  Pieces of
    one length are dealt into ranges by a hash, numbered within each range, and the counts
    of the ranges before are added, so that a length shared by a third of all pieces is
    numbered by many tasks.  Ties (rows equal in all columns) get different places.
    """
    pieces = durable(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(counts, capacity), capacity)
    deal = DEAL * max(1, shuffle_width(pieces.sparkSession) // DEAL)
    rows = pieces.withColumn("part", F.pmod(F.xxhash64(id_col, "piece"), F.lit(deal)).cast("int"))
    before = (
        rows.groupBy("length", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
        .drop("n")
    )
    one = Window.partitionBy("length", "part").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(one) - 1).join(before, ["length", "part"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("number"))

    def place(batches):
        import pyarrow as pa

        key = table[:, 0] << 40 | table[:, 1]
        for batch in batches:
            size, number = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "number"))
            at = table[np.searchsorted(key, size << 40 | number, "right") - 1]
            beyond = number - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(at[:, 3] + beyond // at[:, 2]), pa.array(at[:, 4] + beyond % at[:, 2] * size)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    kind = dict(pieces.dtypes)[id_col]
    return map_arrow(ranked, place, f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = WORD_BPE, capacity: int = CAPACITY) -> DataFrame:
    """Packs whole documents into as few sequences as exact complements and best fit can.

    One row per piece.  Null and empty texts are pieces of one token; repeated rows are
    packed each for itself; an empty table gives an empty table; other columns aren't read.
    """
    return pack(cut_documents(df, id_col, text_col, vocab, capacity=capacity), id_col, capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
