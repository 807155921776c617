"""Threshold-scaled document fingerprints (operator 6).

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size
follows the text's, the union of two sketches is the sketch of both texts, and the part of
one sketch found in another estimates containment however unequal the texts are.  A text
whose hashes all lie above the threshold keeps its least one; only a text without words
has an empty sketch.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import map_arrow, read, shuffle_width

#: One of so many hashes is kept.
SCALE = 8
WIDTH = 5


def sketch_batch(texts: list[str], scale: int = SCALE, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct kept hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in tv.chunks(texts):
        hashes, at = tv.shingles(texts[a:b], width)
        keep = np.flatnonzero(hashes < np.uint64((1 << 64) // scale))
        cut = np.searchsorted(keep, at)
        for x, y, i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            out.append(np.unique(hashes[keep[x:y]]) if y > x else hashes[i:j].min(keepdims=True) if j > i else hashes[:0])
    return out


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    low = both[both < np.uint64((1 << 64) // scale)]
    return low if len(low) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles which the second has; 0 for an empty text."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two texts without words are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def edited(text: str, after: str) -> str:
    """The text whose last half is replaced by as much of the next one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_next(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Rows dealt into ranges of ids, each range sorted and followed by the next one's first row.

    Ranges come from percentiles of the ids and their first ids (some hundred numbers are
    all that reaches the driver); texts are shuffled once.  Columns: part, look (whether the
    row is only there to be looked at), key, text.
    """
    spark = df.sparkSession
    parts = min(1024, 4 * shuffle_width(spark))
    rows = df.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10_000).alias("c")).head()["c"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    array = lambda xs: F.array(*[F.lit(x).cast(kind) for x in xs]) if xs else F.array().cast(f"array<{kind}>")
    part = F.coalesce(F.size(F.filter(array(cuts), lambda x: x <= F.col("key"))), F.lit(0))
    rows = rows.withColumn("part", part)
    first = {r["part"]: r["k"] for r in rows.groupBy("part").agg(F.min(F.struct("key")).alias("k")).collect()}
    order = sorted(first)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    firsts = array([first[p]["key"] if p in first else None for p in range(len(cuts) + 1)])
    prior = F.array(*[F.lit(before.get(p, 0)) for p in range(len(cuts) + 1)])
    place = lambda p, look: F.struct(p.alias("part"), F.lit(look).alias("look"))
    here = place(F.col("part"), False)
    is_first = F.col("key").eqNullSafe(F.element_at(firsts, F.col("part") + 1))
    rows = rows.withColumn("at", F.explode(F.when(is_first, F.array(here, place(F.element_at(prior, F.col("part") + 1), True))).otherwise(F.array(here))))
    rows = rows.select("at.part", "at.look", "key", "text").repartition(max(1, shuffle_width(spark)), "part")
    return rows.sortWithinPartitions("part", "look", "key", F.xxhash64("text")), kind


def fingerprints_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    One row per input row.  A null text counts as empty; an empty text has an empty
    fingerprint; rows with equal ids follow each other by a hash of their texts, null ids
    come first; the only row of a table follows itself; an empty table gives an empty one.
    Besides the contract's columns: contained_edited and contained_next, the share of the
    text's shingles found in the edited text and in the next one.
    """
    rows, kind = with_next(df, id_col, text_col)
    fields = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in fields.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

        def flush(keys, texts, key_type):
            changed = [edited(t, u) for t, u in zip(texts[:-1], texts[1:], strict=True)]
            plain, other = sketch_batch(texts, scale, width), sketch_batch(changed, scale, width)
            own, nxt = plain[:-1], plain[1:]
            columns = [
                [len(t) for t in texts[:-1]],
                [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                list(map(to_text, own)),
                list(map(to_text, other)),
                list(map(likeness, own, other)),
                list(map(likeness, own, nxt)),
                list(map(containment, own, other)),
                list(map(containment, own, nxt)),
            ]
            return pa.RecordBatch.from_arrays([pa.array(keys[:-1], key_type), *map(pa.array, columns, types)], names=["key", *names])

        part, keys, texts, size, closed, key_type = None, [], [], 0, False, None
        for batch in batches:
            key_type = batch.column(2).type
            for p, look, key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != part:
                    if len(texts) > 1:
                        yield flush(keys, texts, key_type)
                    part, keys, texts, size, closed = p, [], [], 0, False
                if closed:
                    continue
                keys.append(key)
                texts.append(text)
                size += len(text)
                closed = look
                if size > tv.CHUNK and len(texts) > 1:
                    yield flush(keys, texts, key_type)
                    keys, texts, size = keys[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield flush(keys, texts, key_type)

    return map_arrow(rows, run, f"key {kind}, {fields}").withColumnRenamed("key", id_col)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(read(spark, sf_dir, "documents"))
