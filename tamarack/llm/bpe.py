"""BPE encoding and decoding of whole texts (operator 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import map_batches, read, tokenizer_path
from .rank_bpe import load

WORD_BPE = "word_bpe_49k.json"


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = WORD_BPE) -> DataFrame:
    """Token ids of each whole text and the text decoded from them.

    Returns ``id_col``, ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and
    ``decoded``.  One row comes back per input row: a null or empty text has no ids and
    decodes to the empty string, equal rows give equal results, a null id stays null, other
    columns are not read, and an empty table gives an empty table.  Texts of any length are
    encoded whole; words of more than a few hundred bytes go through a heap.
    """

    def fn(keys, texts):
        coder = load(tokenizer_path(vocab))
        texts = [t or "" for t in texts]
        for a, b in tv.chunks(texts):
            ids = coder.encode_batch(texts[a:b])
            yield {"key": keys[a:b], "ids": [x.tobytes() for x in ids], "n_tokens": list(map(len, ids)), "decoded": [coder.decode(x).decode() for x in ids]}

    kind = dict(df.dtypes)[id_col]
    out = map_batches(df.select(F.col(id_col), F.col(text_col)), fn, f"key {kind}, ids binary, n_tokens bigint, decoded string")
    return out.withColumnRenamed("key", id_col)


def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    done = encode_documents(read(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
