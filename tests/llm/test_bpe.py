import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tamarack.llm.bpe import encode_documents
from tamarack.llm.rank_bpe import LONG, load

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_whole_texts_as_the_library(spark, make, odd_texts, library):
    rows = encode_documents(make(odd_texts)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(odd_texts)))
    for r in rows:
        ids = library.encode(odd_texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        assert r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_random_strings(library):
    rng = random.Random(3)
    pieces = ["'s", "'re", "'", "A", "é", "é", "Σ", "5", " ", "\n", " ", "\u0085", "\x1c", "<|startoftext|>", "<|", "...", "ſ", "ß", "字", "\U0001f600", "the", "ing"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    got = load(PATH).encode_batch(texts)
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text


def test_long_words_use_the_heap(library):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abeinrst") for _ in range(n)) for n in (LONG - 1, LONG, LONG + 1, 5000)]
    for text, ids in zip(texts, load(PATH).encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_empty_table_and_null_id(spark, make):
    assert encode_documents(make([])).count() == 0
    assert encode_documents(make(["a"], ids=[None])).collect()[0]["doc_id"] is None


def test_decoding_digest(spark, make, library):
    row = encode_documents(make(["Hello there"])).collect()[0]
    assert hashlib.sha256(row["decoded"].encode()).hexdigest() == hashlib.sha256(b"hello</w> there</w>").hexdigest()
