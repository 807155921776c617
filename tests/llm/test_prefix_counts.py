import random

import public_tokenizers
import pytest
import sentencepiece

from tamarack.llm.prefix_counts import load, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_whole_texts_as_the_library(spark, make, odd_texts, library):
    rows = token_counts(make(odd_texts), limit=50).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        text = odd_texts[r["doc_id"]] or ""
        n = len(library.encode(text))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 50)
        if n > 50:
            assert len(library.encode(text[: r["fit_chars"]])) <= 50
        else:
            assert r["fit_chars"] == len(text)


def test_every_prefix(library):
    rng = random.Random(1)
    counter = load(PATH)
    texts = ["".join(rng.choice(counter.names) for _ in range(rng.randint(1, 8))).replace("▁", " ") for _ in range(200)]
    texts += [" " * n + "the" + " " * (n // 2) for n in range(40)] + ["a" * 200, "\n\n x\té\U0001f600 <s> <0x0A>"]
    for text in texts:
        assert counter.prefix_counts(text) == [len(library.encode(text[:k])) for k in range(len(text) + 1)], text


def test_empty_table(make):
    assert token_counts(make([])).count() == 0
