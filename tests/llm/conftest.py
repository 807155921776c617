import os
import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, key string, sid string, host string"


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with columns whose names clash with inner ones."""

    def build(texts, ids=None):
        rows = [((ids[i] if ids else i), t, "en", "s", None if t is None else len(t), "x", "y", "z", "w") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, repeated, many lines, other scripts, and very long texts."""
    return [None, "", " \t\n ", "word", "word", words(80, 1), words(80, 1), "a\n\nb\na\n", "Ünïcödé İstanbul ΣΑΣ 你好 \U0001f600 é", "x" * 30_000, words(30_000, 2), "it's <|endoftext|> we'll", "1 " * 3000]


@pytest.fixture(scope="session")
def sf_dirs():
    """The folders of test tables that there are, smallest first."""
    found = [p for p in (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1")) if os.path.isdir(p)]
    return found or pytest.skip("no test tables here")
