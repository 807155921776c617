import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamarack.llm import packing
from tamarack.llm.packing import pack_documents, plan


def check(rows, texts, capacity):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == list(range(0, len(ids), capacity))
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [2048, 64])
def test_every_piece_has_a_place(spark, make, odd_texts, capacity):
    check(pack_documents(make(odd_texts), capacity=capacity).collect(), odd_texts, capacity)


def test_exact_complements_fill_sequences(spark, make):
    # The text of n words has n + 1 tokens.
    sizes = [2000, 48, 1000, 500, 548, 1024, 1024] * 3
    rows = pack_documents(make([" ".join(["the"] * (n - 1)) for n in sizes])).collect()
    assert len({r["sequence_id"] for r in rows}) == sum(sizes) // 2048


def test_empty_table(make):
    assert pack_documents(make([])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_plan_uses_each_piece_once(counts):
    used = defaultdict(int)
    for items, times in plan(counts, 64):
        assert sum(k * m for k, m in items) <= 64
        for k, m in items:
            used[k] += m * times
    assert dict(used) == counts


def test_plan_is_near_the_bound():
    rng = random.Random(1)
    counts = {k: rng.randint(1, 300) for k in range(1, 900)}
    total = sum(k * n for k, n in counts.items())
    assert sum(n for _, n in plan(counts, 2048)) <= -(-total // 2048) * 1.01


def best_fit_by_piece(counts, capacity):
    """Piece by piece: the fill of each sequence."""
    fill = []
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            best = max((f for f in fill if f + k <= capacity), default=None)
            if best is None:
                fill.append(k)
            else:
                fill[fill.index(best)] += k
    return sorted(fill)


def test_best_fit_against_brute_force():
    rng = random.Random(4)
    for capacity in (7, 20, 64):
        for _ in range(60):
            counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
            patterns = packing.best_fit(counts, capacity)
            used, fill = {}, []
            for items, times in patterns:
                for k, m in items:
                    used[k] = used.get(k, 0) + m * times
                fill += [sum(k * m for k, m in items)] * times
            assert used == counts and sorted(fill) == best_fit_by_piece(counts, capacity)
