import hashlib

import numpy as np

from tamarack.llm.sketches import containment, fingerprints_with_edits, likeness, merge, sketch_batch

from .conftest import words


def test_edits_and_neighbours(spark, make, odd_texts):
    rows = {r["doc_id"]: r for r in fingerprints_with_edits(make(odd_texts)).collect()}
    assert len(rows) == len(odd_texts)
    texts = [t or "" for t in odd_texts]
    for i, t in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert rows[i]["n_chars"] == len(t)
        assert 0 <= rows[i]["near_edited"] <= 1
    assert rows[5]["fingerprint"] == rows[6]["fingerprint"] and rows[5]["near_next"] == 1.0


def test_order_over_many_ranges(spark, make):
    texts = [words(12, i) for i in range(700)]
    rows = {r["doc_id"]: r["edited_sha256"] for r in fingerprints_with_edits(make(texts, ids=[3 * i for i in range(700)]).repartition(7)).collect()}
    for i, t in enumerate(texts):
        half = len(t) // 2
        changed = t[: len(t) - half] + texts[(i + 1) % 700][:half]
        assert rows[3 * i] == hashlib.sha256(changed.encode()).hexdigest()


def test_single_row_empty_table_null_ids(make):
    row = fingerprints_with_edits(make(["one two three four five six"])).collect()[0]
    assert row["near_next"] == 1.0
    assert fingerprints_with_edits(make([])).count() == 0
    assert fingerprints_with_edits(make(["a b", "c d"], ids=[None, 1])).count() == 2


def test_estimates_and_merging():
    a, b = words(4000, 1), words(4000, 2)
    whole, part, other = sketch_batch([a + " " + b, a, b])
    assert containment(part, whole) > 0.99 and 0.4 < containment(whole, part) < 0.6
    assert abs(likeness(part, whole) - 0.5) < 0.1
    assert likeness(part, other) == 0
    assert len(np.setdiff1d(merge(part, other), whole)) == 0
