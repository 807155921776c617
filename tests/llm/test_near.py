import random

import numpy as np
import pytest

from tamarack.llm import near

from .conftest import words


def brute(texts):
    sets = near.text_sets([t or "" for t in texts])
    n = len(sets)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            both = len(np.intersect1d(sets[i], sets[j]))
            either = len(sets[i]) + len(sets[j]) - both
            link[i, j] = i != j and (either == 0 or both * 1000 >= either * 800)
    root = list(range(n))
    while True:
        new = [min([root[i], *(root[j] for j in range(n) if link[i, j])]) for i in range(n)]
        if new == root:
            return link.sum(1).tolist(), root
        root = new


def edits(base, n, rng, changes=1):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(changes):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus(odd_texts):
    rng = random.Random(5)
    texts = list(odd_texts[:9]) + [words(60, i) for i in range(20)]
    texts += [words(100, 900)] * 7 + edits(words(100, 900), 12, rng, 2) + edits(words(220, 901), 10, rng, 5)
    texts += ["same first line here today ok\n" + words(9, i) for i in range(30)]
    return texts


def test_links_and_classes(make, corpus):
    links, root = brute(corpus)
    rows = {r["doc_id"]: r for r in near.near_classes(make(corpus)).collect()}
    assert [rows[i]["n_links"] for i in range(len(corpus))] == links
    assert [rows[i]["class_id"] for i in range(len(corpus))] == root


def test_blocks_give_the_same(make, corpus, monkeypatch):
    links, root = brute(corpus)
    monkeypatch.setattr(near, "BLOCK", 3)
    rows = {r["doc_id"]: r for r in near.near_classes(make(corpus)).collect()}
    assert [rows[i]["n_links"] for i in range(len(corpus))] == links
    assert [rows[i]["class_id"] for i in range(len(corpus))] == root


def test_one_of_each(make, corpus):
    _, root = brute(corpus)
    docs = make(corpus)
    kept = near.one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(root)


def test_repeated_and_missing_ids(make):
    docs = make([words(30, 1), words(30, 1), words(40, 2), None], ids=[1, 1, None, None])
    assert near.near_classes(docs).count() == 4
    assert sorted(str(r["doc_id"]) for r in near.one_of_each_class(docs).collect()) == ["1", "None", "None"]


def test_empty_table(make):
    assert near.near_classes(make([])).count() == 0
    assert near.one_of_each_class(make([])).count() == 0
