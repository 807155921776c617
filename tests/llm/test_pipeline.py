import collections
import os
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
import tokenizers

import __spark_entry__ as entry
import corpus_pipeline as p

from . import test_quality as tq
from .conftest import words

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert any(x.startswith(f"op{n}_") for x in names), n


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    df = docs
    for name, stage in p.STAGES[:-1]:
        df = p.durable(stage(spark, df, SF))
        assert df.columns == docs.columns, name
        sizes.append(df.count())
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] > 0
    packed = p.STAGES[-1][1](spark, df, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in df.select("doc_id").collect()}


def brute_quality(docs, texts):
    """The ids which the rules and the bands keep, from dictionaries of n-grams."""
    of = tq.folds(docs)

    def prose(t):
        seen = [x for x in t if not x.isspace()]
        letters = [x for x in seen if x.isalnum()]
        return 100 * len(letters) >= 92 * len(seen) and 100 * sum(x != x.lower() for x in letters) <= 30 * len(letters)

    counts = [tq.brute(t or "") for t in texts]
    passed = [not (n[0] < 50 or 2 * n[4] > n[0]) for n in counts]
    taught = [ok and prose(t) for ok, t in zip(passed, texts, strict=True)]
    models = [tq.brute_model([t for i, t in enumerate(texts) if taught[i] and of[i] != m]) for m in range(tq.q.FOLDS)]
    found = [tq.brute_entropy(models[of[i]], t) if passed[i] else None for i, t in enumerate(texts)]
    ours = sorted(int(x // tq.q.BIN) for x, t in zip(found, taught, strict=True) if t)
    at = lambda share: next(b for k, b in enumerate(ours, 1) if k >= share * len(ours)) * tq.q.BIN
    middle, spread = at(0.5), max(at(0.75) - at(0.25), 10 * tq.q.BIN)
    kept = []
    for i, t in enumerate(texts):
        if passed[i]:
            reach = spread * (1 + tq.q.SHORT / len(tq.windows(t))) ** 0.5
            if middle - tq.q.BELOW * reach <= found[i] <= middle + tq.q.ABOVE * reach:
                kept.append(i)
    return kept


def brute_near(kept, texts):
    """Of each class of texts with a Jaccard likeness of 0.8 or more the least id."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, texts[i].split()) for i in kept)}
    root = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for i in kept:
            for j in kept:
                if root[j] < root[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                    root[i], changed = root[j], True
    return [i for i in kept if root[i] == i]


def test_rows_against_brute_force(spark, make, tmp_path):
    rng = random.Random(4)
    texts = [words(150, i) for i in range(40)]
    texts[3] += " write to ann.lee@mail.example.org or bob@example.com now"
    texts[5] += " the host 10.0.12.255 answered"
    texts[7] += " call +44 20 7946 0958 today"
    texts[9] += " card 4111 1111 1111 1111 was used"
    texts[11] = words(2500, 99)  # more than one sequence
    texts += [texts[1], texts[1], texts[3]]  # exact copies
    for base in (2, 2, 7):  # near copies: one word of 150 changed
        w = texts[base].split()
        w[rng.randrange(20, 130)] = "changed"
        texts.append(" ".join(w))
    w = texts[4].split()
    texts.append(" ".join("other" + x if k % 6 == 0 else x for k, x in enumerate(w)))  # too far from it
    texts += [words(60, 50).upper(), " | ".join(words(80, 51).split()), words(20, 52), "again and again " * 40, "", None]
    docs = make(texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    kept = brute_near(brute_quality(docs, texts), texts)
    # So few texts make so small a model that a near copy in the other half may put a text below the band.
    assert {3, 5, 9, 11} <= set(kept) and len(set(range(40)) - set(kept)) < 4
    assert not {40, 41, 42, 43, 44, 45} & set(kept) and max(kept) < 47
    shapes = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("card", r"4111 1111 1111 1111"), ("phone", r"\+44 20 7946 0958"), ("ip", r"10\.0\.12\.255")]
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i in kept:
        text = texts[i]
        for kind, shape in shapes:
            text = re.sub(shape, f"[{kind}]", text)
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.add((i, n, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))

    rows = p.run(spark, str(tmp_path)).collect()
    assert len(rows) == len(want)
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    # No more sequences than placing the longest first, each into the fullest that takes it.
    room = []
    for n in sorted((r["length"] for r in rows), reverse=True):
        fits = [k for k, left in enumerate(room) if left >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(2048 - n)
    assert len(filled) <= len(room)
