import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import quality as q

from .conftest import words


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri, cover = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_counts_and_rules(spark, make, odd_texts):
    rows = q.quality(make(odd_texts)).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        n = brute(odd_texts[r["doc_id"]] or "")
        assert tuple(r[c] for c in q.COUNTS) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])


def windows(t):
    """The n-grams of the highest order of a text, white space being one gap."""
    t = " " * (q.ORDER - 1) + re.sub(r"\s+", " ", t + " ")
    return [t[i : i + q.ORDER] for i in range(len(t) - q.ORDER + 1)]


def brute_model(texts):
    """Modified Kneser-Ney in dictionaries: probabilities by n-gram, and the weight left to shorter contexts."""
    level = collections.Counter(g for t in texts for g in windows(t))
    levels = [level]
    for _ in range(q.ORDER - 1):
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    prob, weight = {"": 1 / 0x110000}, {}
    for level in reversed(levels):
        n = [sum(c == i for c in level.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0
        d = [max(0.1, i - (i + 1) * y * n[i] / n[i - 1]) for i in (1, 2, 3)] if min(n[:3]) else [0.5] * 3
        take = lambda c: min(d[min(c, 3) - 1], 0.9 * c)  # noqa: E731,B023
        total, left = collections.Counter(), collections.Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            left[g[:-1]] += take(c)
        weight |= {g: left[g] / total[g] for g in total}
        prob |= {g: (c - take(c)) / total[g[:-1]] + weight[g[:-1]] * prob[g[1:]] for g, c in level.items()}
    return prob, weight


def brute_logp(model, gram):
    prob, weight = model
    return np.log(prob[gram]) if gram in prob else np.log(weight.get(gram[:-1], 1.0)) + brute_logp(model, gram[1:])


def brute_entropy(model, text):
    return -np.mean([brute_logp(model, g) for g in windows(text)])


def folds(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", q._fold("text")).collect()}


PROSE = [words(150, i).capitalize() + f". Hello! Ünder {i}\n\n 你好" for i in range(12)]


def test_model_against_brute_force(spark, make):
    docs = make(PROSE)
    of, rows = folds(docs), collections.defaultdict(dict)
    for r in q.fit(q.count_grams(docs)).collect():
        assert r["lang"] == "en"
        rows[r["model"]][r["gram"]] = r
    for m in range(q.FOLDS):
        prob, weight = brute_model([t for i, t in enumerate(PROSE) if of[i] != m])
        assert {g for g, r in rows[m].items() if r["logp"] is not None} == set(prob)
        for g, p in prob.items():
            assert rows[m][g]["logp"] == pytest.approx(np.log(p) * q.UNIT, abs=0.51)
        for g, w in weight.items():
            assert rows[m][g]["logb"] == pytest.approx(np.log(w) * q.UNIT, abs=0.51)


def load(docs, slices=1):
    packed = q.arrays(q.fit(q.count_grams(docs)), slices)
    return [q.load_slice(packed, s, slices) for s in range(slices)]


def test_probabilities_sum_to_one(spark, make):
    (model,) = load(make([words(400, 5), words(400, 6), words(400, 7), words(400, 8)]))
    every = np.arange(0x110000, dtype=np.uint32)
    for context in ("    ", "QZ你x", "a b "):
        rows = np.column_stack([np.full(len(every), ord(c), np.uint32) for c in context[1 - q.ORDER :]] + [every])
        for m in range(q.FOLDS):
            assert np.exp(model.logp(rows, np.zeros(len(rows), np.int64), [(m, "en")]) / q.UNIT).sum() == pytest.approx(1, abs=1e-4)


def test_perplexity_and_verdict_against_brute_force(spark, make):
    junk = [words(60, 50).upper(), " | ".join(words(60, 51).split()), "zz " * 60]
    texts = [*PROSE, *junk]
    docs = make(texts)
    of, models = folds(docs), {}
    taught = [t for t in texts if not brute(t)[0] < 50 and 2 * brute(t)[4] <= brute(t)[0] and t in PROSE]
    for m in range(q.FOLDS):
        models[m] = brute_model([t for i, t in enumerate(texts) if t in taught and of[i] != m])
    want = [brute_entropy(models[of[i]], t) for i, t in enumerate(texts)]
    ours = sorted(int(np.floor(x / q.BIN)) for t, x in zip(texts, want, strict=True) if t in taught)
    at = lambda share: next(b for k, b in enumerate(ours, 1) if k >= share * len(ours)) * q.BIN
    middle, spread = at(0.5), max(at(0.75) - at(0.25), 10 * q.BIN)
    rows = {r["doc_id"]: r for r in q.quality(docs).collect()}
    for i, t in enumerate(texts):
        assert np.log(rows[i]["perplexity"]) == pytest.approx(want[i], abs=1e-5)
        reach = spread * (1 + q.SHORT / len(windows(t))) ** 0.5
        inside = middle - q.BELOW * reach <= want[i] <= middle + q.ABOVE * reach
        assert rows[i]["kept"] == (inside and not rows[i]["base_failed"])
    assert not any(rows[len(PROSE) + i]["kept"] for i in range(3))


def test_slices_give_the_same(spark, make, monkeypatch, odd_texts):
    docs = make([words(60 + i, i) for i in range(30)] + odd_texts)
    first = sorted(q.quality(docs).collect())
    kept = sorted(r["doc_id"] for r in q.keep_quality(docs).collect())
    monkeypatch.setattr(q, "SLICE", 12_000)
    assert sorted(q.quality(docs).collect()) == first
    assert sorted(r["doc_id"] for r in q.keep_quality(docs).collect()) == kept


def test_model_grows_with_the_corpus(spark, make):
    size = [q.fit(q.count_grams(make([words(200, i) for i in range(n)]))).count() for n in (10, 40)]
    assert size[1] > 2 * size[0]


def test_symbols_and_windows():
    texts = ["", "  ", "a", "a  b\n", " \x00x", "\U0001f600 é"]
    s, at, size = q.symbols(texts)
    assert size.tolist() == [len(windows(t.replace("\x00", " "))) for t in texts]
    for t, a, n in zip(texts, at, size, strict=True):
        got = ["".join(map(chr, s[a + i : a + i + q.ORDER])) for i in range(n)]
        assert got == windows(t.replace("\x00", " "))


def test_columns_whose_names_clash(spark, make):
    docs = make([words(70 + i, i) for i in range(8)])
    for name in ("__verdict", "__row", "__fold", "__lang", "__text", "__band", "v"):
        docs = docs.withColumn(name, F.lit(7))
    out = q.keep_quality(docs)
    assert out.columns == docs.columns
    assert out.filter("v = 7 and __verdict = 7 and __row = 7").count() == out.count() > 0


def test_bands_reject_outliers_and_keep_the_rest(spark, make):
    odd = "".join(chr(33 + (i * 7919) % 90) + (" " if i % 5 == 0 else "") for i in range(2000))
    docs = make([words(200, i) for i in range(60)] + [odd])
    kept = {r["doc_id"] for r in q.keep_quality(docs).collect()}
    assert kept == set(range(60))
    assert q.keep_quality(docs).columns == docs.columns


def test_empty_table_and_null_language(spark, make):
    assert q.quality(make([])).count() == 0
    assert q.keep_quality(make([])).count() == 0
    assert q.quality(make([words(70)]).withColumn("lang", F.lit(None).cast("string"))).count() == 1


def junk_corpus():
    """Sound texts, then texts of words with symbols stuck to them, and of words between bars."""
    sound = [words(120, i) for i in range(120)]
    marked = [" ".join(w + "#$%&*"[i % 5] * 3 for i, w in enumerate(words(120, 1000 + k).split())) for k in range(60)]
    barred = [words(120, 2000 + k).replace(" ", " | ") for k in range(60)]
    return sound, marked + barred


def test_symbol_junk_falls_outside_the_bands(spark, make):
    sound, junk = junk_corpus()
    rows = q.quality(make(sound + junk)).collect()
    assert not any(r["base_failed"] for r in rows)
    assert {r["doc_id"] for r in rows if r["kept"]} == set(range(len(sound)))
