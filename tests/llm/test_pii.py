import hashlib
import re

import numpy as np

from pyspark.sql import functions as F

from tamarack.llm import pii

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "mail a.b@c.de_d@e.f, x@y and \U0001f600 é q@w.e.r.t. @@a@b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.2.3 10.20.30.40x a1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559--4111111111111111 12345678901234567890",
    "+1 (017) 555-7713, +49 30 123456 +1-2 ++44 20 7946 0958.. +123456789012345678",
    "phone +1 (826) 555-4081 190.137.223.204 end",
    "write to john (at) example (dot) com or call tel 415-555-2671 now",
    "version 4.0 of build 2.3.4.5 isbn 9780306406157000",
    None,
    "",
    "a" * 200_000,
    "1" * 100_000,
    "1." * 50_000,
    "a@b" + ".c" * 20_000,
    ("x@y.zz +1 (555) 123-4567 " * 400),
]


def test_base_spans_stay(spark, make):
    rows = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(make(TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        got = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in rows[i] if s["base"]]
        assert got == base(t or ""), i
        assert got == sorted(got, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_listing_digest(spark, make):
    listed = pii.find_personal_data(make(TEXTS[:1])).select(F.sha2(pii._listing(F.filter("spans", lambda s: s["base"])), 256)).head()[0]
    assert listed == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(TEXTS[0])).encode()).hexdigest()


def test_reliabilities_follow_agreement():
    votes = lambda *v: sum(x * 3**i for i, x in enumerate(reversed(v)))
    good, bad, split = votes(1, 1, 1, 0, 0), votes(2, 2, 0, 0, 2), votes(0, 0, 1, 0, 0)
    truth = pii.estimate([(0, good, 500.0), (0, bad, 300.0), (0, split, 10.0)])
    assert truth[0, good] > 0.95 and truth[0, bad] < 0.05 and truth[0, split] > 0.5
    weights = pii.train([(0, good, 0, 500.0), (0, bad, 0, 300.0)])
    score = lambda v: sum(a * b for a, b in zip(weights, pii.inputs(0, v, 0), strict=True))
    assert score(good) > 0 > score(bad)


def test_redaction(spark, make):
    docs = make(["call +1 (017) 555-7713 or a@b.cc!", None, "plain"])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "call [phone] or [email]!", 1: None, 2: "plain"}


def test_empty_table(make):
    assert pii.find_personal_data(make([])).count() == 0
    assert pii.redact(make([])).count() == 0


def test_no_python_in_the_plan(spark, make):
    plan = pii.find_personal_data(make(TEXTS[:3]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PLANTED = {
    -1: ("write to john (at) example (dot) com today", [("email", 9, 36)]),
    -2: ("please call tel 415-555-2671 now", [("phone", 16, 28)]),
    -3: ("the ip address 2001:0db8:85a3:0000:0000:8a2e:0370:7334 logged in", [("ip", 15, 54)]),
    -4: ("order 9870157079875996 was sent", []),
    -5: ("invoice number 1234 5678 9012 3456 is open", []),
    -6: ("build version 415-555-2671 token", []),
}


def test_verdicts_hold_at_any_size(spark, sf_dirs):
    """What is accepted and refused doesn't turn over with the size of the table."""
    planted = spark.createDataFrame([(i, t) for i, (t, _) in PLANTED.items()], "doc_id bigint, text string")
    for folder in sf_dirs:
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(planted)
        found = pii.find_personal_data(docs).join(docs, "doc_id")
        rows = {r["doc_id"]: [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]] for r in found.filter("doc_id < 0").collect()}
        assert rows == {i: want for i, (_, want) in PLANTED.items()}, folder
        cards = found.select("text", F.explode("spans").alias("s")).filter("s.kind = 2").collect()
        assert cards and all(luhn(re.sub("[^0-9]", "", r["text"][r["s"]["start"] : r["s"]["end"]])) for r in cards)


def test_estimate_against_brute_force():
    """The same estimate, span by span and in matrices, from many random votes."""
    rng = np.random.default_rng(3)
    spans = [(int(rng.integers(0, 3)), int(v)) for v in rng.integers(0, 3**pii.LABELERS, 900)]
    counts = {}
    for s in spans:
        counts[s] = counts.get(s, 0) + 1.0
    got = pii.estimate([(k, v, n) for (k, v), n in counts.items()], rounds=25)
    kind, vote = np.array([k for k, _ in spans]), np.array([pii.unpack(v) for _, v in spans])
    fixed = np.array([np.nan if (a := pii.anchor(v)) is None else a for _, v in spans])
    p = np.where(np.isnan(fixed), 1 / (1 + np.exp(-2.0 * ((vote == 1).sum(1) - (vote == 2).sum(1)))), fixed)
    hot, of = np.eye(3)[vote], np.eye(len(pii.KINDS))[kind]
    for _ in range(25):
        both = np.stack([1 - p, p])
        c = np.einsum("ts,sk,slv->ktlv", both, of, hot)
        size = c.sum(-1, keepdims=True)
        worth = size.min(1, keepdims=True)
        worth = worth**2 / (worth + pii.SHARED)
        pooled = pii.SHARED * np.array(pii.PRIOR)[:, None, :] + (worth * c / np.maximum(size, 1e-300)).sum(0)
        chance = (worth * c / np.maximum(size, 1e-300) + pii.SHARED * (pooled / pooled.sum(-1, keepdims=True))) / (worth + pii.SHARED)
        share = 1 + np.einsum("ts,sk->kt", both * np.isnan(fixed), of)
        share /= share.sum(1, keepdims=True)
        score = np.log(share[kind]) + np.einsum("slv,stlv->st", hot[:, 1:, 1:], np.log(chance[kind])[:, :, 1:, 1:])
        p = np.where(np.isnan(fixed), 1 / (1 + np.exp(score[:, 0] - score[:, 1])), fixed)
    for (k, v), q in zip(spans, p, strict=True):
        assert abs(got[k, v] - q) < 1e-9


def test_one_class_only_does_not_collapse():
    only_for, only_against = [(2, 162, 50.0)], [(2, 2 * 81, 3.0)]
    assert pii.unpack(162) == [2, 0, 0, 0, 0] and pii.estimate(only_for)[2, 162] == 0.0
    weights = pii.train([(2, 81, 0, 50.0), (2, 162, 0, 1.0)])
    score = lambda v: sum(a * b for a, b in zip(weights, pii.inputs(2, v, 0), strict=True))
    assert score(81) > 0 > score(162)
    assert pii.train([])[0] < 0
    assert pii.estimate(only_against) == {(2, 162): 0.0}


def test_columns_whose_names_clash(spark, make):
    docs = make(["call +1 (017) 555-7713 or a@b.cc!", "plain"])
    for name in ("__text", "__spans", "__email", "__strict", "___all"):
        docs = docs.withColumn(name, F.lit("mine"))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert out.filter("__text = 'mine' and __spans = 'mine' and __email = 'mine'").count() == 2
    assert out.filter("doc_id = 0").head()["text"] == "call [phone] or [email]!"
