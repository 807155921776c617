"""Personal data by weak supervision (operator 9), with built-in functions only.

Patterns find candidate spans: the base patterns, and looser ones for forms they miss.
Five labelers (shape, gazetteer, context for, context against, surroundings) vote on each
candidate or abstain.  Expectation-maximisation estimates how reliable each labeler is for
each kind, and a logistic classifier of spans is trained on the resulting probabilities.
Base spans always stay; other candidates are added where the classifier says so.

The estimate is anchored, so that a kind can't fall into one class where there is little to
learn from: base spans are personal data, matches which fail the checks of their kind and
have no vote for them are not, and only the others are to be found out.  Labelers start from
a prior (what votes for is right more often than not), kinds share what they know of a
labeler, and the classifier gives the same weight to both anchors and to what is found out.

Both models are fitted on counts of vote and feature patterns over all texts, at most
``4 * 3**5 * 2**3`` rows whatever the corpus; only they reach the driver, and the fitted
weights go back into the plan as constants.

Patterns are possessive and start at the border of a run of their characters, so that a
long run costs linear time; that changes no match, since a match from inside a run ends
or fails where the one from its border does.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read

KINDS = ("email", "ip", "card", "phone")
#: name: kind, pattern, base or not, what a text must contain to be searched.
PATTERNS = {
    "email": (0, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, "instr(text, '@') > 0"),
    "ip": (1, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, r"text rlike '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]'"),
    "card": (2, r"[0-9]++(?:[ -][0-9]++)*+", True, r"text rlike '[0-9](?:[ -]?[0-9]){15}'"),
    "phone": (3, r"\+[0-9][ ().0-9-]+[0-9]", True, r"instr(text, '+') > 0"),
    "email_spelt": (0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++", False, r"text rlike '[(\\[{]at[)\\]}]'"),
    "ip_six": (1, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", False, r"text rlike '[0-9A-Fa-f]:[0-9A-Fa-f]++:[0-9A-Fa-f]'"),
    "phone_local": (3, r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", False, r"text rlike '[0-9]{3}[ .-][0-9]{4}'"),
}
#: Gazetteers: endings of host names, first digits of card issuers, calling codes, reserved networks.
HOST_ENDINGS = ("com", "org", "net", "edu", "gov", "int", "io", "info", "eu", "de", "fr", "es", "it", "nl", "uk", "us", "ca", "ch", "at", "be", "pt", "pl", "se", "no", "dk", "fi", "ie", "br", "mx", "ar", "in", "cn", "jp", "kr", "au", "nz")
CARD_ISSUERS = "^(?:3[0-9]|4|5|6|2[2-7])"
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED_NETWORKS = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."
WORDS_FOR = {
    "email": "e-?mail|mail|contact|correo|courriel|kontakt",
    "ip": "ip|host|server|login|from|address|adresse",
    "card": "card|visa|master|credit|tarjeta|carte|karte|payment",
    "phone": "tel|phone|call|fax|mobile|cell|handy|telefon|téléphone|teléfono",
}
WORDS_AGAINST = "version|v\\.|isbn|issn|doi|section|figure|chapter|build|release|order|invoice|sha|hash|token|key|serial"
LABELERS = 5
#: Chances of a labeler to abstain, vote for and vote against, on what isn't personal data and on what is,
#: before any text is seen; and the counts which these and the labeler's chances over all kinds are worth.
PRIOR, SHARED = ((0.6, 0.1, 0.3), (0.6, 0.3, 0.1)), 20.0
#: The weight of the classifier's least squares.
RIDGE = 1e-3
FEATURES = ("has separators", "is long", "is of a looser form")


def _located(text: str, name: str) -> Column:
    """The matches of a pattern as structs with their place and what stands beside them.

    Texts are split at the matches; the lengths of the parts give the places, in code points.
    """
    kind, pattern, base, needs = PATTERNS[name]
    col = F.col(text)
    needs = F.expr(needs.replace("text", f"`{text}`", 1))
    gaps, found = F.split(col, pattern, -1), F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    shape = "array<struct<text:string,left:string,right:string>>"
    parts = F.when(
        needs,
        F.zip_with(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), F.slice(F.concat(gaps, F.array(F.lit(""))), F.lit(2), F.size(gaps)), lambda a, b: F.struct(a["m"].alias("text"), a["g"].alias("left"), b.alias("right"))),
    ).otherwise(F.array().cast(shape))
    parts = F.filter(parts, lambda p: p["text"].isNotNull())
    one = lambda at, p: F.struct(
        F.lit(kind).alias("kind"),
        (at + F.length(p["left"])).alias("start"),
        (at + F.length(p["left"]) + F.length(p["text"])).alias("end"),
        p["text"].alias("text"),
        F.right(p["left"], F.lit(30)).alias("before"),
        F.left(p["right"], F.lit(8)).alias("after"),
        F.lit(not base).alias("loose"),
    )
    out = "array<struct<kind:int,start:int,end:int,text:string,before:string,after:string,loose:boolean>>"
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast(out).alias("out")),
        lambda a, p: F.struct((a["at"] + F.length(p["left"]) + F.length(p["text"])).alias("at"), F.concat(a["out"], F.array(one(a["at"], p))).alias("out")),
        lambda a: a["out"],
    )


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    """Whether the digits pass the check: every second one from the right counts double."""
    turned = F.reverse(number)
    digit = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, double(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _is_base(s: Column) -> Column:
    """Whether a match of a base pattern is personal data by the checks of its kind."""
    n = F.length(_digits(s["text"]))
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    checks = (
        F.when(s["kind"] == 0, True)
        .when(s["kind"] == 1, s["text"].rlike("^" + r"\.".join([part] * 4) + "$"))
        .when(s["kind"] == 2, F.when(n.between(16, 19), _luhn(_digits(s["text"]))).otherwise(False))
        .otherwise(n.between(8, 15))
    )
    return ~s["loose"] & checks


def _votes(s: Column, base: Column) -> Column:
    """The labelers' votes as a number in base three: 0 abstains, 1 is for, 2 against."""
    kind, text = s["kind"], s["text"]
    shape = F.when(base, 1).when(s["loose"], 0).otherwise(2)
    gazetteer = (
        F.when(kind == 0, F.when(F.lower(F.regexp_extract(text, r"([A-Za-z0-9-]+)$", 1)).isin(*HOST_ENDINGS), 1).otherwise(2))
        .when(kind == 1, F.when(text.rlike(RESERVED_NETWORKS), 2).otherwise(0))
        .when(kind == 2, F.when(_digits(text).rlike(CARD_ISSUERS), 0).otherwise(2))
        .otherwise(F.when(text.rlike(CALLING_CODES), 1).otherwise(0))
    )
    near = F.lower(s["before"])
    words = F.element_at(F.array(*[F.lit(rf"(?:^|[^\p{{L}}])(?:{WORDS_FOR[k]})[^\p{{L}}]") for k in KINDS]), kind + 1)
    context_for = F.when(F.regexp_like(near, words), 1).otherwise(0)
    context_against = F.when(near.rlike(rf"(?:^|[^\p{{L}}])(?:{WORDS_AGAINST})[^\p{{L}}]"), 2).otherwise(0)
    inside = F.when(s["before"].rlike(r"[\p{L}\p{N}_]$") & ~text.startswith("+") | s["after"].rlike(r"^[\p{L}\p{N}_]"), 2).otherwise(0)
    out = F.lit(0)
    for vote in (shape, gazetteer, context_for, context_against, inside):
        out = out * 3 + vote
    return out.cast("int")


def _features(s: Column) -> Column:
    bits = (s["text"].rlike(r"[ ().-]"), F.length(s["text"]) >= 16, s["loose"])
    out = F.lit(0)
    for bit in bits:
        out = out * 2 + bit.cast("int")
    return out.cast("int")


def _prefix(df: DataFrame) -> str:
    """What no column's name begins with, in any case."""
    out = "__"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def candidates(df: DataFrame, text_col: str, prefix: str = "__") -> DataFrame:
    """Adds <prefix>spans: kind, start, end, base, votes and features of each candidate, by kind and place."""
    for name in PATTERNS:
        df = df.withColumn(f"{prefix}{name}", _located(text_col, name))
    shape = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _is_base(s).alias("base"), s["loose"].alias("loose"), s["text"].alias("text"), s["before"].alias("before"), s["after"].alias("after"))
    strict = F.concat(*[F.col(f"{prefix}{n}") for n, p in PATTERNS.items() if p[2]])
    # Digit runs too short for any card aren't candidates.
    strict = F.filter(strict, lambda s: (s["kind"] != 2) | (F.length(_digits(s["text"])) >= 13))
    df = df.withColumn(f"{prefix}strict", F.transform(strict, shape))
    loose = F.concat(*[F.col(f"{prefix}{n}") for n, p in PATTERNS.items() if not p[2]])
    apart = lambda s: ~F.exists(f"{prefix}strict", lambda b: b["base"] & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    df = df.withColumn(f"{prefix}all", F.concat(f"{prefix}strict", F.transform(F.filter(loose, apart), shape)))
    judged = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), _votes(s, s["base"]).alias("votes"), _features(s).alias("features"))
    df = df.withColumn(f"{prefix}spans", F.array_sort(F.transform(f"{prefix}all", judged)))
    return df.drop(f"{prefix}strict", f"{prefix}all", *[f"{prefix}{n}" for n in PATTERNS])


def unpack(votes: int) -> list[int]:
    return [votes // 3**i % 3 for i in reversed(range(LABELERS))]


def anchor(votes: int) -> float | None:
    """1 for a base span, 0 for one which fails its checks with no vote for it, else None: to be found out."""
    shape, *others = unpack(votes)
    return 1.0 if shape == 1 else 0.0 if shape == 2 and 1 not in others else None


def estimate(rows: list[tuple[int, int, float]], rounds: int = 100) -> dict[tuple[int, int], float]:
    """Probability of being personal data for each (kind, votes) of rows(kind, votes, count).

    Each labeler has, for each kind, its chances of each vote on spans that are and aren't
    personal data.  They are drawn towards its chances over all kinds, by ``SHARED`` counts,
    and those towards ``PRIOR``, by as many.  Anchored spans keep their class.  A kind without
    any other candidates, or without any at all, needs no estimate of its own.
    """
    out = {(k, v): anchor(v) if anchor(v) is not None else 1 / (1 + math.exp(-2.0 * (unpack(v).count(1) - unpack(v).count(2)))) for k, v, _ in rows}
    for _ in range(rounds):
        counts = [[[[0.0] * 3 for _ in range(LABELERS)] for _ in range(2)] for _ in KINDS]
        share = [[1.0, 1.0] for _ in KINDS]
        for k, v, n in rows:
            for truth, p in enumerate((1 - out[k, v], out[k, v])):
                share[k][truth] += n * p if anchor(v) is None else 0.0  # how many are anchored says nothing of the others
                for i, vote in enumerate(unpack(v)):
                    counts[k][truth][i][vote] += n * p
        chances = [[[[0.0] * 3 for _ in range(LABELERS)] for _ in range(2)] for _ in KINDS]
        for truth in (0, 1):
            for i in range(LABELERS):
                # A kind counts by shares, so that the most frequent one doesn't speak for all.
                size = [sum(counts[k][truth][i]) for k in range(len(KINDS))]
                # Both classes are believed by as many spans as the smaller one has: else a vote never
                # seen would speak against the class of which more has been seen.  Few are believed
                # less still, or the spans to be found out would bear themselves out.
                few = [min(sum(counts[k][t][i]) for t in (0, 1)) for k in range(len(KINDS))]
                worth = [x * x / (x + SHARED) for x in few]
                pooled = [SHARED * PRIOR[truth][x] + sum(worth[k] * counts[k][truth][i][x] / size[k] for k in range(len(KINDS)) if size[k]) for x in range(3)]
                for k in range(len(KINDS)):
                    for x in range(3):
                        own = counts[k][truth][i][x] / size[k] if size[k] else 0.0
                        chances[k][truth][i][x] = (worth[k] * own + SHARED * pooled[x] / sum(pooled)) / (worth[k] + SHARED)
        moved = 0.0
        for k, v, _ in rows:
            if anchor(v) is None:
                # The shape labeler is what anchors the others, so it has no say on the rest; and who abstains says nothing.
                score = [math.log(share[k][t] / sum(share[k])) + sum(math.log(chances[k][t][i][x]) for i, x in enumerate(unpack(v)) if i and x) for t in (0, 1)]
                p = 1 / (1 + math.exp(max(-60.0, min(60.0, score[0] - score[1]))))
                moved, out[k, v] = max(moved, abs(p - out[k, v])), p
        if moved < 1e-9:
            break
    return out


def inputs(kind: int, votes: int, features: int) -> list[float]:
    """What the span classifier sees: kind, each labeler's votes, and the features."""
    vote = unpack(votes)
    return [
        1.0,
        *[float(kind == k) for k in range(1, len(KINDS))],
        *[float(v == x) for v in vote for x in (1, 2)],
        *[float(features >> i & 1) for i in reversed(range(len(FEATURES)))],
    ]


def train(rows: list[tuple[int, int, int, float]], rounds: int = 30) -> list[float]:
    """Weights of a logistic classifier of spans, on rows(kind, votes, features, count).

    Of each kind, the spans anchored on either side and those found out weigh the same, however
    many they are.  Newton's method; the least squares of the weights keep it finite.
    """
    totals: dict[tuple[int, int], float] = {}
    for k, v, _, n in rows:
        totals[k, v] = totals.get((k, v), 0) + n
    truth = estimate([(k, v, n) for (k, v), n in totals.items()])
    size = len(inputs(0, 0, 0))
    if not rows:
        return [-1.0] + [0.0] * (size - 1)
    sides: dict[tuple[int, float | None], float] = {}
    for k, v, _, n in rows:
        sides[k, anchor(v)] = sides.get((k, anchor(v)), 0.0) + n
    x = np.array([inputs(k, v, f) for k, v, f, _ in rows])
    # A row stands on both sides, by its probability.
    weight = np.array([[n * p / sides[k, anchor(v)] for p in (1 - truth[k, v], truth[k, v])] for k, v, _, n in rows])
    w = np.zeros(size)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        slope = x.T @ (weight.sum(1) * p - weight[:, 1]) + RIDGE * w
        curve = (x * (weight.sum(1) * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(size)
        step = np.linalg.solve(curve, slope)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return [float(a) for a in w]


def fit(found: DataFrame, spans: str = "__spans") -> list[float]:
    """Weights by the candidates of all texts; their patterns are counted by Spark."""
    counts = found.select(F.explode(spans).alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n")).collect()
    return train(sorted((r["kind"], r["votes"], r["features"], float(r["n"])) for r in counts))


def accepted(weights: list[float], spans: str = "__spans") -> Column:
    """The spans to report: base ones, and those which the classifier takes."""
    def classified(s: Column) -> Column:
        x, total = s["votes"], F.lit(weights[0])
        for k in range(1, len(KINDS)):
            total = total + F.when(s["kind"] == k, weights[k]).otherwise(0.0)
        at = len(KINDS)
        for i in reversed(range(LABELERS)):
            vote = F.floor(x / 3**i) % 3
            total = total + F.when(vote == 1, weights[at]).when(vote == 2, weights[at + 1]).otherwise(0.0)
            at += 2
        for i in reversed(range(len(FEATURES))):
            total = total + F.when(F.getbit(s["features"], F.lit(i)) == 1, weights[at]).otherwise(0.0)
            at += 1
        return total > 0

    # What is anchored as no personal data stays so, whatever the weights of others say.
    anchored = [v for v in range(3**LABELERS) if anchor(v) == 0.0]
    return F.filter(spans, lambda s: s["base"] | (~s["votes"].isin(anchored) & classified(s)))


def _listing(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in each whole text.

    Returns ``id_col``, spans (kind, start, end, base; places in code points), listed by kind and
    place.  One row per input row, repeated rows included; null and empty texts have no
    spans; a table without candidates adds none; other columns are not read.
    """
    texts = df.select(F.col(id_col).alias("__key"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = durable(candidates(texts, "__text").select("__key", "__spans"))
    kept = F.transform(accepted(fit(found)), lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base")]))
    return found.select(F.col("__key").alias(id_col), kept.alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with each span of personal data replaced by its kind in brackets.

    Overlapping spans are replaced together under the name of the first.  A null text stays
    null, an empty one empty; very long texts are searched whole; repeated rows are replaced
    alike; an empty table stays empty; all other columns stay as they are, whatever they are
    called.
    """
    prefix = _prefix(df)
    text_of, spans_of = f"{prefix}text", f"{prefix}spans"
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias(text_of))
    weights = fit(candidates(texts, text_of, prefix), spans_of)
    columns = df.columns
    df = candidates(df.withColumn(text_of, F.coalesce(F.col(text_col), F.lit(""))), text_of, prefix)
    spans = F.array_sort(F.transform(accepted(weights, spans_of), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = df.withColumn(spans_of, spans)
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    text = F.col(text_of)
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    done = F.aggregate(
        spans_of,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], cut(a["at"], s["start"]), F.element_at(names, s["kind"] + 1)).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return df.withColumn(text_col, F.when(F.col(text_col).isNull() | (F.size(spans_of) == 0), F.col(text_col)).otherwise(done)).select(columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    found = found.withColumn("base", base)
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listing(F.col("base")), 256).alias("base_sha256"),
        _listing(F.col("spans")).alias("spans"),
        F.size("spans").cast("bigint").alias("n_spans"),
        (F.size("spans") > 0).alias("has_personal_data"),
    )
