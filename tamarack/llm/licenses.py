"""Licence recognition by sentences and rules (operator 1), with built-in functions only.

A text is cut into sentences, which are normalised: lower-case words, then one spelling for
what may be spelled in several ways (``FORMS``: names and versions of licences, how a licence
is referred to, holders' names).  Known sentences have identifiers: a sentence is cut where a
known one begins, and each part is looked up by its first words, the most words first, in a
map of whole normalised sentences.  The identifiers of a text, in order, are a sequence.  Rules
are sequences of identifiers which stand for a licence.  They are tried in order, longer ones
first; what a rule matches is used up, so that a sentence shared by licences counts for the
one whose rule it completes.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read

#: How licences are called after normalisation, and the identifiers of the licences.
NAMES = {
    "mit license": "MIT",
    "isc license": "ISC",
    "zlib license": "Zlib",
    "apache 2": "Apache-2.0",
    "apache 2 0": "Apache-2.0",
    "apache license": "Apache",
    "bsd license": "BSD",
    "bsd 2 clause": "BSD-2-Clause",
    "bsd 3 clause": "BSD-3-Clause",
    "boost software license": "BSL-1.0",
    "mpl 2": "MPL-2.0",
    "mpl 2 0": "MPL-2.0",
    "epl 2": "EPL-2.0",
    "epl 2 0": "EPL-2.0",
    "cc0": "CC0-1.0",
    "cc by": "CC-BY",
    "cc by nc": "CC-BY-NC",
    "cc by nc nd": "CC-BY-NC-ND",
    "cc by nc sa": "CC-BY-NC-SA",
    "cc by nd": "CC-BY-ND",
    "cc by sa": "CC-BY-SA",
    "unlicense": "Unlicense",
}
#: Versions of the GNU licences; by rule, each is known as it is, as "only", and as "or later".
GNU = {"gpl": {"2": "GPL-2.0", "3": "GPL-3.0"}, "lgpl": {"2": "LGPL-2.0", "2 1": "LGPL-2.1", "3": "LGPL-3.0"}, "agpl": {"3": "AGPL-3.0"}}
#: Names which a line of SPDX may hold beside the others.
SPDX = {"mit": "MIT", "isc": "ISC", "zlib": "Zlib", "bsl 1 0": "BSL-1.0"}
#: Sentences of licence texts, normalised, and their identifiers.
SENTENCES = {
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "software distributed under the license is distributed on an as is basis": "apache2-basis",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "mit-asis",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "the software is provided as is and the author disclaims all warranties": "isc-asis",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name may be used to endorse or promote products derived from this software": "bsd-endorse",
    "this software is provided by holder as is": "bsd-asis",
    "this program is free software": "gnu-free",
    "free and unencumbered software": "unlicense-free",
    "given to the public domain": "public-domain",
    "all rights reserved": "all-rights",
    "copyright year": "copyright",
}
#: Rules of whole texts in order, as a licence and the identifiers which stand for it.
TEXTS = (
    ("Apache-2.0", "ref-Apache-2.0 apache2-comply apache2-copy apache2-basis"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse bsd-asis"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-asis"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("MIT", "mit-grant mit-notice mit-asis"),
    ("MIT", "mit-grant mit-notice"),
    ("ISC", "isc-grant isc-asis"),
    ("Unlicense", "unlicense-free"),
    ("MIT", "mit-grant"),
    ("ISC", "isc-grant"),
    ("BSD", "bsd-grant"),
)
_NAME = r"(?:mit|isc|zlib|apache|bsd|boost software|bsl|[al]?gpl|mpl|epl|cc0|cc by|unlicense)\b"
#: Spellings of the same and their one form, in order, over words between single spaces.
FORMS = (
    (r"\blicence", "license"),
    (r"\b([al]?gpl) ?v(?=[0-9])|\b([al]?gpl)(?=[0-9])", "$1$2 "),
    (r"\b(?:versions?|ver|v) ?(?=[0-9])", ""),
    (r"([0-9]) ?\+", "$1 or later"),
    (r"\bgnu affero general public license\b|\baffero general public license\b|\bgnu agpl\b", "agpl"),
    (r"\bgnu (?:lesser|library) general public license\b|\bgnu lgpl\b", "lgpl"),
    (r"\bgnu general public license\b|\bgnu gpl\b", "gpl"),
    (r"\b([al]?gpl) license\b", "$1"),
    (r"\b([al]?gpl) (?:a?l?gpl) (?=[0-9])", "$1 "),
    (r"\b([al]?gpl(?: [0-9])*) as published by the free software foundation\b", "$1"),
    (r"\b([al]?gpl) (?:in |either )+(?=[0-9])", "$1 "),
    (r"\b([al]?gpl [0-9](?: [0-9])?) of the license\b", "$1"),
    (r"\b([al]?gpl [0-9]) 0\b", "$1"),
    (r"\b([al]?gpl [0-9](?: [0-9])?) (?:or )?(?:at your option )?(?:any )?(?:later|newer)(?: version)?\b", "$1 or later"),
    (r"\bmozilla public license\b|\bmpl license\b", "mpl"),
    (r"\beclipse public license\b|\bepl license\b", "epl"),
    (r"\bapache software license\b", "apache license"),
    (r"\bapache license (?=[0-9])", "apache "),
    (r"\bcreative commons zero\b|\bcc zero\b", "cc0"),
    (r"\bcreative commons (?:attribution|by)\b|\bcc attribution\b", "cc by"),
    (r"\bcc by non ?commercial\b", "cc by nc"),
    (r"\bcc by( nc)? share ?alike\b", "cc by$1 sa"),
    (r"\bcc by( nc)? no ?deriv(?:ative)?s?\b", "cc by$1 nd"),
    (r"\b(?:simplified|freebsd) bsd\b|\bbsd (?:2|two) clause\b|\b(?:2|two) clause bsd\b", "bsd 2 clause"),
    (r"\b(?:new|revised|modified) bsd\b|\bbsd (?:3|three) clause\b|\b(?:3|three) clause bsd\b", "bsd 3 clause"),
    (r"\b(?:expat|x11|mit x11|mit expat) license\b", "mit license"),
    (r"\bthe (mit license) mit\b", "$1"),
    (r"^ ((?:apache|gpl|lgpl|agpl) [0-9](?: [0-9])?) (?:[0-9]+ )?(?:january|february|june|november) [0-9]{4}\b.*", " $1 "),
    (r"\bspdx license identifier (?=" + _NAME + ")", "spdx "),
    (r"\b(?:under|subject to|according to|governed by|covered by|in accordance with)(?: the| both| either)?(?: terms(?: and conditions)? of| conditions of)?(?: the| an?)? (?=" + _NAME + ")", "under "),
    (r"\b(spdx [a-z0-9 ]{2,40}?) (?:or|and) (?=" + _NAME + ")", "$1 spdx "),
    (r"\b(under [a-z0-9 ]{2,60}?) (?:or|and) (?:under )?(?:the |an? )?(?=" + _NAME + ")", "$1 under "),
    (r"\bthis library is free software\b", "this program is free software"),
    (r"\bcopy modify and or distribute\b", "copy modify and distribute"),
    (r"\b(?:is|placed|released|dedicated|donated) (?:in|into|to) the public domain\b", "given to the public domain"),
    (r"\bneither the names? of .{1,300}? may be used to endorse\b", "neither the name may be used to endorse"),
    (r"\bthis software is provided by .{1,200}? as is\b", "this software is provided by holder as is"),
    (r"\bcopyright (?:c )?[12][0-9]{3}\b", "copyright year"),
)
#: Every known sentence holds one of these after its words are made (before the forms); others are passed over.
KEYS = r"licen[sc]e|permission|redistribution|provided by|provided as|free software|unencumbered|public domain|rights reserved|copyright|neither the name|\b[al]?gpl|\b[me]pl\b|\bcc0\b|\bcc zero\b|\bcc by\b|\bcc attribution\b|creative commons|clause\b|\bbsd\b|\bapache [0-9v]"
#: Sentences end at a full stop or the like before white space, at an empty line or at the text's end.
#: Semicolons and colons end none: the headers of the GNU licences go on after them; nor does "v. 2.0".
SENTENCE_END = r"(?<![ ,(][vV]|[ ,(][vV]er)[.!?]+(?:[ \t\n\r\f]+|$)|\n[ \t\r]*\n"


@functools.cache
def known() -> dict[str, str]:
    """All known sentences, normalised, and their identifiers: references, by rule from the names, and texts."""
    out = {}
    for lead in ("under", "spdx"):
        for name, licence in references().items():
            out[f"{lead} {name}"] = f"ref-{licence}"
    for name, licence in SPDX.items():
        out[f"spdx {name}"] = f"ref-{licence}"
    return out | SENTENCES


@functools.cache
def references() -> dict[str, str]:
    """Names with versions, and the licences they refer to."""
    out = dict(NAMES)
    for name, versions in GNU.items():
        out[name] = name.upper()
        for version, licence in versions.items():
            out |= {f"{name} {version}": f"{licence}-only", f"{name} {version} only": f"{licence}-only", f"{name} {version} or later": f"{licence}-or-later"}
    return out


@functools.cache
def rules() -> tuple[tuple[str, str], ...]:
    """The rules in order: whole texts (with a reservation of rights that belongs to them), references, what is left."""
    texts = [(licence, f"{before}{ids}") for licence, ids in TEXTS for before in ("all-rights ", "")]
    refs = [(licence, f"ref-{licence}") for licence in dict.fromkeys([*references().values(), *SPDX.values()])]
    free = [(licence, f"gnu-free {ids}") for licence, ids in refs if "GPL" in licence]
    return (*texts, *free, *refs, ("Public-Domain", "public-domain"), ("Proprietary", "copyright all-rights"), ("Proprietary", "all-rights"))


def _begins() -> str:
    """A space before which a known sentence begins."""
    first = sorted({" ".join(s.split()[:3]) for s in SENTENCES})
    return rf" (?=(?:(?:under|spdx) {_NAME}|(?:{'|'.join(map(re.escape, first))})\b))".replace(r"\ ", " ")


def normalised(sentence: Column) -> Column:
    """The words of a sentence in their one form, between single spaces."""
    out = sentence
    for pattern, form in FORMS:
        out = F.regexp_replace(out, pattern, form)
    return out


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    heads = F.create_map(*[F.lit(x) for name, licence in references().items() for x in (name, f"ref-{licence}")])
    lengths = F.array(*[F.lit(n) for n in sorted({len(s.split()) for s in known()}, reverse=True)])

    def of_part(part: Column) -> Column:
        words = F.split(F.trim(part), " ", -1)
        return F.get(F.array_compact(F.transform(lengths, lambda n: F.when(F.size(words) >= n, F.element_at(table, F.array_join(F.slice(words, F.lit(1), n), " "))))), F.lit(0))

    def of_sentence(s: Column) -> Column:
        # A heading is a name and nothing else.
        head = F.element_at(heads, F.regexp_replace(F.trim(s), "^(?:the|license) ", ""))
        return F.when(head.isNotNull(), F.array(head)).otherwise(F.array_compact(F.transform(F.split(s, _begins(), -1), of_part)))

    words = F.transform(F.split(text, SENTENCE_END, -1), lambda s: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9+]+", " ")), F.lit(" ")))
    return F.flatten(F.transform(F.transform(F.filter(words, lambda s: s.rlike(KEYS)), normalised), of_sentence))


def by_rules(found: Column) -> Column:
    """The licences for a sequence of identifiers, in the rules' order, each once."""
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f"|{ids.replace(' ', '|')}|").alias("ids")) for name, ids in rules()])
    start = F.struct(F.concat(F.lit("|"), F.array_join(found, "|"), F.lit("|")).alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(a: Column, r: Column) -> Column:
        return F.when(
            F.contains(a["left"], r["ids"]),
            F.struct(F.replace(a["left"], r["ids"], F.lit("|")).alias("left"), F.array_append(a["names"], r["name"]).alias("names")),
        ).otherwise(a)

    return F.when(F.size(found) > 0, F.array_distinct(F.aggregate(ordered, start, apply, lambda a: a["names"]))).otherwise(F.array().cast("array<string>"))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence sentences and licences of each whole text.

    Returns ``id_col``, sentences (identifiers in order), licenses (names in the rules'
    order, each once).  One row per input row, repeated rows included; a null or empty text
    has neither; very long texts are read whole; other columns are not read, whatever they
    are called; an empty table gives an empty table.
    """
    sentences = fresh(df.select(id_col), "sentences")
    found = df.select(F.col(id_col), identifiers(F.coalesce(F.col(text_col), F.lit(""))).alias(sentences))
    return found.select(id_col, F.col(sentences).alias("sentences"), by_rules(F.col(sentences)).alias("licenses"))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


#: Written out by hand and not made from the tables above: the lines by which documents name
#: their licence, as words at any place of a sentence, and single sentences of licence texts.
#: It joins all windows of words with the lines, and knows no rule of several sentences.
ORACLE = """
WITH phrases(words, identifier, licence, place) AS (VALUES
  ('under the apache license version 2 0', 'ref-Apache-2.0', 'Apache-2.0', 2),
  ('under the gnu general public license version 3', 'ref-GPL-3.0-only', 'GPL-3.0-only', 5),
  ('under the gnu general public license version 2', 'ref-GPL-2.0-only', 'GPL-2.0-only', 4),
  ('under the mit license', 'ref-MIT', 'MIT', 1),
  ('under cc by 4 0', 'ref-CC-BY', 'CC-BY', 6),
  ('under cc by nc 4 0', 'ref-CC-BY-NC', 'CC-BY-NC', 7),
  ('under cc by sa 4 0', 'ref-CC-BY-SA', 'CC-BY-SA', 8),
  ('permission is hereby granted free of charge to any person obtaining a copy', 'mit-grant', 'MIT', 0),
  ('all rights reserved', 'all-rights', 'Proprietary', 9)
), texts AS (
  SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')),
    '[.!?]+(\\s+|$)|\\n[ \\t\\r]*\\n', ' | ', 'g'), '[^a-z0-9+|]+', ' ', 'g')), ' ') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM texts
), windows AS (
  SELECT doc_id, pos, array_to_string(list(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), ' ') AS following FROM words
), found AS (
  SELECT doc_id, pos, identifier, licence, place FROM windows JOIN phrases ON starts_with(following || ' ', words || ' ')
), one AS (
  SELECT doc_id, count(*) AS n, string_agg(identifier, ',' ORDER BY pos) AS ids FROM found GROUP BY doc_id
), licences AS (
  SELECT doc_id, string_agg(licence, ',' ORDER BY place) AS names FROM (SELECT DISTINCT doc_id, licence, place FROM found) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentences, coalesce(names, '') AS licenses
FROM documents d LEFT JOIN one USING (doc_id) LEFT JOIN licences USING (doc_id)
"""


def oracle() -> str:
    return ORACLE
