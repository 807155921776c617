"""String and null functions with the dialect's meaning, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lite_substr(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """SUBSTR with the dialect's window: positions before the text count, and a negative
    length takes the characters before the start."""
    start = start if isinstance(start, Column) else F.lit(start)
    size = F.length(s)
    begin = F.when(start > 0, start - 1).when(start < 0, size + start).otherwise(F.lit(-1))
    if length is None:
        low, high = begin, size
    else:
        length = length if isinstance(length, Column) else F.lit(length)
        low = F.when(length < 0, begin + length).otherwise(begin)
        high = F.when(length < 0, begin).otherwise(begin + length)
    low, high = F.greatest(low, F.lit(0)), F.least(high, size)
    return F.when(high > low, F.substring(s, low + 1, high - low)).when(s.isNotNull() & start.isNotNull(), F.lit(""))


def lite_like(s: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE without regard to case; null operands give null."""
    return s.ilike(pattern) if escape is None else F.ilike(s, F.lit(pattern), F.lit(escape))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a GLOB pattern: ``* ? [set] [^set]``."""
    out, i = ["^"], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^")) if c == "[" else -1
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif end > 0:
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:]) + "]")
            i = end
        elif c == "[":
            return "(?!)"  # a set that isn't closed matches nothing
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out) + "$"


def glob(s: Column, pattern: str) -> Column:
    return s.rlike(glob_regex(pattern))


def text_hex(x: Column) -> Column:
    """HEX of the text of a value."""
    return F.hex(x.cast("string"))


def quote(x: Column, kind: str = "string") -> Column:
    """QUOTE: numbers as they are, text in quotes, null as NULL."""
    text = x.cast("string")
    plain = kind not in ("string", "varchar", "char")
    return F.when(x.isNull(), "NULL").otherwise(text if plain else F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")))


def trim_all(s: Column, left: bool = True, right: bool = True) -> Column:
    """TRIM of all white space."""
    ends = [p for p, on in ((r"^[\s ]+", left), (r"[\s ]+$", right)) if on]
    return F.regexp_replace(s, "|".join(ends), "") if ends else s


def typeof(x: Column, kind: str) -> Column:
    """TYPEOF by a column's declared type: null, integer, real, text or blob."""
    named = "integer" if kind in ("tinyint", "smallint", "int", "bigint", "boolean") else "real" if kind in ("float", "double") or kind.startswith("decimal") else "blob" if kind == "binary" else "text"
    return F.when(x.isNull(), "null").otherwise(named)


def concat_skip(*xs: Column) -> Column:
    """CONCAT, in which nulls are empty."""
    return F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in xs])
