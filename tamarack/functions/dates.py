"""Date and time functions over text, as columns of built-in functions (UTC).

Time values are texts: ISO dates with or without a time, a zone of +HH:MM or Z, a time
alone (on 2000-01-01), or a Julian day number.  What can't be read is null.  Formats and
modifiers are literals, so they become expressions when the plan is built.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\s*(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2})(?::(\d{2})(\.\d+)?)?)?\s*(Z|[+-]\d{2}:\d{2})?\s*$"
_TIME = r"^\s*(\d{2}:\d{2})(?::(\d{2})(\.\d+)?)?\s*(Z|[+-]\d{2}:\d{2})?\s*$"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse(s: Column) -> Column:
    """A timestamp (without zone, in UTC) for a time value."""
    return let(s.cast("string"), _parse)


def _parse(s: Column) -> Column:
    group = lambda p, i: F.regexp_extract(s, p, i)
    part = lambda x, other: F.when(x == "", other).otherwise(x)

    def build(day: Column, hm: Column, sec: Column, frac: Column, zone: Column) -> Column:
        text = F.concat(day, F.lit(" "), part(hm, "00:00"), F.lit(":"), part(sec, "00"), frac)
        at = F.try_to_timestamp(text).cast("timestamp_ntz")
        minutes = F.regexp_extract(zone, r"(\d{2}):(\d{2})", 1).try_cast("int") * 60 + F.regexp_extract(zone, r"(\d{2}):(\d{2})", 2).try_cast("int")
        shift = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
        return F.when(zone.isin("", "Z"), at).otherwise(at - F.make_dt_interval(mins=shift))

    julian = s.try_cast("double")
    return (
        F.when(s.rlike(_ISO), build(group(_ISO, 1), group(_ISO, 2), group(_ISO, 3), group(_ISO, 4), group(_ISO, 5)))
        .when(s.rlike(_TIME), build(F.lit("2000-01-01"), group(_TIME, 1), group(_TIME, 2), group(_TIME, 3), group(_TIME, 4)))
        .when(julian.isNotNull(), from_julian(julian))
    )


def _instant(t: Column) -> Column:
    return t.cast("timestamp")


def from_julian(day: Column) -> Column:
    return F.timestamp_millis(F.round((day - 2440587.5) * 86400000.0).cast("bigint")).cast("timestamp_ntz")


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_millis(F.round(seconds.cast("double") * 1000).cast("bigint")).cast("timestamp_ntz")


def _seconds(t: Column, seconds: Column) -> Column:
    return t + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _months(t: Column, months: int) -> Column:
    """Adds months to the date's numbers; days beyond the month's end run into the next."""

    def moved(t: Column) -> Column:
        first = F.date_trunc("month", t).cast("timestamp_ntz")
        return F.add_months(first.cast("date"), months).cast("timestamp_ntz") + (t - first)

    return let(t, moved)


def modify(t: Column, modifier: str) -> Column:
    """Applies one modifier."""
    m = modifier.strip().lower()
    if found := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*(day|hour|minute|second|month|year)s?", m):
        n, unit = float(found[1]), found[2]
        if unit in ("month", "year"):
            whole = int(n) * (12 if unit == "year" else 1)
            rest = (n - int(n)) * (365 if unit == "year" else 30) * 86400
            return _seconds(_months(t, whole), F.lit(round(rest, 6))) if rest else _months(t, whole)
        return _seconds(t, F.lit(n * {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]))
    if found := re.fullmatch(r"start of (day|month|year)", m):
        return F.date_trunc(found[1], t).cast("timestamp_ntz")
    if found := re.fullmatch(r"weekday (\d)", m):
        return let(t, lambda t: t + F.make_dt_interval(days=F.pmod(F.lit(int(found[1]) + 1) - F.dayofweek(t), F.lit(7))))
    if found := re.fullmatch(r"([+-])(\d{4})-(\d{2})-(\d{2})(?: (\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?)?", m):
        sign = -1 if found[1] == "-" else 1
        moved = _months(t, sign * (int(found[2]) * 12 + int(found[3])))
        seconds = int(found[4]) * 86400 + int(found[5] or 0) * 3600 + int(found[6] or 0) * 60 + float(found[7] or 0)
        return _seconds(moved, F.lit(sign * seconds))
    if m in ("utc", "localtime", "subsec", "subsecond", "ceiling", "floor", "auto"):
        return t
    raise ValueError(f"no such modifier: {modifier}")


def moment(value: Column, *modifiers: str) -> Column:
    """The timestamp of a time value after its modifiers."""
    rest = list(modifiers)
    if rest and rest[0].lower() == "unixepoch":
        t = from_epoch(value.try_cast("double"))
        rest = rest[1:]
    elif rest and rest[0].lower() == "julianday":
        t = from_julian(value.try_cast("double"))
        rest = rest[1:]
    else:
        t = parse(value)
    for m in rest:
        t = modify(t, m)
    return t


def _wants_fraction(modifiers: tuple[str, ...]) -> bool:
    return any(m.lower() in ("subsec", "subsecond") for m in modifiers)


def dated(t: Column, form: str) -> Column:
    """A timestamp in a form that begins with the year; years beyond 9999 have no sign."""
    return F.ltrim(F.date_format(t, form), F.lit("+"))


def date(value: Column, *modifiers: str) -> Column:
    return dated(moment(value, *modifiers), "yyyy-MM-dd")


def time(value: Column, *modifiers: str) -> Column:
    return F.date_format(moment(value, *modifiers), "HH:mm:ss.SSS" if _wants_fraction(modifiers) else "HH:mm:ss")


def datetime(value: Column, *modifiers: str) -> Column:
    return dated(moment(value, *modifiers), "yyyy-MM-dd HH:mm:ss.SSS" if _wants_fraction(modifiers) else "yyyy-MM-dd HH:mm:ss")


def julianday(value: Column, *modifiers: str) -> Column:
    return F.unix_micros(_instant(moment(value, *modifiers))) / 86400e6 + 2440587.5


def unixepoch(value: Column, *modifiers: str) -> Column:
    micros = F.unix_micros(_instant(moment(value, *modifiers)))
    return micros / 1e6 if _wants_fraction(modifiers) else F.floor(micros / 1e6).cast("bigint")


def strftime(form: str, value: Column, *modifiers: str) -> Column:
    """STRFTIME with a literal format; unknown codes are echoed."""
    return let(moment(value, *modifiers), lambda t: _strftime(form, t))


def _strftime(form: str, t: Column) -> Column:
    fmt = lambda p: F.date_format(t, p)
    pad = lambda x, n, c="0": F.lpad(x.cast("string"), n, c)
    day_of_year, weekday = F.dayofyear(t), F.dayofweek(t) - 1
    iso_year = F.extract(F.lit("YEAROFWEEK"), t)
    hour12 = F.pmod(F.hour(t) + 11, F.lit(12)) + 1
    half = F.when(F.hour(t) < 12, "AM").otherwise("PM")
    codes = {
        "d": fmt("dd"), "e": pad(F.dayofmonth(t), 2, " "), "f": fmt("ss.SSS"), "F": dated(t, "yyyy-MM-dd"), "g": pad(iso_year % 100, 2), "G": F.when(iso_year > 9999, iso_year.cast("string")).otherwise(pad(iso_year, 4)),
        "H": fmt("HH"), "I": pad(hour12, 2), "j": pad(day_of_year, 3), "J": julian_text(t), "k": pad(F.hour(t), 2, " "), "l": pad(hour12, 2, " "),
        "m": fmt("MM"), "M": fmt("mm"), "p": half, "P": F.lower(half), "R": fmt("HH:mm"), "s": F.unix_seconds(_instant(t)).cast("string"), "S": fmt("ss"),
        "T": fmt("HH:mm:ss"), "u": (F.pmod(weekday + 6, F.lit(7)) + 1).cast("string"), "U": pad(F.floor((day_of_year + 6 - weekday) / 7), 2),
        "V": pad(F.weekofyear(t), 2), "w": weekday.cast("string"), "W": pad(F.floor((day_of_year + 6 - F.pmod(weekday + 6, F.lit(7))) / 7), 2), "Y": dated(t, "yyyy"), "%": F.lit("%"),
    }
    parts = [codes.get(x[1:], F.lit(x)) if x.startswith("%") else F.lit(x) for x in re.findall(r"%.|[^%]+|%$", form, re.S)]
    return F.when(t.isNotNull(), F.concat(*parts)) if parts else F.when(t.isNotNull(), F.lit(""))


def julian_text(t: Column) -> Column:
    return (F.unix_micros(_instant(t)) / 86400e6 + 2440587.5).cast("string")


def timediff(a: Column, b: Column) -> Column:
    """The calendar difference a - b as +YYYY-MM-DD HH:MM:SS.SSS."""
    return let(F.struct(parse(a).alias("a"), parse(b).alias("b")), lambda s: _timediff(s["a"], s["b"]))


def _timediff(x: Column, y: Column) -> Column:
    sign = F.when(x < y, "-").otherwise("+")
    late, early = F.greatest(x, y), F.least(x, y)
    months = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early)
    first = F.date_trunc("month", early).cast("timestamp_ntz")
    moved = lambda n: F.add_months(first.cast("date"), n).cast("timestamp_ntz") + (early - first)
    # Days past a short month's end may take two months back.
    months = let(months, lambda n: F.when(moved(n) <= late, n).when(moved(n - 1) <= late, n - 1).otherwise(n - 2))
    whole = lambda n: F.floor(n).cast("bigint")

    def text(v: Column) -> Column:
        n, ms = v["months"], v["millis"]
        return F.format_string(
            "%04d-%02d-%02d %02d:%02d:%02d.%03d",
            whole(n / 12), (n % 12).cast("bigint"), whole(ms / 86400000), whole(ms / 3600000) % 24, whole(ms / 60000) % 60, whole(ms / 1000) % 60, ms % 1000,
        )

    rest = lambda n: whole((F.unix_micros(_instant(late)) - F.unix_micros(_instant(moved(n)))) / 1000)
    both = let(months, lambda n: F.struct(n.alias("months"), rest(n).alias("millis")))
    return F.when(x.isNotNull() & y.isNotNull(), F.concat(sign, let(both, text)))
