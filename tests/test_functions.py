"""Expression builders against values known from the dialect."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tamarack.functions import aggregates, arrays, dates, numbers, text
from tamarack.functions import json as js


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


@pytest.mark.parametrize("args", [("US-NY", 0, 3), ("US-NY", 1, 3), ("US-NY", -2, 5), ("US-NY", -9, 6), ("US-NY", 4, -2), ("US-NY", 0, -1), ("US-NY", 9, 2), ("", 1, 1), ("héé", 2, 1)])
def test_substr_as_sqlite(spark, args):
    want = sqlite3.connect(":memory:").execute("SELECT substr(?, ?, ?)", args).fetchone()[0]
    assert value(spark, text.lite_substr(F.lit(args[0]), *args[1:])) == want


@pytest.mark.parametrize("pattern", ["a*", "*[bc]?", "[^a]*", "a.c", "*", "?b?", "[]]*", "a[", "A*"])
def test_glob_as_sqlite(spark, pattern):
    c = sqlite3.connect(":memory:")
    for s in ("abc", "a.c", "]x", "a[", "ABC", "", "xb\n"):
        assert value(spark, text.glob(F.lit(s), pattern)) == bool(c.execute("SELECT ? GLOB ?", (s, pattern)).fetchone()[0]), (s, pattern)


@pytest.mark.parametrize("when", ["2024-01-31", "2024-02-29 23:59:59", "1999-12-31 12:00", "2024-03-10T08:30:15.250Z", "2024-03-10 08:30:15+02:00", "07:30", "2460310.5"])
@pytest.mark.parametrize("mods", [(), ("+1 month",), ("-1 year", "+3 days"), ("start of month", "-1 day"), ("weekday 0",), ("+36 hours",), ("start of year",), ("+0001-02-03 04:05:06",)])
def test_datetime_as_sqlite(spark, when, mods):
    if mods and mods[0].startswith("+0001") and sqlite3.sqlite_version_info < (3, 43):
        pytest.skip("newer than this SQLite")
    want = sqlite3.connect(":memory:").execute(f"SELECT datetime(?{', ?' * len(mods)})", (when, *mods)).fetchone()[0]
    assert value(spark, dates.datetime(F.lit(when), *mods)) == want


@pytest.mark.parametrize("form", ["%Y-%m-%d %H:%M:%S", "%j %w %W", "%f", "%s", "%%x", "plain"])
def test_strftime_as_sqlite(spark, form):
    for when in ("2024-01-01", "2023-12-31 23:59:59.125", "2021-01-03 05:06:07"):
        want = sqlite3.connect(":memory:").execute("SELECT strftime(?, ?)", (form, when)).fetchone()[0]
        assert value(spark, dates.strftime(form, F.lit(when))) == want, (form, when)


def test_unreadable_times_are_null(spark):
    for s in ("", "x", "2024-13-01", "24-01-01"):
        assert value(spark, dates.date(F.lit(s))) is None
    assert value(spark, dates.unixepoch(F.lit("1970-01-02"))) == 86400
    assert value(spark, dates.julianday(F.lit("2024-01-01"))) == 2460310.5
    with pytest.raises(ValueError):
        dates.modify(F.current_timestamp(), "sideways")


def test_division(spark):
    assert value(spark, numbers.int_div(F.lit(-7), F.lit(2))) == -3
    assert value(spark, numbers.int_div(F.lit(7), F.lit(0))) is None
    assert value(spark, numbers.modulo(F.lit(-7), F.lit(3))) == -1
    assert value(spark, numbers.modulo(F.lit(7), F.lit(0))) is None
    assert value(spark, numbers.real_div(F.lit(7), F.lit(2))) == 3.5


def test_years_beyond_9999_have_no_sign(spark):
    day = F.lit("11460310.25")
    assert value(spark, dates.datetime(day)) == "26665-02-28 18:00:00"
    assert value(spark, dates.date(day)) == "26665-02-28"
    assert value(spark, dates.strftime("%F|%Y|%G", day)) == "26665-02-28|26665|26665"
    assert value(spark, dates.datetime(F.lit("5373484"))) == "9999-12-31 12:00:00"


def test_shifts_and_casts(spark):
    assert value(spark, numbers.shift_left(F.lit(1), F.lit(64))) == 0
    assert value(spark, numbers.shift_right(F.lit(-1), F.lit(70))) == -1
    assert value(spark, numbers.shift_left(F.lit(8), F.lit(-2))) == 2
    assert [value(spark, numbers.to_integer(F.lit(s))) for s in ("2.9", "abc", "12abc", None)] == [2, 0, 0, None]
    assert value(spark, numbers.real_text(F.lit(2.0))) == "2.0"


def test_quote_and_like(spark):
    assert value(spark, text.quote(F.lit("it's"))) == "'it''s'"
    assert value(spark, text.lite_like(F.lit("ABC"), "a%")) is True
    assert value(spark, text.lite_like(F.lit("50%"), "50!%", "!")) is True


@pytest.mark.parametrize(("doc", "want"), [('{"b":1,"a":2,"b":3}', '{"a":2,"b":3}'), ("1.50", "1.5"), ("1e2", "100"), ("-0.0", "0"), ('"é"', '"é"'), ("[ 1 , null ]", "[1,null]"), ("12345678901234567890.10", "12345678901234567890.1")])
def test_canonical_json(spark, doc, want):
    assert value(spark, js.canonical(F.lit(doc))) == want


def test_json_editing_as_sqlite(spark):
    c = sqlite3.connect(":memory:")
    doc = '{"a":[1,2],"b":{"c":3}}'
    for name, f in (("json_set", js.json_set), ("json_insert", js.json_insert), ("json_replace", js.json_replace)):
        for path in ("$.a[0]", "$.a[#]", "$.b.c", "$.b.d", "$.x", "$.a[9]"):
            want = c.execute(f"SELECT {name}(?, ?, 7)", (doc, path)).fetchone()[0]
            assert value(spark, f(F.lit(doc), path, F.lit("7"))) == want, (name, path)
    assert value(spark, js.json_remove(F.lit(doc), "$.a[0]", "$.b")) == c.execute("SELECT json_remove(?, '$.a[0]', '$.b')", (doc,)).fetchone()[0]


def test_malformed_json_is_an_error(spark):
    with pytest.raises(Exception, match="malformed JSON"):
        value(spark, js.canonical(F.lit("{oops")))


def test_array_text(spark):
    assert value(spark, arrays.parse(F.lit('{a,NULL,"x y","q\\"z"}'))) == ["a", None, "x y", 'q"z']
    assert value(spark, arrays.parse(F.lit("{}"))) == []
    assert value(spark, arrays.to_text(F.array(F.lit("a"), F.lit(None), F.lit("x y")))) == '{a,NULL,"x y"}'


def test_ordered_aggregates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "i int, s string")
    row = df.agg(aggregates.group_concat(F.col("s"), F.col("i")).alias("a"), aggregates.group_concat(F.col("s"), F.col("i"), distinct=True).alias("d"), aggregates.total(F.col("i")).alias("t"), aggregates.json_group_array(F.col("s"), F.col("i")).alias("j")).head()
    assert tuple(row) == ("a,b,a", "a,b", 10.0, '["a","b",null,"a"]')
    empty = df.filter("false").agg(aggregates.group_concat(F.col("s"), F.col("i")).alias("a"), aggregates.total(F.col("i")).alias("t")).head()
    assert tuple(empty) == (None, 0.0)
