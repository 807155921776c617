"""Scalar functions, dates, arrays, JSON and ordered aggregates, through the function library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates, arrays, dates, numbers, text
from ..functions import json as js
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, source: str, columns: Callable[[], dict[str, Column]] | Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """A query that adds columns to a table's key, or makes a table of another."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        if columns.__code__.co_argcount:
            return columns(df)
        return df.select(*[c.alias(n) for n, c in columns().items()])

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


c = F.col
# Strings, nulls and numbers
add("upper_lower_length", "part", lambda: {"k": c("p_partkey"), "u": F.upper("p_name"), "l": F.lower("p_type"), "n": F.length("p_name").cast("bigint"), "b": F.octet_length("p_name").cast("bigint")}, "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, strlen(p_name) AS b FROM part")
add("substr_window", "part", lambda: {"k": c("p_partkey"), "a": text.lite_substr(c("p_name"), 0, 3), "b": text.lite_substr(c("p_name"), 2, 3), "d": text.lite_substr(c("p_name"), -3, 2), "e": text.lite_substr(c("p_name"), 4, -2), "f": text.lite_substr(c("p_name"), 3)}, "SELECT p_partkey AS k, substr(p_name, 1, 2) AS a, substr(p_name, 2, 3) AS b, substr(p_name, length(p_name) - 2, 2) AS d, substr(p_name, 2, 2) AS e, substr(p_name, 3) AS f FROM part")
add("trim_functions", "part", lambda: {"k": c("p_partkey"), "t": text.trim_all(F.concat(F.lit(" \t"), c("p_name"), F.lit(" \n"))), "l": F.ltrim(F.concat(F.lit("  "), c("p_name"))), "r": F.rtrim(F.concat(c("p_name"), F.lit("  ")))}, "SELECT p_partkey AS k, p_name AS t, p_name AS l, p_name AS r FROM part")
add("replace_instr", "part", lambda: {"k": c("p_partkey"), "r": F.replace(c("p_name"), F.lit("a"), F.lit("[A]")), "i": F.instr("p_name", "e").cast("bigint")}, "SELECT p_partkey AS k, replace(p_name, 'a', '[A]') AS r, instr(p_name, 'e')::BIGINT AS i FROM part")
add("coalesce_nullif", "lineitem", lambda: {"k": c("l_orderkey"), "n": c("l_linenumber"), "p": c("l_partkey"), "c": F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("none")), "i": F.ifnull(F.nullif(c("l_linenumber"), F.lit(1)), F.lit(-1))}, "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, coalesce(nullif(l_returnflag, 'N'), 'none') AS c, ifnull(nullif(l_linenumber, 1), -1) AS i FROM lineitem")
add("typeof_values", "orders", lambda: {"k": c("o_orderkey"), "a": text.typeof(F.nullif("o_orderkey", F.lit(1)), "bigint"), "b": text.typeof(c("o_totalprice"), "double"), "d": text.typeof(c("o_orderstatus"), "string")}, "SELECT o_orderkey AS k, CASE WHEN o_orderkey = 1 THEN 'null' ELSE 'integer' END AS a, 'real' AS b, 'text' AS d FROM orders")
add("printf_format", "orders", lambda: {"k": c("o_orderkey"), "f": F.format_string("%d:%s:%.2f", "o_orderkey", "o_orderstatus", "o_totalprice")}, "SELECT o_orderkey AS k, printf('%d:%s:%.2f', o_orderkey, o_orderstatus, o_totalprice) AS f FROM orders")
add("hex_unhex", "nation", lambda: {"k": c("n_nationkey"), "h": text.text_hex(c("n_name")), "d": text.text_hex(c("n_nationkey")), "u": F.try_to_binary(text.text_hex(c("n_name")), F.lit("hex")).cast("string")}, "SELECT n_nationkey AS k, hex(n_name) AS h, hex(n_nationkey::VARCHAR) AS d, n_name AS u FROM nation")
add("zeroblob", "region", lambda: {"k": c("r_regionkey"), "z": F.hex(F.unhex(F.repeat(F.lit("00"), c("r_regionkey") + 1)))}, "SELECT r_regionkey AS k, repeat('00', r_regionkey + 1) AS z FROM region")
add("glob", "part", lambda df: df.filter(text.glob(c("p_name"), "*[aeiou]*")).select(c("p_partkey").alias("k")), "SELECT p_partkey AS k FROM part WHERE p_name GLOB '*[aeiou]*'")
add("quote", "customer", lambda: {"k": c("c_custkey"), "t": text.quote(F.nullif("c_mktsegment", F.lit("BUILDING"))), "n": text.quote(c("c_custkey"), "bigint")}, "SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NULL' ELSE '''' || c_mktsegment || '''' END AS t, c_custkey::VARCHAR AS n FROM customer")
add("rounding", "lineitem", lambda: {"k": c("l_orderkey"), "n": c("l_linenumber"), "p": c("l_partkey"), "r": F.round("l_extendedprice"), "c": F.ceil("l_extendedprice"), "f": F.floor("l_extendedprice"), "a": F.abs(c("l_linenumber") - 4), "g": F.round(-c("l_quantity") / 8)}, "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, round(l_extendedprice) AS r, ceil(l_extendedprice)::BIGINT AS c, floor(l_extendedprice)::BIGINT AS f, abs(l_linenumber - 4) AS a, round(-l_quantity / 8) AS g FROM lineitem")
add("integer_division", "lineitem", lambda: {"k": c("l_orderkey"), "n": c("l_linenumber"), "p": c("l_partkey"), "d": numbers.int_div(c("l_orderkey") - 500, c("l_linenumber") - 3), "m": numbers.modulo(c("l_orderkey") - 500, c("l_linenumber") - 3), "r": F.round(numbers.real_div(c("l_orderkey"), c("l_linenumber") - 3), 9)}, "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, (l_orderkey - 500) // nullif(l_linenumber - 3, 0) AS d, (l_orderkey - 500) % nullif(l_linenumber - 3, 0) AS m, round(l_orderkey / nullif(l_linenumber - 3, 0), 9) AS r FROM lineitem")
add("shifts", "nation", lambda: {"k": c("n_nationkey"), "l": numbers.shift_left(c("n_nationkey") + 1, c("n_regionkey")), "r": numbers.shift_right(c("n_nationkey") * 1000, c("n_regionkey")), "n": numbers.shift_left(F.lit(1024), -c("n_regionkey")), "o": numbers.shift_left(F.lit(1), c("n_regionkey") + 64), "s": numbers.shift_right(F.lit(-5), c("n_regionkey") + 64)}, "SELECT n_nationkey AS k, (n_nationkey + 1)::BIGINT << n_regionkey AS l, (n_nationkey * 1000)::BIGINT >> n_regionkey AS r, 1024 >> n_regionkey AS n, 0 AS o, -1 AS s FROM nation")
add("casts", "documents", lambda: {"k": c("doc_id"), "i": numbers.to_integer(F.concat(c("doc_id").cast("string"), F.lit(".9"))), "z": numbers.to_integer(c("lang")), "r": numbers.to_real(F.concat(c("doc_id").cast("string"), F.lit(".25"))), "t": c("doc_id").cast("string"), "b": F.hex(c("lang").cast("binary"))}, "SELECT doc_id AS k, doc_id AS i, 0 AS z, doc_id + 0.25 AS r, doc_id::VARCHAR AS t, hex(lang) AS b FROM documents")
add("truthiness", "labels", lambda: {"k": c("doc_id"), "n": numbers.truth(c("quality"), "bigint"), "s": numbers.truth(c("toxic").cast("string"), "string"), "z": numbers.truth(F.nullif("quality", F.lit(1)), "bigint")}, "SELECT doc_id AS k, quality <> 0 AS n, toxic <> 0 AS s, false AS z FROM labels")
add("extremes", "lineitem", lambda: {"k": c("l_orderkey"), "n": c("l_linenumber"), "p": c("l_partkey"), "g": numbers.greatest_null(c("l_quantity"), F.nullif("l_tax", F.lit(0.0)), F.lit(10.0)), "l": numbers.least_null(c("l_quantity"), F.lit(10.0))}, "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE WHEN l_tax <> 0 THEN greatest(l_quantity, l_tax, 10) END AS g, least(l_quantity, 10) AS l FROM lineitem")
add("concat_functions", "lineitem", lambda: {"k": c("l_orderkey"), "n": c("l_linenumber"), "p": c("l_partkey"), "c": text.concat_skip(c("l_returnflag"), F.nullif("l_linestatus", F.lit("O")), F.lit("!")), "w": F.concat_ws("-", "l_returnflag", F.nullif("l_linestatus", F.lit("O")), F.lit("z"))}, "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, concat(l_returnflag, nullif(l_linestatus, 'O'), '!') AS c, concat_ws('-', l_returnflag, nullif(l_linestatus, 'O'), 'z') AS w FROM lineitem")
add("iif", "orders", lambda: {"k": c("o_orderkey"), "v": F.when(c("o_totalprice") > 100000, "big").otherwise("small")}, "SELECT o_orderkey AS k, if(o_totalprice > 100000, 'big', 'small') AS v FROM orders")
add("percent_diff", "part", lambda: {"k": c("p_partkey"), "d": F.round(numbers.percent_diff(c("p_size"), c("p_retailprice")), 6)}, "SELECT p_partkey AS k, CASE WHEN p_size = 0 THEN 'inf'::DOUBLE ELSE round((p_retailprice - p_size) / p_size * 100, 6) END AS d FROM part")
add("random_range", "region", lambda: {"k": c("r_regionkey"), "ok": (F.rand() * F.lit(9.2e18)).cast("bigint") >= 0}, "SELECT r_regionkey AS k, true AS ok FROM region")
# Dates, as text


def ship() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")


add("date_parts", "orders", lambda: {"k": c("o_orderkey"), "d": dates.date(ship()), "t": dates.time(ship()), "dt": dates.datetime(ship())}, "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt FROM orders")
add("julian_epoch", "orders", lambda: {"k": c("o_orderkey"), "j": F.round(dates.julianday(ship()), 6), "u": dates.unixepoch(ship())}, "SELECT o_orderkey AS k, round(epoch(o_orderdate) / 86400 + 2440587.5, 6) AS j, epoch(o_orderdate)::BIGINT AS u FROM orders")
add("strftime_codes", "orders", lambda: {"k": c("o_orderkey"), "a": dates.strftime("%Y/%m/%d %H:%M:%S|%j|%w|%u|%%", ship()), "b": dates.strftime("%F %T %R %G-%V", ship()), "w": dates.strftime("%U %W", ship()), "i": dates.strftime("%I %p %e", ship())}, "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S|%j|%w|%u|%%') AS a, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S %H:%M %G-%V') AS b, strftime(o_orderdate, '%U %W') AS w, strftime(o_orderdate, '%I %p ') || lpad(day(o_orderdate)::VARCHAR, 2, ' ') AS i FROM orders")
add("modifiers_units", "orders", lambda: {"k": c("o_orderkey"), "a": dates.datetime(ship(), "+10 days", "-3 hours"), "b": dates.datetime(ship(), "+90 minutes", "+1.5 seconds"), "y": dates.date(dates.date(ship()), "start of month", "+1 month", "-1 day")}, "SELECT o_orderkey AS k, strftime(o_orderdate + INTERVAL 10 DAY - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate + INTERVAL 90 MINUTE + INTERVAL 1500 MILLISECOND, '%Y-%m-%d %H:%M:%S') AS b, strftime(last_day(o_orderdate), '%Y-%m-%d') AS y FROM orders")
add("modifiers_months", "orders", lambda: {"k": c("o_orderkey"), "m": dates.date(dates.date(ship()), "+1 month"), "y": dates.date(dates.date(ship()), "-1 year")}, "SELECT o_orderkey AS k, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(day(o_orderdate)::INT - 1), '%Y-%m-%d') AS m, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 YEAR + to_days(day(o_orderdate)::INT - 1), '%Y-%m-%d') AS y FROM orders")
add("modifiers_start_weekday", "orders", lambda: {"k": c("o_orderkey"), "s": dates.date(ship(), "start of year"), "m": dates.datetime(ship(), "start of day"), "w": dates.date(ship(), "weekday 1")}, "SELECT o_orderkey AS k, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS s, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') AS m, strftime(o_orderdate + to_days(((8 - dayofweek(o_orderdate)) % 7)::INT), '%Y-%m-%d') AS w FROM orders")
add("time_values", "orders", lambda: {"k": c("o_orderkey"), "z": dates.datetime(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:30:00+02:30"))), "e": dates.datetime(c("o_orderkey").cast("string"), "unixepoch"), "j": dates.datetime((c("o_orderkey") + 2460310).cast("string")), "bad": dates.date(F.lit("no date")), "t": dates.datetime(F.lit("07:05"))}, "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') || ' 08:00:00' AS z, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%d %H:%M:%S') AS e, strftime(TIMESTAMP '2023-12-31 12:00:00' + to_days(o_orderkey::INT), '%Y-%m-%d %H:%M:%S') AS j, NULL AS bad, '2000-01-01 07:05:00' AS t FROM orders")
add("timediff", "orders", lambda: {"k": c("o_orderkey"), "d": dates.timediff(dates.datetime(ship(), "+35 days", "+5 hours"), dates.datetime(dates.datetime(ship()), "+5 days"))}, "SELECT o_orderkey AS k, '+' || CASE WHEN day(last_day(o_orderdate + INTERVAL 5 DAY)) <= 30 THEN '0000-01-' || lpad((30 - day(last_day(o_orderdate + INTERVAL 5 DAY)))::VARCHAR, 2, '0') ELSE '0000-00-30' END || ' 05:00:00.000' AS d FROM orders")
add("clock", "region", lambda: {"k": c("r_regionkey"), "ok": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")}, "SELECT r_regionkey AS k, true AS ok FROM region")
add("date_trunc_extract", "orders", lambda df: df.groupBy(F.year("o_orderdate").cast("bigint").alias("y"), F.month("o_orderdate").cast("bigint").alias("m")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s")), "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY ALL")
# Arrays


def vec() -> Column:
    return c("embedding")


add("array_subscript", "embeddings", lambda: {"k": c("vec_id"), "a": arrays.subscript(vec(), 1).cast("double"), "z": arrays.subscript(vec(), 65).cast("double"), "o": arrays.subscript(vec(), 0).cast("double"), "n": arrays.length(vec()).cast("bigint"), "e": arrays.length(F.array().cast("array<int>")).cast("bigint")}, "SELECT vec_id AS k, embedding[1]::DOUBLE AS a, NULL AS z, NULL AS o, len(embedding) AS n, NULL AS e FROM embeddings")
add("array_any_all", "embeddings", lambda: {"k": c("vec_id"), "any": arrays.any_of(F.lit(0.2), "<", vec()), "all": arrays.all_of(F.lit(-0.4), "<", vec()), "none": arrays.any_of(F.lit(1), "=", F.array().cast("array<int>")), "unknown": arrays.any_of(F.lit(3), "=", F.array(F.lit(1), F.lit(None).cast("int")))}, "SELECT vec_id AS k, list_max(embedding) > 0.2 AS any, list_min(embedding) > -0.4 AS all, false AS none, NULL AS unknown FROM embeddings")
add("array_containment", "lineitem", lambda df: df.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a")).select("l_orderkey", arrays.contains(c("a"), F.array(F.lit(1), F.lit(1))).alias("has"), arrays.contains(F.array(*map(F.lit, range(1, 4))), c("a")).alias("within")), "SELECT l_orderkey, list_has_all(list(l_linenumber), [1, 1]) AS has, list_has_all([1, 2, 3], list(l_linenumber)) AS within FROM lineitem GROUP BY l_orderkey")
add("array_literal", "nation", lambda: {"k": c("n_nationkey"), "t": arrays.to_text(F.array(c("n_name"), F.lit(None), F.lit("a b"), F.lit('q"\\'), F.lit(""))), "n": arrays.length(arrays.parse(F.concat(F.lit('{1,NULL,"x y",'), c("n_name"), F.lit("}")))).cast("bigint"), "x": arrays.subscript(arrays.parse(F.lit('{1,NULL,"x y"}')), 3), "i": arrays.subscript(arrays.parse(F.lit("{4,5}"), "bigint"), 2), "bad": arrays.parse(F.lit("1,2")).isNull()}, """SELECT n_nationkey AS k, '{' || n_name || ',NULL,"a b","q\\"\\\\",""}' AS t, 4 AS n, 'x y' AS x, 5 AS i, true AS bad FROM nation""")
add("array_functions", "lineitem", lambda df: df.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a")).select("l_orderkey", F.array_join(F.array_append("a", F.lit(99)), ",").alias("appended"), F.array_join(F.slice("a", 1, 2), ",").alias("first"), F.array_position("a", 1).alias("at"), F.aggregate("a", F.lit(0), lambda s, x: s + x).cast("bigint").alias("total")), "SELECT l_orderkey, array_to_string(list_append(list_sort(list(l_linenumber)), 99), ',') AS appended, array_to_string(list_sort(list(l_linenumber))[1:2], ',') AS first, coalesce(list_position(list_sort(list(l_linenumber)), 1), 0)::BIGINT AS at, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY l_orderkey")
add("array_dot_product", "embeddings", lambda: {"k": c("vec_id"), "d": F.round(F.sqrt(F.aggregate(F.transform(vec(), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)), 5)}, "SELECT vec_id AS k, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 5) AS d FROM embeddings")
# JSON as text


def props() -> Column:
    return c("props")


add("json_extract", "events", lambda: {"k": c("event_id"), "t": js.extract_text(props(), "$.k").cast("bigint"), "j": js.extract(props(), "$.k"), "m": js.extract(props(), "$.none"), "b": js.extract(props(), "$.k", "$.none")}, "SELECT event_id AS k, (props->>'$.k')::BIGINT AS t, props->>'$.k' AS j, NULL AS m, '[' || (props->>'$.k') || ',null]' AS b FROM events")
add("json_type_valid", "events", lambda: {"k": c("event_id"), "v": js.valid(props()), "bad": js.valid(F.lit("{oops")), "t": js.json_type(props()), "i": js.json_type(props(), "$.k"), "r": js.json_type(F.lit("[1.5, null, true]"), "$[0]"), "n": js.json_type(F.lit("[1.5, null, true]"), "$[-1]")}, "SELECT event_id AS k, 1 AS v, 0 AS bad, 'object' AS t, 'integer' AS i, 'real' AS r, 'true' AS n FROM events")
add("json_edit", "events", lambda: {"k": c("event_id"), "s": js.json_set(props(), "$.new", F.lit("[1]")), "i": js.json_insert(props(), "$.k", F.lit("0")), "r": js.json_replace(props(), "$.k", F.lit("0")), "a": js.json_set(F.lit("[1,2]"), "$[#]", F.lit("3")), "d": js.json_remove(props(), "$.k")}, """SELECT event_id AS k, '{"k":' || (props->>'$.k') || ',"new":[1]}' AS s, '{"k":' || (props->>'$.k') || '}' AS i, '{"k":0}' AS r, '[1,2,3]' AS a, '{}' AS d FROM events""")
add("json_build", "nation", lambda: {"k": c("n_nationkey"), "a": F.to_json(F.array("n_nationkey", "n_regionkey")), "o": F.to_json(F.struct(c("n_name").alias("name"), c("n_regionkey").alias("region")), {"ignoreNullFields": "false"}), "q": js.quote(F.concat(c("n_name"), F.lit('"'))), "l": js.array_length(F.lit("[1,2,3]")).cast("bigint"), "z": js.array_length(F.lit("{}")).cast("bigint")}, """SELECT n_nationkey AS k, '[' || n_nationkey || ',' || n_regionkey || ']' AS a, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS o, '"' || n_name || '\\""' AS q, 3 AS l, 0 AS z FROM nation""")
add("json_minify", "events", lambda: {"k": c("event_id"), "m": js.minify(props())}, """SELECT event_id AS k, '{"k":' || (props->>'$.k') || '}' AS m FROM events""")
# Canonical JSONB
add("jsonb_canonical", "nation", lambda: {"k": c("n_nationkey"), "c": js.canonical(F.concat(F.lit('{"b": 1.50, "a": 1e2, "z": -0.0, "b": '), c("n_nationkey"), F.lit("}")))}, """SELECT n_nationkey AS k, '{"a":100,"b":' || n_nationkey || ',"z":0}' AS c FROM nation""")
add("jsonb_contains", "nation", lambda: {"k": c("n_nationkey"), "a": js.contains(F.lit('{"a":{"b":1,"c":2},"d":[1,2,3]}'), F.lit('{"a":{"b":1},"d":[3]}')), "b": js.contains(F.lit("[1,2]"), F.lit("2")), "n": js.contains(F.concat(F.lit('{"k":'), c("n_nationkey"), F.lit("}")), F.lit('{"k":3}'))}, "SELECT n_nationkey AS k, true AS a, true AS b, n_nationkey = 3 AS n FROM nation")
add("jsonb_keys", "events", lambda: {"k": c("event_id"), "has": js.has_key(props(), "k"), "any": js.has_any_key(props(), "z", "k"), "all": js.has_all_keys(props(), "z", "k"), "keys": F.array_join(js.keys(F.lit('{"b":1,"a":2}')), ",")}, "SELECT event_id AS k, true AS has, true AS any, false AS all, 'a,b' AS keys FROM events")
add("jsonb_concat_delete", "events", lambda: {"k": c("event_id"), "m": js.concat(props(), F.lit('{"a":1}')), "l": js.concat(F.lit("[1]"), F.lit("2")), "d": js.minus_key(props(), "k"), "i": js.minus_key(F.lit("[1,2,3]"), -1), "s": js.minus_key(F.lit('["a","b"]'), ["a"])}, """SELECT event_id AS k, '{"a":1,"k":' || (props->>'$.k') || '}' AS m, '[1,2]' AS l, '{}' AS d, '[1,2]' AS i, '["b"]' AS s FROM events""")
add("jsonb_pretty_strip", "region", lambda: {"k": c("r_regionkey"), "p": js.pretty_text(F.lit('{"b":[1],"a":null}')), "s": js.strip(F.lit('{"b":[1,null],"a":null}'))}, """SELECT r_regionkey AS k, '{' || chr(10) || '    "a": null,' || chr(10) || '    "b": [' || chr(10) || '        1' || chr(10) || '    ]' || chr(10) || '}' AS p, '{"b":[1,null]}' AS s FROM region""")
add("jsonb_each", "events", lambda df: df.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value")), "SELECT event_id, 'k' AS name, props->>'$.k' AS value FROM events")
add("jsonb_array_elements", "nation", lambda df: df.select("n_nationkey", F.posexplode(F.from_json(F.concat(F.lit("["), c("n_nationkey"), F.lit(",null,7]")), "array<string>")).alias("pos", "value")), "SELECT n_nationkey, pos::INT AS pos, value FROM (SELECT n_nationkey, 0 AS pos, n_nationkey::VARCHAR AS value FROM nation UNION ALL SELECT n_nationkey, 1, NULL FROM nation UNION ALL SELECT n_nationkey, 2, '7' FROM nation)")
add("jsonb_object_keys", "nation", lambda df: df.select("n_nationkey", F.explode(js.keys(F.lit('{"b":1,"a":2}'))).alias("key")), "SELECT n_nationkey, unnest(['a', 'b']) AS key FROM nation")
add("jsonb_arrow", "events", lambda: {"k": c("event_id"), "a": js.at_path(js.concat(props(), F.lit('{"s":"x","l":[1,2]}')), "s"), "t": js.text_at_path(js.concat(props(), F.lit('{"s":"x","l":[1,2]}')), "s"), "i": js.at_path(props(), "k"), "l": js.at_path(js.concat(props(), F.lit('{"l":[1,2]}')), "l", -1), "m": js.text_at_path(props(), "none")}, """SELECT event_id AS k, '"x"' AS a, 'x' AS t, props->>'$.k' AS i, '2' AS l, NULL AS m FROM events""")
add("jsonb_delete_path", "events", lambda: {"k": c("event_id"), "d": js.delete_path(js.concat(props(), F.lit('{"l":[1,{"a":2,"b":3}]}')), "l", 1, "a"), "n": js.delete_path(props(), "none", "x"), "e": js.delete_path(props(), "k")}, """SELECT event_id AS k, '{"k":' || (props->>'$.k') || ',"l":[1,{"b":3}]}' AS d, '{"k":' || (props->>'$.k') || '}' AS n, '{}' AS e FROM events""")
add("jsonb_set_path", "events", lambda: {"k": c("event_id"), "s": js.set_path(props(), ["k"], F.lit('"new"')), "a": js.set_path(props(), ["z"], F.lit("[1]")), "n": js.set_path(props(), ["z"], F.lit("[1]"), create=False), "l": js.set_path(F.concat(F.lit("["), js.at_path(props(), "k"), F.lit(",2]")), [-1], F.lit("9"))}, """SELECT event_id AS k, '{"k":"new"}' AS s, '{"k":' || (props->>'$.k') || ',"z":[1]}' AS a, '{"k":' || (props->>'$.k') || '}' AS n, '[' || (props->>'$.k') || ',9]' AS l FROM events""")
add("jsonb_insert_path", "nation", lambda: {"k": c("n_nationkey"), "b": js.insert_path(F.to_json(F.array("n_nationkey", "n_regionkey")), [1], F.lit('"x"')), "a": js.insert_path(F.to_json(F.array("n_nationkey", "n_regionkey")), [1], F.lit('"x"'), after=True), "o": js.insert_path(F.to_json(F.struct(c("n_name").alias("b"))), ["a"], F.lit("1"))}, """SELECT n_nationkey AS k, '[' || n_nationkey || ',"x",' || n_regionkey || ']' AS b, '[' || n_nationkey || ',' || n_regionkey || ',"x"]' AS a, '{"a":1,"b":"' || n_name || '"}' AS o FROM nation""")
add("to_jsonb", "nation", lambda: {"k": c("n_nationkey"), "n": js.to_jsonb(c("n_nationkey")), "s": js.to_jsonb(c("n_name")), "b": js.to_jsonb(c("n_nationkey") > 3), "z": js.to_jsonb(F.nullif("n_nationkey", c("n_nationkey"))), "l": js.to_jsonb(F.array("n_name", F.nullif("n_name", c("n_name"))))}, """SELECT n_nationkey AS k, n_nationkey::VARCHAR AS n, '"' || n_name || '"' AS s, CASE WHEN n_nationkey > 3 THEN 'true' ELSE 'false' END AS b, NULL AS z, '["' || n_name || '",null]' AS l FROM nation""")
add("jsonb_typeof", "events", lambda: {"k": c("event_id"), "o": js.jsonb_typeof(props()), "n": js.jsonb_typeof(js.at_path(props(), "k")), "s": js.jsonb_typeof(js.to_jsonb(c("event_id").cast("string"))), "a": js.jsonb_typeof(F.to_json(F.array("event_id"))), "z": js.jsonb_typeof(F.lit(" null ")), "m": js.jsonb_typeof(js.at_path(props(), "none"))}, "SELECT event_id AS k, 'object' AS o, 'number' AS n, 'string' AS s, 'array' AS a, 'null' AS z, NULL AS m FROM events")
# Aggregates
add("total", "orders", lambda df: df.groupBy("o_orderstatus").agg(F.round(aggregates.total(F.when(c("o_orderstatus") != "P", c("o_totalprice"))), 2).alias("t")), "SELECT o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE round(sum(o_totalprice), 2) END AS t FROM orders GROUP BY o_orderstatus")
add("group_concat", "nation", lambda df: df.groupBy("n_regionkey").agg(aggregates.group_concat(c("n_name"), c("n_nationkey")).alias("names"), aggregates.group_concat(c("n_regionkey"), c("n_nationkey"), "|", distinct=True).alias("once"), aggregates.string_agg(c("n_name"), c("n_nationkey")).alias("tight"), aggregates.group_concat(F.nullif("n_regionkey", c("n_regionkey")), c("n_nationkey")).alias("nothing")), "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, n_regionkey::VARCHAR AS once, string_agg(n_name, '' ORDER BY n_nationkey) AS tight, NULL AS nothing FROM nation GROUP BY n_regionkey")
add("json_group_array", "nation", lambda df: df.groupBy("n_regionkey").agg(aggregates.json_group_array(F.nullif("n_nationkey", F.lit(3)), c("n_nationkey")).alias("ids"), aggregates.json_group_array(c("n_name"), c("n_nationkey")).alias("names")), """SELECT n_regionkey, '[' || string_agg(coalesce(nullif(n_nationkey, 3)::VARCHAR, 'null'), ',' ORDER BY n_nationkey) || ']' AS ids, '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) || ']' AS names FROM nation GROUP BY n_regionkey""")
