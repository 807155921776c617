"""Scans, projection, predicates, joins, aggregation, windows, sorting, set operations and CTEs.

These are plain SQL: Catalyst plans them, and the same or the equivalent text runs on the
comparison engine.  Numbers over a whole table are built by ``operators.numbering`` instead,
since a window without partitions is one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import first_numbered, numbered
from ..session import register, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _tables(sql: str) -> list[str]:
    import re

    from ..session import TABLES

    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def add(name: str, sql: str, other: str | None = None, frame: Callable[[SparkSession, str], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *_tables(sql))
        return spark.sql(sql)

    run.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = frame or run, other or sql


# Scans
add("scan_full", "SELECT * FROM nation")
add("scan_filtered", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
add("scan_bounded", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 5")
add("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
add("secondary_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 37")
add("composite_key_lookup", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
add("count_star", "SELECT count(*) AS n FROM lineitem")
add("constant_false", "SELECT o_orderkey FROM orders WHERE 1 = 0")
add("constant_true", "SELECT r_regionkey, r_name FROM region WHERE 1 = 1")
add("tableless_select", "SELECT 1 + 1 AS two, 'x' AS x, 2 * 3.5 AS seven", "SELECT 1 + 1 AS two, 'x' AS x, CAST(2 * 3.5 AS DECIMAL(4,1)) AS seven")
add("derived_table", "SELECT d.o_custkey AS k, d.s AS s FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey) AS d WHERE d.s > 100000")
add("derived_cross", "SELECT a.r_name AS x, b.n_name AS y FROM (SELECT r_name FROM region) a, (SELECT n_name FROM nation WHERE n_regionkey = 1) b")
add("cte_cross", "WITH a AS (SELECT r_regionkey AS k FROM region), b AS (SELECT n_nationkey AS n FROM nation) SELECT k, n FROM a, b")
add("parenthesised_join", "SELECT n_name, r_name FROM (nation JOIN region ON n_regionkey = r_regionkey) WHERE r_regionkey > 1")
add("unnest_array", "SELECT vec_id, label, pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x", "SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
add("category_scan", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'R'")
add("value_range", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 30000")
add("category_aggregate", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 2) AS mean FROM lineitem GROUP BY l_returnflag")
# Projection
add("projection", "SELECT c_custkey AS id, c_name AS name, round(c_acctbal * 2, 2) AS twice FROM customer")
add("star_of_one", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
add("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
add("select_all", "SELECT ALL o_orderstatus FROM orders")
add("distinct_then_limit", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority LIMIT 3")
add("distinct_over_derived", "SELECT DISTINCT s FROM (SELECT o_orderstatus AS s FROM orders) d")
# Predicates
add("comparisons", "SELECT count_if(l_quantity = 10) AS eq, count_if(l_quantity <> 10) AS ne, count_if(l_quantity < 10) AS lt, count_if(l_quantity <= 10) AS le, count_if(l_quantity > 10) AS gt, count_if(l_quantity >= 10) AS ge FROM lineitem", "SELECT count(*) FILTER (l_quantity = 10) AS eq, count(*) FILTER (l_quantity <> 10) AS ne, count(*) FILTER (l_quantity < 10) AS lt, count(*) FILTER (l_quantity <= 10) AS le, count(*) FILTER (l_quantity > 10) AS gt, count(*) FILTER (l_quantity >= 10) AS ge FROM lineitem")
add("three_valued_logic", "SELECT doc_id, (quality = 1 AND NULLIF(toxic, 0) = 1) AS a, (quality = 1 OR NULLIF(toxic, 0) = 1) AS o, NOT (NULLIF(toxic, 0) = 1) AS n FROM labels")
add("is_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
add("is_not_null", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
add("is_distinct_from", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1")
add("is_not_distinct_from", "SELECT count(*) AS n FROM lineitem WHERE NULLIF(l_returnflag, 'N') IS NOT DISTINCT FROM NULLIF(l_linestatus, 'O')")
add("in_list", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
add("not_in_list_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, NULL)")
add("in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
add("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
add("not_in_subquery_nulls", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 5) FROM orders)")
add("exists_correlated", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
add("not_exists_correlated", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
add("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
add("correlated_scalar", "SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n, (SELECT round(max(o.o_totalprice), 2) FROM orders o WHERE o.o_custkey = c.c_custkey) AS most FROM customer c")
add("between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
add("not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 40")
add("like_any_case", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND p_type NOT ILIKE 'z%'")
add("like_escape", "SELECT count(*) AS n FROM documents WHERE text ILIKE '%!%%' ESCAPE '!'")
add("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
add("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders")
add("arithmetic", "SELECT l_orderkey, l_linenumber, l_linenumber + 2 AS p, l_linenumber - 10 AS m, l_linenumber * 3 AS t, -l_linenumber AS neg, +l_linenumber AS pos FROM lineitem")
add("bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, ~o_orderkey AS n FROM orders")
add("concatenation", "SELECT c_custkey, c_name || '-' || c_mktsegment AS k, c_name || NULLIF(c_mktsegment, 'BUILDING') AS maybe FROM customer")
add("precedence", "SELECT r_regionkey, 1 + 2 * 3 AS a, (1 + 2) * 3 AS b, NOT r_regionkey = 1 AND r_regionkey < 3 OR r_regionkey = 4 AS c FROM region")
# Joins
add("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
add("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
add("join_left_filtered_on", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
add("join_right", "SELECT l.quality, d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
add("join_full", "SELECT c.c_custkey AS a, d.doc_id AS b FROM customer c FULL OUTER JOIN documents d ON c.c_custkey = d.doc_id")
add("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
add("join_theta_left", "SELECT r.r_regionkey, n.n_nationkey FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > r.r_regionkey * 6")
add("join_cross", "SELECT r_name, s_suppkey FROM region CROSS JOIN supplier")
add("join_natural", "SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels")
add("join_using", "SELECT doc_id, d.lang, l.toxic FROM documents d JOIN labels l USING (doc_id)")
add("join_comma", "SELECT n_name, count(*) AS n FROM customer, orders, nation WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey GROUP BY n_name")
add("join_mixed", "SELECT r_name, count(*) AS n FROM region, nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey GROUP BY r_name")
add("join_derived", "SELECT c.c_name, d.n FROM customer c JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) d ON d.k = c.c_custkey")
add("join_null_keys", "SELECT count(*) AS n FROM (SELECT NULLIF(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT NULLIF(r_regionkey, 1) AS k FROM region) b ON a.k = b.k")
add("join_semi", "SELECT p_partkey FROM part LEFT SEMI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49", "SELECT p_partkey FROM part SEMI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49")
add("join_anti", "SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45", "SELECT p_partkey FROM part ANTI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45")
add("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
add("join_star", "SELECT r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment")
# Aggregation
add("aggregate_ungrouped", "SELECT count(*) AS n, count(o_custkey) AS c, count(DISTINCT o_custkey) AS d, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 2) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
add("aggregate_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
add("group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, min(l_shipdate) = max(l_shipdate) AS same FROM lineitem GROUP BY l_returnflag, l_linestatus")
add("group_by_alias", "SELECT o_totalprice > 100000 AS big, count(*) AS n FROM orders GROUP BY big")
add("group_by_expression", "SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 10")
add("group_by_ordinal", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
add("group_bare_column", "SELECT n_regionkey, min_by(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey")
add("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
add("having_ungrouped", "SELECT count(*) AS n FROM orders HAVING count(*) > 1000000000")
add("sum_distinct", "SELECT l_returnflag, sum(DISTINCT l_quantity) AS s, round(avg(DISTINCT l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag")
add("expressions_over_aggregates", "SELECT l_linestatus, round(sum(l_extendedprice) / count(*), 2) AS mean, CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS size, COALESCE(max(NULLIF(l_returnflag, 'N')), '-') AS flag FROM lineitem GROUP BY l_linestatus")
add("aggregate_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_custkey < 50), 2) AS s FROM orders GROUP BY o_orderstatus")
add("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
add("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
add("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("spread", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag")
# Windows
def _row_number_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.nullif("quality", F.lit(0)).alias("q"))
    return numbered(labels, "n", F.col("q").asc_nulls_last(), F.col("doc_id").asc()).select("doc_id", "n")


def _window_then_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return first_numbered(orders, "n", 10, F.col("o_orderkey").desc()).orderBy("n")


add("row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders")
add("row_number_nulls", "SELECT doc_id, row_number() OVER (ORDER BY NULLIF(quality, 0) ASC NULLS LAST, doc_id) AS n FROM labels", frame=_row_number_nulls)
add("rank_functions", "SELECT l_orderkey, l_linenumber, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity)")
add("lag_lead", "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role, 1, 'end') OVER w AS after, first_value(role) OVER w AS first FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
add("running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
add("moving_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS m, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM events")
add("window_then_limit", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS n FROM orders ORDER BY n LIMIT 10", frame=_window_then_limit)
add("best_of_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) t WHERE n <= 2")
# Sorting and limits
add("order_nulls_first", "SELECT doc_id, NULLIF(toxic, 0) AS t FROM labels ORDER BY t ASC NULLS FIRST, doc_id LIMIT 20")
add("order_nulls_last", "SELECT doc_id, NULLIF(toxic, 0) AS t FROM labels ORDER BY t DESC NULLS LAST, doc_id LIMIT 20")
add("order_ordinal", "SELECT n_name, n_regionkey FROM nation ORDER BY 2 DESC, 1 LIMIT 7")
add("order_alias", "SELECT p_partkey, p_retailprice * 2 AS twice FROM part ORDER BY twice DESC, p_partkey LIMIT 10")
add("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
add("compound_order_limit", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY k LIMIT 8 OFFSET 3")
# Set operations and CTEs
add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
add("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
add("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
add("intersect_all", "SELECT o_orderstatus AS s FROM orders INTERSECT ALL SELECT l_linestatus FROM lineitem")
add("except_all", "SELECT l_linestatus AS s FROM lineitem EXCEPT ALL SELECT o_orderstatus FROM orders")
add("set_precedence", "SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier")
add("cte", "WITH big(k, total) AS (SELECT o_custkey, round(sum(o_totalprice), 2) FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 500000) SELECT c.c_name, t.total FROM top t JOIN customer c ON c.c_custkey = t.k")
add("cte_twice", "WITH t AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT a.r AS r, a.n + b.n AS n FROM t a JOIN t b ON a.r = b.r")
add("recursive_union_all", "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 60) SELECT n, n * n AS square FROM s")
add("recursive_hierarchy", "WITH RECURSIVE t(k, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT c.k, t.depth + 1 FROM t JOIN (SELECT s_suppkey AS k, CAST(floor(s_suppkey / 3) AS BIGINT) AS up FROM supplier WHERE s_suppkey > 1) c ON c.up = t.k) SELECT k, depth FROM t", "WITH RECURSIVE t(k, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT c.k, t.depth + 1 FROM t JOIN (SELECT s_suppkey AS k, s_suppkey // 3 AS up FROM supplier WHERE s_suppkey > 1) c ON c.up = t.k) SELECT k, depth FROM t")
add("cte_materialised", "WITH RECURSIVE a AS (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) SELECT k, count(*) AS n FROM a GROUP BY k")
add("values_list", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
add("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS o, sum(l_quantity) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY l_returnflag")
add("lateral_subquery", "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT max(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey = c_custkey) t")
