"""Recursion, special joins, changes to tables, constraints, sources, catalogs and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.joins import asof_join, natural_join, range_join
from ..operators.recursive import fixpoint, shared_folder
from ..plans import dml
from ..plans.database import Database
from ..sources import catalog, files
from ..streaming import events as stream
from ..session import TABLES, register, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# Recursion with UNION
@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem),
  r(n) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.b FROM r JOIN e ON e.a = r.n) SELECT n FROM r""")
def recursive_union_distinct(spark, sf_dir):
    """Reachable nodes of a graph with cycles: only new rows go on."""
    edges = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("a"), (c("l_partkey") % 100).alias("b")).distinct()
    return fixpoint(spark.range(1, 2).toDF("n"), lambda d: d.join(edges, d["n"] == edges["a"]).select(c("b").alias("n")))


@query("""WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, n_regionkey FROM nation UNION SELECT r.b, n.n_regionkey FROM r JOIN nation n ON n.n_nationkey = r.b) SELECT a, b FROM r""")
def recursive_two_columns(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), c("n_regionkey").alias("up"))
    anchor = nation.select(c("k").alias("a"), c("up").alias("b"))
    return fixpoint(anchor, lambda d: d.join(nation, d["b"] == nation["k"]).select(c("b").alias("a"), c("up").alias("b")))


# Joins beyond equality
@query("SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents NATURAL JOIN labels")
def natural_join_frames(spark, sf_dir):
    return natural_join(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""WITH b AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts AS bought, max(event_id) AS last_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
  SELECT b.event_id, p.last_id FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.ts >= p.bought""")
def asof(spark, sf_dir):
    """Each click with the last purchase of its user at or before it."""
    e = table(spark, sf_dir, "events")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", "event_id")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", c("ts").alias("bought")).agg(F.max("event_id").alias("last_id"))
    return asof_join(clicks, bought, ["user_id"], "ts", "bought", ["last_id"]).select("event_id", "last_id")


@query("""SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 20""")
def range_join_bins(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", c("s_acctbal").alias("low"), (c("s_acctbal") + 20).alias("high"))
    return range_join(parts, ranges, "p_retailprice", "low", "high", 20.0).select("p_partkey", "s_suppkey")


# Changes
def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


_O = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders"


@query(f"{_O} UNION ALL SELECT o_orderkey + 10000000, 1, 0.0, 'N' FROM orders WHERE o_orderstatus = 'P'")
def insert_with_defaults(spark, sf_dir):
    old = _orders(spark, sf_dir)
    rows = old.filter("o_orderstatus = 'P'").select((c("o_orderkey") + 10_000_000).alias("o_orderkey"), F.lit(1).alias("o_custkey"))
    return dml.insert(old, rows, defaults={"o_totalprice": F.lit(0.0)}, generated={"o_orderstatus": F.lit("N")})


@query(f"{_O} UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 150000")
def insert_select(spark, sf_dir):
    old = _orders(spark, sf_dir)
    return dml.insert(old, old.filter("o_totalprice > 150000").withColumn("o_orderkey", c("o_orderkey") + 10_000_000))


def _batch(old):
    """All orders and as many with new keys; open ones twice."""
    rows = old.union(old.withColumn("o_orderkey", c("o_orderkey") + 10_000_000)).withColumn("o_totalprice", F.lit(1.0)).withColumn("v", F.lit(1))
    again = rows.filter("o_orderstatus = 'O'").withColumn("o_totalprice", F.lit(2.0)).withColumn("v", F.lit(2))
    return rows.union(again)


_BATCH = "b AS (SELECT o_orderkey + x * 10000000 AS o_orderkey, o_custkey, v::DOUBLE AS o_totalprice, o_orderstatus, v FROM o, (VALUES (0), (1)) t(x), (VALUES (1), (2)) u(v) WHERE v = 1 OR o_orderstatus = 'O')"


@query(f"WITH o AS ({_O}), {_BATCH} SELECT * FROM o UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM b WHERE v = 1 AND o_orderkey NOT IN (SELECT o_orderkey FROM o)")
def insert_or_ignore(spark, sf_dir):
    old = _orders(spark, sf_dir)
    rows = _batch(old)
    return dml.insert_or_ignore(old, rows.withColumn("o_orderkey", c("o_orderkey")).select(*old.columns), ["o_orderkey"], order=c("o_totalprice"))


@query(f"WITH o AS ({_O}), {_BATCH} SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM b x WHERE v = (SELECT max(v) FROM b y WHERE y.o_orderkey = x.o_orderkey)")
def insert_or_replace(spark, sf_dir):
    old = _orders(spark, sf_dir)
    return dml.insert_or_replace(old, _batch(old).select(*old.columns), ["o_orderkey"], order=c("o_totalprice"))


@query(f"WITH o AS ({_O}), {_BATCH}, n AS (SELECT * FROM b WHERE v = 1) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN o.o_orderkey IS NULL THEN n.o_totalprice WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE o.o_totalprice + n.o_totalprice END AS o_totalprice, CASE WHEN o.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL THEN 'U' ELSE coalesce(o.o_orderstatus, n.o_orderstatus) END AS o_orderstatus FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey")
def upsert(spark, sf_dir):
    old = _orders(spark, sf_dir)
    rows = _batch(old).filter("v = 1").select(*old.columns)
    return dml.upsert(old, rows, ["o_orderkey"], {"o_totalprice": c("old.o_totalprice") + c("excluded.o_totalprice"), "o_orderstatus": F.lit("U")})


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE o_custkey END AS o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey::DOUBLE ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def update(spark, sf_dir):
    """Both changes see the old row."""
    return dml.update(_orders(spark, sf_dir), {"o_custkey": c("o_orderkey"), "o_totalprice": c("o_custkey")}, c("o_orderstatus") == "F")


@query("WITH f AS (SELECT l_orderkey, min(l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, o_custkey, coalesce(f.p, o_totalprice) AS o_totalprice, o_orderstatus FROM orders LEFT JOIN f ON l_orderkey = o_orderkey")
def update_from(spark, sf_dir):
    source = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return dml.update_from(_orders(spark, sf_dir), source, ["o_orderkey"], {"o_totalprice": c("source.l_extendedprice")}, c("l_extendedprice"))


@query(f"{_O} WHERE o_orderstatus IS DISTINCT FROM 'F' OR o_totalprice <= 50000")
def delete(spark, sf_dir):
    return dml.delete(_orders(spark, sf_dir), (c("o_orderstatus") == "F") & (c("o_totalprice") > 50000))


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice FROM orders WHERE o_custkey = 5")
def returning(spark, sf_dir):
    return dml.returning(_orders(spark, sf_dir), c("o_custkey") == 5, "o_orderkey", F.round(c("o_totalprice") * 2, 2).alias("twice"))


@query("SELECT n_nationkey, n_name AS name, 'none' AS note FROM nation")
def alter_table(spark, sf_dir):
    df = dml.add_column(table(spark, sf_dir, "nation"), "note", "string", F.lit("none"))
    return dml.drop_column(dml.rename_column(df, "n_name", "name"), "n_regionkey")


@query("SELECT max_id + row_number() OVER (ORDER BY n_name) AS id, n_name FROM nation, (SELECT max(r_regionkey) AS max_id FROM region)")
def autoincrement(spark, sf_dir):
    return dml.next_ids(table(spark, sf_dir, "region").select(c("r_regionkey").alias("id")), table(spark, sf_dir, "nation").select("n_name"), "id", c("n_name"), parts=4).select("id", "n_name")


@query("""SELECT '23514' AS code, 'small' AS name, count(*) AS rows FROM lineitem WHERE NOT (l_quantity < 50)
  UNION ALL SELECT '23505', 'l_orderkey', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)
  UNION ALL SELECT '23502', 'l_returnflag', count(*) FROM lineitem WHERE l_returnflag = 'N'
  UNION ALL SELECT '23503', 'l_suppkey', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey > 3)""")
def constraints(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    return dml.violations(lines, not_null=["l_returnflag"], unique=[["l_orderkey"]], checks={"small": c("l_quantity") < 50}, references={"l_suppkey": (table(spark, sf_dir, "supplier").filter("s_suppkey > 3"), "s_suppkey")})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, sf_dir):
    _, (kept,) = dml.cascade_delete(table(spark, sf_dir, "customer"), "c_custkey", c("c_acctbal") < 0, [(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "cascade")])
    return kept


@query("SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders")
def cascade_set_null(spark, sf_dir):
    _, (kept,) = dml.cascade_delete(table(spark, sf_dir, "customer"), "c_custkey", c("c_acctbal") < 0, [(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "set null")])
    return kept


# Views, parameters, scripts
@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def view_expansion(spark, sf_dir):
    register(spark, sf_dir, "customer", "nation")
    spark.sql("CREATE OR REPLACE TEMP VIEW rich AS SELECT * FROM customer WHERE c_acctbal > 0")
    return spark.sql("SELECT n_name, count(*) AS n FROM rich JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def parameters(spark, sf_dir):
    register(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_custkey = ? AND o_totalprice > ?", args=[7, 1000])


@query("SELECT r_name || ';' AS name FROM region")
def sql_script(spark, sf_dir):
    register(spark, sf_dir, "region")
    files.run_script(spark, "-- a comment; not a statement\nCREATE OR REPLACE TEMP VIEW s1 AS SELECT concat(r_name, ';') AS name FROM region; /* ; */")
    return spark.sql("SELECT name FROM s1")


# Files
@query("SELECT n_nationkey, n_name, n_regionkey + 0.5 AS half FROM nation")
def csv_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/csv"
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", (c("n_regionkey") + 0.5).alias("half"))
    return files.import_csv(spark, _fresh(path, lambda p: files.export_csv(df, p)))


def _fresh(path: str, write) -> str:
    path = f"{path}/{uuid.uuid4().hex}"
    write(path)
    return path


@query("""SELECT 'INSERT INTO region (r_regionkey, r_name) VALUES (' || r_regionkey || ', ''' || r_name || ''');' AS statement FROM region""")
def sql_dump(spark, sf_dir):
    return files.dump_sql(table(spark, sf_dir, "region"), "region")[1]


# Catalog
@query("SELECT 'table' AS type, name, name AS tbl_name FROM (VALUES ('customer'), ('nation'), ('region')) t(name)")
def sqlite_master(spark, sf_dir):
    return catalog.sqlite_master(spark, {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer")}).select("type", "name", "tbl_name")


@query("SELECT * FROM (VALUES ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3), ('region', 'r_regionkey', 1), ('region', 'r_name', 2)) t(table_name, column_name, ordinal_position)")
def information_schema_columns(spark, sf_dir):
    return catalog.information_columns(spark, {n: table(spark, sf_dir, n) for n in ("region", "nation")}).select("table_name", "column_name", "ordinal_position")


@query(f"SELECT unnest({sorted(TABLES)}) AS table_name")
def information_schema_tables(spark, sf_dir):
    return catalog.information_tables(spark, {n: table(spark, sf_dir, n) for n in TABLES}).select("table_name")


# Layout and identity
@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders")
def rowid(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("rowid", F.monotonically_increasing_id()).agg(F.count("*").alias("n"), F.countDistinct("rowid").alias("ids"))


# Streams, drained and compared with the batch answer
def _streamed(spark, sf_dir, operator, mode: str = "append"):
    source = f"{shared_folder(spark)}/events/{uuid.uuid4().hex}"
    batch_files = stream.write_events(table(spark, sf_dir, "events"), source)
    folder = _fresh(f"{shared_folder(spark)}/streams", lambda p: None)
    stream.drain(operator(stream.read_events(spark, source, batch_files)), folder, mode)
    return spark.read.parquet(f"{folder}/rows")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: stream.first_of_each(s, "1 hour")).select("event_id", "user_id", "event_type")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", c("ts").cast("timestamp"))
    return stream.tumbling(e, "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events, range(0, 4) t(i) GROUP BY 1")
def sliding_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", c("ts").cast("timestamp"))
    return stream.sliding(e, "1 hour", "15 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", c("ts").cast("timestamp"))
    return stream.sessions(e, "30 minutes").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""SELECT n_nationkey, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN 'first' ELSE 'later' END AS place FROM nation WHERE n_name GLOB '*A*'""")
def frames_and_glob(spark, sf_dir):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, sf_dir, "nation").filter(text.glob(c("n_name"), "*A*")).select("n_nationkey", F.when(F.row_number().over(w) == 1, "first").otherwise("later").alias("place"))


# Statements of the dialect, on a database of the tables
def _database(spark, sf_dir, *names):
    db = Database(spark, "queries")
    for n in names:
        db.attach(n, table(spark, sf_dir, n))
    return db


@query("SELECT n_nationkey, n_name, n_regionkey + CASE WHEN n_regionkey = 2 THEN 10 ELSE 0 END AS n_regionkey FROM nation")
def transaction_rollback(spark, sf_dir):
    """What follows a savepoint or BEGIN is undone; what came before stays."""
    db = _database(spark, sf_dir, "nation")
    db.run("""UPDATE nation SET n_regionkey = n_regionkey + 10 WHERE n_regionkey = 2; BEGIN; DELETE FROM nation; SAVEPOINT a;
      INSERT INTO nation SELECT 99, 'NOWHERE', 9; ROLLBACK TO SAVEPOINT a; RELEASE a; ROLLBACK""")
    return db.execute("SELECT n_nationkey, n_name, n_regionkey FROM nation")


@query("SELECT c_custkey, c_name, CASE WHEN c_nationkey < 5 THEN c_nationkey + 1000 ELSE c_nationkey END AS c_nationkey FROM customer UNION ALL SELECT -1, 'see customer.c_name', 0")
def upsert_statement(spark, sf_dir):
    db = Database(spark, "queries")
    db.attach("holders", table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"))
    db.execute("CREATE UNIQUE INDEX one ON holders (c_custkey)")
    db.execute("""INSERT INTO holders SELECT c_custkey, 'x', 1000 FROM holders UNION ALL SELECT -1, 'see customer.c_name', 0
      ON CONFLICT (c_custkey) DO UPDATE SET c_nationkey = c_nationkey + excluded.c_nationkey WHERE holders.c_nationkey < 5""")
    return db.execute("SELECT c_custkey, c_name, c_nationkey FROM holders")


@query("SELECT s_suppkey, s_nationkey * 2 AS twice FROM supplier WHERE s_nationkey > 12 UNION ALL SELECT s_suppkey + 1000000, 7 FROM supplier")
def returning_conflict(spark, sf_dir):
    """RETURNING gives the rows that were stored, not those that were proposed or ignored."""
    db = Database(spark, "queries")
    db.attach("sellers", table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"))
    db.execute("CREATE UNIQUE INDEX one ON sellers (s_suppkey)")
    new = db.execute("INSERT OR IGNORE INTO sellers SELECT s_suppkey, 1 FROM sellers UNION ALL SELECT s_suppkey + 1000000, 7 FROM sellers RETURNING s_suppkey, s_nationkey AS twice")
    old = db.execute("INSERT INTO sellers SELECT s_suppkey, -5 FROM sellers WHERE s_suppkey < 1000000 ON CONFLICT (s_suppkey) DO UPDATE SET s_nationkey = s_nationkey * 2 WHERE s_nationkey > 12 RETURNING s_suppkey, s_nationkey AS twice")
    return new.union(old)


@query("SELECT r_regionkey AS id, r_name AS label FROM region UNION ALL SELECT 77, 'new'")
def rename_constraint(spark, sf_dir):
    """Constraints follow a renamed column: the last two rows break them."""
    db = Database(spark, "queries")
    db.run("CREATE TABLE areas (r_regionkey INTEGER PRIMARY KEY, r_name TEXT NOT NULL CHECK (length(r_name) < 30))")
    register(spark, sf_dir, "region")
    db.run("INSERT INTO areas SELECT r_regionkey, r_name FROM region; ALTER TABLE areas RENAME COLUMN r_regionkey TO id; ALTER TABLE areas RENAME COLUMN r_name TO label; INSERT INTO areas (id, label) VALUES (77, 'new')")
    for broken in ("(77, 'again')", "(78, 'a name of far more than thirty letters')"):
        try:
            db.execute(f"INSERT INTO areas (id, label) VALUES {broken}")
        except dml.ConstraintError:
            continue
        raise AssertionError("a constraint was lost")
    return db.execute("SELECT id, label FROM areas")


@query("""SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS month_end,
  strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS later, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS year FROM orders""")
def date_modifiers_sql(spark, sf_dir):
    db = _database(spark, sf_dir, "orders")
    return db.execute("SELECT o_orderkey, date(CAST(o_orderdate AS TEXT), 'start of month', '+1 month', '-1 day') AS month_end, datetime(CAST(o_orderdate AS TEXT), '+36 hours') AS later, date(CAST(o_orderdate AS TEXT), 'start of year') AS year FROM orders")
