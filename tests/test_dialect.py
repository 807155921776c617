"""The dialect's statements, compared with SQLite where both speak it."""

import sqlite3

import pytest

from tamarack.plans.database import Database, Done
from tamarack.plans.dialect import DialectError, to_spark
from tamarack.plans.dml import ConstraintError

SETUP = """
CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, age INTEGER DEFAULT 0, city TEXT);
CREATE TABLE orders (id INTEGER PRIMARY KEY, user_id INTEGER, amount REAL);
INSERT INTO users (id, name, age, city) VALUES (1, 'Ann', 30, 'Rome'), (2, 'bob', 25, NULL), (3, 'O''Neil', 41, 'Oslo');
INSERT INTO orders VALUES (1, 1, 10.5), (2, 1, 20), (3, 3, 7.25), (4, NULL, 1);
"""

QUERIES = [
    "SELECT 7 / 2, -7 / 2, 7 / 0, 7 % 0, 7.0 / 2, 2 + 3 * 4 % 5, (1 + 2) * 3",
    "SELECT id, age / 4, age % 4 FROM users ORDER BY id",
    'SELECT "name", [city] FROM users WHERE name LIKE \'a%\'',
    "SELECT name || '-' || coalesce(city, '?') FROM users ORDER BY 1",
    "SELECT u.name, count(o.id), sum(o.amount), total(o.amount) FROM users u LEFT JOIN orders o ON o.user_id = u.id GROUP BY u.name ORDER BY u.name",
    "SELECT name FROM users WHERE EXISTS (SELECT 1 FROM orders WHERE user_id = users.id) ORDER BY name",
    "SELECT CASE WHEN age > 28 THEN 'old' ELSE 'young' END AS k, count(*) FROM users GROUP BY k ORDER BY k",
    "SELECT substr('US-NY', 0, 3), substr('abc', -2), length('abc'), upper('x'), iif(1 > 2, 'a', 'b'), max(1, 5, 3), typeof(1), typeof('a'), typeof(NULL), typeof(1.5)",
    "WITH big AS (SELECT * FROM orders WHERE amount > 8) SELECT user_id, count(*) FROM big GROUP BY user_id",
    "SELECT id FROM users UNION SELECT user_id FROM orders EXCEPT SELECT 2 ORDER BY 1",
    "SELECT row_number() OVER (PARTITION BY user_id ORDER BY amount) AS n, id FROM orders ORDER BY id",
    "SELECT CAST('12' AS INTEGER), CAST(2.9 AS INTEGER), CAST('abc' AS INTEGER), hex('AB'), x'4142' = CAST('AB' AS BLOB)",
    "SELECT 1 << 3, 64 >> 2, 5 & 3, 5 | 3, ~5 -- the end",
    "SELECT id FROM orders WHERE user_id IS NOT NULL AND amount BETWEEN 7 AND 15 /* between */ ORDER BY id DESC LIMIT 2 OFFSET 0",
    "SELECT name FROM users WHERE city IS NULL OR city NOT IN ('Rome', 'Paris') ORDER BY name",
    "SELECT quote('it''s'), quote(5), instr('hello', 'l'), replace('aXa', 'X', '-'), abs(-3), nullif(1, 1), ifnull(NULL, 4)",
]


@pytest.fixture(scope="module")
def both(spark):
    lite = sqlite3.connect(":memory:")
    lite.executescript(SETUP)
    db = Database(spark)
    db.run(SETUP)
    return db, lite


def rows(df):
    return [tuple(r) for r in df.collect()]


def same(a, b):
    close = lambda x, y: x == y or (isinstance(x, (int, float, bool)) and isinstance(y, (int, float)) and abs(float(x) - float(y)) < 1e-9)
    return len(a) == len(b) and all(len(r) == len(s) and all(map(close, r, s)) for r, s in zip(a, b, strict=True))


@pytest.mark.parametrize("sql", QUERIES)
def test_queries_as_sqlite(both, sql):
    db, lite = both
    got, want = rows(db.execute(sql)), lite.execute(sql).fetchall()
    if "ORDER BY" not in sql:
        got, want = sorted(got, key=str), sorted(want, key=str)
    assert same(got, want), (got, want, to_spark(sql))


STATEMENTS = [
    "INSERT INTO users (name) VALUES ('dora')",
    "INSERT OR IGNORE INTO users (id, name) VALUES (1, 'again'), (7, 'gil')",
    "INSERT OR REPLACE INTO users (id, name, age) VALUES (2, 'Bob', 26)",
    "INSERT INTO users (id, name, age) VALUES (1, 'x', 5), (8, 'hal', 6) ON CONFLICT (id) DO UPDATE SET age = users.age + excluded.age",
    "INSERT INTO users (id, name) SELECT id + 100, name FROM users WHERE age > 29",
    "UPDATE users SET age = age + 1, city = name WHERE city IS NULL",
    "UPDATE users SET age = o.amount FROM (SELECT user_id, CAST(max(amount) AS INTEGER) AS amount FROM orders GROUP BY user_id) AS o WHERE o.user_id = users.id",
    "DELETE FROM users WHERE age < 7",
    "ALTER TABLE users ADD COLUMN note TEXT DEFAULT 'n'",
    "ALTER TABLE users RENAME COLUMN note TO remark",
    "ALTER TABLE users DROP COLUMN remark",
]


def test_changes_as_sqlite(spark):
    lite = sqlite3.connect(":memory:")
    lite.executescript(SETUP)
    db = Database(spark, "changes")
    db.run(SETUP)
    for sql in STATEMENTS:
        assert isinstance(db.execute(sql), Done)
        lite.execute(sql)
        got, want = rows(db.execute("SELECT * FROM users ORDER BY id")), lite.execute("SELECT * FROM users ORDER BY id").fetchall()
        assert same(got, want), (sql, got, want)


def test_constraints_leave_the_table_as_it_was(both):
    db, _ = both
    before = rows(db.execute("SELECT * FROM users ORDER BY id"))
    for sql, code in (("INSERT INTO users (id, name) VALUES (1, 'dup')", "23505"), ("INSERT INTO users (id, name) VALUES (50, NULL)", "23502")):
        with pytest.raises(ConstraintError) as e:
            db.execute(sql)
        assert e.value.code == code
    assert rows(db.execute("SELECT * FROM users ORDER BY id")) == before


def test_references(spark):
    db = Database(spark, "refs")
    db.run("CREATE TABLE a (id INTEGER PRIMARY KEY); CREATE TABLE b (id INTEGER PRIMARY KEY, a_id INTEGER REFERENCES a(id) ON DELETE CASCADE); CREATE TABLE c (b_id INTEGER REFERENCES b(id) ON DELETE SET NULL, CHECK (b_id < 100))")
    db.run("INSERT INTO a VALUES (1), (2); INSERT INTO b VALUES (10, 1), (20, 2); INSERT INTO c VALUES (10), (20), (NULL)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO b VALUES (30, 9)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO c VALUES (100)")
    db.execute("DELETE FROM a WHERE id = 1")
    assert rows(db.execute("SELECT id FROM b")) == [(20,)]
    assert sorted(rows(db.execute("SELECT b_id FROM c")), key=str) == [(20,), (None,), (None,)]


def test_returning_views_and_catalog(both):
    db, _ = both
    assert rows(db.execute("DELETE FROM orders WHERE id = 4 RETURNING id, amount * 2 AS twice")) == [(4, 2.0)]
    db.execute("CREATE VIEW rich AS SELECT user_id FROM orders WHERE amount > 9")
    assert rows(db.execute("SELECT count(*) FROM rich")) == [(2,)]
    assert ("users",) in rows(db.execute("SELECT name FROM sqlite_master WHERE type = 'table'"))


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT '12'::int + 1", 13), ("SELECT ARRAY[1, 2, 3][2]", 2), ("SELECT 2 = ANY(ARRAY[1, 2])", True), ("SELECT ARRAY[1, 2] @> ARRAY[2]", True),
    ("SELECT '{\"a\":{\"b\":5}}' ->> '$.a.b'", "5"), ("SELECT '{\"a\":\"x\"}' -> 'a'", '"x"'), ("SELECT '{\"a\":null}' -> 'a'", "null"), ("SELECT '{\"a\":null}' -> 'b'", None), ("SELECT '{\"a\":[1,\"x\"]}' #> '{a,1}'", '"x"'), ("SELECT '{\"a\":[1,2]}' #- '{a,0}'", '{"a":[2]}'),
    ("SELECT jsonb_set('{\"a\":1}', '{b}', '2')", '{"a":1,"b":2}'), ("SELECT jsonb_insert('[1,2]', '{0}', '0')", "[0,1,2]"), ("SELECT to_jsonb('x')", '"x"'), ("SELECT jsonb_typeof('[1]')", "array"), ("SELECT jsonb_typeof('1.5')", "number"), ("SELECT length(randomblob(20))", 20),
    ("SELECT count(*) FROM main.users", 3), ("SELECT '{\"a\":[1,7]}' #>> '{a,1}'", "7"), ("SELECT 1 IS DISTINCT FROM NULL", True), ("SELECT group_concat(x) FROM (VALUES ('a')) AS t(x)", "a"), ("SELECT '2.5'::text || 'x'", "2.5x"),
])
def test_overlay(both, sql, want):
    assert rows(both[0].execute(sql))[0][0] == want


def test_errors():
    for sql in ("SELECT (1", "SELECT 1)"):
        with pytest.raises(DialectError):
            to_spark(sql)


def test_with_before_changes(spark):
    db = Database(spark, "withs")
    db.run("CREATE TABLE w (id INTEGER PRIMARY KEY, v INTEGER); INSERT INTO w VALUES (1, 10), (2, 20), (3, 30)")
    db.execute("WITH big AS (SELECT id + 10 AS id, v FROM w WHERE v > 15) INSERT INTO w (id, v) SELECT id, v FROM big")
    db.execute("WITH RECURSIVE n(x) AS (SELECT 100 UNION ALL SELECT x + 1 FROM n WHERE x < 102) INSERT INTO w (id, v) SELECT x, 0 FROM n")
    assert rows(db.execute("SELECT id FROM w ORDER BY id")) == [(1,), (2,), (3,), (12,), (13,), (100,), (101,), (102,)]
    db.execute("WITH w2 AS (SELECT id FROM w WHERE id >= 100) DELETE FROM w WHERE id IN (SELECT id FROM w2)")
    assert rows(db.execute("SELECT count(*) FROM w")) == [(5,)]


def test_set_default_and_relations(spark):
    db = Database(spark, "defaults")
    db.run("CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT DEFAULT 'n'); CREATE TABLE k (id INTEGER PRIMARY KEY, p_id INTEGER DEFAULT 1 REFERENCES p(id) ON DELETE SET DEFAULT, CHECK (id > 0), UNIQUE (p_id, id))")
    db.run("INSERT INTO p VALUES (1, 'a'), (2, 'b'); INSERT INTO k VALUES (7, 2), (8, NULL); DELETE FROM p WHERE id = 2")
    assert rows(db.execute("SELECT id, p_id FROM k ORDER BY id")) == [(7, 1), (8, None)]
    assert rows(db.execute("PRAGMA table_info(p)")) == [(0, "id", "INTEGER", 0, None, 1), (1, "name", "TEXT", 0, "'n'", 0)]
    assert [r[2:] for r in rows(db.execute("PRAGMA foreign_key_list(k)"))] == [("p", "p_id", "id", "NO ACTION", "SET DEFAULT")]
    assert rows(db.execute("SELECT constraint_type, count(*) FROM information_schema.table_constraints WHERE table_name = 'k' GROUP BY 1 ORDER BY 1")) == [("CHECK", 1), ("FOREIGN KEY", 1), ("PRIMARY KEY", 1), ("UNIQUE", 1)]
    assert rows(db.execute("SELECT a.attname FROM pg_catalog.pg_class c JOIN pg_attribute a ON a.attrelid = c.oid WHERE c.relname = 'p' ORDER BY a.attnum")) == [("id",), ("name",)]
    assert rows(db.execute("SELECT column_name FROM information_schema.columns WHERE table_name = 'k' ORDER BY ordinal_position")) == [("id",), ("p_id",)]


def test_years_beyond_9999_have_no_sign(spark):
    db = Database(spark, "far")
    got = db.execute("SELECT date(253402300799, 'unixepoch') AS a, datetime(253402300800, 'unixepoch') AS b").head()
    assert tuple(got) == ("9999-12-31", "10000-01-01 00:00:00")
