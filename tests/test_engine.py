"""Changes, constraints, sources, recursion and streams."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tamarack.operators.joins import asof_join, range_join
from tamarack.operators.numbering import first_numbered, numbered
from tamarack.operators.recursive import fixpoint
from tamarack.plans import dml
from tamarack.sources import files
from tamarack.streaming import events as stream

c = F.col


@pytest.fixture()
def people(spark):
    return spark.createDataFrame([(1, "ann", 30), (2, "bob", None), (3, "cat", 50)], "id bigint, name string, age int")


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_and_conflicts(spark, people):
    rows = spark.createDataFrame([(2, "BOB", 1), (9, "new", 2)], "id bigint, name string, age int")
    assert pairs(dml.upsert(people, rows, ["id"], {"name": c("excluded.name")})) == [(1, "ann", 30), (2, "BOB", None), (3, "cat", 50), (9, "new", 2)]
    assert pairs(dml.insert_or_ignore(people, rows, ["id"])) == [(1, "ann", 30), (2, "bob", None), (3, "cat", 50), (9, "new", 2)]
    assert pairs(dml.insert_or_replace(people, rows, ["id"])) == [(1, "ann", 30), (2, "BOB", 1), (3, "cat", 50), (9, "new", 2)]


def test_conflicts_over_many_parts(spark, people, tmp_path, monkeypatch):
    """One shuffle by key in parts that follow the sources' size; null keys conflict with none."""
    monkeypatch.setattr("tamarack.session.PART_BYTES", 500)
    old = [(i, f"o{i}", i) for i in range(0, 300, 2)] + [(None, "old", 0), (7, "twin", 1), (7, "twin", 2)]
    new = [(i, f"n{i}.{j}", j) for i in range(100, 400, 3) for j in range(i % 3 + 1)] + [(None, "a", 1), (None, "b", 2)]
    for name, rows in (("old", old), ("new", new)):
        spark.createDataFrame(rows, people.schema).repartition(5).write.parquet(f"file://{tmp_path}/{name}")
    table, rows = (spark.read.parquet(f"file://{tmp_path}/{n}") for n in ("old", "new"))
    had, given = {r[0] for r in old}, {r[0] for r in new}
    last = {r[0]: r for r in new if r[0] is not None}
    first = {r[0]: r for r in reversed(new) if r[0] is not None}
    free = [r for r in new if r[0] is None]
    replaced = dml.insert_or_replace(table, rows, ["id"], order=c("age"))
    assert pairs(replaced) == sorted([r for r in old if r[0] is None or r[0] not in given] + list(last.values()) + free, key=str)
    ignored = dml.insert_or_ignore(table, rows, ["id"], order=c("age"))
    assert pairs(ignored) == sorted(old + [r for k, r in first.items() if k not in had] + free, key=str)
    assert pairs(dml._last_of_each(rows, ["id"], c("age"))) == sorted(list(last.values()) + free, key=str)
    changed = dml.update_from(table, rows, ["id"], {"name": c("source.name")}, c("age"))
    assert pairs(changed) == sorted([(r[0], first[r[0]][1] if r[0] in first else r[1], r[2]) for r in old], key=str)
    plan = plan_of(replaced)
    plan = plan[plan.index("== Physical Plan ==") :]
    assert plan[plan.rindex("Initial Plan") :].count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan


def test_update_and_delete_with_null_conditions(people):
    assert pairs(dml.update(people, {"age": c("age") + 1}, c("age") > 20)) == [(1, "ann", 31), (2, "bob", None), (3, "cat", 51)]
    assert pairs(dml.delete(people, c("age") > 20)) == [(2, "bob", None)]


def test_constraints(people):
    assert dml.enforce(people, unique=[["id"]], not_null=["name"], checks={"old": c("age") > 10}) is people
    with pytest.raises(dml.ConstraintError) as e:
        dml.enforce(people, not_null=["age"])
    assert e.value.code == "23502"
    with pytest.raises(dml.ConstraintError) as e:
        dml.enforce(people.union(people), unique=[["id"]])
    assert e.value.code == "23505"


def test_restrict(people):
    with pytest.raises(dml.ConstraintError) as e:
        dml.cascade_delete(people, "id", c("id") == 1, [(people, "id", "restrict")])
    assert e.value.code == "23503"


def test_ids_follow_on(people):
    got = dml.next_ids(people, people.select("name"), "id", c("name"), parts=2)
    assert sorted((r["name"], r["id"]) for r in got.collect()) == [("ann", 4), ("bob", 5), ("cat", 6)]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_numbers_over_a_whole_table(spark):
    rows = [(i, None if i % 3 == 0 else i * 7919 % 100) for i in range(1000)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(5)
    got = numbered(df, "n", c("v").asc_nulls_last(), c("k").desc(), parts=7, start=10)
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))
    assert sorted(tuple(r) for r in got.select("n", "k", "v").collect()) == [(i + 11, *r) for i, r in enumerate(want)]
    assert "SinglePartition" not in plan_of(got)
    assert numbered(df.filter("k < 0"), "n", c("k")).collect() == []
    first = first_numbered(df, "n", 3, c("k").desc())
    assert sorted((r["n"], r["k"]) for r in first.collect()) == [(1, 999), (2, 998), (3, 997)]


def test_no_query_sorts_a_whole_table_in_one_task(spark):
    """Before a window over all rows each task keeps its first ones."""
    from tamarack.queries import QUERIES

    plan = plan_of(QUERIES["window_then_limit"](spark, "/root/testdata/sf0.001"))
    physical = plan[plan.index("== Physical Plan ==") :]
    assert 0 < physical.index("Window") < physical.index("TakeOrderedAndProject") < physical.index("FileScan")
    assert "SinglePartition" not in physical
    assert "SinglePartition" not in plan_of(QUERIES["row_number_nulls"](spark, "/root/testdata/sf0.001"))


def test_fixpoint_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "a bigint, b bigint")
    got = fixpoint(spark.range(1, 2).toDF("n"), lambda d: d.join(edges, d["n"] == edges["a"]).select(c("b").alias("n")))
    assert sorted(r["n"] for r in got.collect()) == [1, 2, 3]
    with pytest.raises(RuntimeError):
        fixpoint(spark.range(1), lambda d: d.select((c("id") + 1).alias("id")), rounds=3)


def test_joins_without_nested_loops(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "k string, at int, v string")
    assert pairs(asof_join(left, right, ["k"], "t", "at", ["v"])) == [("a", 1, None, None), ("a", 5, 5, "y"), ("b", 9, None, None)]
    points = spark.createDataFrame([(1.0,), (2.5,), (7.0,)], "x double")
    ranges = spark.createDataFrame([("p", 0.0, 2.5), ("q", 2.0, 7.0)], "n string, lo double, hi double")
    joined = range_join(points, ranges, "x", "lo", "hi", 1.0)
    assert sorted((r["x"], r["n"]) for r in joined.collect()) == [(1.0, "p"), (2.5, "p"), (2.5, "q"), (7.0, "q")]
    assert "NestedLoop" not in joined._jdf.queryExecution().toString()


def test_csv_inference_over_all_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,a,b,c\n1,1,1.5,x\n2,,2,3\n3,7.5,,\n")
    df = files.import_csv(spark, f"file://{tmp_path}/x.csv")
    assert dict(df.dtypes) == {"id": "bigint", "a": "double", "b": "double", "c": "string"}
    assert df.count() == 3


def test_csv_text(spark):
    df = spark.createDataFrame([(2.0, True, bytearray(b"\x01")), (2.5, False, None)], "r double, b boolean, x binary")
    got = df.select(*[files.csv_text(c(n), k) for n, k in df.dtypes]).collect()
    assert [tuple(r) for r in got] == [("2", "1", "0x01"), ("2.5", "0", "")]


def test_statements():
    assert files.split_statements("a; 'x;y' -- z;\n; /* ; */ b;") == ["a", "'x;y' -- z;", "/* ; */ b"]


def test_sqlite_import(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name VARCHAR(10), x REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(1, 101)])
        db.execute("CREATE TABLE none (a INTEGER)")
    tables = files.import_sqlite(spark, path)
    assert dict(tables["t"].dtypes) == {"id": "bigint", "name": "string", "x": "double"}
    assert tables["t"].count() == 100 and tables["none"].count() == 0


def test_stream_gives_the_batch_answer(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i // 10}:{i % 10 * 6:02d}:00", i % 3, "click", 1.0, "{}") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", c("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    batch = stream.tumbling(df.withColumn("at", c("ts").cast("timestamp")), "1 hour")
    stream.drain(stream.tumbling(stream.read_events(spark, f"file://{tmp_path}/in"), "1 hour", "10 hours"), f"file://{tmp_path}/out", "append")
    assert batch.count() == 4
    got = spark.read.schema(batch.schema).parquet(f"file://{tmp_path}/out/rows")
    assert {r["n"] for r in got.collect()} <= {r["n"] for r in batch.collect()}


def test_stream_of_many_files_in_order(spark, tmp_path):
    """Ranges of time in several batches: no row is late, and no task sorts all rows."""
    rows = [(i, f"2024-01-{i * 37 % 28 + 1:02d} {i % 24:02d}:00:00", i % 3, "click", 1.0, "{}") for i in range(600)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", c("ts").cast("timestamp_ntz")).repartition(3)
    source = f"file://{tmp_path}/in"
    assert stream.write_events(df, source, file_rows=100, batch_files=2) == 2
    files = sorted((tmp_path / "in").glob("part-*"))
    assert len(files) == 6
    assert [f.name for f in sorted(files, key=lambda f: f.stat().st_mtime)] == [f.name for f in files]
    spans = [spark.read.parquet(f"file://{f}").agg({"ts": "min"}).head()[0] for f in files]
    assert spans == sorted(spans)
    twice = stream.read_events(spark, source, 2)
    stream.drain(stream.first_of_each(twice.union(twice), "1 hour"), f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out" / "_state" / "offsets").glob("[0-9]*"))) >= 3
    assert sorted(r["event_id"] for r in spark.read.parquet(f"file://{tmp_path}/out/rows").collect()) == list(range(600))


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["r_name", "c_mktsegment", "revenue"] and df.count() > 0


def test_engine_without_the_corpus_operators():
    """The rest never imports the subpackage."""
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "tamarack"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
