"""Catalog relations over the tables of a session or a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DECLARED = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN", "binary": "BLOB"}


def _declared(kind: str) -> str:
    return f"{_declared(kind[6:-1])}[]" if kind.startswith("array<") else _DECLARED.get(kind, "TEXT")


def sqlite_master(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """type, name, tbl_name, rootpage, sql of the tables."""
    ddl = lambda name, df: f"CREATE TABLE {name} ({', '.join(f'{c} {_declared(k)}' for c, k in df.dtypes)})"
    rows = [("table", n, n, i, ddl(n, df)) for i, (n, df) in enumerate(sorted(tables.items()), 2)]
    return spark.createDataFrame(rows, "type string, name string, tbl_name string, rootpage bigint, sql string")


def information_tables(spark: SparkSession, tables: dict[str, DataFrame], schema: str = "public") -> DataFrame:
    return spark.createDataFrame([(schema, n, "BASE TABLE") for n in sorted(tables)], "table_schema string, table_name string, table_type string")


def information_columns(spark: SparkSession, tables: dict[str, DataFrame], schema: str = "public") -> DataFrame:
    """table_schema, table_name, column_name, ordinal_position, data_type, is_nullable."""
    rows = [(schema, n, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO") for n, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position bigint, data_type string, is_nullable string")


def pg_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame([("public", n, "owner") for n in sorted(tables)], "schemaname string, tablename string, tableowner string")


def pg_relations(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """pg_namespace, pg_class, pg_attribute and pg_type; a table's oid is its place among the names."""
    types = sorted({f.dataType.simpleString() for df in tables.values() for f in df.schema.fields})
    names = sorted(tables)
    attributes = [(_OID + i, f.name, 1 + types.index(f.dataType.simpleString()), n, not f.nullable, False) for i, t in enumerate(names) for n, f in enumerate(tables[t].schema.fields, 1)]
    return {
        "pg_namespace": spark.createDataFrame([(11, "pg_catalog"), (2200, "public")], "oid bigint, nspname string"),
        "pg_class": spark.createDataFrame([(_OID + i, t, 2200, "r", len(tables[t].columns)) for i, t in enumerate(names)], "oid bigint, relname string, relnamespace bigint, relkind string, relnatts bigint"),
        "pg_attribute": spark.createDataFrame(attributes, "attrelid bigint, attname string, atttypid bigint, attnum bigint, attnotnull boolean, attisdropped boolean"),
        "pg_type": spark.createDataFrame([(i, t, 11) for i, t in enumerate(types, 1)], "oid bigint, typname string, typnamespace bigint"),
    }


#: The first oid of a user's table.
_OID = 16384


def constraints(spark: SparkSession, rules: dict[str, dict]) -> dict[str, DataFrame]:
    """information_schema's table_constraints, key_column_usage and referential_constraints.

    ``rules`` gives of each table its primary key, unique keys, checks and references.
    """
    named, used, refers = [], [], []
    for t, r in sorted(rules.items()):
        keys = [("PRIMARY KEY", f"{t}_pkey", r["primary"])] if r["primary"] else []
        keys += [("UNIQUE", f"{t}_{'_'.join(k)}_key", k) for k in r["unique"] if k != r["primary"]]
        keys += [("FOREIGN KEY", f"{t}_{c}_fkey", [c]) for c in r["references"]]
        named += [("public", n, t, kind) for kind, n, _ in keys] + [("public", f"{t}_check{i}", t, "CHECK") for i, _ in enumerate(r["checks"], 1)]
        used += [("public", n, t, c, i) for _, n, columns in keys for i, c in enumerate(columns, 1)]
        refers += [(f"{t}_{c}_fkey", f"{parent}_pkey", "NO ACTION", action.upper()) for c, (parent, _, action) in r["references"].items()]
    return {
        "table_constraints": spark.createDataFrame(named, "constraint_schema string, constraint_name string, table_name string, constraint_type string"),
        "key_column_usage": spark.createDataFrame(used, "constraint_schema string, constraint_name string, table_name string, column_name string, ordinal_position bigint"),
        "referential_constraints": spark.createDataFrame(refers, "constraint_name string, unique_constraint_name string, update_rule string, delete_rule string"),
    }


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Makes the catalog relations views of the session."""
    sqlite_master(spark, tables).createOrReplaceTempView("sqlite_master")
    information_tables(spark, tables).createOrReplaceTempView("information_schema_tables")
    information_columns(spark, tables).createOrReplaceTempView("information_schema_columns")
    sqlite_master(spark, tables).createOrReplaceTempView("sqlite_schema")
    pg_tables(spark, tables).createOrReplaceTempView("pg_tables")
    for name, df in pg_relations(spark, tables).items():
        df.createOrReplaceTempView(name)
