"""Changes to tables as new snapshots: each function returns the table after the statement.

Tables on a data lake are not changed in place; a statement is a plan from the old snapshot
to the new one, and the affected rows are a plan as well (RETURNING).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..session import width


class ConstraintError(ValueError):
    """A statement breaks a constraint; ``code`` is the SQLSTATE."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def with_defaults(rows: DataFrame, table: DataFrame, defaults: Mapping[str, Column] | None = None, generated: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows in the table's columns: missing ones get their default (an explicit null stays),
    generated ones are computed."""
    defaults, generated = dict(defaults or {}), dict(generated or {})
    for f in table.schema.fields:
        if f.name not in rows.columns and f.name not in generated:
            rows = rows.withColumn(f.name, defaults.get(f.name, F.lit(None)))
    for name, value in generated.items():
        rows = rows.withColumn(name, value)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields])


def insert(table: DataFrame, rows: DataFrame, **how) -> DataFrame:
    return table.unionByName(with_defaults(rows, table, **how))


def _parts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by keys into parts whose number follows the size of the sources.

    Small tables are left to adaptive plans, as are sources that don't know their size.
    """
    parts = width(rows)
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), *keys) if parts > 1 else rows


def _order(rows: DataFrame, order: Column | None) -> DataFrame:
    return rows.withColumn("__o", order if order is not None else F.monotonically_increasing_id())


def _free(keys: Sequence[str]) -> Column:
    """Whether a key is null: such rows conflict with none."""
    free = F.lit(False)
    for k in keys:
        free = free | F.col(k).isNull()
    return free


def _alone(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gives each row with a null key a group of its own, so that they don't gather in one task."""
    return rows.withColumn("__alone", F.when(_free(keys), F.monotonically_increasing_id()))


def _last_of_each(rows: DataFrame, keys: Sequence[str], order: Column | None) -> DataFrame:
    rows = _parts(_alone(_order(rows, order), keys), [*keys, "__alone"])
    w = Window.partitionBy(*keys, "__alone").orderBy(F.col("__o").desc())
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__o", "__n", "__alone")


def _first_of_each(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Of each key the first row in ``order``; rows with a null key match nothing and aren't there."""
    rows = _parts(_order(rows, order).filter(~_free(keys)), keys)
    w = Window.partitionBy(*keys).orderBy("__o")
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__o", "__n")


def _by_key(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Column | None, last: bool) -> DataFrame:
    """Old and new rows side by side in one shuffle by key, so neither is computed twice or joined.

    __new tells them apart.  __n numbers the rows of a key: with ``last`` new rows come first,
    the last of them leading; else old rows, then the new ones in order.  __met is __new of the
    row that leads.  Rows with a null key stand alone.
    """
    old = table.withColumn("__o", F.lit(None)).withColumn("__new", F.lit(False))
    both = old.unionByName(_order(rows, order).withColumn("__new", F.lit(True)))
    both = _parts(_alone(both, keys), [*keys, "__alone"])
    side, place = (F.col("__new").desc(), F.col("__o").desc()) if last else (F.col("__new").asc(), F.col("__o").asc())
    w = Window.partitionBy(*keys, "__alone").orderBy(side, place).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__n", F.row_number().over(w)).withColumn("__met", F.first("__new").over(w))


def not_there(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """The rows that INSERT OR IGNORE inserts: of each new key the first row."""
    old = table.select(*[F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    return _by_key(old, with_defaults(rows, table), keys, order, last=False).filter("__new AND __n = 1").select(table.columns)


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """ON CONFLICT DO NOTHING: rows whose key is there, or earlier in the batch, are left out."""
    return table.unionByName(not_there(table, rows, keys, order))


def insert_or_replace(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Rows with the key of a new row go; of new rows with one key the last stays."""
    return _by_key(table, with_defaults(rows, table), keys, order, last=True).filter("NOT __met OR (__new AND __n = 1)").select(table.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], changes: Mapping[str, Column], where: Column | None = None, mark: str | None = None) -> DataFrame:
    """ON CONFLICT (keys) DO UPDATE SET ... [WHERE]: one full join; changes may name old.c and excluded.c.

    ``mark`` names a further column which says of each row whether it was inserted or updated.
    """
    old, new = table.alias("old"), with_defaults(rows, table).alias("excluded")
    on = [F.col(f"old.{k}") == F.col(f"excluded.{k}") for k in keys]
    mark_old, mark_new = old.withColumn("__old", F.lit(1)).alias("old"), new.withColumn("__new", F.lit(1)).alias("excluded")
    joined = mark_old.join(mark_new, on, "full")
    both = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    if where is not None:
        both = both & F.coalesce(where, F.lit(False))
    out = []
    for f in table.schema.fields:
        value = changes.get(f.name, F.col(f"old.{f.name}"))
        out.append(F.when(both, value).when(F.col("__old").isNotNull(), F.col(f"old.{f.name}")).otherwise(F.col(f"excluded.{f.name}")).cast(f.dataType).alias(f.name))
    if mark:
        out.append((both | F.col("__old").isNull()).alias(mark))
    return joined.select(*out)


def update(table: DataFrame, changes: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE: all changes see the old row."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return table.select(*[F.when(hit, changes[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in changes else F.col(f.name) for f in table.schema.fields])


def update_from(table: DataFrame, source: DataFrame, keys: Sequence[str], changes: Mapping[str, Column], order: Column) -> DataFrame:
    """UPDATE ... FROM: of several matching source rows the first in ``order`` counts."""
    first = _first_of_each(source, keys, order).withColumn("__hit", F.lit(True)).alias("source")
    target = table.alias("target")
    joined = target.join(first, [F.col(f"target.{k}") == F.col(f"source.{k}") for k in keys], "left")
    return joined.select(*[F.when(F.col("__hit"), changes[f.name]).otherwise(F.col(f"target.{f.name}")).cast(f.dataType).alias(f.name) if f.name in changes else F.col(f"target.{f.name}").alias(f.name) for f in table.schema.fields])


def delete(table: DataFrame, where: Column) -> DataFrame:
    """DELETE: rows for which the condition is true go; null keeps a row."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def returning(table: DataFrame, where: Column, *columns: Column | str) -> DataFrame:
    return table.filter(F.coalesce(where, F.lit(False))).select(*(columns or ("*",)))


def add_column(table: DataFrame, name: str, kind: str, default: Column | None = None) -> DataFrame:
    return table.withColumn(name, (default if default is not None else F.lit(None)).cast(kind))


def drop_column(table: DataFrame, name: str) -> DataFrame:
    return table.drop(name)


def rename_column(table: DataFrame, old: str, new: str) -> DataFrame:
    return table.withColumnRenamed(old, new)


def next_ids(table: DataFrame, rows: DataFrame, key: str, order: Column, parts: int = 200) -> DataFrame:
    """AUTOINCREMENT: ids after the greatest one, in ``order``.

    No task sees all rows (``numbered``).
    """
    start = table.agg(F.max(key)).head()[0] or 0
    return numbered(rows.withColumn("__o", order), key, F.col("__o").asc(), parts=parts, start=start).drop("__o")


def violations(table: DataFrame, not_null: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), checks: Mapping[str, Column] | None = None, references: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(code, name, rows): the broken constraints of a snapshot and how many rows break them.

    Nulls satisfy CHECK, UNIQUE and FOREIGN KEY.
    """
    found = []
    note = lambda df, code, name: df.agg(F.count("*").alias("rows")).select(F.lit(code).alias("code"), F.lit(name).alias("name"), "rows")
    for c in not_null:
        found.append(note(table.filter(F.col(c).isNull()), "23502", c))
    for keys in unique:
        full = F.lit(True)
        for k in keys:
            full = full & F.col(k).isNotNull()
        found.append(note(table.filter(full).groupBy(*keys).count().filter("count > 1"), "23505", ",".join(keys)))
    for name, check in (checks or {}).items():
        found.append(note(table.filter(~check), "23514", name))
    for column, (parent, key) in (references or {}).items():
        orphans = table.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")
        found.append(note(orphans, "23503", column))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.filter("rows > 0")


def enforce(table: DataFrame, **constraints) -> DataFrame:
    """The table, if it breaks no constraint."""
    first = violations(table, **constraints).orderBy("code").head()
    if first:
        raise ConstraintError(first["code"], f"{first['rows']} rows break the constraint on {first['name']}")
    return table


def cascade_delete(parent: DataFrame, key: str, where: Column, children: Sequence[tuple[DataFrame, str, str]], default: Column | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Deletes parents and what refers to them: each child is (table, column, action), the
    action being cascade, set null, set default (``default``, or null) or restrict."""
    gone = parent.filter(F.coalesce(where, F.lit(False))).select(F.col(key).alias("__gone"))
    out = []
    for child, column, action in children:
        match = F.col(column) == F.col("__gone")
        if action == "cascade":
            out.append(child.join(gone, match, "left_anti"))
        elif action in ("set null", "set default"):
            other = default if action == "set default" and default is not None else F.lit(None)
            value = F.when(F.col("__gone").isNull(), F.col(column)).otherwise(other).cast(child.schema[column].dataType)
            out.append(child.join(gone, match, "left").withColumn(column, value).drop("__gone"))
        elif not child.join(gone, match, "left_semi").isEmpty():
            raise ConstraintError("23503", f"rows still refer to {key}")
        else:
            out.append(child)
    return delete(parent, where), out
