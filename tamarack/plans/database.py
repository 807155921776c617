"""A database of snapshots that runs statements of the dialect.

Queries become Spark plans.  Statements that change a table make its next snapshot, check
the constraints on it, write it to the database's folder and move the table's name to it,
so a failed statement changes nothing.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json
from ..operators.recursive import shared_folder
from ..sources import catalog
from ..sources.files import split_statements
from . import dml
from .dialect import DialectError, Group, _commas, _names, grouped, kind_of, plain, quoted, text, to_spark, tokens


@dataclass
class Table:
    frame: DataFrame
    defaults: dict[str, str] = field(default_factory=dict)
    generated: dict[str, str] = field(default_factory=dict)
    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    references: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    key: str | None = None
    primary: list[str] = field(default_factory=list)


@dataclass
class Done:
    """What a statement that returns no rows did."""

    tag: str
    rows: int = 0


def _word(t, *words: str) -> bool:
    return isinstance(t, str) and t.lower() in words


def _resolved(g: list, columns: set[str], table: str) -> list:
    """Names of the stored row's columns, bare or after the table's name, as columns of ``old``."""
    out = Group(g.opens, g.closes) if isinstance(g, Group) else []
    for i, t in enumerate(g):
        after = g[i + 1] if i + 1 < len(g) else None
        if isinstance(t, Group):
            out.append(_resolved(t, columns, table))
        elif i and g[i - 1] == ".":
            out.append(t)
        elif after == "." and plain(t).lower() == table:
            out.append("old")
        elif t[:1] != "'" and plain(t).lower() in columns and after != "." and not (isinstance(after, Group) and after.opens == "("):
            out += ["old", ".", t]
        else:
            out.append(t)
    return out


def _spaced(sql: str) -> list[str]:
    """Text of Spark SQL in pieces: literals, quoted and plain names, and what is between them."""
    return re.findall(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`|[A-Za-z_][A-Za-z0-9_]*|[^'`A-Za-z_]+|['`]", sql)


def _find(g: list, *words: str) -> int:
    """Place of the first of these words outside brackets, or the length."""
    return next((i for i, t in enumerate(g) if _word(t, *words)), len(g))


class Database:
    #: The database whose tables are the session's views now.
    _entered: Database | None = None

    def __init__(self, spark: SparkSession, name: str = "main"):
        self.spark, self.name = spark, name
        self.tables: dict[str, Table] = {}
        self.marks: list[tuple[str, dict[str, Table]]] = []
        json.register(spark)
        self.folder = f"{shared_folder(spark)}/databases/{name}-{uuid.uuid4().hex}"

    def _enter(self) -> None:
        """Names mean this database's tables, where another one of the session was used before."""
        other, Database._entered = Database._entered, self
        if other is not None and other is not self:
            for name in other.tables:
                self.spark.catalog.dropTempView(name)
            for name, table in self.tables.items():
                table.frame.createOrReplaceTempView(name)

    def attach(self, name: str, frame: DataFrame) -> None:
        """Makes a frame a table of the database."""
        self._enter()
        self.tables[name.lower()] = Table(frame)
        frame.createOrReplaceTempView(name)

    def run(self, script: str) -> list[DataFrame | Done]:
        return [self.execute(s) for s in split_statements(script)]

    def execute(self, sql: str, *args) -> DataFrame | Done:
        self._enter()
        g = grouped(self._unqualified(_names(tokens(sql))))
        while g and g[-1] == ";":
            g.pop()
        if not g:
            raise DialectError("an empty statement")
        first = g[0].lower() if isinstance(g[0], str) else "select"
        if first == "with" and (at := _find(g, "insert", "update", "delete")) < len(g):
            return self._with(g[1:at], g[at:])
        if first in ("create", "drop", "alter", "insert", "update", "delete"):
            return getattr(self, f"_{first}")(g)
        if any(isinstance(t, str) and t.lower().startswith(("sqlite_", "pg_", "information_schema")) for t in tokens(sql)):
            catalog.register(self.spark, {n: t.frame for n, t in self.tables.items()})
            for relation, df in catalog.constraints(self.spark, {n: vars(t) for n, t in self.tables.items()}).items():
                df.createOrReplaceTempView(f"information_schema_{relation}")
        if first in ("begin", "start", "commit", "end", "rollback", "savepoint", "release"):
            return self._transaction(first, [t for t in g[1:] if isinstance(t, str)])
        if first == "pragma" and (found := self._pragma(g[1:])) is not None:
            return found
        if first in ("pragma", "analyze", "set", "listen", "unlisten", "notify"):
            return Done(first.upper())
        if first == "explain":
            return self.spark.sql("EXPLAIN FORMATTED " + text(g[1:]))
        return self.spark.sql(text(g), args=list(args)) if args else self.spark.sql(text(g))

    def _unqualified(self, flat: list[str]) -> list[str]:
        """Names without the schema they are in; those of information_schema are views with its name before theirs."""
        out: list[str] = []
        i = 0
        while i < len(flat):
            schema = plain(flat[i]).lower() if flat[i][0] != "'" else ""
            begins = i + 2 < len(flat) and flat[i + 1] == "." and not (out and out[-1] == ".") and schema not in self.tables
            if begins and schema in ("main", "public", "pg_catalog"):
                i += 2
            elif begins and schema == "information_schema":
                out.append(f"information_schema_{plain(flat[i + 2]).lower()}")
                i += 3
                continue
            out.append(flat[i])
            i += 1
        return out

    def _with(self, parts: list, statement: list) -> DataFrame | Done:
        """WITH before INSERT, UPDATE or DELETE: its tables are views for that statement."""
        recursive = "RECURSIVE " if _word(parts[0], "recursive") else ""
        made = []
        try:
            for p in _commas(parts[1:] if recursive else parts):
                self.spark.sql(f"CREATE OR REPLACE TEMP VIEW {quoted(p[0])} AS WITH {recursive}{text(p)} SELECT * FROM {quoted(p[0])}")
                made.append(plain(p[0]))
            return getattr(self, f"_{statement[0].lower()}")(statement)
        finally:
            for name in made:
                self.spark.catalog.dropTempView(name)
                if name.lower() in self.tables:
                    self.tables[name.lower()].frame.createOrReplaceTempView(name)

    def _pragma(self, g: list) -> DataFrame | None:
        """The relations of PRAGMA: table_info, table_list, database_list, index_list, foreign_key_list."""
        what = plain(g[0]).lower()
        if what == "database_list":
            return self.spark.createDataFrame([(0, self.name, self.folder)], "seq int, name string, file string")
        if what == "table_list":
            rows = [("main", n, "table", len(t.frame.columns)) for n, t in sorted(self.tables.items())]
            return self.spark.createDataFrame(rows, "schema string, name string, type string, ncol int")
        if what not in ("table_info", "index_list", "foreign_key_list"):
            return None
        t = self._table(g[1][0] if isinstance(g[1], Group) else g[2])
        if what == "table_info":
            rows = [(i, c, catalog._declared(kind), int(c in t.not_null and c not in t.primary), t.defaults.get(c), t.primary.index(c) + 1 if c in t.primary else 0) for i, (c, kind) in enumerate(t.frame.dtypes)]
            return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")
        if what == "index_list":
            rows = [(i, f"unique_{'_'.join(k)}", 1, "pk" if k == t.primary else "u") for i, k in enumerate(t.unique)]
            return self.spark.createDataFrame(rows, "seq int, name string, unique int, origin string")
        rows = [(i, 0, parent, c, key, "NO ACTION", action.upper()) for i, (c, (parent, key, action)) in enumerate(t.references.items())]
        return self.spark.createDataFrame(rows, "id int, seq int, table string, from string, to string, on_update string, on_delete string")

    # Transactions: a table is a name for a snapshot, so a mark is a copy of the names
    def _copy(self) -> dict[str, Table]:
        fresh = lambda x: x.copy() if isinstance(x, (dict, list)) else x
        return {n: replace(t, **{f.name: fresh(getattr(t, f.name)) for f in fields(t)}) for n, t in self.tables.items()}

    def _restore(self, tables: dict[str, Table]) -> None:
        for name in self.tables.keys() - tables.keys():
            self.spark.catalog.dropTempView(name)
        kept, self.tables = self.tables, tables
        self.tables = self._copy()
        for name, table in self.tables.items():
            if name not in kept or kept[name].frame is not table.frame:
                table.frame.createOrReplaceTempView(name)

    def _transaction(self, first: str, rest: list[str]) -> Done:
        """BEGIN, COMMIT, ROLLBACK [TO], SAVEPOINT and RELEASE, for tables; the innermost savepoint of a name counts."""
        words = [t.lower() for t in rest if t.lower() not in ("transaction", "work", "savepoint", "deferred", "immediate", "exclusive")]
        to = words[:1] == ["to"]
        if first in ("begin", "start"):
            if self.marks:
                raise DialectError("a transaction is open")
            self.marks.append(("", self._copy()))
        elif first == "savepoint":
            self.marks.append((words[0], self._copy()))
        elif first == "release" or to:
            name = words[1] if to else words[0]
            at = max((i for i, (n, _) in enumerate(self.marks) if n == name), default=None)
            if at is None:
                raise DialectError(f"no such savepoint: {name}")
            if to:
                self._restore(self.marks[at][1])
            del self.marks[at + to :]
        else:
            if not self.marks:
                raise DialectError(f"no transaction to {first}")
            if first == "rollback":
                self._restore(self.marks[0][1])
            self.marks.clear()
        return Done(first.upper())

    # Snapshots
    def _table(self, name: str) -> Table:
        try:
            return self.tables[plain(name).lower()]
        except KeyError:
            raise DialectError(f"no such table: {plain(name)}") from None

    def _move(self, name: str, table: Table, frame: DataFrame, check: bool = True) -> DataFrame:
        """Checks the new snapshot, writes it and gives it the table's name."""
        if check and (table.not_null or table.unique or table.checks or table.references):
            parents = {c: (self._table(t).frame, k) for c, (t, k, _) in table.references.items()}
            dml.enforce(frame, not_null=table.not_null, unique=table.unique, checks={k: F.expr(v) for k, v in table.checks.items()}, references=parents)
        path = f"{self.folder}/{plain(name).lower()}/{uuid.uuid4().hex}"
        frame.write.parquet(path)
        table.frame = self.spark.read.schema(frame.schema).parquet(path)
        self.tables[plain(name).lower()] = table
        table.frame.createOrReplaceTempView(plain(name))
        return table.frame

    # CREATE, DROP, ALTER
    def _create(self, g: list) -> Done:
        i = next((k for k, t in enumerate(g) if _word(t, "table", "view", "index")), len(g))
        what = g[i].lower() if i < len(g) else ""
        i += 1
        guard = i < len(g) and _word(g[i], "if")
        i += 3 if guard else 0
        name = g[i]
        if what == "view":
            body = g[_find(g, "as") + 1 :]
            self.spark.sql(f"CREATE OR REPLACE TEMP VIEW {quoted(name)} AS {text(body)}")
            return Done("CREATE VIEW")
        if what == "index":
            if any(_word(t, "unique") for t in g[:i]):
                table = self._table(g[i + 2])
                names = [plain(p[0]) for p in _commas(g[i + 3]) if len(p) == 1 or _word(p[1], "asc", "desc")]
                table.unique.append(names)
                dml.enforce(table.frame, unique=[names])
            return Done("CREATE INDEX")
        if plain(name).lower() in self.tables:
            if guard:
                return Done("CREATE TABLE")
            raise DialectError(f"table {plain(name)} already exists")
        table = Table(None)
        columns: list[str] = []
        for p in _commas(g[i + 1]):
            self._column(table, p, columns)
        self._move(name, table, self.spark.createDataFrame([], ", ".join(columns)), check=False)
        return Done("CREATE TABLE")

    def _column(self, table: Table, p: list, columns: list[str]) -> None:
        """A column definition, or a constraint of the table."""
        if _word(p[0], "constraint"):
            p = p[2:]
        if _word(p[0], "primary", "unique"):
            names = [plain(x[0]) for x in _commas(next(t for t in p if isinstance(t, Group)))]
            table.unique.append(names)
            if _word(p[0], "primary"):
                table.not_null += names
                table.primary = names
            return
        if _word(p[0], "check"):
            table.checks[f"check {len(table.checks) + 1}"] = text(p[1])
            return
        if _word(p[0], "foreign"):
            self._reference(table, plain(p[2][0]), p[_find(p, "references") :])
            return
        name, i, kind = plain(p[0]), 1, []
        while i < len(p) and not _word(p[i], "not", "null", "primary", "unique", "check", "default", "references", "generated", "constraint", "as"):
            kind.append("[]" if isinstance(p[i], Group) and p[i].opens == "[" else "" if isinstance(p[i], Group) else p[i])
            i += 1
        columns.append(f"`{name}` {kind_of(' '.join(kind).replace(' []', '[]'))}")
        while i < len(p):
            if _word(p[i], "not"):
                table.not_null.append(name)
                i += 2
            elif _word(p[i], "primary"):
                table.unique.append([name])
                table.not_null.append(name)
                table.primary = [name]
                table.key = name if "BIGINT" in columns[-1] else None
                i += 2
            elif _word(p[i], "unique"):
                table.unique.append([name])
                i += 1
            elif _word(p[i], "check"):
                table.checks[f"check {len(table.checks) + 1}"] = text(p[i + 1])
                i += 2
            elif _word(p[i], "default"):
                end = i + 1 + _find(p[i + 1 :], "not", "null", "primary", "unique", "check", "references", "constraint") if not _word(p[i + 1], "null") else i + 2
                table.defaults[name] = text(p[i + 1 : end])
                i = end
            elif _word(p[i], "generated", "as"):
                at = next(k for k in range(i, len(p)) if isinstance(p[k], Group))
                table.generated[name] = text(p[at])
                i = at + 1
            elif _word(p[i], "references"):
                self._reference(table, name, p[i:])
                return
            else:
                i += 1

    def _reference(self, table: Table, column: str, p: list) -> None:
        key = plain(p[2][0]) if len(p) > 2 and isinstance(p[2], Group) else self._table(p[1]).key
        words = [t.lower() for t in p if isinstance(t, str)]
        action = "restrict"
        if "delete" in words:
            after = words[words.index("delete") + 1 :]
            action = "cascade" if after[:1] == ["cascade"] else " ".join(after[:2]) if after[:2] in (["set", "null"], ["set", "default"]) else "restrict"
        table.references[column] = (plain(p[1]).lower(), key, action)

    def _drop(self, g: list) -> Done:
        guard = _word(g[2], "if")
        for name in [plain(t) for t in g[4 if guard else 2 :] if t != ","]:
            if _word(g[1], "table") and not guard:
                self._table(name)
            self.tables.pop(name.lower(), None)
            if not _word(g[1], "index"):
                self.spark.catalog.dropTempView(name)
        return Done(f"DROP {g[1].upper()}")

    def _alter(self, g: list) -> Done:
        name, table, rest = g[2], self._table(g[2]), g[3:]
        skip = 2 if len(rest) > 1 and _word(rest[1], "column") else 1
        if _word(rest[0], "add"):
            at = skip + 3 if _word(rest[skip], "if") else skip
            columns: list[str] = []
            if plain(rest[at]).lower() in map(str.lower, table.frame.columns):
                if at > skip:
                    return Done("ALTER TABLE")
                raise DialectError(f"column {plain(rest[at])} already exists")
            self._column(table, rest[at:], columns)
            column, kind = columns[0].split(" ", 1)
            default = table.defaults.get(column.strip("`"))
            self._move(name, table, dml.add_column(table.frame, column.strip("`"), kind, F.expr(default) if default else None))
        elif _word(rest[0], "drop"):
            self._drop_column(name, table, plain(rest[skip]))
        elif _word(rest[1], "to"):
            self.tables.pop(plain(name).lower())
            self.spark.catalog.dropTempView(plain(name))
            self.tables[plain(rest[2]).lower()] = table
            table.frame.createOrReplaceTempView(plain(rest[2]))
        else:
            self._rename_column(name, table, plain(rest[skip]), plain(rest[skip + 2]))
        return Done("ALTER TABLE")

    def _drop_column(self, name: str, table: Table, column: str) -> None:
        """A column goes with its own default and NOT NULL; what else names it forbids that."""
        low = column.lower()
        held = [k for keys in table.unique for k in keys] + list(table.references) + list(table.generated) + ([table.key] if table.key else [])
        named = any(low in {plain(t).lower() for t in tokens(v)} for v in (*table.checks.values(), *table.generated.values()))
        if named or low in map(str.lower, held):
            raise DialectError(f"a constraint names the column {column}")
        table.defaults = {k: v for k, v in table.defaults.items() if k.lower() != low}
        table.not_null = [c for c in table.not_null if c.lower() != low]
        self._move(name, table, dml.drop_column(table.frame, column))

    def _rename_column(self, name: str, table: Table, old: str, new: str) -> None:
        """The constraints, here and of the tables which refer to the column, follow its name."""
        if old.lower() not in map(str.lower, table.frame.columns):
            raise DialectError(f"no such column: {old}")
        low = old.lower()
        other = lambda c: new if c is not None and c.lower() == low else c
        value = lambda v: "".join(f"`{new}`" if t[:1] != "'" and plain(t.strip("`")).lower() == low else t for t in _spaced(v))
        table.defaults = {other(k): v for k, v in table.defaults.items()}
        table.generated = {other(k): value(v) for k, v in table.generated.items()}
        table.checks = {k: value(v) for k, v in table.checks.items()}
        table.not_null, table.key = list(map(other, table.not_null)), other(table.key)
        table.unique = [list(map(other, keys)) for keys in table.unique]
        table.primary = list(map(other, table.primary))
        table.references = {other(k): v for k, v in table.references.items()}
        for t in self.tables.values():
            t.references = {k: (target, other(key) if target == plain(name).lower() else key, action) for k, (target, key, action) in t.references.items()}
        self._move(name, table, dml.rename_column(table.frame, old, new))

    # INSERT, UPDATE, DELETE
    def _insert(self, g: list) -> DataFrame | Done:
        rule = g[2].lower() if _word(g[1], "or") else ""
        i = _find(g, "into") + 1
        name, table = g[i], self._table(g[i])
        i += 1
        names = table.frame.columns
        if i < len(g) and isinstance(g[i], Group):
            names = [plain(p[0]) for p in _commas(g[i])]
            i += 1
        conflict, back = i + _find(g[i:], "on"), i + _find(g[i:], "returning")
        while conflict < len(g) and not (conflict + 1 < len(g) and _word(g[conflict + 1], "conflict")):
            conflict = conflict + 1 + _find(g[conflict + 1 :], "on")
        end = min(conflict, back)
        if _word(g[i], "default"):
            rows = self.spark.range(1).select(F.lit(1).alias("__none")).drop("__none")
        else:
            body = text(g[i:end])
            rows = self.spark.sql(f"SELECT * FROM ({body})" if not _word(g[i], "values") else body)
            if len(rows.columns) != len(names):
                raise DialectError(f"{len(rows.columns)} values for {len(names)} columns")
            rows = rows.toDF(*names)
        defaults = {k: F.expr(v) for k, v in table.defaults.items()}
        if table.key and table.key not in rows.columns:
            rows = dml.next_ids(table.frame, rows, table.key, F.monotonically_increasing_id(), parts=8)
        generated = {k: F.expr(v) for k, v in table.generated.items()}
        rows = dml.with_defaults(rows, table.frame, defaults, generated)
        rows = self.spark.read.schema(rows.schema).parquet(self._kept(rows))
        keys = table.unique[0] if table.unique else []
        done = rows
        if conflict < len(g):
            clause = g[conflict + 2 : back]
            if clause and isinstance(clause[0], Group):
                keys = [plain(p[0]) for p in _commas(clause[0])]
            if any(_word(t, "nothing") for t in clause):
                rule = "ignore"
            else:
                at = _find(clause, "set") + 1
                end = at + _find(clause[at:], "where")
                columns = {c.lower() for c in table.frame.columns}
                of = lambda part: _resolved(part, columns, plain(name).lower())
                changes = {plain(p[0]): F.expr(text(of(p[2:]))) for p in _commas(clause[at:end])}
                where = F.expr(text(of(clause[end + 1 :]))) if end < len(clause) else None
                new = dml.upsert(table.frame, rows, keys, changes, where, mark="__did")
                new = self.spark.read.schema(new.schema).parquet(self._kept(new))
                done, new, rule = new.filter("__did").drop("__did"), new.drop("__did"), "upsert"
        if rule == "replace":
            done = dml._last_of_each(rows, keys, None) if keys else rows
            done = self.spark.read.schema(rows.schema).parquet(self._kept(done.select(rows.columns)))
            new = dml.insert_or_replace(table.frame, done, keys) if keys else table.frame.unionByName(done)
        elif rule == "ignore":
            done = dml.not_there(table.frame, rows, keys) if keys else rows
            done = self.spark.read.schema(rows.schema).parquet(self._kept(done))
            new = table.frame.unionByName(done)
        elif rule != "upsert":
            new = table.frame.unionByName(rows)
        count = done.count()
        self._move(name, table, new)
        return self._returned(done, g[back + 1 :]) if back < len(g) else Done("INSERT", count)

    def _kept(self, rows: DataFrame) -> str:
        path = f"{self.folder}/rows/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _returned(self, rows: DataFrame, columns: list) -> DataFrame:
        return rows.selectExpr(*[text(p) for p in _commas(columns)])

    def _changes(self, g: list) -> dict[str, Column]:
        return {plain(p[0]): F.expr(text(p[2:])) for p in _commas(g)}

    def _update(self, g: list) -> DataFrame | Done:
        name, table = g[1], self._table(g[1])
        back, where = _find(g, "returning"), min(_find(g, "where"), _find(g, "returning"))
        source = min(_find(g, "from"), where)
        changes = self._changes(g[_find(g, "set") + 1 : source])
        condition = text(g[where + 1 : back]) if where < back else "true"
        if source < where:
            # The first match of each row counts, in the order of the source.
            numbered = table.frame.withColumn("__row", F.monotonically_increasing_id())
            numbered = self.spark.read.schema(numbered.schema).parquet(self._kept(numbered))
            numbered.createOrReplaceTempView(plain(name))
            sets = ", ".join(f"{text(p[2:])} AS `__{plain(p[0])}`" for p in _commas(g[_find(g, 'set') + 1 : source]))
            hits = self.spark.sql(f"SELECT {quoted(name)}.__row AS __row, {sets} FROM {quoted(name)}, {text(g[source + 1 : where])} WHERE {condition}").dropDuplicates(["__row"])
            joined = numbered.join(hits.withColumn("__hit", F.lit(True)), "__row", "left")
            new = joined.select(*[F.when(F.col("__hit"), F.col(f"__{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in changes else F.col(f.name) for f in table.frame.schema.fields])
            count = hits.count()
        else:
            count = table.frame.filter(condition).count()
            new = dml.update(table.frame, changes, F.expr(condition))
        for k, v in table.generated.items():
            new = new.withColumn(k, F.expr(v))
        affected = None
        if back < len(g):
            affected = self._returned(dml.update(table.frame.filter(condition), changes), g[back + 1 :])
            affected = self.spark.read.schema(affected.schema).parquet(self._kept(affected))
        self._move(name, table, new)
        return affected if affected is not None else Done("UPDATE", count)

    def _delete(self, g: list) -> DataFrame | Done:
        name, table = g[2], self._table(g[2])
        back, where = _find(g, "returning"), min(_find(g, "where"), _find(g, "returning"))
        condition = text(g[where + 1 : back]) if where < back else "true"
        gone = table.frame.filter(condition)
        gone = self.spark.read.schema(gone.schema).parquet(self._kept(gone))
        kept = self.spark.sql(f"SELECT * FROM {quoted(name)} WHERE NOT coalesce({condition}, false)")
        self._cascade(plain(name).lower(), gone)
        self._move(name, table, kept, check=False)
        return self._returned(gone, g[back + 1 :]) if back < len(g) else Done("DELETE", gone.count())

    def _cascade(self, parent: str, gone: DataFrame) -> None:
        """Rows which refer to deleted ones follow them, lose their reference, or forbid it."""
        for child, table in list(self.tables.items()):
            for column, (target, key, action) in table.references.items():
                if target != parent:
                    continue
                hit = table.frame.join(gone.select(F.col(key).alias("__gone")), F.col(column) == F.col("__gone"), "left_semi")
                if hit.isEmpty():
                    continue
                if action == "restrict":
                    raise dml.ConstraintError("23503", f"rows of {child} still refer to {parent}")
                hit = self.spark.read.schema(hit.schema).parquet(self._kept(hit))
                default = F.expr(table.defaults[column]) if column in table.defaults else None
                _, (kept,) = dml.cascade_delete(gone, key, F.lit(True), [(table.frame, column, action)], default)
                if action == "cascade":
                    self._cascade(child, hit)
                self._move(child, table, kept, check=False)


__all__ = ["Database", "Done", "Table", "to_spark"]
